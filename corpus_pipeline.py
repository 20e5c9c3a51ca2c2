"""A training corpus from `documents`: language, near duplicates, contamination, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of documents; the last returns the encoding of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import decontam, langid, pieces, simhash
from boxloom.llm.common import stored, table, work_path
from boxloom.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language. Texts that are null or have no letter go, and no others if there was nothing to learn from."""
    found = langid.identify(docs, langid.train(docs) or langid.blank(), keep=True, names=("__lang", "__score"))
    return found.where(F.col("__lang") != "und").select(*docs.columns)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number of its own for every row, written so that all readers see the same one, and the name of that column."""
    name = "__at"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component: one with the smallest doc_id, with a null doc_id only if none has an id.

    Rows are told apart by a number, not by doc_id, so ids may be null or repeated.
    """
    rows, at = _numbered(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(at).alias("at"))
    found = simhash.near_duplicates(rows.select(key.alias("key"), "text"), key="key")
    chosen = found.where(F.col("key.at") == F.col("component_id.at")).select(F.col("key.at").alias(at))
    return rows.join(chosen, at, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than a twentieth of the words lie in benchmark windows, decided row by row."""
    rows, at = _numbered(docs)
    found = decontam.verdicts(decontam.contamination(rows, table(spark, sf_dir, "benchmark"), key=at), key=at)
    return rows.join(found.where("contaminated").select(at), at, "left_anti").select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and checksum of the SentencePiece ids of every document, and whether they decode to the text."""
    return pieces.round_trip(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("language ID", identify_language), ("SimHash near-dedup", drop_near_duplicates),
          ("benchmark decontamination", drop_contaminated), ("SentencePiece encoding", encode_pieces)]

# SQL has neither the kernel model nor the fingerprints nor the merges; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = work_path(spark, f"stage{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
