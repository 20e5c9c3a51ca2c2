"""Queries of the operators over the driver tables, and the SQL that checks them where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import ann, decontam, dialogue, html, katz, langid, lexical, pieces, quality, sharding, simhash, tokens, warc
from boxloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return wrap


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_permutation_index")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 50 == 0))


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op3_template_text")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_texts(table(spark, folder, "pages"))


@query("op4_minimax_shards")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.byte_shards(table(spark, folder, "documents"))


WARC_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages) p"""


@query("op5_warc_bundles", WARC_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_digest(table(spark, folder, "pages"))


@query("op6_katz")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = katz.held_out(F.col("doc_id"))
    return katz.katz_scores(docs, held).withColumn("held_out", held)


@query("op7_string_kernel")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op8_simhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op9_token_files")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_table(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op10_fm_index")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.verdicts(decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query("op11_dialogue_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.damaged_repairs(table(spark, folder, "conversations"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPELT = f"translate(unnest(regexp_extract_all(text, '{_TERM}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
RANKED_SQL = f"""
WITH words AS (SELECT doc_id, row_number() OVER () AS d, text FROM documents),
terms AS (SELECT d, doc_id, {_SPELT} AS term FROM words),
tf AS (SELECT d, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT d, count(*) AS n FROM terms GROUP BY d),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
items AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, {_SPELT} AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark))),
scores AS (SELECT i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (d), whole GROUP BY ALL),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50"""


@query("op12_blocked_ranking", RANKED_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_neighbour_quality")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = quality.scored(docs, quality.train(docs, table(spark, folder, "labels")))
    return found.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
