"""Files of page artifacts, master tables, jobs, logs, traces and collections."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.functions import answer_json as aj
from boxloom.operators import jobs, merge, series
from boxloom.operators.ranking import position_block, split_row_number
from boxloom.session import materialise, stored

PAGE_NAME = r"page_([0-9]+)\.json$"
CURSOR_SCHEMA = "file string, bytes bigint, lines bigint"
TRACE_SCHEMA = ("phase string, scope string, model string, elapsedSeconds double, generatedTokens bigint, completionTokens bigint, "
                "reasoningChunks bigint, outputChunks bigint, attempt int, maxAttempts int, failed boolean, error string, output string")


def artifact_pages(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, page) of every artifact file, empty ones too. The layout is <book>/<phase>/page_NNNN.json."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.where(F.rlike("path", F.lit(PAGE_NAME))).select(
        F.element_at(F.split("path", "/"), -3).alias("book_id"), F.regexp_extract("path", PAGE_NAME, 1).cast("bigint").alias("page"))


def _fault(text: Column) -> Column:
    """Why the text of an artifact file cannot be read; null if it can."""
    v = F.try_parse_json(text)
    return (F.when(v.isNull(), "invalid_json").when(~aj.is_array(v), "not_an_array")
            .when(~F.forall(aj.values(v), aj.is_object), "item_not_an_object"))


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of per-page JSON arrays with book and page from the file name and their place in the file.

    Files that are no array of objects give no rows; `broken_artifacts` names them.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("__file"))
    rows = files.where(_fault(F.col("value")).isNull()).select("__file", F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("pos", "item")).select("__file", "pos", "item.*").drop("page")
    return rows.select(F.element_at(F.split("__file", "/"), -3).alias("book_id"),
                       F.regexp_extract("__file", PAGE_NAME, 1).cast("bigint").alias("page"), *[c for c in rows.columns if c != "__file"])


def broken_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Files whose root is not an array of objects: (book_id, page, code)."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("file"))
    return files.select(F.element_at(F.split("file", "/"), -3).alias("book_id"), F.regexp_extract("file", PAGE_NAME, 1).cast("bigint").alias("page"),
                        _fault(F.col("value")).alias("code")).where(F.col("code").isNotNull())


def write_master(rows: DataFrame, path: str) -> None:
    """Replace the books in `rows` under `path`; other books stay. Rows are sorted inside a file."""
    (rows.repartitionByRange("book_id", "page").sortWithinPartitions("book_id", "page", "boxno").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("book_id").json(path))


def read_master(spark: SparkSession, path: str, schema: str, allow_missing: bool = False) -> DataFrame:
    """The master table; a missing path is an empty table only when that is allowed."""
    try:
        return spark.read.schema(f"{schema}, book_id string").json(path)
    except AnalysisException as error:
        if not allow_missing or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, book_id string")


def check_master(rows: DataFrame) -> DataFrame:
    """Records that break the key or region rules, and repeated keys."""
    repeated = merge.duplicate_keys(rows, list(merge.KEY)).select(*merge.KEY, F.lit("duplicate_key").alias("code"))
    return merge.invalid_records(rows).unionByName(repeated)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Open-schema job documents as VARIANT; files that are not an object are left out."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    docs = files.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))
    return docs.where(aj.is_object(F.col("doc"))).select(
        "file", *[F.try_variant_get("doc", f"$.{n}", "string").alias(n) for n in ("category", "jobId", "status", "phase", "createdAt")], "doc")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files to lines: (job_id, seq, line). The job is the name of the folder of the file.

    A file of any size is read in ranges of bytes; a line has its place in the file, counted from the
    lines of the ranges before it. Written once, as the ranges are numbered and then read again.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line"))
    held = stored(lines)
    firsts = held.groupBy("file", "at").agg(F.min("mid").alias("lo"), F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("file").orderBy("at")  # a row for every range of a file
    before = firsts.select(F.col("file").alias("f"), F.col("at").alias("a"), (F.sum("n").over(of) - F.col("n") - F.col("lo")).alias("shift"))
    numbered = held.join(before, (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")))
    return jobs.kept_lines(numbered.select(F.element_at(F.split("file", "/"), -2).alias("job_id"), (F.col("mid") + F.col("shift")).alias("seq"), "line"))


def read_log_tail(spark: SparkSession, path: str, cursor: DataFrame | None = None, closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines of growing log files that a cursor has not seen, and the cursor after them.

    Lines: job_id (folder of the file), file, seq (place in the file), line. The cursor holds file, bytes
    and lines; without one everything is new. The last line of a file may still be growing, so it is only
    given when another line follows it, or when the logs are `closed`. A file that got shorter starts
    again; files that kept their size are not read again. One poll is one consistent reading: it is
    written to the shared folder, as files may grow between two readers of it.
    """
    if cursor is None:
        cursor = spark.createDataFrame([], CURSOR_SCHEMA)
    meta = {"file": "file_path", "bytes": "file_size", "at": "file_block_start"}
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        *[F.col(f"_metadata.{m}").alias(n) for n, m in meta.items()], F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line"))
    seen = cursor.select("file", F.col("bytes").alias("was"), F.col("lines").alias("had"))
    fresh = lines.join(seen, "file", "left")
    if not closed:
        fresh = fresh.where(~F.col("bytes").eqNullSafe(F.col("was")))
    had = F.when(F.col("bytes") >= F.col("was"), F.col("had")).otherwise(0)
    numbered = materialise(split_row_number(fresh, ["file"], [F.col("at"), F.col("mid")], F.struct("at", position_block(F.col("mid"))), "seq")
                           .select("file", "bytes", "seq", had.cast("bigint").alias("had"), "line"))
    ends = numbered.groupBy("file").agg(F.max("bytes").alias("bytes"), (F.max("seq") + (1 if closed else 0)).alias("lines"))
    given = numbered.join(ends.select("file", "lines"), "file").where("seq >= had AND seq < lines").select(
        F.element_at(F.split("file", "/"), -2).alias("job_id"), "file", "seq", "line")
    return given, ends.unionByName(cursor.join(ends, "file", "left_anti").select("file", "bytes", "lines"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of calls; a file holds one JSON object, or an array of the traces of a run."""
    return spark.read.schema(TRACE_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def write_collection(chapters: DataFrame, path: str, by_volume: bool = True, folders: bool = True) -> None:
    """Page lists of the completed chapters, in one folder per output group or as one table."""
    pages = series.collection_pages(chapters, by_volume)
    # one task writes a group, or a block of pages of a large one, so folders hold few files
    writer = pages.repartition("series", "group_key", position_block(F.col("out_page"), 1 << 20)).write.mode("overwrite")
    (writer.partitionBy("series", "group_key") if folders else writer).parquet(path)
