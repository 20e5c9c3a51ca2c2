"""Round trips through files in the shared folder: what is written is read back and checked."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from boxloom.operators import batching
from boxloom.plans import books
from boxloom.plans.registry import query
from boxloom.session import ensure_checkpoint_dir
from boxloom.sources import archives, artifacts
from boxloom.streaming import live

PAGE = ("book_id", "page")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("master_round_trip", "SELECT book_id, page, boxno, l, t, r, b, text FROM boxes", ("boxes",))
def master_round_trip(s):
    path = scratch(s.spark, "master")
    artifacts.write_master(s.boxes.select(*PAGE, "boxno", "l", "t", "r", "b", "text"), path)
    return artifacts.read_master(s.spark, path, "page bigint, boxno bigint, l bigint, t bigint, r bigint, b bigint, text string")


@query("write_collection", """
    SELECT series, CASE WHEN volume <> '' THEN concat('volume:', volume) ELSE concat('chapter:', job_id) END AS group_key, sum(page_count) AS pages
    FROM (SELECT series, volume, job_id, cast(page_count AS bigint) AS page_count FROM chapters WHERE status = 'complete') x GROUP BY ALL""".replace("sum(page_count)", "cast(sum(page_count) AS bigint)"), ("chapters",))
def write_collection(s):
    path = scratch(s.spark, "collection")
    artifacts.write_collection(s.chapters, path, folders=False)
    return s.spark.read.schema("job_id string, page bigint, out_page bigint, series string, group_key string").parquet(path).groupBy("series", "group_key").agg(F.count(F.lit(1)).alias("pages"))


@query("metadata_titles", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang ELSE '' END AS title FROM documents""")
def metadata_titles(s):
    k = F.col("doc_id") % 3
    xml = (F.when(k == 0, F.concat(F.lit("<ComicInfo><Title> </Title><Title> "), "source", F.lit(" </Title></ComicInfo>")))
           .when(k == 1, F.concat(F.lit('<c:ComicInfo xmlns:c="u"><c:Title>'), "lang", F.lit("</c:Title></c:ComicInfo>")))
           .otherwise("<ComicInfo><Title>cut"))
    return s.documents.select("doc_id", archives.xml_title(xml).alias("title"))


def _log_folder(s) -> str:
    """One log file per job, in the folder of the job, lines in order."""
    path = scratch(s.spark, "logs")
    _write_logs(_log_rows(s), path)
    return path


def _log_rows(s) -> DataFrame:
    e = F.col("event_id")
    return s.events.select(F.concat(F.lit("j"), F.col("user_id") % 16).alias("job_id"), e,
                           F.when(e % 7 == 0, "").otherwise(F.concat(F.lit(" note "), e)).alias("line"))


def _write_logs(rows: DataFrame, path: str) -> None:
    rows.repartition("job_id").sortWithinPartitions("job_id", "event_id").select("job_id", "line").write.mode("append").partitionBy("job_id").text(path)


LOG_FILES = """
    l AS (SELECT concat('job_id=j', user_id % 16) AS job_id, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) - 1 AS seq,
        CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(' note ', event_id) END AS line, count(*) OVER (PARTITION BY user_id % 16) AS n FROM events)"""


@query("read_logs", LOG_FILES + " SELECT job_id, cast(seq AS integer) AS seq, trim(line) AS line FROM l WHERE line <> ''")
def read_logs(s):
    return artifacts.read_logs(s.spark, _log_folder(s)).withColumn("seq", F.col("seq").cast("int"))


@query("log_tail", LOG_FILES + " SELECT job_id, seq, line FROM l WHERE seq >= 10 AND seq < n - 1")
def log_tail(s):
    path = _log_folder(s)
    files = s.spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    cursor = files.select("file", F.lit(1).cast("bigint").alias("bytes"), F.lit(10).cast("bigint").alias("lines"))
    return artifacts.read_log_tail(s.spark, path, cursor)[0].drop("file")


@query("review_files", books.REVIEW + """
    , wr AS (SELECT book_id, page, line FROM ln UNION ALL SELECT DISTINCT book_id, page, concat_ws(chr(9), 'page', 'boxno', 'sfx', 'openLettering', 'sourceText', 'englishText') FROM ln)
    SELECT book_id, line, count(*) AS n FROM wr GROUP BY ALL""", ("boxes",))
def review_files(s):
    path = scratch(s.spark, "review")
    batching.write_review(books.review_records(s), path)
    return s.spark.read.schema("value string, book_id string").text(path).groupBy("book_id", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("log_tail_stream", LOG_FILES + " SELECT job_id, line FROM l")
def log_tail_stream(s):
    """Logs that get new files between three runs of a stream; growth and rotation of a file are in the tests."""
    path, out, marks = (scratch(s.spark, name) for name in ("logs", "tail-out", "tail-marks"))
    for part in _parts(_log_rows(s), "event_id"):
        _write_logs(part, path)
        run = live.log_tail(s.spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).start()
        try:
            run.processAllAvailable()
        finally:
            run.stop()
    return s.spark.read.parquet(out).select("job_id", "line")


@query("read_jobs", """
    SELECT concat('c', s_nationkey) AS category, concat('j', s_suppkey) AS job_id, CASE WHEN s_suppkey % 3 = 0 THEN 'failed' END AS status FROM supplier WHERE s_suppkey % 5 <> 0""")
def read_jobs(s):
    path, n = scratch(s.spark, "jobs"), F.col("s_suppkey")
    doc = F.to_json(F.struct(F.concat(F.lit("c"), "s_nationkey").alias("category"), F.concat(F.lit("j"), n).alias("jobId"), F.when(n % 3 == 0, "failed").alias("status")), {"pretty": "true"})
    made = s.supplier.select(F.when(n % 10 == 0, "[1]").when(n % 10 == 5, '{"jobId": ').otherwise(doc).alias("value"))
    made.write.option("maxRecordsPerFile", 1).text(path)
    return artifacts.read_jobs(s.spark, path).select("category", F.col("jobId").alias("job_id"), "status")


@query("read_traces", "SELECT concat('p', s_suppkey % 4) AS phase, cast(s_suppkey AS bigint) AS tokens, s_suppkey % 2 = 0 AS failed FROM supplier")
def read_traces(s):
    path, n = scratch(s.spark, "traces"), F.col("s_suppkey")
    trace = F.to_json(F.struct(F.concat(F.lit("p"), n % 4).alias("phase"), n.alias("generatedTokens"), (n % 2 == 0).alias("failed"), F.lit(1).alias("other")))
    # a file holds the traces of a run as one array: files of one trace each cost more than their reading
    run = s.supplier.select(trace.alias("trace"), F.floor(F.monotonically_increasing_id() / TRACES_OF_A_RUN).alias("run")).groupBy("run")
    run.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("trace"), ",\n"), F.lit("\n]")).alias("value")).select("value") \
        .write.option("maxRecordsPerFile", 1).text(path)
    return artifacts.read_traces(s.spark, path).select("phase", F.col("generatedTokens").alias("tokens"), "failed")


@query("metadata_xml", """
    SELECT cast(s_nationkey AS bigint) AS nation, concat('<ComicInfo>', string_agg(concat('<T', s_suppkey, '>a &lt;&amp; ', s_suppkey, '</T', s_suppkey, '>'), '' ORDER BY concat('T', s_suppkey)), '</ComicInfo>') AS xml
    FROM supplier GROUP BY s_nationkey""")
def metadata_xml(s):
    n = F.col("s_suppkey")
    return archives.metadata_xml(s.supplier.select(F.col("s_nationkey").cast("bigint").alias("nation"), F.concat(F.lit("T"), n).alias("tag"), F.concat(F.lit("a <& "), n).alias("value")), ["nation"])


TRACES_OF_A_RUN = 1000
PARTS = 3  # runs of a stream query, each with new files


def _parts(df: DataFrame, order: str | None) -> list[DataFrame]:
    """The table in parts that arrive one after another: by a time column, else at random."""
    if order is None:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
        return [df.where(part == i) for i in range(PARTS)]
    cuts = df.agg(F.percentile_approx(order, [i / PARTS for i in range(1, PARTS)])).first()[0] or []
    edges = [None, *cuts, None]
    return [df.where((F.lit(True) if low is None else F.col(order) > F.lit(low)) & (F.lit(True) if high is None else F.col(order) <= F.lit(high)))
            for low, high in zip(edges, edges[1:])]


def _streamed(df: DataFrame, order: str | None, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Run a stream over the table as it arrives: every part is a run of its own from the state of the one before."""
    spark = df.sparkSession
    path = scratch(spark, "stream-in")
    for part in _parts(df, order):
        part.write.mode("append").parquet(path)
        start(spark.readStream.schema(df.schema).parquet(path)).trigger(availableNow=True).start().awaitTermination()


def _drained(df: DataFrame, operator: Callable[[DataFrame], DataFrame], mode: str, order: str | None = None) -> DataFrame:
    """What an operator gave out over all parts, with the number of the batch."""
    spark = df.sparkSession
    out, marks = scratch(spark, "stream-out"), scratch(spark, "stream-marks")

    def keep(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/part={number}")

    _streamed(df, order, lambda rows: operator(rows).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", marks))
    return spark.read.option("basePath", out).parquet(f"{out}/part=*").drop("part")


def _latest(df: DataFrame, key: str) -> DataFrame:
    """Last state of every key that an update-mode stream gave out."""
    rest = [c for c in df.columns if c not in (key, "batch")]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(key, "x.*")


@query("live_progress", books.LOG + """
    SELECT job_id, arg_max(phase, seq) AS phase, CASE WHEN arg_max(phase, seq) <> 'Proofreading' THEN arg_max(coalesce(page, -1), seq) END AS page, arg_max(target, seq) AS resume_from, arg_max(target_page, seq) AS resume_page
    FROM pl GROUP BY ALL""")
def live_progress(s):
    return _latest(_drained(books.made_log(s), live.live_progress, "update"), "job_id")


@query("token_meter_stream", books.TOKENS)
def token_meter_stream(s):
    return _latest(_drained(books.token_chunks(s), live.token_meter, "update"), "call")


@query("failure_limiter_stream", books.LIMITER)
def failure_limiter_stream(s):
    with live.state_in_rocksdb(s.spark):
        found = _drained(books.attempts(s), lambda rows: live.failure_limiter(rows, 3, 259_200, 86_400), "append", "at")
    return found.where("NOT late").drop("batch", "late")


@query("runtime_state_stream", books.RUNTIME + books.RUNTIME_RESULT)
def runtime_state_stream(s):
    with live.state_in_rocksdb(s.spark):
        done = _latest(_drained(books.runtime_events(s), live.runtime_state, "update", "at"), "job_id")
    return done.withColumn("running_since", F.col("running_since").cast("timestamp_ntz"))


@query("chapter_release", books.KEYED + books.GATE + " SELECT g.series, g.job_id FROM g JOIN chapters c USING (series, job_id) WHERE reason = '' AND c.status = 'queued'", ("chapters",))
def chapter_release(s):
    chapters, covered = books.gate_tables(s)
    out, marks = scratch(s.spark, "released"), scratch(s.spark, "release-marks")

    def publish(rows: DataFrame, number: int) -> None:
        rows.select("series", "job_id").write.mode("overwrite").parquet(f"{out}/part={number}")

    _streamed(chapters.select("series").distinct(), None, lambda rows: live.chapter_release(rows, lambda: chapters, lambda: covered, publish, marks))
    return s.spark.read.schema("series string, job_id string").option("basePath", out).parquet(f"{out}/part=*").select("series", "job_id").distinct()


# three states of the chapters: some are still running, then those are complete and the notes reach further, then failed ones are deleted
VERSIONS = """
    vs AS (SELECT * FROM (VALUES (1), (2), (3)) x(n)),
    vt AS (SELECT concat(n, '|', series) AS series, job_id, volume, chapter, seq, has_context, page_count, note, seq <= 2 OR (n > 1 AND seq <= 4) AS covered,
        CASE WHEN n = 1 AND seq % 2 = 0 AND status = 'complete' THEN 'running' ELSE status END AS status FROM chapters, vs WHERE n < 3 OR status <> 'failed')"""


@query("chapter_release_feed", VERSIONS + "," + (books.KEYED + books.GATE).replace("FROM chapters", "FROM vt").replace("seq <= 4", "covered") + """,
    rel AS (SELECT split_part(g.series, '|', 2) AS series, g.job_id, cast(split_part(g.series, '|', 1) AS bigint) AS version
      FROM g JOIN vt c USING (series, job_id) WHERE reason = '' AND c.status = 'queued')
    SELECT r.* FROM rel r LEFT JOIN rel p ON p.series = r.series AND p.job_id = r.job_id AND p.version = r.version - 1 WHERE p.job_id IS NULL""", ("chapters",))
def chapter_release_feed(s):
    path, out, marks = scratch(s.spark, "chapter-log"), scratch(s.spark, "released"), scratch(s.spark, "release-marks")
    seq, complete = F.col("seq"), F.col("status") == "complete"
    base = s.kept("chapters").withColumn("skip_gate", F.lit(False)).withColumn("deleted", F.lit(False))
    waiting = (seq % 2 == 0) & complete
    states = [base.withColumn("covered", seq <= 2).withColumn("status", F.when(waiting, "running").otherwise(F.col("status"))),
              base.where(waiting | seq.isin(3, 4)).withColumn("covered", seq <= 4),
              base.where("status = 'failed'").withColumn("covered", seq <= 4).withColumn("deleted", F.lit(True))]

    def publish(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/part={number}")

    for version, state in enumerate(states, 1):
        log = state.withColumn("version", F.lit(version).cast("bigint"))
        log.write.mode("append").parquet(path)
        changes = s.spark.readStream.schema(log.schema).parquet(path)
        live.chapter_release_feed(changes, lambda: s.spark.read.schema(log.schema).parquet(path), publish, marks).trigger(
            availableNow=True).start().awaitTermination()
    return s.spark.read.schema("series string, job_id string, version bigint").option("basePath", out).parquet(f"{out}/part=*").select("series", "job_id", "version")
