"""Streams with state of their own give what their batch twins give, over several batches."""

import uuid

import pytest
from pyspark.sql import functions as F

from boxloom.operators import jobs
from boxloom.streaming import live


@pytest.fixture
def store(spark):
    with live.state_in_rocksdb(spark):
        yield


def run(spark, folder, parts, operator, mode):
    """All rows an operator gives out, a batch for each part."""
    out, source = [], str(folder / uuid.uuid4().hex)

    def keep(rows, number):
        out.extend((number, r) for r in rows.collect())

    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = operator(spark.readStream.schema(part.schema).parquet(source))
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(folder / "marks")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_limiter_of_two_batches_with_late_rows(spark, tmp_path, store):
    n = F.col("id")
    rows = spark.range(400).select((n % 3).alias("client"), n.alias("seq"), F.timestamp_seconds(1000 + F.floor(n / 4) * 7).alias("at"),
                                   F.when(n % 11 == 5, None).otherwise(n % 17 == 0).alias("ok"))
    late = spark.createDataFrame([(0, 1000, 1000, False), (9, 1001, 1000, False), (0, 1002, None, False)], "client bigint, seq bigint, at bigint, ok boolean").withColumn("at", F.timestamp_seconds("at"))
    got = run(spark, tmp_path, [rows.where("seq < 200"), rows.where("seq >= 200").union(late)], lambda r: live.failure_limiter(r, 3, 60), "append")
    want = jobs.failure_limiter(rows, 3, 60).collect()
    assert sorted((r.client, r.seq, r.failures, r.retry_after) for _, r in got if not r.late and r.client != 9) == sorted(tuple(r) for r in want)
    assert [(r.client, r.seq, r.failures) for _, r in got if r.late] == [(0, 1000, None)]
    assert [(r.seq, r.failures) for _, r in got if r.client == 9] == [(1001, 1)]


def test_runtime_of_two_batches(spark, tmp_path, store):
    rows = spark.createDataFrame([("a", 10, 0, "start"), ("a", 20, 1, "start"), ("a", 25, 2, "note"), ("a", 30, 3, "stop"), ("a", 40, 4, "stop"), ("b", 5, 5, "stop"),
                                  ("a", 50, 6, "start"), ("b", 60, 7, "start"), ("a", 55, 8, "stop"), ("a", None, 9, "start")],
                                 "job_id string, at bigint, seq bigint, kind string").withColumn("at", F.timestamp_seconds("at"))
    got = run(spark, tmp_path, [rows.where("seq < 6"), rows.where("seq >= 6")], live.runtime_state, "update")
    read = sorted((number, r.job_id, r.elapsed_micros, r.running_since.second if r.running_since else None) for number, r in got)
    assert read == [(0, "a", 20_000_000, None), (0, "b", 0, None), (1, "a", 25_000_000, None), (1, "b", 0, 0)]


def test_a_chapter_is_released_once_when_its_gate_opens(spark, tmp_path):
    kind = "version bigint, series string, job_id string, volume string, chapter string, status string, has_context boolean, skip_gate boolean, covered boolean, deleted boolean"

    def change(version, job, chapter, status, covered=True, deleted=False):
        return spark.createDataFrame([(version, "s", job, "1", chapter, status, False, False, covered, deleted)], kind)

    log = [change(1, "a", "1", "running").union(change(1, "b", "2", "queued", covered=False)), change(2, "a", "1", "complete"), change(3, "a", "1", "complete"),
           change(4, "c", "3", "queued", covered=False), change(5, "b", "2", "queued", covered=False, deleted=True)]
    source, out = str(tmp_path / "log"), []
    for part in log:
        part.write.mode("append").parquet(source)
        live.chapter_release_feed(spark.readStream.schema(part.schema).parquet(source), lambda: spark.read.schema(part.schema).parquet(source),
                                  lambda rows, number: out.extend((r.job_id, r.version) for r in rows.collect()), str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    assert out == [("b", 2), ("c", 5)]


def test_a_batch_of_chapters_reads_the_log_once(spark, tmp_path):
    kind = "version bigint, series string, job_id string, volume string, chapter string, status string, has_context boolean, skip_gate boolean, covered boolean, deleted boolean"
    rows = [(1, "s", "a", "1", "1", "running", False, False, True, False), (1, "s", "b", "1", "2", "queued", False, False, False, False), (2, "s", "a", "1", "1", "complete", False, False, True, False),
            (1, "other", "c", "1", "1", "queued", False, False, False, False), (2, "s", "d", "2", "1", "queued", False, False, True, True)]
    source, out, seen = str(tmp_path / "log"), [], spark.sparkContext.accumulator(0)
    for version in (1, 2):
        part = spark.createDataFrame([r for r in rows if r[0] == version], kind).coalesce(1)
        part.write.mode("append").parquet(source)

        def history():
            def look(_):
                seen.add(1)
                return True
            return spark.read.schema(part.schema).parquet(source).where(F.udf(look, "boolean")(F.col("job_id")))

        live.chapter_release_feed(spark.readStream.schema(part.schema).parquet(source), history,
                                  lambda found, number: out.extend((r.job_id, r.version) for r in found.collect()), str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    assert out == [("c", 1), ("b", 2)]
    assert seen.value <= 3 + 5  # every row of the log once in each batch
