"""Streams of log lines, attempts, start/stop events, chapter changes and token chunks.

Each has a batch twin in `boxloom.operators`; both give the same values on the same input.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from boxloom.operators import jobs, merge, series
from boxloom.session import stored
from boxloom.streaming.tail import LogTail

LIMIT_OUT = "seq bigint, failures bigint, retry_after bigint, late boolean"
RUNTIME_OUT = "job_id string, elapsed_micros bigint, running_micros bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK = 65_536  # rows of a client that are given out together


def log_tail(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files as they grow: (job_id, file, at, line), every line once. See `tail`."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").load(path)


def live_progress(lines: DataFrame, terminated: DataFrame | None = None) -> DataFrame:
    """Current phase, page and resume target per job, in update mode. `lines`: job_id, seq, line."""
    return jobs.latest_progress(lines, terminated)


def token_meter(chunks: DataFrame) -> DataFrame:
    """Running chunk counts per call, in update mode."""
    return jobs.token_meter(chunks)


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Start queries of `failure_limiter` and `runtime_state` inside it: they need this store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _in_order(rows: Iterator[pd.DataFrame], value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, numbers and values of a key's rows of a batch, sorted; chunks are kept as plain arrays of 17 bytes a row."""
    chunks = [(r["us"].to_numpy(np.int64), r["seq"].to_numpy(np.int64), r[value].to_numpy(np.int8)) for r in rows]
    us, seq, kind = (np.concatenate(c) for c in zip(*chunks))
    order = np.lexsort((seq, us))
    return us[order], seq[order], kind[order]


class _Limiter(StatefulProcessor):
    """Failures of a client by their time, and its newest time."""

    def __init__(self, limit: int, window_us: int, late_us: int, keep_ms: int | None):
        self.limit, self.window, self.late, self.keep = limit, window_us, late_us, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failed = handle.getListState("failed", "us bigint, n bigint", self.keep)
        self.newest = handle.getValueState("newest", "us bigint", self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        us, seq, ok = _in_order(rows, "ok")
        newest = self.newest.get()[0] if self.newest.exists() else None
        behind = int(np.searchsorted(us, newest - self.late)) if newest is not None else 0
        for at in range(0, behind, CHUNK):
            part = seq[at:min(behind, at + CHUNK)]
            yield self._out(key, part, None, None, True)
        live = deque([t, n] for t, n in self.failed.get()) if self.failed.exists() else deque()
        counted = sum(n for _, n in live)
        for at in range(behind, len(us), CHUNK):
            failures, waits = [], []
            for t, good in zip(us[at:at + CHUNK].tolist(), ok[at:at + CHUNK].tolist()):
                if good == 1:
                    live.clear()
                    counted = 0
                elif good == 0:
                    counted += 1
                    if live and live[-1][0] >= t:  # not before the newest one
                        live[-1][1] += 1
                    else:
                        live.append([t, 1])
                while live and live[0][0] <= t - self.window:
                    counted -= live.popleft()[1]
                failures.append(counted)
                waits.append(max(1, round((self.window - (t - live[0][0])) / 1e6)) if counted >= self.limit and live else 0)
            yield self._out(key, seq[at:at + CHUNK], failures, waits, False)
        if behind < len(us):
            self.newest.update((max(int(us[-1]), newest if newest is not None else int(us[-1])),))
        if live:
            self.failed.put([tuple(x) for x in live])
        else:
            self.failed.clear()

    def _out(self, key: tuple, seq: np.ndarray, failures: list | None, waits: list | None, late: bool) -> pd.DataFrame:
        none = [None] * len(seq)
        return pd.DataFrame({"client": pd.Series([key[0]] * len(seq), dtype=object), "seq": seq, "failures": pd.array(failures or none, dtype="Int64"),
                             "retry_after": pd.array(waits or none, dtype="Int64"), "late": late})

    def close(self) -> None:
        pass


def failure_limiter(attempts: DataFrame, limit: int = 5, window_seconds: int = 60, late_seconds: int = 10, keep_seconds: int | None = None) -> DataFrame:
    """Failures still counted at each attempt and the seconds to wait: (client, seq, failures, retry_after, late).

    `attempts`: client (of any simple type), seq, at (timestamp), ok; rows without `at` or `seq` take
    no part, a null `ok` is neither a success nor a failure. Rows of a client are taken in the order of
    (at, seq) inside a batch and answered in that batch. One that comes more than `late_seconds` behind
    the newest row of its client in earlier batches is given out with `late` and no counts: write those to a table
    of their own. The state of a client is how many failures each instant inside one window has. With
    `keep_seconds` it is forgotten when the client has sent nothing for that long and a window; such a query
    runs batches without data too, so it needs a trigger by processing time (`availableNow` would not end).
    """
    window = window_seconds * 1_000_000
    worker = _Limiter(limit, window, late_seconds * 1_000_000, (keep_seconds + window_seconds) * 1000 if keep_seconds else None)
    good = F.when(F.col("ok"), 1).when(~F.col("ok"), 0).otherwise(-1)
    rows = attempts.select("client", "seq", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), good.cast("tinyint").alias("ok"))
    out = T.StructType([T.StructField("client", attempts.schema["client"].dataType), *T.StructType.fromDDL(LIMIT_OUT).fields])
    return rows.where("us IS NOT NULL AND seq IS NOT NULL").groupBy("client").transformWithStateInPandas(worker, out, "append", "ProcessingTime" if keep_seconds else "None")


class _Runtime(StatefulProcessor):
    """Active time of a job so far, and since when it runs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("runtime", "elapsed bigint, since bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        elapsed, since = self.state.get() if self.state.exists() else (0, None)
        us, _, start = _in_order(rows, "start")
        turns = np.flatnonzero(np.diff(start, prepend=1 - start[0]))  # only the first of several starts or stops in a row counts
        for at, begins in zip(us[turns].tolist(), start[turns].tolist()):
            if begins:
                since = at if since is None else since
            else:
                elapsed, since = elapsed + (max(0, at - since) if since is not None else 0), None
        self.state.update((elapsed, since))
        yield pd.DataFrame({"job_id": [key[0]], "elapsed_micros": [elapsed], "running_micros": pd.array([since], dtype="Int64")})

    def close(self) -> None:
        pass


def runtime_state(events: DataFrame) -> DataFrame:
    """Active time per job from start and stop events, in update mode. `events`: job_id, at, seq, kind; rows without `at` or `seq` take no part."""
    timed = events.where(F.col("kind").isin("start", "stop")).select(
        "job_id", "seq", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), (F.col("kind") == "start").cast("tinyint").alias("start"))
    rows = timed.where("us IS NOT NULL AND seq IS NOT NULL").groupBy("job_id").transformWithStateInPandas(_Runtime(), RUNTIME_OUT, "update", "None")
    return rows.select("job_id", "elapsed_micros", F.timestamp_micros("running_micros").alias("running_since"))


def chapter_release(changes: DataFrame, chapters: Callable[[], DataFrame], coverage: Callable[[], DataFrame],
                    publish: Callable[[DataFrame, int], None], checkpoint: str):
    """On every change of a series, find the queued chapters that may start and pass them on.

    `changes` is a stream with `series`; `chapters` and `coverage` give the current tables.
    Only series with a change are looked at. `publish` gets (rows, batch number) and should
    write by that number, so that a repeated batch does no harm.
    """
    def batch(rows: DataFrame, number: int) -> None:
        touched = rows.select("series").distinct()
        current = chapters().join(touched, "series", "left_semi")
        gate = series.series_gate(current, coverage().join(touched, "series", "left_semi"))
        queued = current.where("status = 'queued'").select("series", "job_id")
        publish(gate.where("ready").join(queued, ["series", "job_id"], "left_semi"), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def chapter_release_feed(changes: DataFrame, history: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None],
                         checkpoint: str):
    """Find the queued chapters that a change lets start, each once, when it happens.

    `changes` streams a log of whole chapter rows: version, series, job_id, volume, chapter, status,
    has_context, skip_gate, covered (by the series notes), deleted. Versions rise from batch to
    batch. `history` reads the same log as a table. A batch compares the series it touches as
    they were before its first version and after its last one, so both states follow from the log
    and the batch alone: a batch that is repeated after a failure releases the same chapters, though
    the log has grown since. `publish` gets (series, job_id, version) and the number of the batch.
    """
    key = ("series", "job_id")
    fields = ("volume", "chapter", "status", "has_context", "skip_gate", "covered", "deleted")

    def ready(states: DataFrame, state: str) -> DataFrame:
        now = merge.present(states, key, state)
        gate = series.series_gate(now, series.coverage_boundary(now))
        return gate.where("ready").join(now.where("status = 'queued'").select(*key), list(key), "left_semi").select(*key)

    def batch(rows: DataFrame, number: int) -> None:
        first, last = rows.agg(F.min("version"), F.max("version")).first()
        if last is None:
            return
        log = history().select(*key, "version", *fields).join(rows.select("series").distinct(), "series", "left_semi")
        states = stored(merge.states_of(log, key, {"before": first - 1, "after": last}))  # the log is grouped once, the gates read it many times
        freed = ready(states, "after").join(ready(states, "before"), list(key), "left_anti")
        publish(freed.withColumn("version", F.lit(last).cast("bigint")), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
