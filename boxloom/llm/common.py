"""What the operators share: session folders, text chunks, hashing, components of link tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.operators.graph import dealt_join
from boxloom.session import ensure_checkpoint_dir

CHUNK_CHARS = 1_000_000  # characters of text that a task takes apart at a time


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors of the session, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="boxloom-")) / f"boxloom-{context.applicationId}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, file.relative_to(home.parent).as_posix())
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """`df.mapInArrow` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder of the session (`spark.checkpoint.dir`)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: columns stay prunable."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of at most `limit` characters, or one longer text. Null texts are empty."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        start, size = 0, 0
        held: list[str] = []
        for i in range(len(ids)):
            text = texts[i].as_py() or ""
            if held and size + len(text) > limit:
                yield ids[start:i], held
                start, size, held = i, 0, []
            held.append(text)
            size += len(text)
        if held:
            yield ids[start:], held


def spread(lengths: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """firsts[i], firsts[i] + 1, ... for lengths[i] values each, all in one array."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    return np.arange(total, dtype=np.int64) + np.repeat(firsts.astype(np.int64) - (ends - lengths), lengths)


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of a link table; root is the smallest node of its component.

    Alternating star contraction: each round replaces the links of a node by links to its
    smallest neighbour, by grouped minima and joins, until nothing moves. The number of rounds
    grows with the logarithm of the number of nodes. Each round is written to the shared folder.
    The neighbours of a hub are dealt over several keys.
    """
    edges = stored(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "links")
    before, rows = None, edges.count()
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = dealt_join(both.where("v > u"), low, ["u"], "v", rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = dealt_join(large, low, ["u"], "v", rows).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = stored(small.where("u <> v").distinct(), "links")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = after
        if tuple(state) == before:
            break
        before, rows = tuple(state), state[0]
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


class UnitIds:
    """Token ids of text units, each distinct unit encoded once while it is remembered.

    `encode` gets a list of new distinct units and returns all their ids in a row and the number of
    ids of each. Units are kept in two generations of at most about `limit` units: when the young one
    is full it becomes the old one, and units of the old one that are met again move to the young one
    without being encoded.
    """

    def __init__(self, encode, limit: int = 700_000):
        self.encode, self.limit = encode, limit
        self.young, self.old = _Generation(), _Generation()

    def ids(self, docs: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in a row, ids per document)."""
        if len(self.young.place) > self.limit:
            self.young, self.old = _Generation(), self.young
        place = self.young.place
        flat = list(chain.from_iterable(docs))
        at = np.fromiter(map(place.get, flat, repeat(-1)), np.int64, len(flat))
        absent = np.flatnonzero(at < 0)
        if len(absent):
            missing = list(dict.fromkeys([flat[i] for i in absent]))
            known = [u for u in missing if u in self.old.place]
            if known:
                self.young.add(known, *self.old.ids([self.old.place[u] for u in known]))
                missing = [u for u in missing if u not in self.old.place]
            if missing:
                self.young.add(missing, *self.encode(missing))
            at[absent] = np.fromiter((place[flat[i]] for i in absent), np.int64, len(absent))
        ids, sizes = self.young.ids(at)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum([len(units) for units in docs])
        return ids, np.diff(np.concatenate([[0], upto[ends]]))


class _Generation:
    def __init__(self):
        self.place: dict = {}
        self.starts, self.sizes, self.flat = array("q"), array("i"), array("i")

    def add(self, units: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.starts)
        self.place.update(zip(units, range(first, first + len(units))))
        sizes = np.asarray(sizes, np.int32)
        self.starts.frombytes((len(self.flat) + np.cumsum(sizes, dtype=np.int64) - sizes).tobytes())
        self.sizes.frombytes(sizes.tobytes())
        self.flat.frombytes(np.asarray(ids, np.int32).tobytes())

    def ids(self, at) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.frombuffer(self.sizes, np.int32)[at].astype(np.int64) if len(self.sizes) else np.zeros(0, np.int64)
        starts = np.frombuffer(self.starts, np.int64)[at] if len(self.starts) else sizes
        flat = np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32)
        return flat[spread(sizes, starts)], sizes
