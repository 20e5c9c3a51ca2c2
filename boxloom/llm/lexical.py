"""Ranked lexical search by dense blocked matrix products.

The items are cut into blocks of bounded size, and a block into tiles of items. A tile has a compact
vocabulary, the terms of its own items. Documents come in tiles too: the impacts of the terms of an
item tile in a document tile are a dense float64 matrix, and its product with the term weights of
the items gives all scores of the two tiles. Weights and impacts are whole numbers; the vocabulary
is cut where the sum of weight times largest impact could reach 2^53, so every partial sum is exact,
and the sums of the cuts are added as 64-bit integers.

A task keeps for every item the best `k` of what it has seen. The cut of a tile keeps every score
that is not below the k-th, ties included, and only then orders by score and key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from boxloom.llm.common import arrow, stored, text_chunks

TOP = 50
ITEM_TILE = 64  # items of a matrix product
DOC_TILE = 512  # documents of a matrix product
BLOCK_BYTES = 4 << 20  # text of the items that go to the executors at once
EXACT = 1 << 53
IMPACT = 1_000_000  # an impact is below this
SALTS = 64  # parts of an item whose best rows are found first

# separators are all ASCII signs that are neither digits nor letters; A-Z become a-z, other bytes stay
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


@dataclass
class Block:
    """Items of a block, each with its distinct terms as numbers of the vocabulary of the block."""

    ids: list
    items: list[np.ndarray]
    number: dict[bytes, int] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: Iterable[tuple]) -> Block:
        ids, items, number = [], [], {}
        for key, text in rows:
            ids.append(key)
            items.append(np.array(sorted({number.setdefault(t, len(number)) for t in terms(text)}), np.int64))
        return cls(ids, items, number)


def blocks(items: DataFrame, key: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of at most `limit` bytes of text, or one longer item, read one after the other."""
    rows: list[tuple] = []
    size = 0
    for row in items.select(key, text).toLocalIterator():
        n = len((row[1] or "").encode("utf-8", "surrogatepass"))
        if rows and size + n > limit:
            yield Block.of(rows)
            rows, size = [], 0
        rows.append((row[0], row[1]))
        size += n + 64
    if rows:
        yield Block.of(rows)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _numbers(found: list[bytes], number: dict[bytes, int]) -> Counter:
    """How often each term of the vocabulary occurs."""
    counts = Counter(map(number.get, found))
    counts.pop(None, None)
    return counts


def _statistics(rows: DataFrame, number: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all documents, documents that hold each term of the vocabulary)."""
    shared = rows.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        holding, documents, total = Counter(), 0, 0
        for _, texts in text_chunks(batches):
            for text in texts:
                found = terms(text)
                documents += bool(found)
                total += len(found)
                holding.update(set(map(vocabulary.get, found)))
        holding.pop(None, None)
        codes = [-2, -1, *holding]
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array([documents, total, *holding.values()], pa.int64())], ["term", "n"])

    sums = arrow(rows, run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a number for each term of the block
    got = {r["term"]: r["n"] for r in sums}
    holding = np.zeros(len(number), np.int64)
    for term, n in got.items():
        if term >= 0:
            holding[term] = n
    return got.get(-2, 0), got.get(-1, 0), holding


@dataclass
class Tile:
    """Items from `first` on, the vocabulary of the tile, and term weights in cuts (from, to, items x terms)."""

    first: int
    size: int
    column: np.ndarray  # number in the block -> column of the tile, -1 if it is not there
    cuts: list[tuple[int, int, np.ndarray]]


def tiles(block: Block, weights: np.ndarray, size: int = ITEM_TILE, exact: int = EXACT) -> list[Tile]:
    out = []
    for first in range(0, len(block.items), size):
        own = block.items[first:first + size]
        used = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
        used = used[weights[used] > 0]
        column = np.full(len(weights), -1, np.int64)
        column[used] = np.arange(len(used))
        dense = np.zeros((len(own), len(used)))
        for i, numbers in enumerate(own):
            at = column[numbers]
            dense[i, at[at >= 0]] = weights[numbers[at >= 0]]
        cuts, start, held = [], 0, 0
        for at, w in enumerate(weights[used]):
            if held + int(w) * IMPACT >= exact:
                cuts.append((start, at, dense[:, start:at]))
                start, held = at, 0
            held += int(w) * IMPACT
        if len(used):
            cuts.append((start, len(used), dense[:, start:]))
        out.append(Tile(first, len(own), column, cuts))
    return out


class _Best:
    """The best k (score, key) of every item so far; keys order as in SQL, nulls first."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.held: list[list[tuple]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # scores below this are not among the best

    def add(self, first: int, scores: np.ndarray, keys: list) -> None:
        """`scores`: items from `first` on, by documents."""
        if scores.shape[1] > self.k:
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
        else:
            kth = np.zeros(len(scores), np.int64)
        floor = np.maximum(kth, self.least[first:first + len(scores)])
        at_item, at_doc = np.nonzero(scores >= floor[:, None])
        for i, d, s in zip(at_item.tolist(), at_doc.tolist(), scores[at_item, at_doc].tolist()):
            self.held[first + i].append((-s, keys[d] is not None, keys[d]))
        for i in np.unique(at_item).tolist():
            if len(self.held[first + i]) > 4 * self.k:
                self.cut(first + i)

    def cut(self, i: int) -> None:
        held = self.held[i]
        held.sort(key=lambda x: x if x[1] else (x[0], False))
        del held[self.k:]
        if len(held) == self.k:
            self.least[i] = -held[-1][0]


def _scored(rows: DataFrame, block: Block, parts: list[Tile], documents: int, total: int, k: int, key_type: T.DataType, doc_tile: int) -> DataFrame:
    """(item, key, score): the best `k` documents of every item in every task."""
    shared = rows.sparkSession.sparkContext.broadcast((block.number, parts, len(block.ids)))

    def score(found: list[tuple[Counter, int]]) -> Iterator[tuple[int, np.ndarray]]:
        which = np.repeat(np.arange(len(found)), [len(c) for c, _ in found])
        number = np.fromiter((t for c, _ in found for t in c), np.int64, len(which))
        tf = np.fromiter((n for c, _ in found for n in c.values()), np.int64, len(which))
        mean = np.array([20 * (50 + 50 * n * documents // total) for _, n in found], np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + mean[which])
        for part in shared.value[1]:
            column = part.column[number]
            here = column >= 0
            dense = np.zeros((len(found), int(part.column.max(initial=-1)) + 1))
            dense[which[here], column[here]] = impact[here]
            sums = np.zeros((part.size, len(found)), np.int64)
            for a, b, weights in part.cuts:
                sums += (weights @ dense[:, a:b].T).astype(np.int64)
            yield part.first, sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, _, size = shared.value
        best = _Best(size, k)
        held: list[tuple[Counter, int]] = []
        keys: list = []

        def flush() -> None:
            if held:
                for first, sums in score(held):
                    best.add(first, sums, keys)
                held.clear()
                keys.clear()

        for ids, texts in text_chunks(batches):
            for key, text in zip(ids, texts):
                found = terms(text)
                counts = _numbers(found, number)
                if counts:
                    held.append((counts, len(found)))
                    keys.append(key)
                    if len(held) == doc_tile:
                        flush()
        flush()
        for i in range(size):
            best.cut(i)
        rows = [(i, x[2], -x[0]) for i, own in enumerate(best.held) for x in own]
        columns = list(zip(*rows)) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], to_arrow_type(key_type)), pa.array(columns[2], pa.int64())], ["item", "key", "score"])

    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("key", key_type), T.StructField("score", T.LongType())])
    return arrow(rows, run, schema)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           item_tile: int = ITEM_TILE, doc_tile: int = DOC_TILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, key, score): the `k` best documents of every row of `items` with a score above 0.

    Equal scores go by ascending key, null keys first; rows with an equal key are documents of their
    own, and so are rows with an equal item. Null and empty texts hold no terms; an item without terms,
    or whose terms occur in no document, has no rows. Other columns play no part. Every block of
    items reads the documents twice: once for the statistics of its terms, once for the scores.
    """
    spark = docs.sparkSession
    rows = docs.select(key, text)
    item_type, key_type = items.schema[item].dataType, docs.schema[key].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField(item, item_type), T.StructField("rank", T.IntegerType()), T.StructField(key, key_type), T.StructField("score", T.LongType())]))
    for block in blocks(items, item, item_text, block_bytes):
        documents, total, holding = _statistics(rows, block.number)
        if not total:
            continue
        weights = np.array([weight(documents, int(n)) if n else 0 for n in holding], np.int64)
        found = stored(_scored(rows, block, tiles(block, weights, item_tile), documents, total, k, key_type, doc_tile), "scores")
        best = lambda *group: Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_first("key"))
        parts = found.withColumn("salt", F.pmod(F.hash("key", "score"), F.lit(SALTS))).withColumn("at", F.row_number().over(best("item", "salt"))).where(F.col("at") <= k)
        last = parts.withColumn("rank", F.row_number().over(best("item"))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("name", item_type)]))
        out = out.unionByName(last.join(F.broadcast(names), "item").select(F.col("name").alias(item), "rank", F.col("key").alias(key), "score"))
    return out
