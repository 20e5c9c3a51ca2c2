"""Quality of texts by the votes of their nearest labelled neighbours.

A text is a row of terms: trigrams of sign classes, hashed words, and classes of how much it repeats
itself. The terms of a bounded sample of labelled texts are weighted by their rarity and decomposed
(truncated, randomised singular value decomposition); the right singular vectors map every text to
its latent-semantic vector. The labelled vectors go to every executor, and blocks of texts meet all
of them in one matrix product of exact cosines. The nearest labelled texts, and all that are as near
as the last of them, vote with a weight that rises with their cosine.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from boxloom.llm.common import arrow

SAMPLE = 4000  # labelled texts that are neighbours, those with the smallest hash of their key
RANK = 96  # latent dimensions
NEIGHBOURS = 15
SHARPNESS = 8  # a neighbour votes with its cosine to this power
BATCH = 256
PREDICT = 0.7  # scores from here on are predicted as 1
TIE = 1e-6  # cosines that differ by less are as near

CLASSES = 16
SHAPES = CLASSES ** 3
WORDS = 4096
BINS = 16
MEASURES = 4
TERMS = SHAPES + WORDS + MEASURES * BINS
SHARES = (1.0, 0.4, 1.0)  # length of the sign, word and repetition part of a row


def _classes() -> np.ndarray:
    groups = ("", "", "", "", "", " ", "\n\r\t\x0b\x0c", ".", ",", "!?", "*#", "%&$@^~", "|", "-_=+/\\<>", "\"'`():;[]{}")
    table = np.full(256, 15, np.int32)
    table[128:] = 4
    for c in range(128):
        sign = chr(c)
        table[c] = 1 if sign.islower() else 2 if sign.isupper() else 3 if sign.isdigit() else next((i for i, g in enumerate(groups) if sign in g), 15)
    return table


_TABLE = _classes()


def _bin(share: float) -> int:
    return min(BINS - 1, int(share * BINS))


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(terms, values) of a whole text, each part of length 1 or empty before weighting; empty without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    c = _TABLE[np.frombuffer(raw, np.uint8)]
    shapes = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=SHAPES) if len(c) > 2 else np.zeros(SHAPES, np.int64)
    at = np.flatnonzero(shapes)
    counts = Counter(words)
    hashed: Counter = Counter()
    for word, n in counts.items():
        hashed[zlib.crc32(word) % WORDS] += n
    lines = raw.split(b"\n")
    measures = (len(counts) / len(words), sum(map(eq, words, words[1:])) / len(words), len(set(lines)) / len(lines), min(1.0, len(raw) / len(words) / 20))
    codes = np.concatenate([at, SHAPES + np.fromiter(hashed, np.int64, len(hashed)), [SHAPES + WORDS + BINS * i + _bin(m) for i, m in enumerate(measures)]])
    values = np.concatenate([np.log1p(shapes[at]), np.log1p(np.fromiter(hashed.values(), np.float64, len(hashed))), np.ones(MEASURES)])
    return codes.astype(np.int32), values.astype(np.float32)


@dataclass
class Model:
    """Rarity of every term, the map to the latent space, and unit vectors and labels of the labelled texts."""

    rarity: np.ndarray
    to_latent: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit rows; zero for texts without words or without a known term."""
        return _units(_weighted(rows, self.rarity) @ self.to_latent)

    def scores(self, latent: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Share of the votes for label 1, from exact cosines with all labelled vectors."""
        near = latent @ self.vectors.T
        k = min(k, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        votes = np.where(near >= last[:, None] - TIE, np.clip(near, 0, 1).astype(np.float64) ** SHARPNESS, 0)
        weight = votes.sum(axis=1)
        return np.where(weight > 0, votes @ self.labels / np.maximum(weight, 1e-300), self.labels.mean())


def _units(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def _weighted(rows: list[tuple[np.ndarray, np.ndarray]], rarity: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), TERMS), np.float32)
    for i, (codes, values) in enumerate(rows):
        out[i, codes] = values * rarity[codes]
    for share, (a, b) in zip(SHARES, ((0, SHAPES), (SHAPES, SHAPES + WORDS), (SHAPES + WORDS, TERMS))):
        part = out[:, a:b]
        part *= share / np.maximum(np.sqrt((part * part).sum(axis=1, keepdims=True)), 1e-12)
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[float], rank: int = RANK) -> Model:
    """Weights, decomposition and labelled vectors of the sample; the same sample gives the same model."""
    holding = np.bincount(np.concatenate([c for c, _ in rows]), minlength=TERMS)
    rarity = (np.log((1 + len(rows)) / (1 + holding)) + 0.1).astype(np.float32)
    rarity[holding == 0] = 0
    matrix = _weighted(rows, rarity)
    rng = np.random.default_rng(0)
    wide = min(rank + 16, *matrix.shape)
    probe = np.linalg.qr(matrix @ rng.standard_normal((TERMS, wide)).astype(np.float32))[0]
    for _ in range(3):
        probe = np.linalg.qr(matrix @ (matrix.T @ probe))[0]
    values, right = np.linalg.svd(probe.T @ matrix, full_matrices=False)[1:]
    good = values > 1e-5 * max(values[0], 1e-12)
    to_latent = np.ascontiguousarray(right[good][:rank].T)
    return Model(rarity, to_latent, _units(matrix @ to_latent), np.array(labels, np.float64))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, rank: int = RANK) -> Model | None:
    """Fit on the labelled, not held-out texts with words: at most `sample` of them, those with the smallest hash of the key.

    The label of a key with several label rows is their mean; null keys and null labels play no
    part. Of rows with an equal key the text with the smallest MD5 is taken. Only the terms of the
    sample reach the driver. None if there is no such row.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.avg(F.col(label)).alias("y"))
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.rlike("t", F.lit(r"[^\x00-\x20]")))
    there = texts.select("k").distinct().join(marked, "k")
    picked = there.orderBy(F.xxhash64("k"), "k").limit(sample)
    one = texts.join(F.broadcast(picked), "k").groupBy("k", "y").agg(F.min_by("t", F.md5("t")).alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.astype("<i4").tobytes() for c, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())], ["k", "y", "c", "v"])

    got = arrow(one.select(F.col("k").cast("string").alias("k"), F.col("y").cast("double").alias("y"), "t"), run, "k string, y double, c binary, v binary").collect()
    got = sorted((r["k"], r["y"], bytes(r["c"]), bytes(r["v"])) for r in got if len(r["c"]))
    return fit([(np.frombuffer(c, "<i4"), np.frombuffer(v, "<f4")) for _, _, c, v in got], [y for _, y, _, _ in got], rank) if got else None


def scored(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", k: int = NEIGHBOURS) -> DataFrame:
    """(key, score, predicted) of every row.

    Texts that are null, empty or without a known term get the mean label of the sample, and every
    text 0.5 if there was nothing to learn from. Repeated rows give repeated results; a text of any
    length is read whole; other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    key_type = to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for start in range(0, len(whole), BATCH):
                batch = whole.slice(start, BATCH)
                score = np.full(len(batch), 0.5) if model is None else model.scores(model.latent([terms(t.as_py()) for t in batch.column(1)]), k)
                score = np.clip(score, 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(key_type), pa.array(score, pa.float64()), pa.array((score >= PREDICT).astype(np.int32))], schema.names)

    return arrow(docs.select(key, text), run, schema)
