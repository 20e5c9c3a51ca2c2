"""Language identification with a blended-spectrum string kernel.

A text is the set of its letter n-grams of one to three letters (presence, no counts). The
kernel of two texts is the number of n-grams they share over the root of the product of their
numbers. Nystroem landmarks turn the kernel into features, and one ridge regression per
language is fitted on them. As kernel, feature map and regression are linear in the n-gram
row of the scored text, scoring is one matrix product per batch of texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.llm.common import arrow

ORDER = 3
CLASSES = 64  # letter classes: 0 is what is no letter
SIZE = CLASSES + CLASSES ** 2 + CLASSES ** 3
SAMPLE = 3000  # labelled texts that the model is fitted on
LANDMARKS = 256
RIDGE = 1e-3
BATCH = 128

_TABLE: list[np.ndarray] = []


def letter_classes() -> np.ndarray:
    """Class of every code point: 1-26 for a-z, 27-63 for other letters, 0 for the rest."""
    if not _TABLE:
        codes = np.arange(0x110000)
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        table = np.where(letter, 27 + codes % 37, 0).astype(np.int32)
        table[97:123] = np.arange(1, 27)
        _TABLE.append(table)
    return _TABLE[0]


def ngrams(text: str | None) -> np.ndarray:
    """Sorted codes of the distinct n-grams of a whole text, in lower case; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letter_classes()[points]
    if not c.any():
        return np.zeros(0, np.int32)
    seen = np.zeros(SIZE, bool)
    seen[c] = True
    two = c[:-1] * CLASSES + c[1:]
    seen[CLASSES + two] = True
    seen[CLASSES + CLASSES ** 2 + two[:-1] * CLASSES + c[2:]] = True
    seen[0] = False
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """n-gram columns, their weight per language, and the languages in order."""

    column: np.ndarray
    weights: np.ndarray
    langs: list[str]

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per n-gram set and one column per language, by a matrix product."""
        rows = np.zeros((len(sets), self.weights.shape[0]), np.float32)
        for i, codes in enumerate(sets):
            at = self.column[codes]
            rows[i, at[at >= 0]] = 1
        size = np.sqrt(np.maximum(1, [len(s) for s in sets]))
        return (rows @ self.weights) / size[:, None]


def fit(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nystroem features; every language against the rest.

    The first `landmarks` sets, taken in turn from the languages, are the landmarks.
    """
    names = sorted(set(langs))
    turn: dict[str, int] = {}
    order = sorted(range(len(sets)), key=lambda i: (turn.__setitem__(langs[i], turn.get(langs[i], 0) + 1) or turn[langs[i]], langs[i]))
    marks = order[:landmarks]
    used = np.unique(np.concatenate([sets[i] for i in marks])) if marks else np.zeros(0, np.int32)
    column = np.full(SIZE, -1, np.int32)
    column[used] = np.arange(len(used))

    def rows(which: list[int]) -> np.ndarray:
        out = np.zeros((len(which), len(used)), np.float32)
        for r, i in enumerate(which):
            at = column[sets[i]]
            out[r, at[at >= 0]] = 1 / np.sqrt(len(sets[i]))
        return out

    base = rows(marks)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > 1e-6 * max(values.max(initial=0), 1e-12)
    to_features = vectors[:, good] / np.sqrt(values[good])
    gram, cross = np.zeros((good.sum(), good.sum())), np.zeros((good.sum(), len(names)))
    for start in range(0, len(sets), 512):
        which = list(range(start, min(start + 512, len(sets))))
        psi = (rows(which) @ base.T).astype(np.float64) @ to_features
        target = np.where(np.array([[langs[i] == n for n in names] for i in which]), 1.0, -1.0)
        gram += psi.T @ psi
        cross += psi.T @ target
    solved = np.linalg.solve(gram + ridge * len(sets) * np.eye(len(gram)), cross)
    return Model(column, (base.T.astype(np.float64) @ (to_features @ solved)).astype(np.float32), names)


def blank() -> Model:
    """A model of one unnamed language, fitted on nothing: it only tells texts with letters from others."""
    return Model(np.full(SIZE, -1, np.int32), np.zeros((0, 1), np.float32), [""])


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on the labelled, not held-out rows: at most `sample` of them, those with the smallest
    hash of the key. Only their n-gram sets reach the driver. None if there is no such row.
    """
    rows = docs.where(F.col(lang).isNotNull() & ~held_out(F.coalesce(F.col(key).cast("string"), F.lit("")))).select(
        F.col(key).alias("k"), F.col(lang).alias("l"))
    picked = rows.select("k").orderBy(F.xxhash64("k"), "k").limit(sample)
    chosen = docs.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).where("l is not null").join(F.broadcast(picked.distinct()), "k", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [ngrams(t.as_py()).astype("<i4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(codes, pa.binary())], ["k", "l", "c"])

    got = arrow(chosen.select(F.col("k").cast("string").alias("k"), "l", "t"), run, "k string, l string, c binary").limit(4 * sample).collect()
    got = sorted((r["k"] or "", r["l"], bytes(r["c"])) for r in got if len(r["c"]))
    got = sorted(got, key=lambda r: zlib.crc32(r[0].encode()))
    return fit([np.frombuffer(c, "<i4") for _, _, c in got], [x for _, x, _ in got], landmarks) if got else None


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: bool = False,
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(key, lang_pred, score 0 to 1) of every row, or with `keep` all columns of the row and these two.

    Texts that are null or have no letter get `und` and score 0; so does every text if there was
    nothing to learn from. Equal scores go to the first language by name. `names` are the names of
    the two result columns; columns of `docs` that have them are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(*names) if keep else docs.select(key, text)
    if keep and text not in rows.columns:
        raise ValueError(f"{text} cannot be one of the result columns")
    place = rows.columns.index(text)
    carried = [i for i in range(len(rows.columns)) if keep or i != place]
    schema = T.StructType([*[rows.schema.fields[i] for i in carried], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            picked: list[str] = []
            scores: list[float] = []
            for start in range(0, len(batch), BATCH):
                sets = [ngrams(t.as_py()) for t in batch.column(place).slice(start, BATCH)]
                if model is None:
                    picked, scores = picked + ["und"] * len(sets), scores + [0.0] * len(sets)
                    continue
                values = model.scores(sets)
                best = values.argmax(axis=1)
                for i, codes in enumerate(sets):
                    picked.append(model.langs[best[i]] if len(codes) else "und")
                    scores.append(float(np.clip((values[i, best[i]] + 1) / 2, 0, 1)) if len(codes) else 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in carried], pa.array(picked, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return arrow(rows, run, schema)
