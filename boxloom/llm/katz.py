"""Katz backoff language model over words.

    P(w | h) = d(c) c(h, w) / c(h)          if c = c(h, w) > 0
             = alpha(h) P(w)                otherwise

d is the Good-Turing discount of counts up to 5 (1 above), P(w) the additive base distribution
(c(w) + 1/2) / (N + (V + 1) / 2), where all unknown words are one more word. alpha(h) is what the
discounts leave, over the base probability of the words not seen after h, so every P(. | h) sums
to one. A history whose counts are not discounted counts one event more; one that every class
follows is not backed off, and its discounted counts are divided by their own sum.

Every training word is a word and a history of its own. The most frequent ones, at most `FREQUENT`
(words of the lowest count that no longer fits are left out together), go to every executor with
their counts as a short cut; the others are rare, and known by their hash where they are bucketed.

Tables: `words` (hash, count) of all training words, `pairs`, one row per frequent history and bucket
with its frequent words and counts, and `rare`, the pairs with a rare word or history in packed
blocks. A pair with a rare word is in the bucket of the word, which so knows the count of the word; one
with a rare history is in the bucket of the history, which knows its sums and backoff weight; with both
rare it is in both. Texts are scored where the pairs are: tokens go to the buckets of their pair in
packed blocks, and the sums per text come back. Where both are rare, the bucket of the history gives
the discounted share or the backoff weight and the bucket of the word the base probability if the pair
is not there; both see it. Pairs of a frequent history are spread over all buckets; pairs that make up
more than a 4096th of all tokens are scored where the text is read.

With `most` a caller limits the model itself to so many words. All others are then one class, whose
base probability is all that is left; inside it a word has its share of the base distribution.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from boxloom.llm.common import arrow, spread, stored

FREQUENT = 1 << 18  # words that go to every executor; results do not depend on it
KNOWN_TO = 5  # counts up to this one are discounted
BUCKET_TOKENS = 4_000_000
BLOCK_TOKENS = 2_500_000
HEAVY_PAIRS = 4096
END = b"\n"  # no word holds it
START = b" "


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def tokens(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], "<i8").tobytes()
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"" for a in arrays)
    return head + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    count = int(np.frombuffer(data, "<i8", 1)[0])
    shape = np.frombuffer(data, "<i8", 2 * count, 8).reshape(-1, 2)
    planes = zstandard.ZstdDecompressor().decompress(data[8 + 16 * count:], max_output_size=max(1, int((shape[:, 0] * shape[:, 1]).sum())))
    out, at = [], 0
    for (n, width), kind in zip(shape.tolist(), kinds):
        part = np.frombuffer(planes, np.uint8, n * width, at).reshape(width, n).T
        out.append(np.ascontiguousarray(part).view(kind).ravel() if n else np.zeros(0, kind))
        at += n * width
    return out


@dataclass
class Words:
    """What every executor gets: frequent words by hash, base probabilities, and how pairs are dealt."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    texts: int  # training texts
    buckets: int
    pooled: bool = False  # the other words are one class of the model

    def __post_init__(self):
        self.rest = len(self.hashes)  # the class of other words
        self.start = self.rest + 1
        self.scale = self.total + 0.5 * (self.distinct + 1)
        base = (self.counts + 0.5) / self.scale
        self.base = np.concatenate([base, [max(1 - base.sum(), 0.5 / self.scale)]])
        others = max(0, self.total - int(self.counts.sum()))
        often = np.concatenate([self.counts, [others, self.texts]])
        self.spread = often > BUCKET_TOKENS // 4

    def base_of(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / self.scale

    def home(self, hashes: np.ndarray) -> np.ndarray:
        """Buckets of rare words and histories."""
        return (_mix(hashes.view(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        found = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        return np.where(found, at, self.rest)

    def bucket(self, pairs: np.ndarray) -> np.ndarray:
        history = pairs >> np.uint64(32)
        return (_mix(np.where(self.spread[history.astype(np.int64)], pairs, history)) % np.uint64(self.buckets)).astype(np.int64)


class _Coder:
    """Classes and hashes of the words of texts; each distinct word is looked up once while there is room."""

    def __init__(self, words: Words, limit: int = 300_000):
        self.words, self.limit = words, limit
        self.place: dict[bytes, int] = {}
        self.classes, self.hashes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def codes(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        units = tokens(text)
        new = [u for u in set(units) if u not in self.place]
        if new:
            if len(self.place) > self.limit:
                self.place.clear()
                self.classes, self.hashes = np.zeros(0, np.int64), np.zeros(0, np.int64)
                new = list(set(units))
            first = len(self.place)
            self.place |= {u: first + i for i, u in enumerate(new)}
            if len(self.place) > len(self.classes):
                grown = np.zeros(max(1024, 2 * len(self.place)), np.int64)
                for name in ("classes", "hashes"):
                    old = getattr(self, name)
                    copy = grown.copy()
                    copy[:len(old)] = old
                    setattr(self, name, copy)
            hashes = np.fromiter(map(word_hash, new), np.int64, len(new))
            self.hashes[first:first + len(new)] = hashes
            self.classes[first:first + len(new)] = self.words.ids(hashes)
        at = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))
        return self.classes[at], self.hashes[at]


def _pairs(classes: np.ndarray, start: int) -> np.ndarray:
    histories = np.concatenate([[start], classes[:-1]]).astype(np.uint64)
    return (histories << np.uint64(32)) | classes.astype(np.uint64)


def _rare_pairs(classes: np.ndarray, hashes: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where a word or its history is rare: the places, the hashes of the history and the word, and the class of the history."""
    before = np.concatenate([[words.start], classes[:-1]])
    at = np.flatnonzero((classes == words.rest) | (before == words.rest))
    return at, np.concatenate([[word_hash(START)], hashes[:-1]])[at], hashes[at], before[at]


def _sum_rows(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (first, second) in order with their counts added up."""
    order = np.lexsort((second, first))
    first, second, counts = first[order], second[order], counts[order]
    at = _starts(first, second)
    return first[at], second[at], np.add.reduceat(counts, at) if len(at) else counts


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    changed = np.zeros(len(columns[0]), bool)
    changed[0] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def _small(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many counts of every run are 1 to 6; runs start at `at`."""
    return np.stack([np.add.reduceat((counts == r).astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for r in range(1, KNOWN_TO + 2)], axis=1)


def count_words(docs: DataFrame, text: str = "text", room: int = 500_000) -> DataFrame:
    """(hash, count) of all tokens of the rows, counted in the tasks first."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter(map(word_hash, held), np.int64, len(held))
            out = pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(held.values()), pa.int64())], ["hash", "count"])
            held.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                held.update(tokens(value.as_py()))
                if len(held) > room:
                    yield flush()
        yield flush()

    return arrow(docs.select(text), run, "hash bigint, count bigint").groupBy("hash").agg(F.sum("count").alias("count"))


def vocabulary(words: DataFrame, texts: int, most: int = FREQUENT, pooled: bool = False) -> tuple[Words, int]:
    """The words that go to the executors, and their lowest count. At most `most` words are collected."""
    sizes = words.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).toArrow()  # one row per distinct count
    counts, n = sizes["count"].to_numpy(), sizes["n"].to_numpy()
    total, distinct = int((counts * n).sum()), int(n.sum())
    fits = np.flatnonzero(np.cumsum(n) <= most)
    least = int(counts[fits[-1]]) if len(fits) else (int(counts[0]) + 1 if len(counts) else 1)
    top = words.where(F.col("count") >= least).toArrow()
    hashes, kept = top["hash"].to_numpy(), top["count"].to_numpy()
    order = np.argsort(hashes)
    return Words(hashes[order], kept[order], total, distinct, texts, max(1, -(-total // BUCKET_TOKENS)), pooled), least


_PAIRS = "kind int, bucket int, history bigint, words array<int>, counts array<bigint>, n array<bigint>, total bigint, over bigint, seen double, block binary"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
_NAMES = [c.split()[0] for c in _PAIRS.split(", ")]
BY_WORD, BY_HISTORY, SUMS, FREQUENT_PAIRS = range(4)


def _rows(count: int, **columns) -> pa.Table:
    return pa.table([pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(count, t)) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def count_pairs(docs: DataFrame, words, text: str = "text") -> DataFrame:
    """Training pairs by kind.

    FREQUENT_PAIRS: one row per frequent history and bucket: words, counts, how many counts are 1 to 6, and the sums
    that alpha needs. BY_WORD: a block (word, history, count) with the pairs of the rare words of a bucket. BY_HISTORY:
    blocks (history, word, count, count of the word) of rare histories, several a bucket. SUMS: the sums of a frequent
    history over its rare words.
    """
    names = ["bucket", "kind", "block"]

    def deal(kind: int, home: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(home, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            if len(part):
                values = [c[part] for c in columns]
                if kind == FREQUENT_PAIRS:
                    values[0] = np.diff(values[0], prepend=np.uint64(0))
                yield pa.RecordBatch.from_arrays([pa.array([int(home[part[0]])], pa.int32()), pa.array([kind], pa.int32()), pa.array([pack(*values)], pa.binary())], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        coder = _Coder(known)
        held, size, ready, ready_n, kept = [], 0, [], [], 0
        rare: list[tuple] = []
        rare_size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            if ready:
                keys, sums = np.concatenate(ready), np.concatenate(ready_n)
                ready.clear()  # what is joined is not held twice
                ready_n.clear()
                keys, sums = _sum_by(keys, sums)
                yield from deal(FREQUENT_PAIRS, known.bucket(keys), keys, sums)

        def emit_rare() -> Iterator[pa.RecordBatch]:
            if rare:
                history, word, _, after = (np.concatenate(x) for x in zip(*rare))
                rare.clear()
                by_word = after == known.rest
                w, h, n = _sum_rows(word[by_word], history[by_word], np.ones(int(by_word.sum()), np.int64))
                yield from deal(BY_WORD, known.home(w), w, h, n)
                h, w, n = _sum_rows(history[~by_word], word[~by_word], np.ones(int((~by_word).sum()), np.int64))
                yield from deal(BY_HISTORY, known.home(h), h, w, n)

        def fold() -> None:
            nonlocal held, size, kept
            if size:
                keys, n = np.unique(np.concatenate(held), return_counts=True)
                ready.append(keys)
                ready_n.append(n.astype(np.int32))
                kept += len(keys)
                held, size = [], 0

        for batch in batches:
            for value in batch.column(0):
                classes, hashes = coder.codes(value.as_py())
                found = _pairs(classes, known.start)
                if not known.pooled:
                    at, history, word, before = _rare_pairs(classes, hashes, known)
                    if len(at):
                        found = np.delete(found, at)
                        rare.append((history, word, before, classes[at]))
                        rare_size += len(at)
                held.append(found)
                size += len(found)
                if size > BLOCK_TOKENS // 4:
                    fold()
                    if kept > BLOCK_TOKENS:
                        yield from emit()
                        ready, ready_n, kept = [], [], 0
                if rare_size > BLOCK_TOKENS // 4:
                    yield from emit_rare()
                    rare, rare_size = [], 0
        fold()
        yield from emit()
        yield from emit_rare()

    def merge(blocks: pa.Table) -> pa.Table:
        known = words.value
        bucket = blocks["bucket"][0].as_py()
        out = []
        for kind, parts in _by_kind(blocks):
            if kind == FREQUENT_PAIRS:
                out.append(frequent(bucket, [unpack(p, "<u8", "<i8") for p in parts], known))
                continue
            a, b, n = _sum_rows(*(np.concatenate(c) for c in zip(*[unpack(p, "<i8", "<i8", "<i8") for p in parts])))
            if kind == BY_WORD:
                out += by_word(bucket, a, b, n, known)
            else:  # the words are frequent
                out.append(_rows(1, kind=[BY_HISTORY], bucket=[bucket], block=[pack(a, b, n, known.counts[known.ids(b)])]))
        return pa.concat_tables(out)

    def frequent(bucket: int, parts: list, known: Words) -> pa.Table:
        keys, counts = _sum_by(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts]))
        history, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int32)
        first = _starts(history)
        ends = np.concatenate([first, [len(keys)]])
        sums = lambda x: np.add.reduceat(x, first)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        return _rows(len(first), kind=np.full(len(first), FREQUENT_PAIRS, np.int32), bucket=np.full(len(first), bucket, np.int32), history=history[first], words=lists(word), counts=lists(counts),
                     n=_lists(_small(counts, first)), total=sums(counts), over=sums(np.where(counts > KNOWN_TO, counts, 0)), seen=sums(known.base[word]))

    def by_word(bucket: int, word: np.ndarray, history: np.ndarray, n: np.ndarray, known: Words) -> list[pa.Table]:
        """The pairs of rare words; those with a rare history also go to its bucket, sums of frequent ones to the driver."""
        out = [_rows(1, kind=[BY_WORD], bucket=[bucket], block=[pack(word, history, n)])]
        first = _starts(word)
        count = np.repeat(np.add.reduceat(n, first), np.diff(np.concatenate([first, [len(word)]])))
        classes = np.where(history == word_hash(START), known.start, known.ids(history))
        at = np.flatnonzero(classes == known.rest)
        home = known.home(history[at])
        order = np.argsort(home, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            if len(part):
                p = at[part]
                out.append(_rows(1, kind=[BY_HISTORY], bucket=[int(home[part[0]])], block=[pack(history[p], word[p], n[p], count[p])]))
        at = np.flatnonzero(classes != known.rest)
        if len(at):
            at = at[np.argsort(classes[at], kind="stable")]
            first = _starts(classes[at])
            sums = lambda x: np.add.reduceat(x, first)
            out.append(_rows(len(first), kind=np.full(len(first), SUMS, np.int32), bucket=np.full(len(first), bucket, np.int32), history=classes[at][first], n=_lists(_small(n[at], first)),
                             total=sums(n[at]), over=sums(np.where(n[at] > KNOWN_TO, n[at], 0)), seen=sums(known.base_of(count[at]))))
        return out

    return arrow(docs.select(text), run, "bucket int, kind int, block binary").groupBy("bucket").applyInArrow(merge, _PAIRS)


def rare_histories(pairs: DataFrame, words) -> DataFrame:
    """One row per bucket with the pairs of its rare histories and their sums; n are the counts of counts of all of them."""
    def merge(blocks: pa.Table) -> pa.Table:
        known = words.value
        h, w, n, c = (np.concatenate(x) for x in zip(*[unpack(p.as_py(), "<i8", "<i8", "<i8", "<i8") for p in blocks["block"]]))
        order = np.lexsort((w, h))  # a pair is there once: its word is rare or not
        h, w, n, c = h[order], w[order], n[order], c[order]
        first = _starts(h)
        sums = lambda x: np.add.reduceat(x, first)
        small = _small(n, first)
        block = pack(h, w, n, h[first], sums(n), sums(np.where(n > KNOWN_TO, n, 0)), sums(known.base_of(c)), *[np.ascontiguousarray(small[:, r]) for r in range(KNOWN_TO)])
        return _rows(1, kind=[BY_HISTORY], bucket=[blocks["bucket"][0].as_py()], n=[small.sum(axis=0).tolist()], block=[block])

    return pairs.where(F.col("kind") == BY_HISTORY).select("bucket", "block").groupBy("bucket").applyInArrow(merge, _PAIRS)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _by_kind(blocks: pa.Table) -> list[tuple[int, list[bytes]]]:
    kinds, parts = blocks["kind"].to_pylist(), blocks["block"].to_pylist()
    return [(k, [p for p, x in zip(parts, kinds) if x == k]) for k in sorted(set(kinds))]


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discounts of counts 1 to 5 from how many pairs have counts 1 to 6; 1 where they give none."""
    out = np.ones(KNOWN_TO + 1)
    if n[0] and n[KNOWN_TO]:
        shared = (KNOWN_TO + 1) * n[KNOWN_TO] / n[0]
        for r in range(1, KNOWN_TO + 1):
            if n[r - 1] and shared < 1:
                d = ((r + 1) * n[r] / (r * n[r - 1]) - shared) / (1 - shared)
                out[r] = d if 0 < d < 1 else 1.0
    return out


@dataclass
class Model:
    """Histories and frequent pairs of a trained model; the other pairs stay in the table."""

    words: Words
    discount: np.ndarray
    total: np.ndarray  # c(h), or one more, by history; 0 if it was not seen
    alpha: np.ndarray
    heavy: np.ndarray  # sorted pairs
    heavy_counts: np.ndarray

    def log_probability(self, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        history, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        d = np.where(counts > KNOWN_TO, 1.0, self.discount[np.minimum(counts, KNOWN_TO)])
        seen = d * counts / np.where(self.total[history] > 0, self.total[history], 1)
        with np.errstate(divide="ignore"):
            return np.log10(np.where(counts > 0, seen, self.alpha[history] * self.words.base[word]))


def _weights(total: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the counts of a history are divided by, and its backoff weight."""
    grown = np.where(total - kept < 1e-9 * total, total + 1.0, total)
    every = 1 - seen < 1e-12  # no class is left to back off to: what is seen shares all
    grown = np.where(every, kept, grown)
    return grown, np.where(every, 0, (1 - kept / grown) / np.maximum(1 - seen, 1e-12))


def finish(words: Words, pairs: DataFrame, rare: DataFrame | None = None) -> Model:
    """Discounts, backoff weights and frequent pairs. One row per frequent history is collected."""
    lists = pairs.where("n IS NOT NULL").select("history", "n", "total", "over", "seen")
    if rare is not None:
        lists = lists.unionByName(rare.select("history", "n", "total", "over", "seen"))
    sums = lists.agg(*[F.sum(F.element_at("n", r + 1)).alias(f"n{r}") for r in range(KNOWN_TO + 1)]).first()
    d = discounts([int(x or 0) for x in sums])
    kept = sum((F.element_at("n", r) * r * float(d[r]) for r in range(1, KNOWN_TO + 1)), F.col("over").cast("double"))
    rows = lists.where("history IS NOT NULL").groupBy("history").agg(F.sum("total").alias("total"), F.sum(kept).alias("kept"), F.sum("seen").alias("seen")).toArrow()
    size = words.start + 1
    total, alpha = np.zeros(size), np.ones(size)
    h, t, k, s = (rows[c].to_numpy() for c in ("history", "total", "kept", "seen"))
    total[h], alpha[h] = _weights(t, k, s)
    often = max(1, words.total // HEAVY_PAIRS)
    top = pairs.where((F.col("kind") == FREQUENT_PAIRS) & (F.col("total") > often)).select("history", F.explode(F.arrays_zip("words", "counts")).alias("p")).where(F.col("p.counts") > often)
    top = top.select("history", "p.words", "p.counts").toArrow()
    keys = (top["history"].to_numpy().astype(np.uint64) << np.uint64(32)) | top["words"].to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    return Model(words, d, total, alpha, keys[order], top["counts"].to_numpy()[order])


def score(docs: DataFrame, model: Model, words: DataFrame, least: int, pairs: DataFrame, key: str = "doc_id", text: str = "text", histories: DataFrame | None = None) -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every whole text; null texts are empty.

    A chunk is what a task reads for one set of blocks. Its texts are numbered, the sums of every
    bucket come back as one packed row per chunk, and they are added up chunk by chunk.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    pooled = model.words.pooled
    buckets = model.words.buckets
    fields = [("bucket", T.IntegerType()), ("chunk", T.LongType()), ("block", T.BinaryType()), ("row", T.LongType()), ("key", docs.schema[key].dataType),
              ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    sent = T.StructType([T.StructField(*f) for f in fields])
    got, out = T.StructType(sent.fields[1:]), T.StructType([T.StructField(key, fields[4][1]), *sent.fields[5:]])
    sent_arrow, got_arrow, out_arrow = (to_arrow_schema(x) for x in (sent, got, out))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        w = m.words
        log_base = np.log10(w.base)
        coder = _Coder(w)
        chunk, size = TaskContext.get().partitionId() << 32, 0
        kept: list[np.ndarray] = []
        rare: list[np.ndarray] = []
        apart: list[tuple] = []  # (history, word, class of the history, class of the word) where one is rare

        def blocks() -> Iterator[pa.RecordBatch]:
            doc = np.repeat(np.arange(len(kept)), [len(p) for p in kept])
            rare_doc = np.repeat(np.arange(len(kept)), [len(p) for p in rare])
            parts = [_deal(np.concatenate(kept), doc, w.bucket), _deal(np.concatenate(rare).view(np.uint64), rare_doc, lambda x: (_mix(x) % np.uint64(buckets)).astype(np.int64))]
            nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            history, word, before, after = (np.concatenate(x) for x in zip(*apart))
            place = np.repeat(np.arange(len(apart)), [len(x[0]) for x in apart])
            roles = [_deal_pairs(word[on], history[on], before[on], place[on], w.home) for on in (after == w.rest,)]
            roles += [_deal_pairs(history[on], word[on], after[on], place[on], w.home) for on in (before == w.rest,)]
            none = (np.zeros(0, np.int64),) * 5
            for b in sorted({*parts[0], *parts[1], *roles[0], *roles[1]}):
                (k, n, d), (rk, rn, rd) = (p.get(b, nothing) for p in parts)
                (wa, wb, wc, wn, wd), (ha, hb, hc, hn, hd) = (r.get(b, none) for r in roles)
                block = pack(np.diff(k, prepend=np.uint64(0)), n.astype("<u4"), np.diff(rk, prepend=np.uint64(0)), rn.astype("<u4"),
                             wa, wb, wc.astype("<u4"), wn.astype("<u4"), ha, hb, hc.astype("<u4"), hn.astype("<u4"), np.concatenate([d, rd, wd, hd]).astype("<u4"))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([b, chunk, block, *[None] * 6], sent_arrow.types)], sent.names)

        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for value in batch.column(1):
                classes, hashes = coder.codes(value.as_py())
                every = _pairs(classes, w.start)
                at_rare, *units = _rare_pairs(classes, hashes, w) if not pooled else (np.zeros(0, np.int64),) * 4
                apart.append((*units, classes[at_rare]))
                other = classes == w.rest
                at = np.searchsorted(m.heavy, every)
                at[at == len(m.heavy)] = 0
                heavy = m.heavy[at] == every if len(m.heavy) else np.zeros(len(every), bool)
                here = m.log_probability(every[heavy], m.heavy_counts[at[heavy]]).sum() if heavy.any() else 0.0
                for column, x in zip(columns, (chunk, len(kept), len(every), int((~other).sum()), float(log_base[classes[~other]].sum()), float(here))):
                    column.append(x)
                heavy[at_rare] = True  # they go apart
                kept.append(every[~heavy])
                rare.append(hashes[other] if pooled else hashes[:0])
                size += len(every) + 4 * len(at_rare)  # what is held of a rare one takes five times the room
                if size > BLOCK_TOKENS:
                    yield from blocks()
                    chunk, size, kept, rare, apart = chunk + 1, 0, [], [], []
            n = len(batch)
            home = (_mix(np.array(columns[0], np.uint64) + np.array(columns[1], np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(columns[0], pa.int64()), pa.nulls(n, pa.binary()), pa.array(columns[1], pa.int64()), batch.column(0),
                                              *[pa.array(c, t) for c, t in zip(columns[2:], sent_arrow.types[5:])]], sent.names)
        if kept:
            yield from blocks()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return got_arrow.empty_table()
        m = shared.value
        w = m.words
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        hashes, hash_counts = keys, counts
        apart = _Apart(m)
        if len(right):
            for kind, parts in _by_kind(right.filter(pc.is_valid(right["block"]))):
                for part in parts:
                    apart.load(kind, part)
            right = right.filter(pc.is_null(right["block"]))
            table, others = right.filter(pc.is_valid(right["words"])), right.filter(pc.is_null(right["words"]))
            if len(table):
                lists = table["words"].combine_chunks()
                sizes = np.diff(lists.offsets.to_numpy())
                keys = (np.repeat(table["history"].to_numpy(), sizes).astype(np.uint64) << np.uint64(32)) | lists.flatten().to_numpy().astype(np.uint64)
                order = np.argsort(keys)
                keys, counts = keys[order], table["counts"].combine_chunks().flatten().to_numpy()[order]
            if len(others):
                hashes = others["history"].to_numpy().view(np.uint64)
                order = np.argsort(hashes)
                hashes, hash_counts = hashes[order], others["total"].to_numpy()[order]
        inside = np.log10(w.base[w.rest])
        chunks, sums = [], []
        texts = left.filter(pc.is_null(left["block"]))
        blocks = left.filter(pc.is_valid(left["block"]))
        for chunk, block in zip(blocks["chunk"].to_pylist(), blocks["block"]):
            k, n, rk, rn, *units, at = unpack(block.as_py(), "<u8", "<u4", "<u8", "<u4", *("<i8", "<i8", "<u4", "<u4") * 2, "<u4")
            k, rk = np.cumsum(k, dtype=np.uint64), np.cumsum(rk, dtype=np.uint64)
            logs = m.log_probability(k, _find(keys, counts, k))
            c = _find(hashes, hash_counts, rk)
            base = np.log10((c + 0.5) / w.scale)
            wn, hn = units[3], units[7]
            word_counts, word_logs = apart.of_words(*units[:3])
            word_base = np.log10(w.base_of(word_counts))
            size, split = int(at.max()) + 1, int(n.sum())
            first, second = split + int(rn.sum()), split + int(rn.sum()) + int(wn.sum())
            of_rare, of_word, of_history = at[split:first], at[first:second], at[second:]
            add = lambda where, values, times: np.bincount(where, np.repeat(values, times), size)  # noqa: B023, E731
            total = add(at[:split], logs, n) + add(of_rare, base - inside, rn) + add(of_word, word_logs, wn) + add(of_history, apart.of_histories(*units[4:7]), hn)
            known = add(of_rare, (c > 0).astype(float), rn) + add(of_word, (word_counts > 0).astype(float), wn)
            bases = add(of_rare, base, rn) + add(of_word, word_base, wn)
            used = np.unique(at)
            chunks.append(chunk)
            sums.append(pack(used, known[used].astype("<u4"), bases[used], total[used]))
        nulls = [pa.nulls(len(sums), t) for t in got_arrow.types[2:]]
        packed = pa.table([pa.array(chunks, pa.int64()), pa.array(sums, pa.binary()), *nulls], schema=got_arrow)
        return pa.concat_tables([texts.select(got.names).cast(got_arrow), packed])

    def add_up(chunk: pa.Table) -> pa.Table:
        texts = chunk.filter(pc.is_null(chunk["block"])).sort_by("row")
        known, base, total = (texts[c].to_numpy().astype(float) for c in ("n_known", "base_score", "score"))
        for block in chunk.filter(pc.is_valid(chunk["block"]))["block"]:
            used, k, b, t = unpack(block.as_py(), "<u4", "<u4", "<f8", "<f8")
            known[used] += k
            base[used] += b
            total[used] += t
        return pa.table([texts["key"], texts["n_tokens"], pa.array(known.astype(np.int64)), pa.array(base), pa.array(total)], schema=out_arrow)

    left = arrow(docs.select(key, text), run, sent)
    nothing = F.lit(None)
    names = ["bucket", "history", "words", "counts", "total", "kind", "block"]
    right = pairs.where(F.col("kind").isin(FREQUENT_PAIRS, BY_WORD)).select(*names)
    if pooled:
        rare = arrow(words.where(F.col("count") < least).select("hash", "count"), _home(buckets), "bucket int, history bigint, total bigint")
        right = right.union(rare.select("bucket", "history", nothing.cast("array<int>"), nothing.cast("array<bigint>"), "total", nothing.cast("int"), nothing.cast("binary")))
    elif histories is not None:
        right = right.union(histories.select(*names))
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(meet, got).groupBy("chunk").applyInArrow(add_up, out)


class _Apart:
    """The pairs of a bucket that have a rare word or history, and what they give to the score of a token."""

    def __init__(self, model: Model):
        self.model = model
        ints, floats = np.zeros(0, np.uint64), np.zeros(0)
        self.words, self.word_counts, self.by_word, self.by_word_counts = ints, ints, ints, ints
        self.histories, self.by_history, self.by_history_counts, self.total, self.alpha = ints, ints, ints, floats, floats

    def load(self, kind: int, block: bytes) -> None:
        if kind == BY_WORD:
            word, history, n = unpack(block, "<i8", "<i8", "<i8")
            first = _starts(word)
            self.words, self.word_counts = word[first], np.add.reduceat(n, first)
            self.by_word, self.by_word_counts = _sum_by(_pair_key(word, history), n)
            return
        h, w, n, self.histories, total, over, seen, *small = unpack(block, *["<i8"] * 6, "<f8", *["<i8"] * KNOWN_TO)
        self.by_history, self.by_history_counts = _sum_by(_pair_key(h, w), n)
        kept = over + sum(x * (r + 1) * self.model.discount[r + 1] for r, x in enumerate(small))
        self.total, self.alpha = _weights(total.astype(float), kept, seen)

    def _discounted(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > KNOWN_TO, 1.0, self.model.discount[np.minimum(counts, KNOWN_TO)]) * counts

    def of_words(self, word: np.ndarray, history: np.ndarray, history_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of rare words, and the share of the score: all of it after a frequent history, else the base of an unseen pair."""
        m = self.model
        counts = _find(self.words, self.word_counts, word)
        n = _find(self.by_word, self.by_word_counts, _pair_key(word, history))
        base = m.words.base_of(counts)
        total = m.total[history_class]
        with np.errstate(divide="ignore"):
            whole = np.log10(np.where(n > 0, self._discounted(n) / np.where(total > 0, total, 1), m.alpha[history_class] * base))
        return counts, np.where(history_class != m.words.rest, whole, np.where(n > 0, 0.0, np.log10(base)))

    def of_histories(self, history: np.ndarray, word: np.ndarray, word_class: np.ndarray) -> np.ndarray:
        """The share of the score of rare histories: of the base of an unseen pair only what is frequent."""
        m = self.model
        n = _find(self.by_history, self.by_history_counts, _pair_key(history, word))
        total, alpha = np.ones(len(history)), np.ones(len(history))
        if len(self.histories):
            at = np.searchsorted(self.histories, history)
            at[at == len(self.histories)] = 0
            here = self.histories[at] == history
            total, alpha = np.where(here, self.total[at], 1.0), np.where(here, self.alpha[at], 1.0)
        base = np.where(word_class != m.words.rest, m.words.base[word_class], 1.0)
        with np.errstate(divide="ignore"):
            return np.log10(np.where(n > 0, self._discounted(n) / total, alpha * base))


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a.view(np.uint64)) + b.view(np.uint64)


def _home(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False)
            home = (_mix(hashes.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(home), batch.column(0), batch.column(1)], ["bucket", "history", "total"])

    return run


def _find(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, counts[at], 0)


def _deal(keys: np.ndarray, doc: np.ndarray, bucket) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By bucket: distinct keys in order, how often each occurs, and the documents of the occurrences."""
    if not len(keys):
        return {}
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(keys)]]))
    home = bucket(keys[first])
    by = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[by])) + 1
    return {int(home[p[0]]): (keys[first[p]], sizes[p], doc[spread(sizes[p], first[p])]) for p in np.split(by, cuts)}


def _deal_pairs(first: np.ndarray, second: np.ndarray, kind: np.ndarray, doc: np.ndarray, home) -> dict[int, tuple[np.ndarray, ...]]:
    """By bucket of `first`: distinct (first, second, kind), how often each occurs, and the documents of the occurrences."""
    if not len(first):
        return {}
    order = np.lexsort((second, first))
    first, second, kind, doc = first[order], second[order], kind[order], doc[order]
    at = _starts(first, second)
    sizes = np.diff(np.concatenate([at, [len(first)]]))
    bucket = home(first[at])
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    return {int(bucket[p[0]]): (first[at[p]], second[at[p]], kind[at[p]], sizes[p], doc[spread(sizes[p], at[p])]) for p in np.split(by, cuts)}


def katz_scores(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", most: int | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Train on the rows that are not held out and score all: (key, n_tokens, n_known, train_tokens,
    base_score, score). Null texts are empty; without training rows every word is unknown. `most`
    limits the words of the model; `frequent` only those that are sent to every executor.
    """
    spark = docs.sparkSession
    train = docs.where(~held)
    words = stored(count_words(train, text), "words")
    known, least = vocabulary(words, train.count(), frequent if most is None else most, most is not None)
    shared = spark.sparkContext.broadcast(known)
    pairs = stored(count_pairs(train, shared, text), "pairs")
    histories = None if known.pooled else stored(rare_histories(pairs, shared), "histories")
    model = finish(known, pairs, histories)
    return score(docs, model, words, least, pairs, key, text, histories).withColumn("train_tokens", F.lit(known.total).cast("bigint"))
