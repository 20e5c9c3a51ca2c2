"""Benchmark decontamination with an FM-index per shard of training text.

A shard is one Arrow batch of documents. Its index text holds the words that occur in the
benchmark as symbols; every other word is a separator. Runs of symbols shorter than the
shortest phrase cannot hold an occurrence and stay out of the index. Phrases are found by
backward search through the ranks of a wavelet matrix over the Burrows-Wheeler transform,
occurrences are located by walking back to sampled suffix positions, and their word spans
are merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import arrow, spread

WINDOW = 13
SAMPLE = 8  # every so many text positions one suffix position is kept
PHRASE_BYTES = 16 << 20  # benchmark text that is sent to the executors at a time

# every byte that is no word byte becomes a space, A-Z becomes a-z
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are put in lower case; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Bits:
    """A bit vector with a rank directory: ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        part = self.words[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[word] + np.bitwise_count(part)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """Wavelet matrix over symbols 0 .. size - 1: rank and access in one step per bit."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level) & 1 == 1
            self.levels.append((Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[k] before position i[k]."""
        start = np.zeros_like(i)
        for (bits, zeros), level in zip(self.levels, range(self.depth - 1, -1, -1)):
            one = (symbol >> level) & 1 == 1
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i[k], and how often it occurs before i[k]."""
        start, symbol = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in self.levels:
            one = bits.get(i)
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
            symbol = symbol * 2 + one
        return symbol, i - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # rank = place of the first of the tie
    k = 1
    while True:
        group = rank[order]
        tied = np.zeros(n, bool)
        tied[1:] |= group[1:] == group[:-1]
        tied[:-1] |= group[:-1] == group[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        sub = order[at]
        after = np.where(sub + k < n, rank[np.minimum(sub + k, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[sub]))
        sub, after = sub[by], after[by]
        order[at] = sub
        head = rank[sub]
        new = np.concatenate([[True], (head[1:] != head[:-1]) | (after[1:] != after[:-1])])
        rank[sub] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        k *= 2


class FMIndex:
    """Backward search and location over symbols 1 .. size - 1; symbol 0 ends the text and occurs nowhere else."""

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE):
        text = np.concatenate([text, [0]]).astype(np.int64)
        self.n = len(text)
        order = suffix_array(text)
        self.bwt = Wavelet(text[order - 1], size)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])[:size].astype(np.int64)
        marked = order % sample == 0
        self.marks, self.sampled = Bits(marked), order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open suffix ranges of phrases of one length, one phrase a row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low[alive] = self.less[symbol] + self.bwt.rank(symbol, low[alive])
            high[alive] = self.less[symbol] + self.bwt.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            hit = self.marks.get(rows[open_])
            done = open_[hit]
            out[done] = self.sampled[self.marks.rank(rows[done])] + steps
            open_ = open_[~hit]
            symbol, rank = self.bwt.symbol_and_rank(rows[open_])
            rows[open_] = self.less[symbol] + rank
            steps += 1
        return out


@dataclass
class Phrases:
    """Distinct windows of benchmark items as symbols, by length, and the items of each window.

    Symbol 1 stands for any other word.
    """

    symbols: dict[bytes, int]
    by_length: dict[int, np.ndarray]
    items: list[list[tuple[str, ...]]]

    @staticmethod
    def of(rows: Iterable[tuple], window: int = WINDOW) -> "Phrases":
        symbols: dict[bytes, int] = {}
        held: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in rows:
            ids = [symbols.setdefault(w, len(symbols) + 2) for w in words(text)]
            size = min(window, len(ids))
            if size and item is not None:
                for at in range(len(ids) - size + 1):
                    held.setdefault(size, {}).setdefault(tuple(ids[at:at + size]), set()).add(str(item))
        return Phrases(symbols, {k: np.array(list(v), np.int64) for k, v in held.items()},
                       [[tuple(sorted(x)) for x in v.values()] for v in held.values()])


def occurrences(batch_words: list[list[bytes]], phrases: Phrases, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(document, first word, length, items) of every occurrence of a phrase in a shard of documents."""
    none = np.zeros(0, np.int64)
    sizes = np.array([len(w) for w in batch_words], np.int64)
    if not phrases.by_length or not sizes.sum():
        return none, none, none, []
    symbol = phrases.symbols.get
    flat = np.fromiter((symbol(w, 1) for ws in batch_words for w in [*ws, b""]), np.int64, int(sizes.sum()) + len(sizes))
    inside = np.concatenate([[0], (flat > 1).view(np.int8), [0]])
    starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    keep = ends - starts >= min(phrases.by_length)
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return none, none, none, []
    at = spread(ends - starts + 1, starts)  # with the separator behind each run
    index = FMIndex(flat[at], len(phrases.symbols) + 2, sample)
    first_word = np.concatenate([[0], np.cumsum(sizes + 1)])
    found: list[tuple[np.ndarray, np.ndarray, int, list]] = []
    for (length, rows), items in zip(phrases.by_length.items(), phrases.items):
        low, high = index.search(rows)
        hit = np.flatnonzero(low < high)
        counts = high[hit] - low[hit]
        where = at[index.locate(spread(counts, low[hit]))]
        doc = np.searchsorted(first_word, where, "right") - 1
        found.append((doc, where - first_word[doc], length, [items[i] for i in np.repeat(hit, counts)]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]),
            np.concatenate([np.full(len(f[0]), f[2]) for f in found]), [x for f in found for x in f[3]])


def merge_spans(first: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Half-open spans that cover the same words, in order and apart from each other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first.tolist(), (first + length).tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_HITS = "n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"


def _scan(docs: DataFrame, key: str, text: str, phrases: Phrases) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 2000) for i in range(0, len(whole), 2000)):
                split = [words(t.as_py()) for t in batch.column(2)]
                doc, first, length, items = occurrences(split, shared.value)
                spans: list[list] = [[] for _ in split]
                named: list[list[str]] = [[] for _ in split]
                order = np.argsort(doc, kind="stable")
                cuts = np.flatnonzero(np.diff(doc[order])) + 1
                for part in np.split(order, cuts) if len(order) else []:
                    d = int(doc[part[0]])
                    spans[d] = [{"first": a, "last": b} for a, b in merge_spans(first[part], length[part])]
                    named[d] = sorted({i for p in part for i in items[p]})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(w) for w in split], pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                     pa.array(named, pa.list_(pa.string()))], [key, "__row", "n_words", "spans", "items"])

    return arrow(docs.select(key, F.xxhash64(text).alias("__row"), text), run, f"`{key}` {kind}, __row bigint, {_HITS}")


def contamination(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """(key, n_words, spans, items): merged word spans of benchmark windows in every document.

    The benchmark is measured first. It is sent to the executors in parts of about `phrase_bytes`
    by the hash of the item; with more than one part the spans of a row are merged afterwards.
    Null or empty documents have no words and no spans; items without words or with a null id
    have no window; an empty benchmark gives no spans. Repeated rows give repeated result rows: every
    part finds the same in equal rows, so they are merged as one, counted, and given out that often.
    """
    items = bench.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-int(total) // phrase_bytes))
    out = None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).collect()
        one = _scan(docs, key, text, Phrases.of(((r["i"], r["t"]) for r in rows), window))
        out = one if out is None else out.union(one)
    if parts > 1:
        apart = F.array_sort(F.flatten(F.collect_set("spans")))

        def join(done, span):
            last = F.element_at(done, -1)
            touches = (F.size(done) > 0) & (span["first"] <= last["last"])
            grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"))))
            return F.when(F.size(done) == 0, F.array(span)).when(touches, grown).otherwise(F.concat(done, F.array(span)))

        out = out.groupBy(key, "__row").agg(F.max("n_words").alias("n_words"), apart.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
                                         (F.count(F.lit(1)) / parts).cast("bigint").alias("__copies"))
        empty = F.array().cast("array<struct<first:bigint,last:bigint>>")
        out = out.withColumn("spans", F.when(F.size("spans") == 0, empty).otherwise(F.aggregate(F.slice("spans", 2, F.greatest(F.size("spans"), F.lit(1))), F.slice("spans", 1, 1), join)))
        out = out.withColumn("__copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies"))).drop("__copies")
    return out.drop("__row")


def verdicts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest of the items and the rule: hit words are a twentieth of all words or more."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return (found.withColumn("n_hit", hit)
            .select(key, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")))


def digest_of(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
