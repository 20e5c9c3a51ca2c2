"""Near-duplicate search on 64-bit SimHash fingerprints by deletion-variant signatures.

Fingerprints that differ in at most 4 bits are cut into 3 segments, so at least one segment
differs in at most one bit. Every fingerprint is posted once per bit position: the key is
the segment that holds the position, with that bit wiped out. Two linked fingerprints meet
under at least one key, and every pair that meets is checked on all 64 bits.

Equal segments meet under every key of the segment. So pairs with an equal segment are taken
only under the first position of the segment, and under another position only pairs that
differ in just that bit are compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import arrow, components, stored

SHINGLE, SEED, BITS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, width
BLOCK = 8192  # fingerprints of one key that are compared in one task
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles, repeats included; 0 for a text without words.

    Words are runs of bytes other than space and \\x09-\\x0D, A-Z in lower case. A bit is 1 if
    it is set in over half of the XXH64 values. A text of fewer words is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(words[i:i + width]), seed) for i in range(n)), np.uint64, n)
    parts = hashes.view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp long): the fingerprint of every row; null texts have 0."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], [key, "fp"])

    return arrow(docs.select(key, text), run, f"`{key}` {kind}, fp bigint")


def _keys(fp: Column) -> Column:
    """The 64 one-wildcard keys of a fingerprint: bit position above, what is left of the segment below."""
    out = []
    for first, width in SEGMENTS:
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            out.append(segment.bitwiseAND(F.lit(~(1 << bit))) + F.lit((first + bit) << 32))
    return F.array(*out)


def _meet(x: np.ndarray, others: np.ndarray, position: int, bits: int) -> np.ndarray:
    apart = np.bitwise_count(x ^ others) <= bits
    if position not in {first for first, _ in SEGMENTS}:
        apart &= ((x ^ others) >> np.uint64(position)) & np.uint64(1) == 1
    return apart


def _forest(fps: np.ndarray, position: int, bits: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one key as all their links would."""
    out: list[tuple[int, int]] = []
    rest = fps
    while len(rest) > 1:
        waiting, rest = [rest[0]], rest[1:]
        while waiting and len(rest):
            x = waiting.pop()
            near = _meet(x, rest, position, bits)
            hit = rest[near]
            out += [(int(x), int(h)) for h in hit]
            waiting += list(hit)
            rest = rest[~near]
    return out


def _bucket_links(keys: np.ndarray, fps: np.ndarray, bits: int, small: int = 16) -> np.ndarray:
    """Links between fingerprints of equal keys; `keys` is sorted. Small keys all at once, others one by one."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    first = np.isin(keys >> 32, [f for f, _ in SEGMENTS])
    found: list[np.ndarray] = []
    little = np.repeat(sizes <= small, sizes)
    for step in range(1, small):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & little[step:])
        if not len(at):
            break
        x, y = fps[at], fps[at + step]
        near = np.bitwise_count(x ^ y) <= bits
        near &= first[at] | (((x ^ y) >> (keys[at] >> 32).astype(np.uint64)) & np.uint64(1) == 1)
        found.append(np.stack([x[near], y[near]], axis=1))
    for b in np.flatnonzero(sizes > small):
        s = slice(starts[b], starts[b] + sizes[b])
        if pairs := _forest(fps[s], int(keys[starts[b]] >> 32), bits):
            found.append(np.array(pairs, np.uint64))
    links = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
    return np.unique(np.sort(links.view(np.int64), axis=1), axis=0)


def _link_tasks(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            links = _bucket_links(keys, fps.view(np.uint64), bits)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])

        for batch in batches:
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if held and last == 0 and held[-1][0][-1] == keys[0]:
                held.append((keys, fps))  # all of one key
                continue
            held.append((keys[:last], fps[:last]))
            yield done(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))
            held = [(keys[last:], fps[last:])]
        if held:
            yield done(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    return run


def fingerprint_links(distinct: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(u, v) links between the distinct fingerprints `fp`, enough to give every component.

    Keys of more than `block` fingerprints are cut into blocks, and every pair of blocks is a
    task of its own, so no task holds more than about two blocks of one key.
    """
    variants = distinct.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp").repartition("key")
    heavy = variants.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    heavy = stored(heavy, "keys")
    light = variants.join(heavy, "key", "left_anti").sortWithinPartitions("key")
    links = arrow(light, _link_tasks(bits), "u bigint, v bigint")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    cut = (variants.join(heavy, "key").select("key", "fp", F.explode(blocks).alias("pair"))
           .repartition("key", "pair").sortWithinPartitions("key", "pair").select("key", "fp", "pair.i", "pair.j"))
    return links.union(arrow(cut, _cut_tasks(bits), "u bigint, v bigint")).distinct()


def _cut_tasks(bits: int):
    inner = _link_tasks(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int, int], list[np.ndarray]] = {}

        def flush(keep=None):
            for k in [k for k in parts if k != keep]:
                fps = np.concatenate(parts.pop(k))
                yield from inner([pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), k[0])), pa.array(fps)], ["key", "fp"])])

        for batch in batches:
            keys, fps, i, j = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(keys) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                parts.setdefault((int(keys[a]), int(i[a]), int(j[a])), []).append(fps[a:b].copy())
            yield from flush(next(reversed(parts)))
        yield from flush()

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(key, fingerprint hex, component_id): every row with the smallest key of its component.

    Texts with an equal fingerprint are one node. Null and empty texts have fingerprint zero and
    are linked like any other. Rows with a null key take part; a component of null keys only has
    a null component_id. Repeated rows give repeated result rows.
    """
    fps = stored(fingerprints(docs, key, text), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp"), bits, block))
    roots = roots.join(nodes, roots["node"] == nodes["fp"])
    smallest = roots.groupBy("root").agg(F.min("first").alias("smallest"))
    linked = roots.join(smallest, "root").select("fp", "smallest")
    # written, so that the last join has a plain exchange on both sides and its hot rows can be split
    labels = stored(nodes.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id")), "labels")
    return fps.join(labels, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
