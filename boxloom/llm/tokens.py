"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id and a bitmap that
tells which ids go on; level 1 holds the next chunk of just those, and so on. A rank directory
over each bitmap gives the place of an id's next chunk, so any id is read without decoding its
neighbours.

A file (segment) holds the ids of consecutive documents in ascending order of the key:

    magic "DAC1", documents, ids, levels        4 bytes, three unsigned 64-bit integers
    first id of every document, and the end     documents + 1 unsigned 64-bit integers
    per level: chunks, ones                     two unsigned 64-bit integers
      chunks                                    bytes, padded to 8
      bitmap                                    64-bit words, one more than needed
      directory: ones before each word          unsigned 32-bit integers, padded to 8

All numbers are little-endian. Segments are rows of a Parquet table (part, segment, keys,
content), which any file system that Spark knows can hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from boxloom.llm.common import UnitIds, arrow, text_chunks, work_path

SEGMENT_IDS = 2_000_000  # ids after which a segment is closed
MAGIC = b"DAC1"


def _pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def pack(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """One segment: the ids of documents with `sizes` ids each."""
    rest = ids.astype(np.uint32)
    levels = []
    while True:
        more = rest > 0xFF
        bitmap = np.zeros(len(rest) // 64 + 1, np.uint64)
        bits = np.packbits(more, bitorder="little")
        bitmap.view(np.uint8)[:len(bits)] = bits
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(bitmap), dtype=np.int64)]).astype("<u4")
        levels.append(np.array([len(rest), more.sum()], "<u8").tobytes() + _pad((rest & 0xFF).astype(np.uint8).tobytes())
                      + bitmap.astype("<u8").tobytes() + _pad(before.tobytes()))
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = MAGIC + bytes(4) + np.array([len(sizes), len(ids), len(levels)], "<u8").tobytes()
    return head + np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes() + b"".join(levels)


class Segment:
    """A packed segment; `at` reads ids at any places."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        docs, self.size, levels = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        self.firsts = np.frombuffer(data, "<u8", docs + 1, 32).astype(np.int64)
        place = 32 + 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            count = int(np.frombuffer(data, "<u8", 1, place)[0])
            place += 16
            chunks = np.frombuffer(data, np.uint8, count, place)
            place += count + -count % 8
            words = count // 64 + 1
            bitmap = np.frombuffer(data, "<u8", words, place)
            place += 8 * words
            before = np.frombuffer(data, "<u4", words + 1, place)
            place += 4 * (words + 1) + -(4 * (words + 1)) % 8
            self.levels.append((chunks, bitmap, before))

    def at(self, places: np.ndarray) -> np.ndarray:
        """Ids at `places`, by rank on the bitmaps alone."""
        out = np.zeros(len(places), np.uint32)
        open_, here = np.arange(len(places)), places.astype(np.int64)
        for level, (chunks, bitmap, before) in enumerate(self.levels):
            out[open_] |= chunks[here].astype(np.uint32) << np.uint32(8 * level)
            word, bit = here >> 6, (here & 63).astype(np.uint64)
            value = bitmap[word]
            more = (value >> bit) & np.uint64(1) == 1
            rank = before[word] + np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1)))
            open_, here = open_[more], rank[more].astype(np.int64)
            if not len(open_):
                break
        return out

    def all(self) -> np.ndarray:
        """Every id in order, level by level."""
        out = np.zeros(self.size, np.uint32)
        where: np.ndarray | None = None
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out, where = part, np.arange(self.size)
            else:
                out[where] |= part
            more = np.unpackbits(bitmap.view(np.uint8), count=len(chunks), bitorder="little").view(bool)
            where = where[more]
        return out

    def document(self, number: int) -> np.ndarray:
        return self.at(np.arange(self.firsts[number], self.firsts[number + 1]))


_OPEN: dict[str, UnitIds] = {}


def _encoder(path: str) -> UnitIds:
    """Ids of words between ASCII white space. The pattern of the tokenizer ends every token at
    white space and its normaliser works inside words, so whole texts give the same ids.

    New words are encoded in one text, with a sign between them that none of them holds and that is
    one token; where there is no such sign, the offset of a token tells its word.
    """
    if path not in _OPEN:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        marks = {c: e.ids[0] for c in "|^~`\\{}_<>=+*&%#@$" if len((e := tokenizer.encode(c, add_special_tokens=False)).ids) == 1}

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            texts = [w.decode("utf-8", "replace") for w in words]
            joined = "".join(texts)
            for sign, mark in marks.items():
                if sign not in joined:
                    ids = np.array(tokenizer.encode_batch_fast([f" {sign} ".join(texts)], add_special_tokens=False)[0].ids, np.int32)
                    ends = np.flatnonzero(ids == mark)
                    if len(ends) == len(words) - 1:
                        return np.delete(ids, ends), np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
            found = tokenizer.encode("\n".join(texts), add_special_tokens=False)
            starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            word = np.searchsorted(starts, [o[0] for o in found.offsets], "right") - 1
            return np.array(found.ids, np.int32), np.bincount(word, minlength=len(words))

        _OPEN[path] = UnitIds(encode)
    return _OPEN[path]


def _words(text: str) -> list[bytes]:
    """Words between ASCII white space. A-Z become lower case, as the tokenizer makes them, unless a
    combining mark (U+0300 to U+036F) could join a letter, or a special token could be spelt out.
    """
    data = text.encode("utf-8", "surrogatepass")
    if b"\xcc" not in data and b"\xcd" not in data and b"<|" not in data:
        data = data.lower()
    return data.split()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
                 segment_ids: int = SEGMENT_IDS, partitions: int | None = None) -> None:
    """Write the ids of every whole text, each followed by `end_id`, in ascending order of the key.

    Documents are dealt by ranges of the key and sorted inside; equal keys keep together and are
    ordered by the hash of their text. Null keys come first. Null texts are empty. A range that
    holds many equal keys is as large as they are.
    """
    spark = docs.sparkSession
    key_type = to_arrow_type(docs.schema[key].dataType)
    kind = docs.schema[key].dataType.simpleString()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        store = _encoder(tokenizer)
        keys: list = []
        held_ids: list[np.ndarray] = []
        held_sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            sizes = np.concatenate(held_sizes)
            content = pack(np.concatenate(held_ids), sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([int(sizes.sum())], pa.int64()),
                 pa.array([keys], pa.list_(key_type)), pa.array([content], pa.binary())], ["part", "segment", "n_ids", "keys", "content"])

        for names, texts in text_chunks(batches):
            ids, sizes = store.ids([_words(t) for t in texts])
            ends = np.cumsum(sizes)
            held_ids.append(np.insert(ids, ends, end_id))
            held_sizes.append(sizes + 1)
            keys += names
            if sum(map(len, held_ids)) >= segment_ids:
                yield close()
                number += 1
                keys, held_ids, held_sizes = [], [], []
        if keys:
            yield close()

    rows = (docs.select(key, text).repartitionByRange(n, F.col(key)).sortWithinPartitions(F.col(key), F.xxhash64(text)))
    arrow(rows, run, f"part int, segment int, n_ids bigint, keys array<{kind}>, content binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files alone.

    `start` counts the ids of all documents before. The running value over segments is taken
    inside parts first, then over the totals of the parts.
    """
    files = spark.read.parquet(path)
    kind = files.schema["keys"].dataType.elementType
    totals = files.select("part", "segment", "n_ids")
    before = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("n_ids").alias("n"))
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(first), F.lit(0)).alias("earlier"))
    bases = (totals.withColumn("inside", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
             .join(parts, F.col("part") == F.col("p")).select("part", "segment", (F.col("inside") + F.col("earlier")).alias("base")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                segment = Segment(batch.column(3)[row].as_py())
                sizes = np.diff(segment.firsts)
                n = len(sizes)
                ids = segment.all().astype("<u4", copy=False)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(segment.firsts[:-1], segment.firsts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[row].as_py()] * n, pa.int32()), pa.array([batch.column(1)[row].as_py()] * n, pa.int32()),
                     batch.column(2)[row].values, pa.array(segment.firsts[:-1]), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    ["part", "segment", key, "inside", "n_tokens", "ids_crc32"])

    rows = arrow(
        files.select("part", "segment", "keys", "content"), run, f"part int, segment int, `{key}` {kind.simpleString()}, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(bases, ["part", "segment"]).select(key, (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids under the shared folder and read them back."""
    path = work_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, key, text)
    return read_tokens(docs.sparkSession, path, key)
