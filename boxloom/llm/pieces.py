"""SentencePiece encoding and decoding with one forward pass over a trie of marked words.

A text is marked (spaces become U+2581, one is put in front) and cut into units: a run of marks
with the word behind it, and before signs that no piece joins to what stands before. No piece
crosses the end of a unit, so units are encoded on their own. The distinct units of a block of documents are sorted
and walked depth-first as a trie: forward values of a common prefix are computed once and reused
by every unit below it.

- Unigram models: the forward value is the best score of a prefix, and the path is the usual
  Viterbi path.
- BPE models: their scores are merge ranks, and the path with the best sum of scores is not what
  the merges give. The forward value is therefore zero or minus infinity: a path counts if any two
  neighbouring pieces stay apart when their joined text is merged alone. Exactly one such path ends
  at every prefix; it is the one that merging gives. Units that begin with several marks hold pieces
  of equal rank, where this is not sure, and are merged directly.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxloom.llm.common import UnitIds, arrow, text_chunks

MARK = "▁"
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ʯ"  # of the scripts whose words carry signs at their end
_LETTER = re.compile(f"[{_LETTERS}]")
UNKNOWN_PENALTY = 10.0  # a character without a piece scores this much less than the worst piece


@dataclass
class Vocabulary:
    """Pieces with ids and scores. `kind` is "bpe" or "unigram"."""

    ids: dict[str, int]
    scores: dict[str, float]
    kind: str
    unknown: int = 0
    byte_ids: list[int] = field(default_factory=list)
    prefix: bool = True  # put a mark in front of the text

    def __post_init__(self):
        self.longest = max((len(p) for p in self.ids), default=1)
        self.joined = {c for p in self.ids if len(p) > 1 for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses a word mark")
        self.floor = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self._apart: dict[tuple[str, str], bool] = {}
        table = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        table |= {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.bytes_of = [table.get(i, b"") for i in range(max([self.unknown, *table], default=0) + 1)]
        if not self.byte_ids:
            self.bytes_of[self.unknown] = " ⁇ ".encode()
        # signs that no piece holds right behind a letter: a unit ends between the two
        joined = {b for p in self.ids for a, b in zip(p, p[1:]) if _LETTER.match(a)}
        s = re.escape("".join(sorted({c for c in self.joined | set(".,;:!?\n") if not c.isalnum() and c != MARK} - joined)))
        a = _LETTERS
        self.cut = re.compile(f"{MARK}*[^{MARK}{a}]*(?:[{a}]+(?:[^{MARK}{a}{s}][^{MARK}{a}]*)?)*")

    # merging

    def merge(self, text: str) -> list[str]:
        """Pieces after merging the best neighbouring pair, the left one of equals, until none is left."""
        parts, ids, scores = list(text), self.ids, self.scores
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(parts) and (both := parts[i] + parts[j]) in ids:
                heapq.heappush(heap, (-scores[both], i, both, j))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both, j = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def apart(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces stay as they are when their text is merged alone."""
        known = self._apart.get((left, right))
        if known is None:
            if len(self._apart) > 250_000:
                self._apart.clear()
            known = self._apart[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    # forward passes over sorted units

    def _bpe_step(self, word: str, at: int, values: list[str]) -> str:
        for size in range(min(self.longest, at), 0, -1):
            piece = word[at - size:at]
            if (size == 1 or piece in self.ids) and self.apart("" if size == at else values[at - size], piece):
                return piece
        raise ValueError(f"no path for {word[:at]!r}")

    def _unigram_step(self, word: str, at: int, values: list[tuple[float, str]]) -> tuple[float, str]:
        best = (values[at - 1][0] + self.scores.get(word[at - 1], self.floor), word[at - 1])
        for size in range(2, min(self.longest, at) + 1):
            piece = word[at - size:at]
            if piece in self.ids and (score := values[at - size][0] + self.scores[piece]) > best[0]:
                best = (score, piece)
        return best

    def segment(self, units: Iterable[str]) -> dict[str, list[str]]:
        """Pieces of every unit, by one depth-first walk over the trie of the sorted units."""
        out: dict[str, list[str]] = {}
        bpe = self.kind == "bpe"
        step: Callable = self._bpe_step if bpe else self._unigram_step
        last, values = "", [""] if bpe else [(0.0, "")]
        for unit in sorted(set(units)):
            if bpe and unit.startswith(MARK * 2):
                out[unit] = self.merge(unit)
                continue
            same, limit = 0, min(len(last), len(unit))
            while same < limit and last[same] == unit[same]:
                same += 1
            del values[same + 1:]
            for at in range(same + 1, len(unit) + 1):
                values.append(step(unit, at, values))
            last, at, path = unit, len(unit), []
            while at:
                piece = values[at] if bpe else values[at][1]
                path.append(piece)
                at -= len(piece)
            out[unit] = path[::-1]
        return out

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and the number of ids of each."""
        found, get = self.segment(units), self.ids.get
        out: list[int] = []
        sizes: list[int] = []
        for unit in units:
            before = len(out)
            for piece in found[unit]:
                known = get(piece)
                if known is None:
                    out += self._piece_ids(piece)
                else:
                    out.append(known)
            sizes.append(len(out) - before)
        return np.array(out, np.int32), np.array(sizes, np.int32)

    def _piece_ids(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        if known is not None:
            return [known]
        if self.byte_ids:
            return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def units(self, text: str) -> list[str]:
        """Units of a text; joined they are the marked text."""
        if not text:
            return []
        found = self.cut.findall((MARK if self.prefix else "") + text.replace(" ", MARK))
        return found[:-1] if not found[-1] else found

    def decode(self, ids: Iterable[int]) -> str:
        """Text of a row of ids. A literal U+2581 in the text comes back as a space."""
        table = self.bytes_of
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_OPEN: dict[str, tuple[Vocabulary, UnitIds]] = {}


def load(path: str, kind: str = "bpe") -> Vocabulary:
    """The pieces of a model file whose normaliser leaves texts as they are."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "Ａ  é\t"
    if model.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("the model changes the text before it is encoded")
    size = range(model.get_piece_size())
    plain = [i for i in size if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Vocabulary({model.id_to_piece(i): i for i in plain}, {model.id_to_piece(i): model.get_score(i) for i in plain},
                      kind, model.unk_id(), [i for i in size if model.is_byte(i)])


def _opened(path: str) -> tuple[Vocabulary, UnitIds]:
    if path not in _OPEN:
        vocabulary = load(path)
        _OPEN[path] = (vocabulary, UnitIds(vocabulary.encode_units, 350_000))
    return _OPEN[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): SentencePiece ids of every whole text; null and empty texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, store = _opened(path)
        for keys, texts in text_chunks(batches):
            ids, sizes = store.ids([vocabulary.units(t) for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type[0]), lists], [key, "ids"])

    key_type = [_arrow_type(docs, key)]
    return arrow(docs.select(key, text), run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): the text of every row of ids; a null row gives null."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = _opened(path)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                texts = [None if not row.is_valid else vocabulary.decode(row.as_py()) for row in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [key, "decoded"])

    return arrow(encoded.select(key, ids), run, f"`{key}` {kind}, decoded string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, n_tokens, ids_crc32, decoded_sha256, round_trip) of every whole text.

    Encodes and decodes in one pass. `ids_crc32` is over the ids as little-endian 32-bit integers;
    `round_trip` tells whether decoding gave the text back (null counts as empty). A text that
    holds U+2581 itself does not come back.
    """
    kind = docs.schema[key].dataType.simpleString()
    key_type = _arrow_type(docs, key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        vocabulary, store = _opened(path)
        for keys, texts in text_chunks(batches):
            ids, sizes = store.ids([vocabulary.units(t) for t in texts])
            rows = np.split(ids, np.cumsum(sizes)[:-1])
            back = [vocabulary.decode(r.tolist()) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()),
                 pa.array([hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back]),
                 pa.array([a == b for a, b in zip(texts, back)])],
                [key, "n_chars", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return arrow(
        docs.select(key, text), run, f"`{key}` {kind}, n_chars bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
