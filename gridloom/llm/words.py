"""Base encoder: exact ids of many texts at once, along the seams of the tokenizer's pre-split.

A *seam* is a place where the pre-split must break whatever stands around it; there the
ids of the parts are the ids of the whole. Texts fall into words at their seams, and a
memo of fixed size holds the ids of words met before, so that a batch of bytes is
encoded by array operations. The memo is a direct-mapped table that compares the words'
bytes, not only their hash: a collision costs an encoding and never a wrong id.

The vocabulary is read on the driver and broadcast (under 2 MB for the public ones), so
executors need no copy of the file.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-split of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = 3  # words of up to 8 * WORDS bytes are kept in the table, longer ones in a dictionary
SLOTS = 1 << 20
STORE = 1 << 23  # ids kept before the cache starts anew
LONG = 100_000  # long chunks kept before the dictionary starts anew
PIECE = 2 << 20  # bytes worked on at once
_OTHER, _LETTER, _DIGIT, _BLANK, _MARK = range(5)


def _classes() -> np.ndarray:
    c = np.full(256, _OTHER, np.uint8)
    c[33:127] = _MARK
    c[48:58] = _DIGIT
    c[65:91] = c[97:123] = _LETTER
    c[[9, 10, 11, 12, 13, 32]] = _BLANK
    return c


_CLASS = _classes()
#: Seams between two ASCII characters, by class before and after; an apostrophe before a letter is excluded below.
_SEAM = np.zeros((5, 5), bool)
_SEAM[_LETTER, [_DIGIT, _BLANK, _MARK]] = True
_SEAM[_DIGIT, [_LETTER, _BLANK, _MARK]] = True
_SEAM[_MARK, [_LETTER, _DIGIT, _BLANK]] = True


#: Of the k-th eight bytes of a word of so many bytes those that belong to it.
_KEEP = [np.array([(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for n in range(8 * WORDS + 1)], np.uint64) for k in range(WORDS)]


def seams(b: np.ndarray) -> np.ndarray:
    """True at i if the pre-split breaks before byte i whatever else the text holds. Beyond ASCII only a blank after a
    character that is surely none counts: U+0085, U+00A0, U+1680, U+2000 to U+205F and U+3000 are avoided."""
    out = np.zeros(len(b), bool)
    if len(b) < 2:
        return out
    c = _CLASS[b]
    out[1:] = _SEAM[c[:-1], c[1:]]
    out[1:] &= ~((b[:-1] == 39) & (c[1:] == _LETTER))
    at = np.flatnonzero((c[1:] == _BLANK) & (b[:-1] >= 0x80)) + 1
    at = at[at >= 4]
    one, two, three, four = b[at - 1], b[at - 2], b[at - 3], b[at - 4]
    sure = ((two >= 0xC3) & (two <= 0xDF)) | ((three >= 0xE4) & (three <= 0xEF)) | ((three == 0xE3) & ~((two == 0x80) & (one == 0x80))) | (four >= 0xF0)
    out[at[sure]] = True
    return out


def word_starts(b: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Starts of the words of many texts laid end to end; limits: start of every text."""
    mark = seams(b)
    mark[limits[limits < len(b)]] = True
    return np.flatnonzero(mark)


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file's content, to be broadcast; compared by name and checksum."""

    name: str
    checksum: int
    lines: bytes = field(compare=False, repr=False)

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, "rb") as f:
            lines = f.read()
        return Vocabulary(path, zlib.crc32(lines), lines)

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.lines.splitlines())}


@cache
def _tokenizer(vocabulary: Vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks(), special_tokens={})


@cache
def token_bytes(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens end to end, their limits)."""
    ranks = sorted(vocabulary.ranks().items(), key=lambda x: x[1])
    limits = np.zeros(ranks[-1][1] + 2, np.int64)
    for raw, k in ranks:
        limits[k + 1] = len(raw)
    return np.frombuffer(b"".join(raw for raw, _ in ranks), np.uint8), np.cumsum(limits)


class WordEncoder:
    """Encodes texts word by word with a memo of distinct words."""

    def __init__(self, vocabulary: Vocabulary, slots: int = SLOTS):
        self.encode = _tokenizer(vocabulary).encode_ordinary
        self.slots = slots
        self._clear()

    def _clear(self) -> None:
        self.key = [np.zeros(self.slots, np.uint64) for _ in range(WORDS)]
        self.size = np.zeros(self.slots, np.int64)  # 0: free
        self.at = np.zeros(self.slots, np.int32)
        self.count = np.zeros(self.slots, np.int32)
        self.store = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _keep(self, ids: list[int]) -> int:
        at, n = self.used, len(ids)
        while at + n > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[at : at + n] = ids
        self.used = at + n
        return at

    def texts(self, b: np.ndarray, limits: np.ndarray, sizes_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """(ids of all texts, number of ids of each). b: the texts' bytes laid end to end; limits: their starts and the
        end of the last."""
        texts = len(limits) - 1
        if self.used > STORE or len(self.long) > LONG:
            self._clear()
        if not len(b):
            return np.empty(0, np.int32), np.zeros(texts, np.int64)
        start = word_starts(b, limits[:-1])
        size = np.diff(np.append(start, len(b)))
        at, count = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        short = np.flatnonzero(size <= 8 * WORDS)
        self._short(b, start[short], size[short], short, at, count)
        raw = b.tobytes() if len(short) < len(start) else b""
        for i in np.flatnonzero(size > 8 * WORDS).tolist():
            chunk = raw[start[i] : start[i] + size[i]]
            known = self.long.get(chunk)
            if known is None:
                ids = self.encode(chunk.decode("utf-8", "replace"))
                known = self.long[chunk] = (self._keep(ids), len(ids))
            at[i], count[i] = known
        total = np.concatenate([[0], np.cumsum(count)])
        per_text = np.diff(total[np.searchsorted(start, limits)])
        if sizes_only:
            return None, per_text
        take = np.repeat(at - total[:-1], count)
        take += np.arange(total[-1])
        return self.store[take], per_text

    def _short(self, b, start, size, which, at, count) -> None:
        padded = np.concatenate([b, np.zeros(8 * WORDS, np.uint8)])
        words = np.ndarray(len(b) + 8 * (WORDS - 1) + 1, "<u8", padded, strides=(1,))  # eight bytes from every position on
        key = [words[start + 8 * k] & _KEEP[k][size] for k in range(WORDS)]
        h = size.astype(np.uint64)
        for k in range(WORDS):
            h ^= key[k]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        found = self.size[slot] == size
        for k in range(WORDS):
            found &= self.key[k][slot] == key[k]
        got_at, got_count = self.at[slot], self.count[slot]
        miss = np.flatnonzero(~found)
        if len(miss):
            _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[first]
            new_at, new_count = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
            raw = b.tobytes()
            for j, (s, n) in enumerate(zip(start[one].tolist(), size[one].tolist(), strict=True)):
                ids = self.encode(raw[s : s + n].decode("utf-8", "replace"))
                new_at[j], new_count[j] = self._keep(ids), len(ids)
            got_at[miss], got_count[miss] = new_at[back], new_count[back]
            same = size[miss] == size[one][back]
            for k in range(WORDS):
                self.key[k][slot[one]] = key[k][one]
                same &= key[k][miss] == key[k][one][back]
            # Of two chunks for one slot the last stands, in all arrays alike.
            self.size[slot[one]], self.at[slot[one]], self.count[slot[one]] = size[one], new_at, new_count
            for i in miss[~same].tolist():  # equal hashes of different bytes
                ids = self.encode(raw[start[i] : start[i] + size[i]].decode("utf-8", "replace"))
                got_at[i], got_count[i] = self._keep(ids), len(ids)
        at[which], count[which] = got_at, got_count


@cache
def worker(vocabulary: Vocabulary) -> WordEncoder:
    """The encoder of this Python worker."""
    return WordEncoder(vocabulary)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, limits) of a string column; NULL counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    limits = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    b = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if column.null_count:  # what lies behind a NULL need not be empty
        column = column.fill_null("")
        return _bytes_of(column)
    return b[limits[0] : limits[-1]], limits - limits[0]


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, limits) of a string column of about ``most`` bytes; a row is never split."""
    b, limits = _bytes_of(column)
    n, row = len(limits) - 1, 0
    while row < n:
        end = max(int(np.searchsorted(limits, limits[row] + most, side="right")) - 1, row + 1)
        yield row, end, b[limits[row] : limits[end]], limits[row : end + 1] - limits[row]
        row = end


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every document, without building the ids; 0 for an empty and for a NULL text."""

    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker(shared.value)
        for batch in batches:
            for row, end, b, limits in pieces(batch.column(1)):
                _, n = encoder.texts(b, limits, sizes_only=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(n)], names=["doc_id", "n_tokens"])

    return documents.select(key, text).mapInArrow(scan, "doc_id bigint, n_tokens bigint")
