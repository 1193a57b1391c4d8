"""Texts of an Arrow batch as one flat byte array, and vectorised word splitting.

The word rule used by several operators: lower-case A-Z, then take maximal runs
of ASCII digits, letters and all characters above ASCII.  As every byte of such
a character is 0x80 or more, the rule works on UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = 32
#: Byte -> lower-cased word byte, or a space for every separator.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else SPACE
    for b in range(256)
)
WORD_TABLE = np.frombuffer(WORD_BYTES, dtype=np.uint8)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches, column: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about max_bytes of text; one longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


class Words:
    """Words of a block of texts.

    ``data``: the texts with one space before every word and after the last one,
    separators collapsed (unless ``collapse`` is false: then as they stand).  ``starts``: where each word starts in
    ``data``; ``ends``; ``doc``: the text of each word; ``count``: words of each
    text; ``first``: index of each text's first word.
    """

    def __init__(self, column, table: np.ndarray = WORD_TABLE, collapse: bool = True):
        raw, offsets = flat(column)
        n = len(offsets) - 1
        # a separator before the first text and after each keeps words of different texts apart
        data = np.full(len(raw) + n + 1, SPACE, np.uint8)
        inside = np.ones(len(data), bool)
        borders = offsets + np.arange(n + 1)
        inside[borders] = False
        data[inside] = table[raw]
        word = data != SPACE
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1  # words begin and end in turn
        self.starts, self.ends = edge[::2], edge[1::2]
        self.count = np.diff(np.searchsorted(self.starts, borders))
        self.first = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(n), self.count)
        self.data, self.n_docs = data, n
        if collapse:
            keep = word.copy()
            keep[:-1] |= word[1:]  # the separator just before a word stays
            self.data = np.append(data[keep], np.uint8(SPACE))
            size = self.ends - self.starts
            self.ends = np.cumsum(size + 1)
            self.starts = self.ends - size

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word: eight bytes at a time, each mixed in; of words over ``LONG`` bytes, of their BLAKE2 digest."""
        data = np.append(self.data, np.zeros(8, np.uint8))
        eight = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=data, strides=(1,))
        size = self.ends - self.starts
        with np.errstate(over="ignore"):
            out = mix(size.astype(np.uint64) + np.uint64(seed) * _ODD)
            at, left = np.arange(len(self)), size
            for offset in range(0, LONG, 8):
                x = eight[self.starts[at] + offset] & _FIRST[np.minimum(left, 8)]
                out[at] = mix(out[at] ^ x * _ODD)
                on = left > 8
                at, left = at[on], left[on] - 8
                if not len(at):
                    break
        for i in np.flatnonzero(size > LONG).tolist():
            digest = hashlib.blake2b(data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
            out[i] = int.from_bytes(digest.digest(), "little")
        return out

    def runs(self, head: np.ndarray, size: np.ndarray, words: np.ndarray) -> np.ndarray:
        """A hash of each run of ``size`` words from word ``head``, of the words' hashes."""
        with np.errstate(over="ignore"):
            out = mix(size.astype(np.uint64) * _ODD)
            for k in range(int(size.max(initial=0))):
                on = slice(None) if (size > k).all() else size > k
                out[on] = mix(out[on] * _ODD + words[head[on] + k])
        return out


_ODD = np.uint64(0x9E3779B97F4A7C15)
LONG = 64
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of eight bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two rounds of xor-shift and multiplication)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """256 random odd-looking 64-bit numbers, one for each byte."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1009)) * _ODD)


_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        with np.errstate(over="ignore"):
            out[1:] = np.uint64(base)
            np.multiply.accumulate(out, out=out)
    return out


class Rolling:
    """Polynomial hashes modulo 2**64 of any ranges of one byte array."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(byte_codes(seed)[data] * powers(_BASE, n), out=self.prefix[1:])
        self.back = powers(_INVERSE, n + 1)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[ends] - self.prefix[starts]) * self.back[starts])

    def all(self, width: int) -> np.ndarray:
        """Hashes of every range of a width."""
        n = len(self.prefix) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.prefix[width:] - self.prefix[:n]) * self.back[:n])
