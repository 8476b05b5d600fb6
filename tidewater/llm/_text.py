"""Array-at-a-time tokenising and hashing of Arrow string columns, for use inside tasks.

Texts are taken as one UTF-8 byte buffer. All delimiters are ASCII, so cutting at
bytes never cuts a code point. Work goes in blocks of whole texts of about ``BLOCK``
bytes, which bounds memory; a longer text is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
#: Longer ranges are hashed one by one, by a digest.
LONG = 256
_M64 = (1 << 64) - 1
U = np.uint64
#: The first 0 to 8 bytes of eight.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def table(delimiters) -> np.ndarray:
    """256 booleans: True for the bytes that are no part of a word."""
    out = np.zeros(256, bool)
    out[list(delimiters)] = True
    return out


#: Bytes \x20 and \x09-\x0D.
WHITE = table([0x20, *range(0x09, 0x0E)])
#: ASCII bytes that are neither letters nor digits.
NON_WORD = table([b for b in range(0x80) if not chr(b).isalnum()])
#: ASCII bytes that are no letters.
NON_LETTER = table([b for b in range(0x80) if not chr(b).isalpha()])
#: A-Z lower-cased, all other bytes as they are.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets with the end) for blocks of whole texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + BLOCK, "right")) - 1)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def head(size: np.ndarray) -> np.ndarray:
    """Masks of the first ``size`` (0 to 8) bytes of eight."""
    return _HEAD[size]


class Spans:
    """Words of a block: ``start`` and ``end`` in bytes, ``first[i]:first[i+1]`` those of text i."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray):
        """kind: 256 small integers; 0 is between words, and a word's bytes are of one kind."""
        k = kind[data]
        n = len(k)
        before, after = np.zeros_like(k), np.zeros_like(k)
        before[1:], after[:-1] = k[:-1], k[1:]
        edge = offs[:-1][offs[:-1] < n]
        before[edge] = 0
        after[edge[edge > 0] - 1] = 0
        self.start = np.flatnonzero((k != before) & (k != 0))
        self.end = np.flatnonzero((k != after) & (k != 0)) + 1
        self.first = np.searchsorted(self.start, offs)
        self.data, self.offs = data, offs

    def bytes(self, fold: np.ndarray | None = None) -> np.ndarray:
        """The block's bytes, folded, with eight more so that eight can be read from every place."""
        out = np.zeros(len(self.data) + 8, np.uint8)
        out[: len(self.data)] = fold[self.data] if fold is not None else self.data
        return out

    @staticmethod
    def ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of ranges of what ``bytes`` gives; equal bytes have equal hashes wherever they stand.

        Eight bytes at a time are mixed in, by a step that is one to one and not linear: no family of texts is known
        to collide, as there is for polynomials modulo 2**64.
        """
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        size = end - start
        h = mix(size.astype(U) * U(0xD6E8FEB86659FD93) + (eight[start] & head(np.minimum(size, 8))))
        more, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(more):
            left = size[more] - k
            h[more] = mix(h[more] * U(0x9E3779B97F4A7C15) + (eight[start[more] + k] & head(np.minimum(left, 8))))
            more, k = more[left > 8], k + 8
        for i in np.flatnonzero(size > LONG):
            h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
        return h

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        return self.ranges(self.bytes(fold), self.start, self.end)


def words(data: np.ndarray, offs: np.ndarray, delimiters: np.ndarray) -> Spans:
    return Spans(data, offs, (~delimiters).astype(np.uint8))


def gram(h: np.ndarray, first: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (h[i], h[i + steps[0]], ...) within a text, and the text of each."""
    reach = max(steps, default=0)
    n = len(h) - reach
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = text[:n] == text[reach:]
    out = h[:n] * U(0xA0761D6478BD642F)
    for k, s in enumerate(steps, 1):
        out = (out ^ (out >> U(32))) * U(0xE7037ED1A0B428DB) + h[s : s + n] * U((2 * k + 1) * 0x8EBC6AF09C88C6E3 & _M64 | 1)
    return mix(out[ok] + U(reach)), text[:n][ok]


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by text."""
    return np.bincount(text, values, n)
