"""Encoding of whole texts by way of their distinct pieces, inside tasks.

A piece is a run of ASCII white space with the run of other characters after it, cut again
where an ASCII mark follows a letter of Latin script. Where
a tokenizer never makes a token that spans the end of a piece, a text's ids are those
of its pieces in order, so that each distinct piece need only be encoded once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from tidewater.llm import _text as T

#: Pieces above this many bytes are not kept.
LONGEST = 512


#: ASCII letters; ASCII that is neither letter, digit, white space nor control.
LETTER = np.array([b < 0x80 and chr(b).isalpha() for b in range(256)])
MARK = np.array([0x20 < b < 0x7F and not chr(b).isalnum() for b in range(256)])


class _Table:
    """Numbers by 64-bit hash, with linear probing; half of the slots stay free."""

    def __init__(self, most: int):
        self.bits = (2 * most - 1).bit_length()
        self.key, self.value = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.n = 0

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo, at = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            value = self.value[at]
            same = (self.key[at] == keys[todo]) & (value >= 0)
            out[todo[same]] = value[same]
            on = ~same & (value >= 0)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number new, distinct keys on from the last."""
        number = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.value[at] < 0
            self.key[at[free]], self.value[at[free]] = keys[free], number[free]  # of several at one slot the last stays
            lost = self.value[at] != number
            keys, number, at = keys[lost], number[lost], at[lost]
            at = (at + 1) & ((1 << self.bits) - 1)


def _doubled(x: np.ndarray) -> np.ndarray:
    """Twice as long, by zeros, which take no memory until they are written."""
    out = np.zeros(2 * len(x), x.dtype)
    out[: len(x)] = x
    return out


class Pieces:
    """Ids of pieces seen so far in this process; started anew when ``most`` pieces are kept."""

    def __init__(self, encode: Callable[[list[str]], list], whole: Callable[[str], list], white: bool, most: int = 1_000_000):
        """encode: ids of each of many pieces; whole: ids of a text that pieces can't be used for; white: pieces carry the white space before them."""
        self.encode, self.whole, self.white, self.most = encode, whole, white, most
        self.clear()

    def clear(self) -> None:
        self.at = _Table(self.most)
        self.ids, self.off, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int16)
        self.used = 0
        self.raw, self.raw_off, self.raw_used = np.zeros(1 << 16, np.uint8), np.zeros((1 << 12) + 1, np.int64), 0

    def _add(self, keys: np.ndarray, ids: list, pieces: list[bytes]) -> None:
        n, size = self.at.n, np.fromiter(map(len, ids), np.int64, len(ids))
        text = np.frombuffer(b"".join(pieces), np.uint8)
        while len(self.raw) < self.raw_used + len(text) + 8:  # eight bytes are read from any place
            self.raw = _doubled(self.raw)
        while len(self.raw_off) <= n + len(keys):
            self.raw_off = _doubled(self.raw_off)
        self.raw[self.raw_used : self.raw_used + len(text)] = text
        self.raw_off[n + 1 : n + len(keys) + 1] = self.raw_used + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        self.raw_used += len(text)
        while len(self.off) < n + len(keys):
            self.off, self.size = _doubled(self.off), _doubled(self.size)
        while len(self.ids) < self.used + size.sum():
            self.ids = _doubled(self.ids)
        self.off[n : n + len(keys)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(keys)] = size
        self.ids[self.used : self.used + size.sum()] = np.fromiter(chain.from_iterable(ids), np.int32, size.sum())
        self.used += int(size.sum())
        self.at.add(keys)

    def texts(self, column: pa.Array, odd: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, offsets of each text's ids with the end) by block. odd: texts to be encoded whole."""
        for a, z, data, offs in T.blocks(column):
            yield a, z, *self._block(data, offs, odd[a:z])

    def _other(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which ranges are not, byte by byte, the pieces that their hashes stand for."""
        a, b = (np.ndarray(len(x) - 7, "<u8", x, strides=(1,)) for x in (raw, self.raw))
        at, size = self.raw_off[piece], end - start
        out = self.raw_off[piece + 1] - at != size
        todo, k = np.flatnonzero(~out), 0
        while len(todo):
            rest = T.head(np.minimum(size[todo] - k, 8))
            out[todo] = ((a[start[todo] + k] ^ b[at[todo] + k]) & rest) != 0
            todo, k = todo[~out[todo] & (size[todo] > k + 8)], k + 8
        return out

    @staticmethod
    def _cut(data: np.ndarray, s: T.Spans, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, cut besides where a mark follows a letter: no token spans that either."""
        letter = LETTER[data]
        two = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))
        two = two[(data[two] != 0xC3) | (data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
        letter[two + 1] = True  # U+00C0 to U+024F without the two signs among them
        cut = np.flatnonzero(letter[:-1] & MARK[data[1:]]) + 1
        cut = cut[~np.isin(cut, offs)]
        if not len(cut):
            return s.start, s.end, s.first
        at, to = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        at[s.start], at[cut], to[s.end], to[cut] = True, True, True, True
        start = np.flatnonzero(at)
        return start, np.flatnonzero(to), np.searchsorted(start, offs)

    def _block(self, data: np.ndarray, offs: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offs) - 1
        s = T.words(data, offs, T.WHITE)
        start, end, first = self._cut(data, s, offs)
        if self.white:
            before = np.concatenate([[0], end[:-1]])
            head = first[:-1][first[:-1] < first[1:]]
            before[head] = offs[:-1][first[:-1] < first[1:]]
            last = np.where(first[1:] > first[:-1], end[np.maximum(first[1:] - 1, 0)] if len(end) else 0, offs[:-1])
            tail = np.flatnonzero(last < offs[1:])
            start = before
            if len(tail):
                order = np.argsort(np.concatenate([before, last[tail]]), kind="stable")
                start, end = np.concatenate([before, last[tail]])[order], np.concatenate([end, offs[1:][tail]])[order]
            first = np.searchsorted(start, offs)
        text = np.repeat(np.arange(n), np.diff(first))
        odd = odd.copy()
        odd[text[end - start > LONGEST]] = True
        if odd.any():
            use = ~odd[text]
            start, end, text = start[use], end[use], text[use]
        padded = s.bytes()
        h = s.ranges(padded, start, end)
        keys, where, back = np.unique(h, return_index=True, return_inverse=True)
        if self.at.n + len(keys) > self.most:
            self.clear()
        got = self.at.get(keys)
        new = np.flatnonzero(got < 0)
        if len(new):
            raw = data.tobytes()
            got[new] = np.arange(self.at.n, self.at.n + len(new))
            pieces = [raw[a:b] for a, b in zip(start[where[new]].tolist(), end[where[new]].tolist(), strict=True)]
            self._add(keys[new], self.encode([x.decode() for x in pieces]), pieces)
        piece = got[back]
        other = self._other(padded, start, end, piece)
        if other.any():  # one hash, two pieces: their texts are encoded whole
            odd[text[other]] = True
            return self._block(data, offs, odd)
        size = self.size[piece].astype(np.int64)
        ids = self.ids[np.repeat(self.off[piece] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        count = np.bincount(text, size, n).astype(np.int64)
        if not odd.any():
            return ids, np.concatenate([[0], np.cumsum(count)])
        cuts, parts = np.concatenate([[0], np.cumsum(count)]), []
        raw = data.tobytes()
        for i in range(n):
            x = np.asarray(self.whole(raw[offs[i] : offs[i + 1]].decode()), np.int32) if odd[i] else ids[cuts[i] : cuts[i + 1]]
            count[i] = len(x)
            parts.append(x)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(count)])
