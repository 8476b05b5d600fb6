"""Language ID: a linear-chain conditional random field that labels the words of a text.

A word's emission is the sum of learned weights of its prefixes and suffixes (1 to 3
bytes), its inner byte trigrams, the word itself and its membership in learned word
lists; transitions between neighbouring words are learned too, from chains of which
some switch language midway. Forward-backward gives each word's marginals, whose sum
over the text decides. A whole text is one chain. Its segments of ``SEGMENT`` words advance together: the product
of a segment's transitions carries messages over it, so that what enters and leaves each is exact.

Defined results: a null text, or one without any letter, is ``und`` with score 0; ties
go to the label first in code-point order; repeated rows are judged alike; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _text as T
from tidewater.llm._sample import per_label
from tidewater.llm._tasks import in_arrow

BITS = 16
SHIFT = np.uint64(64 - BITS)
#: Words by which all segments advance together.
SEGMENT = 64
#: Feature kinds: prefix and suffix of 1, 2, 3 bytes and the whole word; trigrams have a table of their own.
KINDS = 7


@dataclass(frozen=True)
class Model:
    labels: list[str]
    emit: np.ndarray  # (KINDS + 1) << BITS rows, a column a label
    lexicon: np.ndarray  # hashes of listed words, ascending
    listed: np.ndarray  # the label of each
    lex_weight: np.ndarray  # label of the list, label of the word
    move: np.ndarray  # label before, label after


def _features(data: np.ndarray, offs: np.ndarray):
    """Spans; (words, KINDS) rows of the table; trigram rows and the word of each; word hashes."""
    s = T.words(data, offs, T.NON_LETTER)
    raw = s.bytes(T.LOWER)
    whole = s.ranges(raw, s.start, s.end)
    cols = [s.ranges(raw, s.start, np.minimum(s.start + k, s.end)) for k in (1, 2, 3)] + [s.ranges(raw, np.maximum(s.end - k, s.start), s.end) for k in (1, 2, 3)] + [whole]
    rows = np.stack([(c >> SHIFT).astype(np.int64) + (i << BITS) for i, c in enumerate(cols)], 1)
    size = np.maximum(s.end - s.start - 2, 0)
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s.start, size)
    tri = (s.ranges(raw, at, at + 3) >> SHIFT).astype(np.int64) + (KINDS << BITS)
    return s, rows, tri, word, whole


def _emissions(m: Model, rows, tri, word, whole) -> np.ndarray:
    k = len(m.labels)
    out = np.zeros((len(rows), k))
    for i in range(KINDS):
        out += m.emit[rows[:, i]]
    size = np.maximum(np.bincount(word, minlength=len(rows)), 1)
    for j in range(k):
        out[:, j] += np.bincount(word, m.emit[tri, j], len(rows)) / size
    if len(m.lexicon):
        at = np.minimum(np.searchsorted(m.lexicon, whole), len(m.lexicon) - 1)
        hit = m.lexicon[at] == whole
        out[hit] += m.lex_weight[m.listed[at[hit]]]
    return out


def _segments(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of each segment of a text, and its number in the text."""
    n = np.diff(first)
    parts = -(-n // length)
    text = np.repeat(np.arange(len(n)), parts)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[:-1][text] + k * length
    return start, np.minimum(length, first[1:][text] - start), k


def _share(x: np.ndarray) -> np.ndarray:
    return x / x.sum(tuple(range(1, x.ndim)), keepdims=True)


def _messages(e: np.ndarray, a: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters each segment from the words before it, and what its last word gets from those after it."""
    k, first = len(a), number == 0
    over = np.where(first[:, None, None], np.eye(k), a) * e[start][:, None, :]  # (segments, label before, label at its end)
    for t in range(1, int(size.max())):
        more = np.flatnonzero(size > t)
        over[more] = _share((over[more] @ a) * e[start[more] + t][:, None, :])
    enter, leave, end = np.ones((len(start), k)), np.ones((len(start), k)), _share(over.sum(1))
    levels = np.split(np.argsort(number, kind="stable"), np.cumsum(np.bincount(number))[:-1])[1:]
    for at in levels:
        enter[at] = end[at - 1]
        end[at] = _share((enter[at][:, None, :] @ over[at])[:, 0])
    for at in reversed(levels):
        leave[at - 1] = _share((over[at] @ leave[at][:, :, None])[:, :, 0])
    return enter, leave


def _marginals(emit: np.ndarray, move: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray | None = None, pairs: bool = False):
    """Forward-backward over all segments at once: (words, labels) marginals, and summed pair marginals if asked for.

    number: each segment's place in its chain, whose segments follow one another; without it each is a chain of its own.
    """
    e = np.exp(emit - emit.max(1, keepdims=True)) if len(emit) else emit
    a = np.exp(move - move.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    enter = None
    if number is not None and len(number) and number.max() > 0:
        enter, leave = _messages(e, a, start, size, number)
        beta[start + size - 1] = leave
        enter = np.where((number == 0)[:, None], 1.0, enter @ a)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), "left")  # segments with more than t words
    f = None
    for t in range(longest):
        at = start[: alive[t]] + t
        if f is None:
            f = e[at] if enter is None else enter[order] * e[at]
        else:
            f = (f[: alive[t]] @ a) * e[at]
        f = _share(f)
        alpha[at] = f
    total = np.zeros_like(a)
    for t in range(longest - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        right = beta[at + 1] * e[at + 1]
        if pairs:
            total += _share(alpha[at][:, :, None] * a[None] * right[:, None, :]).sum(0)
        beta[at] = _share(right @ a.T)
    return _share(alpha * beta), total


def _room(sizes: list[int], total: int) -> int:
    """The size to which the longest texts are shortened, so that all together hold at most ``total`` bytes."""
    for i, x in enumerate(sorted(sizes)):
        if x * (len(sizes) - i) > total:
            return max(1, total // (len(sizes) - i))
        total -= x
    return max(sizes)


def _spread(text: pa.Buffer, room: int, pieces: int = 16) -> str:
    """The text, or about ``room`` bytes of it in pieces at even distances."""
    if text.size <= room:
        return text.to_pybytes().decode()
    p = max(1, min(pieces, room // 512))
    return " ".join(text.slice(i * (text.size // p), room // p).to_pybytes().decode("utf-8", "ignore") for i in range(p))


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", key_col: str = "doc_id", max_per_label: int = 300, max_bytes: int = 2_500_000, epochs: int = 6, rate: float = 0.3, lexicon_size: int = 400) -> Model:
    """Fit on at most ``max_per_label`` texts of each label, those of the smallest hash of key and text; every label with a text takes part.

    ``max_bytes`` bounds what is learned of a label. Where its sampled texts hold more, none is left
    out: the longest are shortened to one size at which all fit, by pieces spread over the whole text.
    """
    size, row = F.octet_length(text_col), F.struct(F.col(key_col).alias("id"), F.xxhash64(text_col).alias("h"))
    chosen = per_label(docs.where(size.isNotNull()).withColumn("_row", row), "_row", label_col, max_per_label, size).select("k.id", "k.h", "y", "x").collect()
    sizes: dict = {}
    for r in chosen:
        sizes.setdefault(r.y, []).append(r.x)
    room = {y: _room(x, max_bytes) for y, x in sizes.items()}
    keys = docs.sparkSession.createDataFrame([(r.id, r.h, room[r.y]) for r in chosen], docs.select(F.col(key_col).alias("_id")).schema.add("_h", "long").add("room", "long"))
    known = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t"), F.col(label_col).alias("y")).where(F.col("y").isNotNull() & F.col("t").isNotNull())
    known = known.join(F.broadcast(keys), F.col("k").eqNullSafe(F.col("_id")) & (F.xxhash64("t") == F.col("_h")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_spread(t.as_buffer(), n) for t, n in zip(b.column(0), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *b.columns[2:]], ["t", "y", "n"])

    known = known.select("t", "room", "y", F.xxhash64("k").alias("n"))
    got = in_arrow(known, cut, known.select("t", "y", "n").schema).distinct().toPandas().sort_values(["n", "y", "t"])
    labels = sorted(set(got.y))
    k = len(labels)
    if not k:
        return Model([], np.zeros(((KINDS + 1) << BITS, 0)), np.zeros(0, np.uint64), np.zeros(0, int), np.zeros((0, 0)), np.zeros((0, 0)))
    rng = np.random.default_rng(5)
    # Texts are cut into pieces of some words, dealt out at random, so that chains switch language midway.
    texts = pa.array(list(got.t), pa.large_string())
    parts = []
    for a, z, data, offs in T.blocks(texts):
        s, r, tri, word, whole = _features(data, offs)
        y = np.repeat(np.searchsorted(labels, got.y.to_numpy()[a:z]), np.diff(s.first))
        parts.append((r, tri, word, whole, y, s.first))
    lexicon, listed = _lexicon(parts, k, lexicon_size)
    m = Model(labels, np.zeros(((KINDS + 1) << BITS, k)), lexicon, listed, np.zeros((k, k)), np.zeros((k, k)))
    seen = [np.full_like(x, 1e-8) for x in (m.emit, m.lex_weight, m.move)]

    def step(x: np.ndarray, g: np.ndarray, n: np.ndarray, at=slice(None)) -> None:
        n[at] += g * g
        x[at] += rate * g / np.sqrt(n[at])

    for _ in range(epochs):
        for r, tri, word, whole, y, first in parts:
            start, size, _ = _segments(first, 12)
            cut = rng.permutation(len(start))
            for some in np.array_split(cut, max(1, len(cut) // 400)):
                w = np.concatenate([np.arange(a, a + n) for a, n in zip(start[some], size[some], strict=True)] or [np.zeros(0, int)])
                if not len(w):
                    continue
                mine = np.zeros(len(y), np.int64) - 1
                mine[w] = np.arange(len(w))
                t = np.flatnonzero(mine[word] >= 0)
                ti, tw = tri[t], mine[word[t]]
                e = _emissions(m, r[w], ti, tw, whole[w])
                chain = np.arange(0, len(w), 48)
                marg, pair = _marginals(e, m.move, chain, np.minimum(48, len(w) - chain), pairs=True)
                gold = np.eye(k)[y[w]]
                g = gold - marg
                n = len(w)
                flat, inv = np.unique(r[w].ravel(), return_inverse=True)
                step(m.emit, np.stack([np.bincount(inv, np.repeat(g[:, j], KINDS), len(flat)) for j in range(k)], 1), seen[0], flat)
                if len(ti):
                    share = 1 / np.maximum(np.bincount(tw, minlength=n), 1)
                    flat, inv = np.unique(ti, return_inverse=True)
                    step(m.emit, np.stack([np.bincount(inv, g[tw, j] * share[tw], len(flat)) for j in range(k)], 1), seen[0], flat)
                if len(lexicon):
                    at = np.minimum(np.searchsorted(lexicon, whole[w]), len(lexicon) - 1)
                    hit = lexicon[at] == whole[w]
                    lg = np.zeros((k, k))
                    np.add.at(lg, listed[at[hit]], g[hit])
                    step(m.lex_weight, lg, seen[1])
                real = np.zeros((k, k))
                inside = (np.arange(1, n) % 48) != 0
                np.add.at(real, (y[w][:-1][inside], y[w][1:][inside]), 1)
                step(m.move, real - pair, seen[2])
    return m


def _lexicon(parts, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest words of each label that hardly stand under another."""
    whole, y = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
    h, inv = np.unique(whole, return_inverse=True)
    n = np.stack([np.bincount(inv[y == j], minlength=len(h)) for j in range(k)], 1)
    best = n.argmax(1)
    pure = (n.max(1) >= 5) & (n.max(1) >= 0.9 * n.sum(1))
    keep = np.zeros(len(h), bool)
    for j in range(k):
        at = np.flatnonzero(pure & (best == j))
        keep[at[np.argsort(-n[at, j], kind="stable")[:size]]] = True
    return h[keep], best[keep]


def predict(docs: DataFrame, model: Model, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``key_cols``, ``lang_pred`` and ``score``, the mean marginal of that label over the words of the whole text."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*key_cols).schema.add("lang_pred", "string", False).add("score", "double", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.labels, "und"], object)
        k = len(m.labels)
        letters = ~T.NON_LETTER
        for b in batches:
            pick, score = [np.zeros(0, int)], [np.zeros(0)]
            texts = b.column(0)
            for a, z, data, offs in T.blocks(texts):
                n = z - a
                s, *f = _features(data, offs)
                p, best = np.zeros((n, k)), np.full(n, k)
                count = np.diff(s.first)
                if len(s.start) and k:
                    marg, _ = _marginals(_emissions(m, *f), m.move, *_segments(s.first, SEGMENT))
                    text = np.repeat(np.arange(n), count)
                    for j in range(k):
                        p[:, j] = T.per_text(marg[:, j], text, n)
                    p /= np.maximum(count, 1)[:, None]
                    plain = letters.copy()
                    plain[0x80:] = False
                    sure = np.diff(np.concatenate([[0], np.cumsum(plain[data])])[offs]) > 0
                    best = np.where(count > 0, p.argmax(1), k)
                    for i in np.flatnonzero((count > 0) & ~sure):  # only non-ASCII: is any of it a letter?
                        if not any(c.isalpha() for c in texts[a + int(i)].as_py() or ""):
                            best[i] = k
                pick.append(best)
                score.append(np.where(best < k, np.take_along_axis(np.concatenate([p, np.zeros((n, 1))], 1), best[:, None], 1)[:, 0], 0.0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(names[np.concatenate(pick)], pa.string()), pa.array(np.clip(np.concatenate(score), 0, 1))], schema.names)

    return in_arrow(docs.select(F.col(text_col), *key_cols), run, schema)
