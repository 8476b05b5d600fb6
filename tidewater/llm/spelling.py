"""Spelling variant grouping by a rare-first q-gram prefix filter.

Runs of letters, ``[A-Za-z\\u00C0-\\u00FF]+``, with A-Z lower-cased, are counted over all whole texts. Words are those
of at least ``least_length`` code points and ``least_n`` occurrences. Two words are near if one inserted, deleted or
replaced code point makes one the other.

One edit touches at most two of a word's bigrams. With the bigrams of all words in one order, by
frequency, then by bigram and place, near words share one of their three rarest: the first of those that the edit leaves
alone comes after at most two others in either. So words meet only under their three rarest bigrams, where the places differ by
the difference of the lengths, one at most, or not at all. As the shared bigram is whole, the edit is on one side of it
and the other side is equal: that side is part of the key, so that words that merely share a rare
bigram do not meet. What meets is verified by its edit distance.

A word's form is its most frequent near word (ties: smallest in code-point order) if that is at least ``ratio`` times
as frequent; its root is where the forms end. A form is ten times as frequent as its word, so that paths are short, and words with a
common form are near it, at most some 180 for each of its code points: no key of these joins is hot.

Defined results: a null text has no words, a null id is written as an empty one, repeated rows count as often as
they stand, an empty table gives an empty result, texts and words of any length are taken whole, other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _text as T
from tidewater.llm._tasks import in_arrow
from tidewater.runtime import materialize, shared_dir

#: Of 31 values of a run's hash one has a code point of it deleted.
NOISE = 31
#: Words up to which a table of forms of forms is broadcast.
BROADCAST = 1_000_000
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
#: Letters of ASCII are 1, the first byte of À-ÿ is 2, all others 0.
_LETTER = np.array([1 if chr(b).isalpha() and b < 0x80 else 2 if b == 0xC3 else 0 for b in range(256)], np.uint8)


def crc32(start: np.ndarray, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """CRC-32 of ranges of bytes, each after a prefix whose CRC-32 is ``start``, a byte of all ranges at a time."""
    state, size = ~start.astype(np.uint32), last - first
    todo, k = np.flatnonzero((size > 0) & (size <= T.LONG)), 0
    while len(todo):
        now = state[todo]
        state[todo] = _CRC[(now ^ raw[first[todo] + k]) & 0xFF] ^ (now >> np.uint32(8))
        k += 1
        todo = todo[size[todo] > k]
    for i in np.flatnonzero(size > T.LONG):
        state[i] = ~np.uint32(zlib.crc32(raw[first[i] : last[i]], int(start[i])))
    return ~state


def _runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, first, last, text) of a block's runs of letters."""
    raw = T.LOWER[data]
    kind = _LETTER[raw]
    kind[1:][kind[:-1] == 2] = 2  # the byte after 0xC3
    letter = np.zeros(len(raw) + 2, bool)
    letter[1:-1] = kind > 0
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    first, last = edge[::2], edge[1::2]
    # A run ends where its text does, even if the next text begins with a letter.
    cut = offs[1:-1]
    cut = np.unique(cut[np.searchsorted(first, cut, "left") > np.searchsorted(last, cut, "right")]) if len(first) else cut[:0]
    first, last = np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([last, cut]))
    return raw, first, last, np.searchsorted(offs, first, "right") - 1


def count(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_length: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n): words of ``least_length`` code points at least, ``least_n`` times or more, one code point of some occurrences deleted by hash."""
    if least_length < 4:
        raise ValueError("words of fewer than four code points have fewer than three bigrams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, ids = [], ["" if i is None else i for i in b.column(0).to_pylist()]
            for a, z, data, offs in T.blocks(b.column(1)):
                raw, first, last, text = _runs(data, offs)
                # A shorter run, in bytes, has too few code points with or without deletion.
                long = last - first >= least_length
                first, last, text = first[long], last[long], text[long]
                prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[a:z]], np.uint32)
                h = crc32(prefix[text], raw, first, last)
                lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                size = lead[last] - lead[first]
                noisy = h % NOISE == 0
                whole = ~noisy & (size >= least_length)
                bounds = np.stack([first[whole], last[whole]], 1)
                words = _slices(raw, bounds)
                cut = []
                for i in np.flatnonzero(noisy & (size > least_length)):
                    w = raw[first[i] : last[i]].tobytes().decode()
                    at = int(h[i]) % len(w)
                    cut.append(w[:at] + w[at + 1 :])
                held += [words, pa.array(cut, pa.string())]
            counts = pa.chunked_array(held, pa.string()).value_counts() if held else pa.array([], pa.struct([("values", pa.string()), ("counts", pa.int64())]))
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])

    found = in_arrow(docs.select(F.col(id_col).cast("string"), F.col(text_col)), run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _slices(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Strings of ranges of bytes."""
    size = bounds[:, 1] - bounds[:, 0]
    offs = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(bounds[:, 0] - offs[:-1], size) + np.arange(offs[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(raw[at].tobytes()))


def _grouped(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their code points as a matrix) for the words of each length."""
    plain = words.to_pylist()
    size = np.array([len(w) for w in plain])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer("".join(plain[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n)


def _bigrams(codes: np.ndarray) -> np.ndarray:
    return codes[:, :-1] << np.uint32(8) | codes[:, 1:]


def bigram_counts(words: DataFrame) -> DataFrame:
    """(bigram, n) over all words. A letter is one of 90, so that there are 8,100 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for _, codes in _grouped(b.column(0)):
                total += np.bincount(_bigrams(codes).ravel(), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bigram", "n"])

    return in_arrow(words.select("word"), run, "bigram int, n long").groupBy("bigram").agg(F.sum("n").alias("n"))


def near_pairs(words: DataFrame, grams: int = 3) -> DataFrame:
    """(a, an, b, bn): pairs of near words with their counts, each once, a before b by length and then by code points.

    A key is the hash of the longer word's length, the bigram, its place and what is equal on one side of it. The shorter
    word says where its bigram stands in words of its own length and in ones longer by one; equal hashes of other
    keys cost a verification.
    """
    spark = words.sparkSession
    found = bigram_counts(words).toPandas()  # 8,100 rows at most
    rank = np.zeros(1 << 16, np.int64)
    order = np.lexsort((found.bigram, found.n))
    rank[found.bigram.to_numpy()[order]] = np.arange(len(found))
    rank = spark.sparkContext.broadcast(rank.astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows, short = [], [], []
            letters, pairs = np.zeros((2, b.num_rows), np.uint64)
            for at, codes in _grouped(b.column(0)):
                m, n = codes.shape
                g = _bigrams(codes)
                letters[at], pairs[at] = _bits(codes.astype(np.uint64)), _bits(T.mix(g.astype(np.uint64)))
                # The rarest first, of equal ones the first.
                place = np.argsort(rank.value[g].astype(np.int64) * n + np.arange(n - 1), axis=1)[:, :grams]
                head, tail = _ends(codes)
                row = np.arange(m)
                for k in range(place.shape[1]):
                    p = place[:, k]
                    left, right, gram = head[row, p + 2], tail[row, p], g[row, p].astype(np.uint64)
                    for side, equal, moves in ((0, left, (0, 0)), (1, right, (0, 1))):
                        for longer, move in enumerate(moves):  # words as long, and ones longer by one
                            keys.append(_key(n + longer, gram, p + move, side, equal))
                            rows.append(at)
                            short.append(np.full(m, True))
                        keys.append(_key(n, gram, p, side, equal))
                        rows.append(at)
                        short.append(np.full(m, False))
            if not keys:
                continue
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), b.column(0).take(at), b.column(1).take(at), *(pa.array(x.view(np.int64)).take(at) for x in (letters, pairs)), pa.array(np.concatenate(short))], ["key", "word", "n", "letters", "pairs", "short"])

    each = materialize(in_arrow(words.select("word", "n"), run, "key long, word string, n long, letters long, pairs long, short boolean"), shared_dir(spark), "keys")
    a = each.where("short").select("key", F.col("word").alias("a"), F.col("n").alias("an"), F.col("letters").alias("al"), F.col("pairs").alias("ap"))
    b = each.where("not short").select("key", F.col("word").alias("b"), F.col("n").alias("bn"), F.col("letters").alias("bl"), F.col("pairs").alias("bp"))
    # An edit changes which letters a word has by two at most and which bigrams by four, which spares most of what meets the costlier distance.
    alike = (F.bit_count(F.col("al").bitwiseXOR(F.col("bl"))) <= 2) & (F.bit_count(F.col("ap").bitwiseXOR(F.col("bp"))) <= 4)
    first = (F.length("a") < F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))
    return a.join(b, "key").where(alike & first & (F.levenshtein("a", "b", 1) == 1)).select("a", "an", "b", "bn").distinct()


def _bits(values: np.ndarray) -> np.ndarray:
    """Each row's values as a set of 64 bits."""
    return np.bitwise_or.reduce(np.uint64(1) << (values & np.uint64(63)), axis=1)


def _ends(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's first and last code points: ``head[:, k]`` of the first k, ``tail[:, k]`` of those from k."""
    m, n = codes.shape
    head, tail = np.zeros((m, n + 1), np.uint64), np.zeros((m, n + 1), np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    for k in range(n):
        head[:, k + 1] = T.mix(head[:, k] * np.uint64(0x9E3779B97F4A7C15) + c[:, k])
        tail[:, n - k - 1] = T.mix(tail[:, n - k] * np.uint64(0x9E3779B97F4A7C15) + c[:, n - k - 1])
    return head, tail


def _key(length: int, gram: np.ndarray, place: np.ndarray, side: int, equal: np.ndarray) -> np.ndarray:
    return T.mix(equal + T.mix(gram | place.astype(np.uint64) << np.uint64(17) | np.uint64(side << 16)) + np.uint64(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def group(words: DataFrame, ratio: int = 10, path: str | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for counted words (word, n)."""
    path = path or shared_dir(words.sparkSession)
    pairs = materialize(near_pairs(words), path, "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    is_form = -F.col("best.n") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    rows = materialize(rows, path, "forms")
    ends = _few(roots(rows.select("word", "form"), path))
    # Words without form, as a rule most, do not take part in the join.
    led = rows.where(F.col("form").isNotNull()).join(ends, "form", "left").select(*rows.columns, F.coalesce("root", "form").alias("root"))
    return led.unionByName(rows.where(F.col("form").isNull()).withColumn("root", F.col("word")))


def roots(forms: DataFrame, path: str) -> DataFrame:
    """(form, root) of those forms that have a form themselves: paths are halved in each round."""
    heads = forms.where(F.col("form").isNotNull()).select(F.col("form").alias("word")).distinct()
    now = materialize(forms.where(F.col("form").isNotNull()).join(heads, "word", "left_semi").select(F.col("word").alias("form"), F.col("form").alias("root")), path, "paths-0")
    k = 0
    while True:
        k += 1
        on = now.select(F.col("form").alias("root"), F.col("root").alias("far"))
        new = materialize(now.join(_few(on), "root", "left").select("form", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), path, f"paths-{k}")
        now = new.select("form", "root")
        if not new.where("moved").limit(1).count():
            return now


def _few(rows: DataFrame) -> DataFrame:
    """Broadcast if the counted rows are few, else as it is."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_length: int = 7, least_n: int = 2, ratio: int = 10) -> DataFrame:
    """``group`` of the words that ``count`` finds, which are stored first."""
    path = shared_dir(docs.sparkSession)
    return group(materialize(count(docs, text_col, id_col, least_length, least_n), path, "words"), ratio, path)
