"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct hashed words, word pairs and pairs with one word
between (A-Z lower-cased, words are runs of letters, digits and non-ASCII). The
learner keeps a rate per coordinate and an L1 penalty, which leaves most weights at
exactly zero, so that a model is a short list of (bucket, weight). Rate and penalty are chosen on a split of
the labelled rows, as the penalty that suits depends on how many there are.

Defined results: a null or empty text has no features and gets the score of the bias
alone; repeated rows are scored alike, each on its own; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm import _text as T
from tidewater.llm._sample import per_label
from tidewater.llm._tasks import in_arrow
from tidewater.runtime import materialize, shared_dir

BITS = 20
SHIFT = np.uint64(64 - BITS)


@dataclass(frozen=True)
class Model:
    """Weights other than zero, by ascending bucket, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every n-gram of a block, and the text of each, not yet distinct."""
    s = T.words(data, offs, T.NON_WORD)
    h = s.hashes(T.LOWER)
    got = [T.gram(h, s.first, steps) for steps in ((), (1,), (2,))]
    return np.concatenate([(g >> SHIFT).astype(np.int32) for g, _ in got]), np.concatenate([t for _, t in got])


def distinct(bucket: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((text.astype(np.int64) << BITS) | bucket)
    return (key & ((1 << BITS) - 1)).astype(np.int32), key >> BITS


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", key_col: str = "doc_id", max_per_label: int = 4000, max_features: int = 12_000_000, epochs: int = 4, alpha: float | tuple[float, ...] = (0.3, 1.0), beta: float = 1.0, l1: float | tuple[float, ...] = (1.0, 2.0, 4.0, 8.0), l2: float = 1.0) -> Model:
    """Fit on at most ``max_per_label`` labelled rows of each label, those of the smallest hash of the key, and of these on
    as many, whole, as have ``max_features`` features together.

    These bounds are parameters of the fit alone. The first makes the sampled keys small enough
    to broadcast, the second what the driver gets: 4 bytes a feature. Where several of ``alpha`` or ``l1`` are given, each pair is fitted
    on three rows of four, a task a pair, and the pair of the smallest log loss on the fourth (ties: the larger penalty) on all.
    """
    sample = per_label(labels, key_col, F.col(label_col).cast("int"), max_per_label)
    rows = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(sample), "k").select("t", "y", F.xxhash64("k").alias("n"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, offs in T.blocks(b.column(0)):
                bucket, text = distinct(*features(data, offs))
                cuts = np.searchsorted(text, np.arange(z - a + 1))
                raw = [bucket[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(a, z - a), b.column(2).slice(a, z - a), pa.array(np.diff(cuts)), pa.array(raw, pa.binary())], ["y", "n", "size", "x"])

    spark = docs.sparkSession
    found = materialize(in_arrow(rows, extract, "y int, n long, size long, x binary"), shared_dir(spark), "features")
    upto = F.sum("size").over(Window.partitionBy("y").orderBy("n", "size", "x").rowsBetween(Window.unboundedPreceding, 0))  # of at most ``max_per_label`` rows
    got = found.withColumn("_upto", upto).where(F.col("_upto") <= max_features).select("y", "n", "x").toArrow()
    ys, n = got["y"].to_numpy().astype(float), got["n"].to_numpy()
    order = np.lexsort((ys, n))
    # Features stay where Arrow has them, and are copied for no row.
    xs = [np.frombuffer(x.as_buffer(), np.int32) for x in got["x"]]
    xs, ys, n = [xs[i] for i in order], ys[order], n[order]
    pairs = [(a, p) for a in np.atleast_1d(alpha).tolist() for p in np.atleast_1d(l1).tolist()]
    rate, penalty = pairs[0] if len(pairs) == 1 else _best(spark, xs, ys, n % 4 == 0, pairs, epochs, beta, l2)
    return learn(xs, ys, epochs, rate, beta, penalty, l2)


def learn(xs: list[np.ndarray], ys: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> Model:
    """FTRL-proximal over rows of distinct buckets, in an order of its own for each epoch."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = np.array([1 << BITS], np.int32)
    order = np.random.default_rng(7)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(xs)):
            i = np.concatenate([xs[k], bias])
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - ys[k]
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    w = weight(np.arange((1 << BITS) + 1))
    at = np.flatnonzero(w[:-1])
    return Model(at.astype(np.int32), w[at], float(w[-1]))


def _best(spark: SparkSession, xs: list[np.ndarray], ys: np.ndarray, apart: np.ndarray, pairs: list[tuple[float, float]], epochs: int, beta: float, l2: float) -> tuple[float, float]:
    """The pair (alpha, l1) whose fit on the rows not ``apart`` has the smallest log loss on those that are."""
    data = spark.sparkContext.broadcast((xs, ys, apart))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, apart = data.value
        for b in batches:
            for a, p in (pairs[k] for k in b.column(0).to_pylist()):
                m = learn([x for x, o in zip(xs, apart, strict=True) if not o], ys[~apart], epochs, a, beta, p, l2)
                dense = np.zeros(1 << BITS)
                dense[m.buckets] = m.weights
                total = np.array([np.clip(dense[x].sum() + m.bias, -35, 35) for x, o in zip(xs, apart, strict=True) if o])
                loss = float((np.logaddexp(0, total) - ys[apart] * total).sum())
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([p]), pa.array([loss])], ["a", "p", "loss"])

    got = in_arrow(spark.range(0, len(pairs), 1, len(pairs)), run, "a double, p double, loss double").collect()
    data.destroy()
    r = min(got, key=lambda r: (r.loss, -r.p, r.a))
    return r.a, r.p


def score(docs: DataFrame, model: Model, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``key_cols`` and ``score``, from 0 to 1, of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*key_cols).schema.add("score", "double", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        dense = np.zeros(1 << BITS)
        dense[m.buckets] = m.weights
        for b in batches:
            out = [np.zeros(0)]
            for a, z, data, offs in T.blocks(b.column(0)):
                bucket, text = features(data, offs)
                hit = dense[bucket] != 0
                bucket, text = distinct(bucket[hit], text[hit])
                total = T.per_text(dense[bucket], text, z - a) + m.bias
                out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.concatenate(out))], schema.names)

    return in_arrow(docs.select(F.col(text_col), *key_cols), run, schema)
