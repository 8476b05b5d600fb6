"""Quality classifier: importance resampling of raw text towards a target.

Two generative models over hashed token unigrams and bigrams, and one for immediate repetition, are counted: one of the
target texts, one of all raw texts. A text's log importance is the log ratio of its
probability under both, the sum over its n-grams; a text of more than ``LENGTH`` n-grams has that of ``LENGTH``
n-grams of its own mean, so that texts do not rank by their length and noise counts for long ones too. Resampling without replacement is the
Gumbel top-k: the k largest of log importance plus Gumbel noise. k is the caller's; by default
it is the expected number of good texts among those given: the sum of each one's chance to be good, a logistic
function of its log importance, fitted on labelled texts that the target counts do not hold. The noise comes from a hash of the key, so that runs and retries agree.

Defined results: a null or empty text has no tokens, importance 0, and takes part in
the draw; rows that tie with the k-th, as repeated ones do, are all kept; a null key is a key like others;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _text as T
from tidewater.llm._sample import per_label
from tidewater.llm._tasks import in_arrow
from tidewater.runtime import materialize, shared_dir

BITS = 16
#: The n-grams that a longer text counts for. A tempering: noise has a standard deviation of 1.3, whatever the text.
LENGTH = 10.0
#: One labelled row in so many is kept from the target, for the chances.
FOLDS = 5
SHIFT = np.uint64(64 - BITS)
#: 1: letters, digits and non-ASCII; 2: other visible ASCII; 0: white space and controls.
KINDS = np.array([0 if b <= 0x20 or b == 0x7F else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Model:
    """Log ratio of target to raw by bucket, and slope and bias of the chance to be good by log importance."""

    ratio: np.ndarray
    slope: float = 0.0
    bias: float = float("inf")


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = T.Spans(data, offs, KINDS)
    h = s.hashes()
    got = [T.gram(h, s.first, steps) for steps in ((), (1,))]
    text = np.repeat(np.arange(len(offs) - 1), np.diff(s.first))
    again = np.flatnonzero((h[1:] == h[:-1]) & (text[1:] == text[:-1]))
    got.append((np.full(len(again), 1, np.uint64), text[again]))  # a token that repeats the one before it: bucket 0
    return np.concatenate([(g >> SHIFT).astype(np.int32) for g, _ in got]), np.concatenate([t for _, t in got]), np.diff(s.first)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): how often each hashed n-gram stands in all the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for _, _, data, offs in T.blocks(b.column(0)):
                total += np.bincount(_grams(data, offs)[0], minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return in_arrow(docs.select(text_col), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", key_col: str = "doc_id", max_per_label: int = 20_000, smoothing: float = 0.5) -> Model:
    """Raw counts over all documents; target counts over those labelled 1, but for one in ``FOLDS``; chances from those left out, of both labels.

    At most ``max_per_label`` rows of each label are used, those of the smallest hash of the
    key, a bound that makes their keys small enough to broadcast. Without labels every text counts as
    good. The driver gets counts of 65,536 buckets, and two numbers for each row left out.
    """
    sample = per_label(labels, key_col, (F.col(label_col).cast("int") == 1).cast("int"), max_per_label)
    apart = F.pmod(F.xxhash64(F.lit("chance"), F.col("k").cast("string")), F.lit(FOLDS)) == 0
    known = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(sample), "k")
    logs = []
    for some, column in ((known.where(~apart & (F.col("y") == 1)), "t"), (docs, text_col)):
        got = counts(some, column).toArrow()
        total = np.zeros(1 << BITS)
        total[got["bucket"].to_numpy()] = got["n"].to_numpy()
        logs.append(np.log((total + smoothing) / (total.sum() + smoothing * (1 << BITS))))
    model = Model(logs[0] - logs[1])
    got = importance(known.where(apart), model, "t", ("y",)).toArrow()
    return Model(model.ratio, *_chance(got["log_importance"].to_numpy(), got["y"].to_numpy().astype(float)))


def _chance(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, float]:
    """Slope and bias of a logistic regression of y on x, by Newton's method; the slope of the scaled x has a ridge, as labels may part without error.

    The bias has none, so that chances add up to the number of ones. Of one label alone, or no row, the chance is that label, or 1.
    """
    if not len(y) or y.min() == y.max():
        return 0.0, float("inf") if not len(y) or y[0] == 1 else -float("inf")
    mean, scale = x.mean(), x.std() or 1.0
    rows = np.stack([(x - mean) / scale, np.ones(len(x))], 1)
    w, pull = np.zeros(2), np.diag([ridge, 0.0])
    loss = lambda w: np.logaddexp(0, rows @ w).sum() - y @ (rows @ w) + w @ pull @ w / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -35, 35)))
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + pull + 1e-9 * np.eye(2), rows.T @ (p - y) + pull @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def chance(model: Model) -> Column:
    """The chance of a text of ``log_importance`` to be good."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("log_importance") * F.lit(model.slope) + F.lit(model.bias))))


def expected(scored: DataFrame, model: Model) -> int:
    """The expected number of good texts, of chances in millionths, so that the order of the sum does not count."""
    return round((scored.agg(F.sum(F.round(chance(model) * 1e6).cast("long"))).first()[0] or 0) / 1e6)


def select(docs: DataFrame, model: Model, text_col: str = "text", key_col: str = "doc_id", k: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """``resample`` of the documents, with the columns ``also``. Texts are read once: their importance is written and reread."""
    scored = importance(docs, model, text_col, (key_col, *also))
    scored = materialize(scored, shared_dir(docs.sparkSession), "importance")
    return resample(scored, expected(scored, model) if k is None else k, key_col)


def importance(docs: DataFrame, model: Model, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``key_cols``, ``n_tokens`` and ``log_importance`` of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*key_cols).schema.add("n_tokens", "long", False).add("log_importance", "double", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value.ratio
        for b in batches:
            tokens, logs = [np.zeros(0, np.int64)], [np.zeros(0)]
            for a, z, data, offs in T.blocks(b.column(0)):
                bucket, text, n = _grams(data, offs)
                tokens.append(n.astype(np.int64))
                logs.append(T.per_text(ratio[bucket], text, z - a) * np.minimum(1, LENGTH / np.maximum(1, np.bincount(text, minlength=z - a))))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.concatenate(tokens)), pa.array(np.concatenate(logs))], schema.names)

    return in_arrow(docs.select(F.col(text_col), *key_cols), run, schema)


def resample(scored: DataFrame, k: int, key_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """Adds ``gumbel`` and ``kept``: whether the row is among the k largest of log importance plus Gumbel noise, or ties with the k-th."""
    u = (F.xxhash64(F.lit(seed), F.col(key_col).cast("string")).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = scored.withColumn("gumbel", -F.log(-F.log(u)))
    total = F.col("log_importance") + F.col("gumbel")
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    return rows.withColumn("kept", total >= F.lit(_kth(rows.select(total.alias("x")), k)))


def _kth(rows: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest x, by counts in bins of the range where it must be, until a bin holds one value; of fewer rows minus infinity."""
    low, high, n = rows.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if k > n:
        return -float("inf")
    while low < high:
        at = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1))
        found = rows.where(F.col("x").between(low, high)).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r["at"]):  # at most ``bins`` rows
            if k <= r.n:
                low, high = r.low, r.high
                break
            k -= r.n
    return low
