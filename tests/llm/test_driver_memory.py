"""What the driver's Python holds while operators gather bounded lists from the corpus."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import jaccard, toxicity


def test_the_counts_that_order_sets_come_to_the_driver_as_arrays(spark):
    # 100 texts of 2,000 words of their own, each twice but for its last word: some 200,000 shingles counted twice.
    rows = spark.range(0, 100, 1, 1).withColumn("t", F.explode(F.array(F.lit(0), F.lit(1))))
    word = F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.concat(F.col("id").cast("string"), F.lit("w"), i.cast("string")))
    docs = rows.select((F.col("id") * 2 + F.col("t")).alias("doc_id"), F.concat(F.array_join(word, " "), F.lit(" "), F.col("t").cast("string")).alias("text"))
    tracemalloc.start()
    try:
        got = jaccard.join(docs)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == {(k, 1997, k - k % 2) for k in range(200)}
    assert peak < 100 * 200_000  # bytes; a Row takes some 300


def test_lists_of_counts_are_merged_as_a_dictionary_would(monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED", 6)
    rng = np.random.default_rng(3)
    for n, m in ((0, 0), (0, 3), (5, 0), (6, 4), (6, 6)):
        value = np.sort(rng.choice(np.array([1, 2, 3, 2**63, 2**63 + 5, 2**64 - 1, 9, 11], np.uint64), n, False))
        crowd = np.sort(rng.choice(np.array([1, 3, 2**63, 2**64 - 1, 40, 50], np.uint64), m, False))
        count, size = rng.integers(2, 5, n), rng.integers(4, 9, m)
        had = dict(zip(value.tolist(), count.tolist(), strict=True))
        assert jaccard._known((value, count), crowd).tolist() == [had.get(x, 0) for x in crowd.tolist()]
        both = had | dict(zip(crowd.tolist(), size.tolist(), strict=True))
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        want = dict(sorted(both.items(), key=lambda x: (-x[1], signed(x[0])))[:6])
        value, count = jaccard._raised((value, count), (crowd, size))
        assert dict(zip(value.tolist(), count.tolist(), strict=True)) == want and value.tolist() == sorted(want)


def test_the_rows_of_a_fit_are_not_copied_and_their_broadcast_goes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"{'bad' if k % 2 else 'good'} word{k} here") for k in range(40)], "doc_id long, text string")
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    sent, seen, plain, learn = [], [], type(spark.sparkContext).broadcast, toxicity.learn
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(plain(self, x)) or sent[-1])
    monkeypatch.setattr(toxicity, "learn", lambda xs, *a: seen.extend(xs) or learn(xs, *a))
    model = toxicity.fit(docs, labels)
    assert len(seen) == 40 and not any(x.flags.owndata or x.flags.writeable for x in seen)
    with pytest.raises(Exception, match="destroyed|Broadcast"):
        spark.sparkContext.parallelize([0], 1).map(lambda _, b=sent[0]: len(b.value)).collect()
    monkeypatch.undo()
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(scored[k] for k in range(1, 40, 2)) > max(scored[k] for k in range(0, 40, 2))
