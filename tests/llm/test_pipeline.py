"""The pipeline's stages against what each must have kept of its own input."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import brute_jaccard, low
from tidewater.llm import quality, queries
from tidewater.runtime import materialize, shared_dir

SF = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_every_stage_works_on_all_that_the_one_before_kept(spark):
    docs, path, seen = spark.read.parquet(f"{SF}/documents.parquet"), shared_dir(spark), []
    twice = docs.limit(3)
    odd = spark.createDataFrame([(900_000, None, None, None, None), (900_001, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(twice).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), path, name)
        seen.append((name, before, docs))
    for name, before, after in seen[:-1]:
        assert set(after.columns) == set(before.columns), name
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    _, before, after = seen[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in brute_jaccard(rows)})
    _, before, after = seen[3]
    words = lambda x: re.findall(WORD, low(x or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} - {()}
    sizes = {len(w) for w in windows}
    clean = {r.doc_id for r in before.collect() if not any(tuple(words(r.text)[i : i + k]) in windows for k in sizes for i in range(len(words(r.text)) - k + 1))}
    assert {r.doc_id for r in after.collect()} == clean
    _, before, after = seen[4]
    t = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in before.collect()}
    got = after.collect()
    assert {r.doc_id for r in got} == set(texts) and all(list(r.ids) == t.encode(texts[r.doc_id], add_special_tokens=False).ids for r in got)


def test_rows_without_id_and_ids_with_two_texts_are_judged_by_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean, other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta", "gamma"))
    rows = [(None, f"{clean} {item} {clean}"), (None, clean), (7, f"{other} {item}"), (7, other), (8, third)]
    made = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], docs.schema)
    left = corpus_pipeline.decontamination_stage(spark, made, SF)
    assert {(r.doc_id, r.text) for r in left.collect()} == {(None, clean), (7, other), (8, third)}

    rows = [(3, clean), (None, clean), (5, clean), (5, other), (None, third), (None, third), (9, third + " more"), (None, ""), (None, ""), (None, None), (5, other), (2**40, other + " x")]
    made = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], docs.schema)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_stage(spark, made, SF).collect()]
    assert sorted(left, key=str) == sorted([(3, clean), (5, other), (9, third + " more"), (None, ""), (None, ""), (None, None)], key=str)

    alike = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    two = docs.withColumn("doc_id", F.lit(4).cast("long"))
    model = queries.quality_model(spark, SF)
    for odd in (alike, two):
        scored = quality.select(odd.withColumn("h", F.xxhash64("text")), model, also=("h",))
        good = {r.h for r in scored.where("kept").collect()}
        assert 0 < len(good) < odd.count()
        assert {r.h for r in corpus_pipeline.quality_stage(spark, odd, SF).select(F.xxhash64("text").alias("h")).collect()} == good


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_toxic_and_bad_documents_go_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    left = corpus_pipeline.toxicity_stage(spark, docs, sf).join(labels, "doc_id").groupBy("toxic").count()
    n = {r.toxic: r["count"] for r in left.collect()}
    all_n = {r.toxic: r["count"] for r in docs.join(labels, "doc_id").groupBy("toxic").count().collect()}
    assert n[0] >= 0.99 * all_n[0] and n.get(1, 0) <= 0.15 * all_n[1]
    left = corpus_pipeline.quality_stage(spark, docs, sf).join(labels.where(F.col("quality").isNotNull()), "doc_id").groupBy("quality").count()
    n = {r.quality: r["count"] for r in left.collect()}
    all_n = {r.quality: r["count"] for r in docs.join(labels, "doc_id").groupBy("quality").count().collect()}
    assert n[1] >= 0.99 * all_n[1] and n.get(0, 0) <= 0.1 * all_n[0]
