"""The corpus pipeline: from raw documents to encoded ones that are clean, good, distinct and apart from the benchmark.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
and reads it again for the next. Each row is judged by itself: what a stage rejects goes by an
anti-join with the rejected rows' ids and hashes of their texts, which are broadcast only if a count
shows that they are few. So a row without id is judged too, and of an id with two texts just the bad one goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontaminate, jaccard, quality, queries, toxicity
from tidewater.runtime import materialize, shared_dir, ship

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _few(rows: DataFrame) -> DataFrame:
    """Broadcast if a count shows that the rows are few, else as they are."""
    return F.broadcast(rows) if rows.count() <= jaccard.BROADCAST else rows


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents whose row, (doc_id, ``text_hash``), is not among the rejected ones; a null id is an id like others."""
    no = _few(rejected.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    return docs.join(no, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti").select(*DOCUMENT)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score below 0.3; a null or empty text has the score of the bias alone."""
    ship(spark)
    scored = toxicity.score(docs, queries.toxicity_model(spark, sf_dir), key_cols=DOCUMENT)
    return scored.where(F.col("score") < 0.3).select(*DOCUMENT)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    ship(spark)
    path = shared_dir(spark)
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    drawn = materialize(quality.select(rows, queries.quality_model(spark, sf_dir), also=("text_hash",)).select("doc_id", "text_hash", "kept"), path, "drawn")
    return _without(docs, drawn.where(~F.col("kept")))


def _numbered(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Documents with ``row``, one number for each id and text, and (row, id, hash) of the rows that have not their id as number.

    Those are the rows without id and those whose id has several texts; there are none in most tables.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"))
    several = rows.groupBy("doc_id").agg(F.min("hash").alias("a"), F.max("hash").alias("z")).where(F.col("doc_id").isNull() | (F.col("a") != F.col("z")))
    several = materialize(several.select(F.col("doc_id").alias("id")), path, "several")
    if not several.limit(1).count():
        return docs.withColumn("row", F.col("doc_id").cast("long")), None
    own = materialize(rows.join(_few(several), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").distinct(), path, "own")
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    start = 0 if high is None else high + 1 if high < 2**62 else low - 2**62
    # Written, as such numbers are not the same twice.
    own = own.withColumn("row", F.monotonically_increasing_id() + F.lit(start))
    own = materialize(own.select("row", F.col("doc_id").alias("id"), "hash"), path, "numbers")
    named = docs.join(_few(own), F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash")), "left")
    return named.select(*DOCUMENT, F.coalesce("row", F.col("doc_id").cast("long")).alias("row")), own


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, and of rows with one id, or without id, that
    of the smallest hash of the text. Equal rows are one document, but for rows without id and words."""
    ship(spark)
    path = shared_dir(spark)
    named, own = _numbered(docs, path)
    found = materialize(jaccard.join(named, id_col="row"), path, "groups")
    if own is None:
        rejected, loose = found.where(F.col("component_id") != F.col("row")), None
    else:
        each = found.join(_few(own), "row", "left")
        each = each.withColumn("order", F.struct(F.col("hash").isNotNull() & F.col("id").isNull(), F.when(F.col("hash").isNull(), F.col("row")).otherwise(F.col("id").cast("long")), "hash"))
        each = materialize(each, path, "orders")
        best = each.groupBy("component_id").agg(F.min("order").alias("best"))
        rejected = each.join(best, "component_id").where(~F.col("order").eqNullSafe(F.col("best")))
        loose = each.where(F.col("hash").isNotNull() & F.col("id").isNull() & (F.col("n_shingles") == 0)).select("row").distinct()
    kept = named.join(_few(rejected.select("row").distinct()), "row", "left_anti")
    if found.groupBy("row").count().where(F.col("count") > 1).limit(1).count():
        one = kept if loose is None else kept.join(_few(loose), "row", "left_anti")
        one = one.groupBy("row").agg(F.min(F.struct(*DOCUMENT)).alias("d")).select("d.*")
        kept = one if loose is None else one.unionByName(kept.join(_few(loose), "row", "left_semi").select(*DOCUMENT))
    return kept.select(*DOCUMENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, one without id among them."""
    ship(spark)
    path = shared_dir(spark)
    found = decontaminate.hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = materialize(found.where(F.size("spans") > 0).select("doc_id", "text_hash"), path, "hit")
    return _without(docs, hit)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's whole text, and the text that they decode to."""
    ship(spark)
    out = bpe.encode_decode(docs, queries.tokenizer("word_bpe_49k.json"), key_cols=("doc_id", "lang", "source"))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Learned models and hashing decide; held against a brute-force version in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``."""
    ship(spark)
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, path, name)
    return docs
