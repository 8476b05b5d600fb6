"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone.

An item's windows of ``window`` consecutive words (or the whole item, if it has fewer, but
not none) are sets of word shingles with positions. A window stands in a document only if
all of its shingles do, so that by the prefix principle one shingle, the rarest of the
documents, is the necessary prefix. Documents are joined on prefix shingles; the positional
bound (a window begins no earlier than the document) and the length bound (it ends no
later) cut candidates; and each that is left is verified word by word. Items join the
documents last, by their windows that were verified.

The windows' tables are broadcast if their checked number of rows is within
``max_broadcast``, else shuffled.

Words are runs of characters other than ASCII non-alphanumerics, A-Z lower-cased.

Defined results: a null or empty text has no words and no hits; an item without words has no
windows; items with equal windows all count; an item without id hits words and is not listed; repeated documents are each judged; a
null id is an id like others; empty tables give an empty result, or no hits; other columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.runtime import materialize, shared_dir

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text; where it is all ASCII, plain lower-casing does the same as translating."""
    plain = F.octet_length(text) == F.length(text)
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(folded, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def shingles(words: Column, k: int) -> Column:
    """Hashes of every k consecutive words, in order; empty where there are fewer."""
    n = F.size(words) - (k - 1)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def windows(items: DataFrame, text_col: str, item_col: str, window: int) -> DataFrame:
    """(words, item): the distinct windows of each item, whose id is given as text."""
    own = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    each = own.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return each.select(F.expr(f"slice(w, i + 1, {int(window)})").alias("words"), "item").distinct()


def hits(docs: DataFrame, items: DataFrame, doc_text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = 10, shingle: int = 3, max_broadcast: int = 1_000_000) -> DataFrame:
    """Per document: id, ``text_hash`` (xxhash64 of the text), ``n_words``, ``spans`` (array of start and length of each occurrence) and ``items`` (sorted ids, as text)."""
    path = shared_dir(docs.sparkSession)
    owners = materialize(windows(items, item_text, item_id, window).withColumn("window", F.xxhash64(F.concat_ws(" ", "words"))), path, "owners")
    found = materialize(owners.select("window", "words", F.size("words").alias("size")).distinct(), path, "windows")
    # No fewer rows than the windows.
    small = owners.count() * window <= max_broadcast
    near = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    sizes = [r.k for r in found.select(F.least(F.lit(shingle), "size").alias("k")).distinct().collect()]

    def of_documents(k: int) -> DataFrame:
        text = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(doc_text).alias("text_hash"), words(F.col(doc_text)).alias("w"))
        return text.select("doc", "text_hash", F.posexplode(shingles(F.col("w"), k)).alias("at", "h"))

    def of_windows(k: int) -> DataFrame:
        mine = found.where(F.least(F.lit(shingle), "size") == k)
        return mine.select("window", "size", F.posexplode(shingles(F.col("words"), k)).alias("offset", "h"))

    candidates = None
    for k in sizes:
        # Where shingles of windows stand in the documents, and how often: the order from rare to frequent.
        wanted = of_windows(k)
        seen = materialize(of_documents(k).join(near(wanted.select("h").distinct()), "h", "left_semi"), path, f"seen{k}")
        often = seen.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
        rare = wanted.join(near(often), "h", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "offset", "h")).alias("p"))
        # A window with a shingle that no document has stands in none.
        prefix = materialize(rare.where(F.col("p.often") > 0).select("window", "size", F.col("p.offset").alias("offset"), F.col("p.h").alias("h")), path, f"prefix{k}")
        got = seen.join(near(prefix), "h").where(F.col("at") >= F.col("offset")).select("doc", "text_hash", "window", (F.col("at") - F.col("offset")).alias("start"))
        candidates = got if candidates is None else candidates.unionByName(got)
    own = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(doc_text).alias("text_hash"), F.col(doc_text).alias("_text"))
    if candidates is None:
        none = F.array().cast("array<struct<start:int,size:int>>")
        return own.select(F.col("doc").alias(doc_id), "text_hash", F.size(words(F.col("_text"))).cast("long").alias("n_words"), none.alias("spans"), F.array().cast("array<string>").alias("items"))
    spots = candidates.join(near(found.select("window", "words")), "window")
    per_document = materialize(spots.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("start", "words")).alias("spots")), path, "spots")
    tried = own.join(per_document.withColumnsRenamed({"doc": "_doc", "text_hash": "_hash"}), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    # The words of a document without candidates are only counted.
    tried = tried.select("doc", "text_hash", words(F.col("_text")).alias("w"), "spots").select("doc", "text_hash", F.size("w").cast("long").alias("n_words"), F.when(F.col("spots").isNotNull(), F.expr("filter(spots, s -> s.start + size(s.words) <= size(w) AND slice(w, s.start + 1, size(s.words)) = s.words)")).alias("spots"))
    spots = F.coalesce("spots", F.array().cast(tried.schema["spots"].dataType))
    spans = F.transform(spots, lambda s: F.struct(s.start.alias("start"), F.size(s.words).alias("size")))
    verified = materialize(tried.select("doc", "text_hash", "n_words", spans.alias("spans"), F.array_distinct(F.transform(spots, lambda s: s.words)).alias("had")), path, "verified")
    # Items meet documents only by windows that do stand there: a window of many items is one row of theirs until then.
    had = verified.select("doc", "text_hash", F.explode("had").alias("words")).withColumn("window", F.xxhash64(F.concat_ws(" ", "words")))
    of_items = had.join(near(owners), ["window", "words"]).groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    of_items = of_items.withColumnsRenamed({"doc": "_doc", "text_hash": "_hash"})
    out = verified.join(of_items, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select(F.col("doc").alias(doc_id), "text_hash", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def summary(found: DataFrame) -> DataFrame:
    """Adds ``n_hit``, ``n_items`` and ``contaminated`` to the result of ``hits``."""
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.start + s["size"] - 1)))
    n = F.size(F.array_distinct(covered)).cast("long")
    return found.withColumns({"n_hit": n, "n_items": F.size("items").cast("long")}).withColumn("contaminated", F.col("n_hit") > 0)
