"""Key-value operators over a table (k string, v string, expires_at timestamp), and what is built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.mutate import one_per_key
from tidewater.streaming.transforms import before

COLUMNS = ("k", "v", "expires_at")


def live(store: DataFrame, now: Column | None = None) -> DataFrame:
    """Entries that have not expired."""
    return store.where(F.col("expires_at").isNull() | (F.col("expires_at") > (now if now is not None else F.current_timestamp())))


def get(store: DataFrame, key: str, now: Column | None = None) -> DataFrame:
    return live(store, now).where(F.col("k") == key)


def mget(store: DataFrame, keys: DataFrame | list[str], now: Column | None = None) -> DataFrame:
    """The entries among the keys that there are; keys may be a table (k), of any size."""
    rows = live(store, now)
    return rows.where(F.col("k").isin(keys)) if isinstance(keys, list) else rows.join(keys.select("k").distinct(), "k", "left_semi")


def exists(store: DataFrame, keys: DataFrame | list[str], now: Column | None = None) -> DataFrame:
    return mget(store, keys, now).agg(F.count_distinct("k").alias("n"))


def put(store: DataFrame, new: DataFrame, only: str | None = None, now: Column | None = None, order: str | None = None) -> DataFrame:
    """The store after writing: all, those not there (``nx``), or those there (``xx``).

    Of new entries of one key that which is largest by ``order``, and then by value, counts.
    """
    kept = live(store, now)
    new = one_per_key(new.select(*COLUMNS, *([order] if order else [])), ["k"], order).select(*COLUMNS)
    if only == "nx":
        return kept.unionByName(new.join(kept.select("k"), "k", "left_anti").select(*COLUMNS))
    if only == "xx":
        new = new.join(kept.select("k"), "k", "left_semi").select(*COLUMNS)
    return kept.join(new.select("k"), "k", "left_anti").select(*COLUMNS).unionByName(new)


def remove(store: DataFrame, keys: DataFrame | list[str]) -> DataFrame:
    return store.where(~F.col("k").isin(keys)) if isinstance(keys, list) else store.join(keys.select("k"), "k", "left_anti").select(*COLUMNS)


def ttl(store: DataFrame, now: Column) -> DataFrame:
    """(k, seconds): what is left; null for entries that don't expire."""
    return live(store, now).select("k", (F.unix_micros(F.col("expires_at").cast("timestamp")) / 1e6 - F.unix_micros(now.cast("timestamp")) / 1e6).alias("seconds"))


def expire(store: DataFrame, keys: DataFrame | list[str], at: Column) -> DataFrame:
    """The entries of the keys, a list or a table (k) of any size, end at a time."""
    if isinstance(keys, list):
        return store.withColumn("expires_at", F.when(F.col("k").isin(keys), at).otherwise(F.col("expires_at")))
    marked = store.join(keys.select("k").distinct().withColumn("_hit", F.lit(True)), "k", "left")
    return marked.withColumn("expires_at", F.when(F.col("_hit"), at).otherwise(F.col("expires_at"))).select(*store.columns)


def compare_and_set(store: DataFrame, new: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(the store after, the keys written) for rows (k, v, expires_at, expected): a row writes only where the entry's value is as expected, null for no entry.

    Of rows of one key the largest by value is the one tried.
    """
    kept = live(store, now)
    tried = one_per_key(new.select(*COLUMNS, "expected"), ["k"]).alias("n").join(kept.select("k", F.col("v").alias("_v")), "k", "left")
    won = tried.where(F.col("_v").eqNullSafe(F.col("expected"))).select(*COLUMNS)
    return kept.join(won.select("k"), "k", "left_anti").select(*COLUMNS).unionByName(won), won.select("k")


def increment(store: DataFrame, deltas: DataFrame, now: Column | None = None) -> DataFrame:
    """The store after adding deltas (k, n) to counters kept as text; an absent one starts from 0, and times to live stay."""
    kept = live(store, now)
    total = deltas.groupBy("k").agg(F.sum("n").alias("_n"))
    both = kept.join(total, "k", "full")
    return both.select("k", F.when(F.col("_n").isNull(), F.col("v")).otherwise((F.coalesce(F.col("v").cast("long"), F.lit(0)) + F.col("_n")).cast("string")).alias("v"), "expires_at")


def batch(store: DataFrame, ops: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the store after, the values read, one row of counts) for operations (op, k, v, expires_at) of the kinds get, set and del, all at once.

    Reads see the store as it was, then sets are made, then deletions. Of several sets of a key the largest by value
    counts. ``written`` counts keys set, ``deleted`` those that were there to be deleted.
    """
    of = lambda kind: ops.where(F.col("op") == kind)
    values = mget(store, of("get").select("k"), now).select("k", "v")
    sets, gone = one_per_key(of("set").select(*COLUMNS), ["k"]), of("del").select("k").distinct()
    after = put(store, sets, now=now)
    counts = sets.agg(F.count("k").alias("written")).crossJoin(F.broadcast(exists(after, gone, now).select(F.col("n").alias("deleted"))))  # one row each
    return remove(after, gone), values, counts


def update_items(items: DataFrame, key: list[str], changes: DataFrame, condition: str | None = None, **assign: str) -> DataFrame:
    """Items with assignments, SQL over ``item.`` and ``change.``, where a row of ``changes`` has the key and the condition holds; one row of changes a key."""
    one = one_per_key(changes, key).withColumn("_hit", F.lit(True))
    both = items.alias("item").join(one.alias("change"), [F.col(f"item.{k}").eqNullSafe(F.col(f"change.{k}")) for k in key], "left")
    hit = F.col("change._hit") & (F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True))
    return both.select(*[F.when(hit, F.expr(assign[c])).otherwise(F.col(f"item.{c}")).cast(items.schema[c].dataType).alias(c) if c in assign else F.col(f"item.{c}") for c in items.columns])


def scan(store: DataFrame, glob: str, now: Column | None = None) -> DataFrame:
    """Entries whose keys fit a glob of ``*`` and ``?``."""
    like = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return live(store, now).where(F.col("k").like(like))


def prefix_scan(store: DataFrame, prefix: str, now: Column | None = None) -> DataFrame:
    return live(store, now).where(F.col("k").startswith(prefix))


def range_scan(store: DataFrame, start: str, end: str, now: Column | None = None) -> DataFrame:
    """Keys from start up to, without, end, in order."""
    return live(store, now).where((F.col("k") >= start) & (F.col("k") < end)).orderBy("k")


def namespaced(store: DataFrame, name: str) -> DataFrame:
    return store.withColumn("k", F.concat(F.lit(name + ":"), "k"))


def query(items: DataFrame, key: str | Column, sort: str, after=None, limit: int = 0, ascending: bool = True, condition: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """One partition's items in the order of a sort key, a page at a time; the limit counts items before the condition."""
    df = items.where(F.expr(key) if isinstance(key, str) else key)
    if after is not None:
        df = df.where(F.col(sort) > after if ascending else F.col(sort) < after)
    df = df.orderBy(F.asc(sort) if ascending else F.desc(sort))
    df = df.limit(limit) if limit > 0 else df
    df = df.where(F.expr(condition)) if condition else df
    return df.select(*columns) if columns else df


def leaderboard(scores: DataFrame, order: str | None = None) -> DataFrame:
    """(member, score, rank): last score of each member by ``order``; equal scores share the better rank.

    Ranks need only the number of members with each score, so that the sort, by ranges, is of distinct scores.
    """
    rows = scores.groupBy("member").agg(F.max_by("score", order).alias("score")) if order else scores.select("member", "score")
    per = rows.groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    ranks = before(per, "_n", F.desc("score")).select("score", (F.col("_b") + 1).cast("long").alias("rank"))
    return rows.join(ranks, "score").select("member", "score", "rank")


def top(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "member").limit(n)


def rate_limit(hits: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """(key, window start, hits, allowed): of each window at most so many are allowed."""
    w = F.window(ts, f"{seconds} seconds")
    return hits.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("hits")).select(key, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "hits", F.least("hits", F.lit(most)).alias("allowed"))


def sliding_rate(hits: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Each hit with the number of its key's hits in the seconds up to it, itself included, and whether that is allowed."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return hits.withColumn("_at", at).withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("recent") <= most).drop("_at")


def queue_next(jobs: DataFrame, acked: DataFrame, n: int = 1) -> DataFrame:
    """The first jobs, by time and id, that are not acknowledged."""
    return jobs.join(acked.select("id"), "id", "left_anti").orderBy("enqueued_at", "id").limit(n)


def backoff(attempt: Column, first: float, most: float) -> Column:
    return F.least(F.lit(first) * F.pow(F.lit(2.0), attempt), F.lit(most))
