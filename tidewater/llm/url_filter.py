"""URL filter by mined association rules.

A URL's tokens are its host's labels and their parts, the first folder of its path, the path's
ending, and the names in its query. From labelled URLs, FP-growth mines the sets of
tokens that come with a label; rules of enough support, confidence and lift over the label's share are kept, and of
these only such as hold no shorter one. Tokens that are rules by themselves, and all but one of
tokens that stand in just the same URLs, are counted before and don't enter the mining: no minimal rule
needs them, and copies of a URL with many names would else have every subset of these as a rule. An
inverted index from each rule's rarest token to the rule finds those whose tokens a URL has: with one, it is blocked.

Fixed rules (host, path, verdict) go first: a rule fits its host and all subdomains where
the URL's path starts with the rule's, and the longest that fits wins.

Defined results: a null URL, or one without ``://``, has an empty host and path and no tokens,
and is allowed; repeated rows are judged alike; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm._tasks import in_arrow
from tidewater.runtime import materialize, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    """What stands after the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def fixed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule is (host, path from its first slash, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL."""
    labels = F.split(host(url), r"\.")
    parts = F.split(host(url), r"[.\-]")
    folder = F.regexp_extract(path(url), r"^/([^/]+)/", 1)
    ending = F.regexp_extract(path(url), r"\.([A-Za-z0-9]{1,8})$", 1)
    names = F.regexp_extract_all(F.regexp_extract(rest(url), r"\?([^#]*)", 1), F.lit(r"([^&=]+)=?[^&]*"), F.lit(1))
    kinds = [("h:", labels), ("w:", parts), ("f:", F.array(folder)), ("e:", F.array(ending)), ("q:", names)]

    def marked(kind: str, found: Column) -> Column:
        return F.transform(F.filter(found, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    return F.array_distinct(F.concat(*[marked(*x) for x in kinds]))


def mine(labelled: DataFrame, url_col: str = "url", label_col: str = "label", block: str = "block", min_count: int = 8, min_support: float = 0.0005, min_confidence: float = 0.9, min_lift: float = 2.0) -> list[tuple[str, ...]]:
    """Token sets that imply ``block``, shortest first and then by support: all minimal ones that stand in at least
    ``min_count`` blocked URLs and a share of ``min_support`` of all, ``min_confidence`` of them blocked, and at odds of ``min_lift``
    times those of all URLs. Where all are blocked there are no rules.

    Of tokens that stand in just the same URLs the first by name speaks for all. Only tokens of that support,
    and rules, reach the driver.
    """
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.monotonically_increasing_id().alias("id"), tokens(F.col(url_col)).alias("t"), (F.col(label_col) == block).alias("y"), F.xxhash64(url_col).alias("h"))
    n, blocked = rows.agg(F.count(F.lit(1)), F.sum(F.col("y").cast("long"))).first()
    if not n:
        return []
    if blocked == n:
        return []
    odds = min_lift * blocked / (n - blocked)
    min_confidence = max(min_confidence, odds / (1 + odds))
    need = max(min_count, math.ceil(min_support * n))
    each = rows.select("id", F.explode("t").alias("x"), F.col("y").cast("long").alias("y"), "h")
    places = [F.sum(F.shiftright("h", k).bitwiseAND(F.lit((1 << 30) - 1))) for k in (0, 30)]  # of equal URLs, equal sums
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("b"), F.array(*places).alias("places")).where(F.col("b") >= need)
    found = sorted(often.collect(), key=lambda r: r.x)
    single = sorted((r for r in found if r.b >= min_confidence * r.n), key=lambda r: (-r.b, r.x))
    first: dict = {}
    for r in found:
        first.setdefault((r.n, *r.places), r)
    alone = {r.x for r in single}
    out = [(r.x,) for r in single if first[(r.n, *r.places)].x == r.x]
    left = [(r.x,) for r in first.values() if r.x not in alone]
    if len(left) < 2:
        return out
    kept = each.join(F.broadcast(labelled.sparkSession.createDataFrame(left, "x string")), "x")
    items = kept.groupBy("id").agg(F.collect_set("x").alias("items"), F.max("y").alias("y")).select(F.when(F.col("y") == 1, F.concat("items", F.array(F.lit("label")))).otherwise(F.col("items")).alias("items"))
    items = materialize(items, shared_dir(labelled.sparkSession), "items")
    total = items.count()
    if not total:
        return out
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / total), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & F.array_contains("consequent", "label")).select(F.array_sort("antecedent").alias("a"), "support")
    minimal: dict[frozenset, float] = {}
    for r in sorted(rules.collect(), key=lambda r: (len(r.a), -r.support, r.a)):
        own = frozenset(r.a)
        if not any(frozenset(s) in minimal for k in range(1, len(r.a)) for s in combinations(r.a, k)):
            minimal[own] = r.support
            out.append(tuple(r.a))
    return out


def judge(urls: DataFrame, rules: list[tuple[str, ...]], url_col: str = "url", key_cols: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``key_cols`` and ``mined``: the tokens of the first mined rule that fits (joined by spaces), or null."""
    schema = urls.select(*key_cols).schema.add("mined", "string")
    often = Counter(t for r in rules for t in r)
    by_token: dict[str, list[tuple[int, frozenset, str]]] = {}
    for k, r in enumerate(rules):
        by_token.setdefault(min(r, key=lambda t: (often[t], t)), []).append((k, frozenset(r), " ".join(r)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for got in b.column(0).to_pylist():
                have = set(got or ())
                fits = [(k, name) for t in have for k, need, name in by_token.get(t, ()) if need <= have]
                out.append(min(fits)[1] if fits else None)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.string())], schema.names)

    return in_arrow(urls.select(tokens(F.col(url_col)).alias("_tokens"), *key_cols), run, schema)
