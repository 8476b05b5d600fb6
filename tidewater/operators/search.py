"""Search-style queries: boolean clauses become a condition and a score, aggregations become groupings.

Analysed text is its words: maximal runs of letters, digits and underscores, lower-cased.
A clause's score is the number of distinct query words that a field has; the relevance
formula of any one server is not imitated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A character of a word.
LETTER = r"[\p{L}\p{N}_]"


def analyse(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def has_word(text: Column, word: str) -> Column:
    """Whether a lower-cased word stands in a text: a plain search, and only where that finds it a pattern with the word's ends."""
    low = F.lower(text)
    return F.coalesce(low.contains(word) & low.rlike(f"(?<!{LETTER}){word}(?!{LETTER})"), F.lit(False))


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+", text.lower()) if w]


@dataclass
class Clause:
    hit: Column
    score: Column = field(default_factory=lambda: F.lit(0.0))


def clause(spec: dict) -> Clause:
    """One clause: match, match_phrase, term, terms, range, exists, match_all, prefix, wildcard or bool."""
    kind, x = next(iter(spec.items()))
    sure = lambda p: F.coalesce(p, F.lit(False))
    if kind == "match_all":
        return Clause(F.lit(True), F.lit(1.0))
    if kind == "bool":
        return boolean(x)
    if kind == "exists":
        return Clause(F.col(x["field"]).isNotNull(), F.lit(1.0))
    name, v = next(iter(x.items()))
    c = F.col(name)
    if kind == "match":
        words = list(dict.fromkeys(_words(str(v["query"] if isinstance(v, dict) else v))))
        has = [has_word(c, w) for w in words]
        join = Column.__and__ if isinstance(v, dict) and v.get("operator") == "and" else Column.__or__
        return Clause(reduce(join, has) if has else F.lit(False), reduce(Column.__add__, [h.cast("double") for h in has], F.lit(0.0)))
    if kind == "match_phrase":
        words, low = _words(v), F.lower(c)
        line = F.concat(F.lit(" "), F.array_join(analyse(c), " "), F.lit(" "))
        # Only a text with all the words somewhere is cut.
        maybe = reduce(Column.__and__, [low.contains(w) for w in dict.fromkeys(words)], F.lit(True))
        return Clause(sure(maybe & line.contains(" " + " ".join(words) + " ")), F.lit(float(len(words))))
    if kind == "term":
        return Clause(sure(c == F.lit(v)), F.lit(1.0))
    if kind == "terms":
        return Clause(sure(c.isin(*v)) if v else F.lit(False), F.lit(1.0))
    if kind == "prefix":
        return Clause(sure(c.startswith(v)), F.lit(1.0))
    if kind == "wildcard":
        return Clause(sure(c.like(v.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_"))), F.lit(1.0))
    if kind == "range":
        as_time = (lambda y: F.to_timestamp(F.lit(y), v["format"])) if "format" in v else F.lit
        tests = {"gt": lambda y: c > y, "gte": lambda y: c >= y, "lt": lambda y: c < y, "lte": lambda y: c <= y}
        return Clause(sure(reduce(Column.__and__, [tests[k](as_time(y)) for k, y in v.items() if k in tests], F.lit(True))), F.lit(1.0))
    raise ValueError(f"unknown clause {kind}")


def boolean(spec: dict) -> Clause:
    """must and filter hold, must_not doesn't (a missing field does not match), and of should as many as asked for.

    Without minimum_should_match: one if there is neither must nor filter, else none.
    """
    group = {k: [clause(c) for c in (v if isinstance(v, list) else [v])] for k, v in spec.items() if k != "minimum_should_match"}
    must, should = group.get("must", []), group.get("should", [])
    hit = reduce(Column.__and__, [c.hit for c in must + group.get("filter", [])] + [~c.hit for c in group.get("must_not", [])], F.lit(True))
    need = spec.get("minimum_should_match", 0 if must or "filter" in group else 1)
    if should:
        hit = hit & (reduce(Column.__add__, [c.hit.cast("int") for c in should]) >= need)
    score = reduce(Column.__add__, [c.score for c in must] + [F.when(c.hit, c.score).otherwise(0.0) for c in should], F.lit(0.0))
    return Clause(hit, score)


class Search:
    """A search over rows; clauses add up as ``must``, and ``bool`` replaces what was there."""

    def __init__(self, df: DataFrame):
        self.rows, self.query = df, None
        self.sorts: list[Column] = []
        self.first, self.size = 0, 10
        self.included: list[str] | None = None
        self.excluded: list[str] = []
        self.after: tuple[list[str], list[Any]] | None = None
        self.marked: dict[str, list[str]] = {}

    def add(self, spec: dict) -> Search:
        """A second clause wraps both in ``must``; to a bool it is added as ``must``."""
        if self.query is None:
            self.query = spec
        elif "bool" in self.query:
            b = dict(self.query["bool"])
            b["must"] = [*(b.get("must") or []), spec]
            self.query = {"bool": b}
        else:
            self.query = {"bool": {"must": [self.query, spec]}}
        return self

    def match(self, name: str, v: Any) -> Search:
        return self.add({"match": {name: v}})

    def match_phrase(self, name: str, v: str) -> Search:
        return self.add({"match_phrase": {name: v}})

    def term(self, name: str, v: Any) -> Search:
        return self.add({"term": {name: v}})

    def terms(self, name: str, *v: Any) -> Search:
        return self.add({"terms": {name: list(v)}})

    def range(self, name: str, **v: Any) -> Search:
        return self.add({"range": {name: v}})

    def exists(self, name: str) -> Search:
        return self.add({"exists": {"field": name}})

    def bool(self, **spec: Any) -> Search:
        self.query = {"bool": spec}
        return self

    def raw(self, query: dict) -> Search:
        self.query = query
        return self

    def sort(self, name: str, direction: str = "asc") -> Search:
        """Missing values last either way."""
        self.sorts.append(F.col(name).asc_nulls_last() if direction == "asc" else F.col(name).desc_nulls_last())
        return self

    def page(self, first: int = 0, size: int = 10) -> Search:
        """size below 0: all."""
        self.first, self.size = first, size
        return self

    def search_after(self, names: list[str], values: list[Any]) -> Search:
        self.after = names, values
        return self

    def source(self, *names: str) -> Search:
        self.included = list(names)
        return self

    def exclude(self, *names: str) -> Search:
        self.excluded = list(names)
        return self

    def highlight(self, name: str, words: str) -> Search:
        self.marked[name] = _words(words)
        return self

    def hits(self) -> DataFrame:
        """All hits with ``_score``, before paging."""
        c = clause(self.query) if self.query else Clause(F.lit(True), F.lit(1.0))
        return self.rows.withColumn("_score", c.score).where(c.hit)

    def df(self) -> DataFrame:
        df = self.hits()
        if self.after:
            names, values = self.after
            df = df.where(F.struct(*names) > F.struct(*[F.lit(v).cast(df.schema[n].dataType) for n, v in zip(names, values, strict=True)]))
        df = df.orderBy(*(self.sorts or [F.desc("_score")]))
        df = df.offset(self.first) if self.first else df
        df = df.limit(self.size) if self.size >= 0 else df
        for name, words in self.marked.items():
            df = df.withColumn(f"{name}_highlight", F.regexp_replace(name, "(?i)\\b(" + "|".join(map(re.escape, words)) + ")\\b", "<em>$1</em>"))
        if self.included:
            df = df.select(*self.included, *[f"{n}_highlight" for n in self.marked])
        return df.drop(*self.excluded) if self.excluded else df

    def count(self) -> DataFrame:
        return self.hits().agg(F.count(F.lit(1)).alias("n"))


def metrics(specs: dict[str, dict]) -> list[Column]:
    """Metric aggregations by name: avg, sum (0 of nothing), min, max, value_count, cardinality, percentile."""
    made = []
    for name, spec in specs.items():
        kind, x = next(iter(spec.items()))
        c = F.col(x["field"])
        known = {"avg": lambda c=c: F.avg(c), "sum": lambda c=c: F.coalesce(F.sum(c), F.lit(0)), "min": lambda c=c: F.min(c), "max": lambda c=c: F.max(c), "value_count": lambda c=c: F.count(c), "cardinality": lambda c=c, x=x: F.count_distinct(c) if x.get("exact") else F.approx_count_distinct(c, 0.01), "percentile": lambda c=c, x=x: F.percentile_approx(c, x["p"] / 100, 10_000)}
        made.append(known[kind]().alias(name))
    return made


def terms(df: DataFrame, field: str, size: int = 10, sub: dict[str, dict] | None = None) -> DataFrame:
    """Buckets (key, doc_count and sub-metrics) of the commonest values; null has none."""
    buckets = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("key")).agg(F.count(F.lit(1)).alias("doc_count"), *metrics(sub or {}))
    return buckets.orderBy(F.desc("doc_count"), "key").limit(size)


def date_histogram(df: DataFrame, field: str, interval: str, sub: dict[str, dict] | None = None) -> DataFrame:
    """A bucket for every interval between the first and the last, also where nothing fell."""
    rows = df.where(F.col(field).isNotNull()).withColumn("key", F.date_trunc(interval, field).cast("timestamp_ntz"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("doc_count"), *metrics(sub or {}))
    ends = buckets.agg(F.min("key").alias("a"), F.max("key").alias("z")).where(F.col("a").isNotNull())
    every = ends.select(F.explode(F.expr(f"sequence(a, z, interval 1 {interval})")).alias("key"))
    return every.join(buckets, "key", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
