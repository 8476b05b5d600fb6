"""Quality rules by document and by host.

Every whole text is held to rules on its words, symbols, lines and repetition. What fails a base rule goes. The other rules
are milder: alone they reject nothing, as a good text may fail one. They are put in force by host: failures of each
rule are counted by ``source``, and a host's rate is shrunk towards the rate of all by a beta prior, which is fitted to
the hosts themselves by moments, so that a host of few documents is not judged by chance. A rule holds
for the documents of a host that fails it at a shrunk rate above ``most``; a host that fails the base
rules at such a rate is held to all of them. A document that passes every rule is never rejected, whatever its host.

Defined results: a null or empty text has no words and fails the base rules; documents without source are a
host of their own; repeated rows count as often as they stand; every row is judged by itself; an empty table gives
an empty result; texts are taken whole, and columns other than text, key and source are not read. Equal lines and windows of words are
known by 64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _text as T
from tidewater.llm._tasks import in_arrow
from tidewater.runtime import materialize, shared_dir

WINDOW = 5
SYMBOLS = T.table(b"#*$%&|<>")
#: Bytes that end lines, as what is between words.
LINE_END = (~T.table(b"\n")).astype(np.uint8)
#: Hosts up to which a table of them is broadcast, and documents of a host from which it is sent to them beyond that.
BROADCAST, CROWD = 1_000_000, 100_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rules that reject by themselves, and rules that hold where a host fails them; each SQL is true for a failure.
BASE = {"short": "n_words < 10", "repetitive": "100 * n_repeat_words > 20 * n_words"}
HOST = {"symbols": "10 * n_symbols > n_words", "lines": "10 * n_dup_lines > 3 * n_lines", "length": "word_chars < 3 * n_words or word_chars > 10 * n_words"}


def _sums(marks: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many marks each text has."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[offs[1:]] - total[offs[:-1]]


def _again(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values of texts (which equal an earlier one of the text, which equal any other one)."""
    order = np.lexsort((np.arange(len(value)), value, text))
    same = (value[order][1:] == value[order][:-1]) & (text[order][1:] == text[order][:-1])
    later, other = np.zeros(len(value), bool), np.zeros(len(value), bool)
    later[order[1:][same]] = True
    other[order[1:][same]] = other[order[:-1][same]] = True
    return later, other


def measures(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """``MEASURES`` of each text of a block."""
    n = len(offs) - 1
    s = T.words(data, offs, T.WHITE)
    white = T.WHITE[data]
    text = np.repeat(np.arange(n), np.diff(s.first))

    lines = T.Spans(data, offs, LINE_END)
    of_text = np.repeat(np.arange(n), np.diff(lines.first))
    inked = np.concatenate([[0], np.cumsum(~white)])
    full = inked[lines.end] > inked[lines.start]
    later, _ = _again(T.Spans.ranges(lines.bytes(), lines.start[full], lines.end[full]), of_text[full])

    window, of_window = T.gram(s.hashes(), s.first, tuple(range(1, WINDOW)))
    at = np.flatnonzero(text[: len(text) - WINDOW + 1] == text[WINDOW - 1 :]) if len(text) >= WINDOW else np.zeros(0, np.int64)
    _, other = _again(window, of_window)
    edge = np.zeros(len(text) + WINDOW, np.int64)
    np.add.at(edge, at[other], 1)
    np.add.at(edge, at[other] + WINDOW, -1)
    covered = np.cumsum(edge)[: len(text)] > 0
    count = lambda of, kept=slice(None): np.bincount(of[kept], minlength=n)
    return [np.diff(s.first), _sums(((data & 0xC0) != 0x80) & ~white, offs), _sums(SYMBOLS[data], offs), count(of_text, full), count(of_text[full], later), count(text, covered)]


def measured(docs: DataFrame, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``key_cols`` and ``MEASURES`` of every whole text."""
    schema = docs.select(*key_cols).schema
    for c in MEASURES:
        schema = schema.add(c, "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.stack(measures(data, offs)) for _, _, data, offs in T.blocks(b.column(0))]
            found = np.concatenate(got, 1) if got else np.zeros((len(MEASURES), 0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(x.astype(np.int64)) for x in found)], schema.names)

    return in_arrow(docs.select(text_col, *key_cols), run, schema)


def prior(hosts: DataFrame, rules: list[str]) -> DataFrame:
    """One row: ``m_r``, the rate of all, and ``s_r``, how many documents the beta prior counts for, for each rule r, from (n, f_r) of all hosts.

    Kleinman's moments of a beta-binomial. Where hosts differ no more than by chance the prior counts for a billion.
    """
    n = F.sum("n").cast("double").alias("n")
    sums = hosts.agg(n, F.count(F.lit(1)).alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), *[F.sum(f"f_{r}").cast("double").alias(f"f_{r}") for r in rules], *[F.sum(F.col(f"f_{r}").cast("double") * F.col(f"f_{r}") / F.col("n")).alias(f"ff_{r}") for r in rules])
    out = []
    for r in rules:
        m = F.col(f"f_{r}") / F.col("n")
        chance = m * (1 - m) * (F.col("k") - 1)
        spread = F.try_divide(F.col(f"ff_{r}") - F.col("n") * m * m - chance, m * (1 - m) * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)))
        spread = F.least(F.greatest(F.coalesce(spread, F.lit(0.0)), F.lit(1e-9)), F.lit(1.0))
        out += [m.alias(f"m_{r}"), (1 / spread - 1).alias(f"s_{r}")]
    return sums.select(*out)


def host_rates(rows: DataFrame, host: str, rules: dict[str, Column]) -> DataFrame:
    """(host, n, rate of each rule): shrunk rates of failure of every host. Counts meet after they are added up in each task."""
    hosts = rows.groupBy(host).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("int")).alias(f"f_{r}") for r, c in rules.items()])
    hosts = materialize(hosts, shared_dir(rows.sparkSession), "hosts")
    both = hosts.crossJoin(F.broadcast(prior(hosts, list(rules))))  # one row
    return both.select(host, "n", *[((F.col(f"f_{r}") + F.col(f"m_{r}") * F.col(f"s_{r}")) / (F.col("n") + F.col(f"s_{r}"))).alias(r) for r in rules])


def judge(docs: DataFrame, text_col: str = "text", host: str = "source", key_cols: tuple[str, ...] = ("doc_id",), most: float = 0.5, base: dict[str, str] | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """``key_cols``, ``MEASURES``, ``base_failed``, ``failed`` (the host's rules that the document fails) and ``kept`` of every document.

    Texts are read once. Of the hosts just those with a rule in force are joined back: broadcast if a count shows them to be few,
    else only those with very many documents are, and the others meet their documents by a shuffle.
    """
    base, rules = base or BASE, rules or HOST
    rows = materialize(measured(docs, text_col, tuple(dict.fromkeys((*key_cols, host)))), shared_dir(docs.sparkSession), "measures")
    of = {r: F.expr(sql) for r, sql in rules.items()}
    base_failed = F.expr(" or ".join(f"({sql})" for sql in base.values()))
    rates = host_rates(rows, host, {"base": base_failed, **of})
    force = F.array_compact(F.array(*[F.when((F.col(r) > most) | (F.col("base") > most), F.lit(r)) for r in rules]))
    strict = rates.select(F.col(host).alias("_host"), F.col("n").alias("_n"), force.alias("force")).where(F.size("force") > 0)
    strict = materialize(strict, shared_dir(docs.sparkSession), "strict")
    rows = rows.withColumns({"base_failed": base_failed, "fails": F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in of.items()]))})
    same = F.col(host).eqNullSafe(F.col("_host"))
    if strict.count() <= BROADCAST:
        met = rows.join(F.broadcast(strict), same, "left")
    else:
        crowded = F.broadcast(strict.where(F.col("_n") >= CROWD))  # one for each CROWD documents at most
        met = rows.join(crowded, same).unionByName(rows.join(crowded, same, "left_anti").join(strict.where(F.col("_n") < CROWD), same, "left"))
    met = met.withColumn("failed", F.coalesce(F.array_intersect("fails", "force"), F.array().cast("array<string>")))
    return met.select(*key_cols, *MEASURES, "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
