"""Spelling variants, conversation tries and quality rules against brute-force versions, odd cases included."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, views
from tests.llm.test_operators import ODD, low
from tidewater.llm import _text, prefix_trie, quality_rules, queries, spelling
from tidewater.runtime import shared_dir

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling", "op12_prefix_trie", "op13_quality_rules"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), views(SMALL), queries.ORACLE_SQL[name])


# Spelling.
def counted(docs, least_n=2):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= least_n}


def edits(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words):
    near = {w: [v for v in words if edits(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v), default=None) for w, vs in near.items()}
    form = {w: v if v is not None and words[v] >= 10 * words[w] else None for w, v in form.items()}
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return out


def found(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()}


def test_words_are_counted_over_whole_texts(spark):
    long = "x" * 700 + "É" * 40
    texts = [*enumerate(ODD), *[(900 + k, t) for k, t in enumerate(["Straße×÷GRÖSSE naïveté", f"{long} {long}", "abcdefg", "hijklmn", "", "ÀÉÎabcd-ÀÉÎabcd", "écoleĀétudiant étudiant"] * 3)], *[(None, "Anonymous anonymous")] * 4, *[(k, "Understanding understanding misunderstanding " * 9) for k in range(400)]]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = {r.word: r.n for r in spelling.count(docs).collect()}
    assert got == counted(texts) and len(got) > 20
    assert spelling.variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.count(docs, least_length=3)


@pytest.mark.parametrize("seed", range(3))
def test_near_words_and_roots_are_the_brute_force_ones(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "abcé", "abcdefghijklmnopqrstuvwxyzÀ×ÿ"][seed]
    words = {}
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, 10)))
        for n in (3000, 300, 20, 20, 2, 2):  # chains of ever rarer variants, and ties
            words[w] = max(words.get(w, 0), n + rng.randint(0, 1))
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
            w = w if len(w) >= 7 else w + "aaaaaaa"
    words["z" * 900], words["z" * 901], words["z" * 450 + "y" + "z" * 450] = 2, 40, 3
    rows = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    want = grouped(words)
    assert found(spelling.group(rows)) == want
    assert any(form and root != form for _, _, _, form, _, root in want)


def test_words_with_a_common_rare_bigram_do_not_all_meet(spark):
    """A third of all words hold one rare bigram, far from one another: what meets stays in proportion to the words."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abcdefgh") for _ in range(6)) + "qx" + "".join(rng.choice("abcdefgh") for _ in range(6)): 2 for _ in range(3000)}
    words |= {"".join(rng.choice("abcdefgh") for _ in range(14)): 2 for _ in range(6000)}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = spelling.near_pairs(rows)
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in words for i in range(len(a)) for c in "abcdefghqx" if a < (b := a[:i] + c + a[i + 1 :]) and b in words}


# Conversation tries.
def trie_of(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(p)))) for p, members in nodes.items()}
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items())


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def sequences(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    digest = lambda x: hashlib.md5(f"{len(x[0].encode())}:{x[0]}{x[1]}".encode()).digest()
    return {c: [x[2] for x in sorted(s, key=lambda x: (x[:2], digest(x[2])))] for c, s in convs.items()}


def rebuild(convs):
    out = {}
    for c, s in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + s[h:]
    return out


def talk(seed, n, deepest, long, words="ab"):
    """Turns of conversations that share beginnings, with copies, one very long one, nulls and ties."""
    rng, rows, pool = random.Random(seed), [], []
    for c in range(n):
        if pool and rng.random() < 0.6:
            base = rng.choice(pool)
            s = base[: rng.randint(0, len(base))] if rng.random() < 0.8 else list(base)
        else:
            s = []
        while rng.random() < 0.7 and len(s) < deepest:
            s.append((rng.choice(["u", "a", None]), rng.choice([None, "é" * 3, *words])))
        pool.append(s)
        ids = c * 3 - n if rng.random() < 0.9 else c * 3 - n - 1
        rows += [(ids, k if k or rng.random() < 0.5 else None, r, t) for k, (r, t) in enumerate(s)]
    rows += [(None, 0, "u", "lost")] * 3 + [(5 * n, k, "u", "long") for k in range(long)] + [(5 * n + 1, k, "u", "long") for k in range(12 if long < 64 else 64)] + [(5 * n + 5, 1, "u", "tie"), (5 * n + 5, 1, "a", "tie"), (5 * n + 5, 1, "a", "tie")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("depth", "parts"), [(256, 1), (256, 23), (3, 7), (64, 9)])
def test_trie_is_the_brute_force_one(spark, depth, parts):
    rows = talk(depth + parts, 150, 12, 13 if depth == 3 else 130)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert as_rows(prefix_trie.build(df, depth=depth)) == trie_of(sequences(rows))
        assert as_rows(prefix_trie.build(df, rebuild=True, depth=depth)) == trie_of(rebuild(sequences(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_of_one_conversation_are_spread_and_hashed_in_order(spark):
    rows = [(c, k, "u", f"t{k}") for c in range(600) for k in range(3)] + [(c, k, "u", f"t{k}") for c in range(600, 640) for k in range(2 + c % 2 * 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        each, sizes = prefix_trie.plain(prefix_trie.turns(df))
        got = as_rows(prefix_trie.trie(each, sizes, shared_dir(spark)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == trie_of(sequences(rows))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.build(none).count() == 0 and prefix_trie.build(none, rebuild=True).count() == 0
    few = [(c, 0, "u", "x") for c in range(1, 40)]  # most lose their only turn, as their base has none
    got = as_rows(prefix_trie.build(spark.createDataFrame(few, none.schema), rebuild=True))
    assert got == trie_of(rebuild(sequences(few))) and got[0][:2] == (1, 0)
    with pytest.raises(ValueError):
        prefix_trie.trie(none, none, "", 0)


@pytest.mark.parametrize("seed", range(4))
def test_common_prefixes(seed):
    rng = random.Random(seed)
    for _ in range(300):
        a, b = ([rng.choice([b"a" * 16, b"b" * 16]) for _ in range(rng.randint(0, 9))] for _ in range(2))
        want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert prefix_trie.lcp(b"".join(a), b"".join(b)) == want


# Quality rules.
def measure(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def rule_texts():
    rng = random.Random(2)
    made = ["\n".join(" ".join(rng.choice(["a", "bb", "é#", "the", "x|y"]) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    return [*ODD, "\n\n\n", "a\na\n a\na ", "\r\n", "one two three four five " * 2, "ab " * 4, "x" * 3000 + "\n" + "x" * 3000, *made]


def test_measures_are_the_brute_force_ones(spark):
    texts = rule_texts()
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: tuple(r[c] for c in quality_rules.MEASURES) for r in quality_rules.measured(docs.drop("n_words")).collect()}
    assert got == {i: measure(t) for i, t in enumerate(texts)}
    assert quality_rules.judge(docs).count() == len(texts) and quality_rules.judge(docs.limit(0)).count() == 0


def shrunk(hosts):
    """Rates of (n, f) of each host by the moments of a beta-binomial."""
    n, f = (np.array([x[k] for x in hosts.values()], float) for k in (0, 1))
    total, k, m = n.sum(), len(n), f.sum() / n.sum()
    chance = m * (1 - m) * (k - 1)
    below = m * (1 - m) * (total - (n * n).sum() / total - (k - 1))
    g = min(max(((f * f / n).sum() - total * m * m - chance) / below if below else 0, 1e-9), 1)
    return {h: (f + m * (1 / g - 1)) / (n + 1 / g - 1) for h, (n, f) in hosts.items()}


def host_docs():
    good = "Each of these words stands here once, and nothing about this line is odd or said again today."
    marks = good + " " + " ".join(f"#{k}" for k in range(9))
    lines = "\n".join([*["This line is said thrice."] * 3, good])
    rows = [(i, marks if i % 4 else good, "marks.org") for i in range(40)] + [(100 + i, good if i % 9 else marks, "fine.org") for i in range(200)] + [(400, marks, "one.org")]
    rows += [(500 + i, "few words" if i % 3 else lines if i % 2 else good, "junk.org") for i in range(60)] + [(700 + i, lines, None) for i in range(30)] + [(800, None, "fine.org"), (800, None, "fine.org")]
    return rows


@pytest.mark.parametrize("few", [True, False])
def test_host_verdicts_are_the_brute_force_ones(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(quality_rules, "BROADCAST", 0)
        monkeypatch.setattr(quality_rules, "CROWD", 35)
    rows = host_docs()
    m = [(i, s, *measure(t)) for i, t, s in rows]
    fails = [{"base": w < 10 or 100 * again > 20 * w, "symbols": 10 * sym > w, "lines": 10 * dup > 3 * ln, "length": chars < 3 * w or chars > 10 * w} for _, _, w, chars, sym, ln, dup, again in m]
    rates = {r: shrunk({s: (sum(x[1] == s for x in m), sum(f[r] for x, f in zip(m, fails, strict=True) if x[1] == s)) for s in {x[1] for x in m}}) for r in fails[0]}
    want = Counter()
    for (i, s, *_), f in zip(m, fails, strict=True):
        force = [r for r in ("symbols", "lines", "length") if rates[r][s] > 0.5 or rates["base"][s] > 0.5]
        want[i, f["base"], tuple(r for r in force if f[r]), not f["base"] and not any(f[r] for r in force)] += 1
    got = Counter((r.doc_id, r.base_failed, tuple(r.failed), r.kept) for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got == want
    kept = {i: k for i, _, _, k in got}
    assert kept[0] and not kept[1] and kept[100] and not kept[501]
    assert all(kept[i] for i, t, s in rows if t and t.startswith("Each") and "#" not in t)  # clean ones stay, whatever their host


def test_one_host_and_no_failures_are_no_division_by_zero(spark):
    good = "Each of these words stands here once, and nothing about this line is odd or said again."
    for rows in ([(1, good, "a")], [(1, good, "a"), (2, good, "b")], [(1, "", "a"), (2, None, "a")]):
        got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert [r.kept for r in got] == [bool(t) for _, t, _ in rows]


def test_equal_values_within_a_text_only():
    later, other = quality_rules._again(np.array([5, 5, 7, 5, 7], np.uint64), np.array([0, 0, 0, 1, 1]))
    assert later.tolist() == [False, True, False, False, False] and other.tolist() == [True, True, False, False, False]
    assert _text.table(b"#")[ord("#")]
