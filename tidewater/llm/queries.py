"""The registered queries of these operators, each over its whole tables, and the SQL that they can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import ann, bpe, decontaminate, html_text, jaccard, langid, prefix_trie, quality, quality_rules, spelling, token_files, toxicity, url_filter
from tidewater.runtime import materialize, shared_dir, ship


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from; a null key counts as an empty one."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4 == 2


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").where(~held_out()))


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file; the same on every machine of the cluster."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.summary(decontaminate.hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(_read(spark, sf_dir, "pages"), html_text.fit())
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: Fixed rules of the URL filter: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def page_labels(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """(page_id, url, label) of every page: block where its main text is toxic or more likely bad than good, by the models
    fitted on the labelled documents; nothing of the URL takes part."""
    texts = html_text.extract(pages, html_text.fit())
    model = quality_model(spark, sf_dir)
    scored = toxicity.score(texts, toxicity_model(spark, sf_dir), key_cols=("page_id", "url", "text"))
    both = quality.importance(scored, model, key_cols=("page_id", "url", "score"))
    bad = (F.col("score") >= 0.3) | (quality.chance(model) < 0.5)
    return both.select("page_id", "url", F.when(bad, "block").otherwise("allow").alias("label"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    host, path = url_filter.host(F.col("url")), url_filter.path(F.col("url"))
    rule, verdict = url_filter.fixed(host, path, URL_RULES)
    # Learned from what the pages say, but for those held out; what URLs of bad pages have in common judges every URL without a fixed rule.
    mined = url_filter.mine(materialize(page_labels(spark, sf_dir, pages.where(~held_out("page_id"))), shared_dir(spark), "labelled"))
    out = url_filter.judge(pages, mined, key_cols=("page_id", "url"))
    own = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "mined")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.valid(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.search(rows, rows.where(F.col("id") % 20 == 0))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    return quality.fit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").where(~held_out()))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(_read(spark, sf_dir, "documents"), quality_model(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(_read(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(_read(spark, sf_dir, "conversations"), rebuild=True)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_bpe": op2_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_html_text": op4_html_text,
    "op5_url_filter": op5_url_filter,
    "op6_neighbours": op6_neighbours,
    "op7_jaccard": op7_jaccard,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_spelling": op11_spelling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_quality_rules": op13_quality_rules,
}

def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a text's UTF-8: a step takes a byte in, or one of its eight bits out."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    steps = f"flatten(list_transform({octets}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda c, b: {step}), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op11_spelling": rf"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
low AS (SELECT id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS k FROM runs WHERE length(r) >= 7 GROUP BY ALL),
hashed AS (SELECT r, k, {_crc32("id || ':' || r")} AS h FROM low),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, k FROM hashed),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS s FROM w, unnest(range(1, length(word) + 1)) AS t(i)),
near AS MATERIALIZED (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.s UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.s),
best AS (SELECT word, count(*) AS n_near, arg_min({{'w': near, 'n': n}}, {{'a': -n, 'b': encode(near)}}) AS f FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 10 * w.n THEN f.w END AS form, CASE WHEN f.n >= 10 * w.n THEN f.n END AS form_n FROM w LEFT JOIN best USING (word)),
path AS (SELECT word, coalesce(form, word) AS at, form IS NULL AS done FROM f UNION ALL SELECT p.word, coalesce(f.form, p.at), f.form IS NULL FROM path p JOIN f ON f.word = p.at WHERE NOT p.done)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, p.at AS root FROM f JOIN path p ON p.word = f.word AND p.done
""",
    "op12_prefix_trie": rf"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, list(x ORDER BY p) AS l FROM t GROUP BY c),
r AS (SELECT k.c, {_crc32("CAST(k.c AS VARCHAR)")} % 9 AS h, k.l, coalesce(b.l, []) AS base FROM k LEFT JOIN k b ON b.c = k.c - k.c % 5),
s AS MATERIALIZED (SELECT c, list_concat(base[1:h], l[h + 1:]) AS l FROM r),
m AS (SELECT c, d, l[1:d] AS pre, d = len(l) AS ends FROM s, unnest(range(0, len(l) + 1)) AS u(d)),
node AS MATERIALIZED (SELECT pre, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS e, (count(*) - 1) * coalesce(strlen(pre[d].t), 0) AS own FROM m GROUP BY pre, d),
kids AS (SELECT pre[1:d - 1] AS pre, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
up AS (SELECT a.pre[1:j] AS pre, j AS d, sum(own) AS own, count(*) FILTER (kids.n IS NULL) AS leaves FROM node a LEFT JOIN kids ON kids.pre = a.pre AND kids.d = a.d, unnest(range(0, a.d + 1)) AS u(j) GROUP BY 1, 2)
SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n AS n_convs, coalesce(kids.n, 0) AS n_children, up.leaves AS n_leaves, CAST(up.own AS BIGINT) AS saved_tokens, sha256(a.e) AS ends_sha256
FROM node a LEFT JOIN node b ON b.d = a.d - 1 AND b.pre = a.pre[1:a.d - 1] LEFT JOIN kids ON kids.pre = a.pre AND kids.d = a.d JOIN up ON up.pre = a.pre AND up.d = a.d
""",
    "op13_quality_rules": r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, w[i:i + 4] AS s FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
twice AS (SELECT r, unnest(range(i, i + 5)) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS k FROM win) WHERE k > 1),
again AS (SELECT r, count(DISTINCT j) AS n FROM twice GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS MATERIALIZED (SELECT d.doc_id, d.source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words FROM d JOIN lines USING (r) LEFT JOIN again USING (r)),
f AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS lines, word_chars < 3 * n_words OR word_chars > 10 * n_words AS length FROM m),
long AS (SELECT source, unnest([{'r': 'base', 'f': base_failed}, {'r': 'symbols', 'f': symbols}, {'r': 'lines', 'f': lines}, {'r': 'length', 'f': length}], recursive := true) FROM f),
host AS MATERIALIZED (SELECT r, source, count(*)::DOUBLE AS n, count(*) FILTER (f)::DOUBLE AS f FROM long GROUP BY r, source),
tot AS (SELECT r, sum(n) AS n, count(*) AS k, sum(n * n) AS nn, sum(f) AS f, sum(f * f / n) AS ff FROM host GROUP BY r),
mean AS (SELECT *, f / n AS m FROM tot),
spread AS (SELECT r, m, least(greatest(coalesce(CASE WHEN m * (1 - m) * (n - nn / n - (k - 1)) <> 0 THEN (ff - n * m * m - m * (1 - m) * (k - 1)) / (m * (1 - m) * (n - nn / n - (k - 1))) END, 0), 1e-9), 1) AS g FROM mean),
rate AS (SELECT source, r, (f + m * (1 / g - 1)) / (n + 1 / g - 1) AS p FROM host JOIN spread USING (r)),
bad AS (SELECT source, max(p) FILTER (r = 'base') > 0.5 AS b, max(p) FILTER (r = 'symbols') > 0.5 AS s, max(p) FILTER (r = 'lines') > 0.5 AS l, max(p) FILTER (r = 'length') > 0.5 AS g FROM rate GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (symbols AND (b OR s)) AND NOT (lines AND (b OR l)) AND NOT (length AND (b OR g)) AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
""",
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[i:i + least(10, len(w)) - 1] AS words FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(words) AS k FROM win),
pos AS (SELECT d.r, k, i, w[i:i + k - 1] AS words FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hit AS (SELECT pos.r, pos.k, pos.i, win.item FROM pos JOIN win ON win.words = pos.words),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, k, i FROM hit) h, unnest(range(h.i, h.i + h.k)) AS t(j) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN it ON it.r = d.r
""",
}
