"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set holds the hashes (64 bits) of its distinct shingles of five words; words are cut
at ASCII white space, A-Z lower-cased; a text of fewer words has its whole sequence as
its one shingle. Two texts link where 100 x intersection >= 80 x union.

Texts of equal sets are one class, and only classes are joined. All sets are ordered alike, by
how often a shingle was counted and then by hash. If two sets of n and m shingles link, they
share at least T(n) = ceil(0.8 n) of them, so that the prefixes of n - T(n) + l and
m - T(m) + l shingles share at least l, for any l up to T. Each class chooses its l, from 1
to ``levels`` (7 at most), by the estimated cost of its candidates: frequent shingles make it lengthen
its prefix, and then more of them must be shared before a pair is verified. A pair is held to the
smaller l of the two, and to prefixes for just its two sizes.

What is asked for are components, not all pairs, so that a large group of similar texts is
never expanded. First the classes that share a prefix shingle are paired with one leader of
the group, pairs that meet often enough are verified, and links make components; a group whose
classes are all in one component is done. What is left is joined exactly: every pair of
classes of different components that shares prefix shingles enough is verified. A shingle
that very many texts were counted to have is split into parts by class, each with
its own leader, and the leaders of the parts are paired with the first of them. What is left of
a group of very many classes is joined in blocks of them.

Counts are taken within tasks, so that a shingle of very many texts which meets itself in
none is taken for rare at first. Where prefixes turn out to crowd under a shingle, it gets the
count of these, moves behind the rarer ones in the order, and prefixes are chosen anew.

Defined results: an empty or null text has an empty set and links with nothing, its component is
its own id; rows with a null id get their number of shingles and no component; an id given
more than once counts as linked with all its texts; empty tables give empty results; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import _text as T
from tidewater.llm._tasks import in_arrow
from tidewater.runtime import materialize, shared_dir

#: Where the words of texts end.
WORDS = 5
#: Shingles whose counts order the sets, 10 bytes each in a task; beyond these the order is by hash alone, which changes cost, not results.
COUNTED = 1 << 20
#: How often a shingle beyond these is taken to stand: once, but for one in so many.
UNLISTED = 1.01
#: Counted texts with a shingle for which its group has one more part.
PART = 4096
#: How often prefixes are chosen at most: crowded shingles that are left then cost pairs, not links.
ROUNDS = 3
#: Texts of a class above which its component is sent to them.
CROWD = 1000
#: Rows of ids up to which a table of them is broadcast: 16 bytes each, 4 MB, of which the driver holds rows, hash table and blocks at once.
BROADCAST = 250_000


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """The least intersection of a set of n with any that it links with."""
    return (80 * n + 99) // 100


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted set of each text of a block."""
    s = T.words(data, offs, T.WHITE)
    h = s.hashes(T.LOWER)
    g, text = T.gram(h, s.first, tuple(range(1, WORDS)))
    cuts = np.searchsorted(text, np.arange(len(offs)))
    for i in range(len(offs) - 1):
        a, z = s.first[i], s.first[i + 1]
        if 0 < z - a < WORDS:
            yield T.gram(h[a:z], np.array([0, z - a]), tuple(range(1, z - a)))[0]
        else:
            yield np.unique(g[cuts[i] : cuts[i + 1]])


def class_of(found: np.ndarray) -> int:
    """The class of a set: 63 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little") >> 1


def _ids(texts: pa.Array, keys: pa.Array) -> Iterator[tuple[int | None, np.ndarray]]:
    for a, z, data, offs in T.blocks(texts):
        yield from zip(keys.slice(a, z - a).to_pylist(), shingle_sets(data, offs), strict=True)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text (doc, cls, n), and rows (shingle, count) of what stands in several texts of this task."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(held), return_counts=True)
        value, n = value[n > 1], n[n > 1]
        none = pa.nulls(len(value), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(value.view(np.int64)), pa.array(n)], ["doc", "cls", "n", "shingle", "count"])

    for b in batches:
        docs, cls, n = [], [], []
        for doc, found in _ids(b.column(1), b.column(0)):
            docs.append(doc)
            cls.append(class_of(found))
            n.append(len(found))
            held.append(found)
            size += len(found)
            if size > 1_000_000:
                yield counted()
                held, size = [], 0
        none = pa.nulls(len(docs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), none, none], ["doc", "cls", "n", "shingle", "count"])
    if held:
        yield counted()


def choose(counts: np.ndarray, levels: int, verify: float = 16.0) -> tuple[int, int]:
    """(l, prefix length) of least estimated cost for a set in order, given how often each shingle was counted.

    Every other holder of a prefix shingle is a posting to read; of these, one in l is taken to become a pair to verify.
    """
    n = len(counts)
    t = int(needed(n))
    most = max(1, min(levels, t))
    postings = np.cumsum(counts[: n - t + most].astype(np.float64) - 1.0)[n - t :]
    steps = np.arange(1, most + 1)
    best = int(np.argmin(postings + verify * postings / steps))
    return best + 1, n - t + best + 1


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast if the counted rows are few enough, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", levels: int = 4) -> DataFrame:
    """(id, ``n_shingles``, ``component_id``) per row of the documents; component_id is the smallest id that links reach."""
    path = shared_dir(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    first = materialize(in_arrow(texts, _first_pass, "doc long, cls long, n long, shingle long, count long"), path, "first")
    rows = first.where(F.col("n").isNotNull()).select("doc", "cls", "n")
    members = rows.where((F.col("n") > 0) & F.col("doc").isNotNull())
    counts = _listed(first.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("count").alias("count")))
    total = members.count()
    classes = materialize(members.groupBy("cls").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("texts")), path, "classes", total)

    shared = _placed(texts, members, classes, counts, levels, path, total)
    most = shared.count()
    links, labels, seen = _same_id(members, path, total), None, None
    for k, pairs in enumerate((_leader_pairs, _rest_pairs)):
        pairs = pairs(shared, labels, seen, path, most)
        found = _verify(texts, classes, pairs, path, k)
        if k == 0 or found.limit(1).count():
            links = links.unionByName(found)
            labels = components(links, path, f"round{k}", labels)
        seen = pairs
    low = labels.join(classes, labels.node == classes.cls).groupBy("label").agg(F.min("rep").alias("component"))
    of_class = classes.join(labels.join(low, "label").select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", "texts", F.coalesce("component", "rep").alias("component"))
    # The texts of a class with very many don't meet in one task: such classes are few, and their components are sent to the texts.
    small, hot = of_class.where(F.col("texts") <= CROWD).select("cls", "component"), of_class.where(F.col("texts") > CROWD).select("cls", "component")
    linked = F.col("doc").isNotNull() & (F.col("n") > 0)
    alone, hot = rows.where(~linked).withColumn("component", F.col("doc")), _bounded(hot)
    crowded = rows.where(linked).join(hot, "cls")
    others = rows.where(linked).join(hot.select("cls"), "cls", "left_anti").join(small, "cls")
    out = alone.unionByName(crowded).unionByName(others)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _listed(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the largest counts, at most ``COUNTED``, in ascending order, and their counts; they come as Arrow, 16 bytes each."""
    got = counted.select("shingle", "count").orderBy(F.desc("count"), "shingle").limit(COUNTED).toArrow()
    value, count = got["shingle"].to_numpy().view(np.uint64), got["count"].to_numpy()
    order = np.argsort(value)
    return value[order], count[order]


def _known(counts: tuple[np.ndarray, np.ndarray], shingles: np.ndarray) -> np.ndarray:
    """The listed counts of the shingles, 0 of those not listed."""
    value, count = counts
    if not len(value):
        return np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(value, shingles), len(value) - 1)
    return np.where(value[at] == shingles, count[at], 0)


def _raised(counts: tuple[np.ndarray, np.ndarray], crowds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The list with the counts of ``crowds`` for theirs, cut to the largest."""
    value, first = np.unique(np.concatenate([crowds[0], counts[0]]), return_index=True)
    count = np.concatenate([crowds[1], counts[1]])[first]
    if len(value) > COUNTED:
        most = np.sort(np.lexsort((value.view(np.int64), -count))[:COUNTED])
        value, count = value[most], count[most]
    return value, count


def _same_id(members: DataFrame, path: str, total: int) -> DataFrame:
    """Links between the classes of an id that has several."""
    several = members.groupBy("doc").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where(F.col("a") != F.col("z")).select("doc", "a")
    several = materialize(several, path, "several", total)
    return members.join(_bounded(several), "doc").where(F.col("cls") != F.col("a")).select("a", F.col("cls").alias("b")).distinct()


def _placed(texts: DataFrame, members: DataFrame, classes: DataFrame, counts: tuple[np.ndarray, np.ndarray], levels: int, path: str, total: int) -> DataFrame:
    """The prefix shingles of ``_shared_prefixes``, in an order in which no shingle that prefixes crowd under was taken for rare."""
    # Of each class its text with the smallest id speaks; the ids of all others are few, or shuffled.
    reps = classes.select(F.col("rep").alias("doc"), "cls")
    copies = materialize(members.join(reps, ["doc", "cls"], "left_anti").distinct(), path, "copies", total)
    for k in range(ROUNDS):
        shared = _shared_prefixes(texts, copies, counts, levels, path, k)
        crowd, size = _listed(shared.where(F.col("crowd").isNotNull()).groupBy("shingle").agg(F.max("crowd").alias("count")))
        known = _known(counts, crowd)
        size = size * _parts(known)
        more = size > 2 * known
        if not more.any():
            break
        counts = _raised(counts, (crowd[more], size[more]))
    return shared


def _parts(count: np.ndarray) -> np.ndarray:
    """In how many parts the group of a shingle is, that was counted so often."""
    return np.where(count > PART, count // PART + 1, 1)


def _shared_prefixes(texts: DataFrame, copies: DataFrame, counts: tuple[np.ndarray, np.ndarray], levels: int, path: str, k: int) -> DataFrame:
    """(shingle, part, cls, n, at, l, lead, crowd): prefix shingles that several classes have, their place in the set's order, the leader of the group, and its size if it is very large. Part 0 is of a group with no others."""
    listed, often = counts
    hot = often > PART
    order_b = texts.sparkSession.sparkContext.broadcast((listed, np.minimum(often, 65_535).astype(np.uint16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, count = order_b.value
        for b in batches:
            docs, cls, meta, tokens, size = [], [], [], [], []
            for doc, found in _ids(b.column(1), b.column(0)):
                n = len(found)
                if not n or doc is None:
                    continue
                often = np.full(n, UNLISTED, np.float32)
                if len(value):
                    at = np.minimum(np.searchsorted(value, found), len(value) - 1)
                    hit = value[at] == found
                    often[hit] = count[at[hit]]
                order = np.argsort(often, kind="stable")
                l, p = choose(often[order], levels)
                docs.append(doc)
                cls.append(class_of(found))
                meta.append(n << 33 | l)
                tokens.append(found[order[:p]].view(np.int64))
                size.append(p)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(cls, pa.int64()), pa.array(meta, pa.int64()), lists], ["doc", "cls", "meta", "tokens"])

    made = in_arrow(texts, run, "doc long, cls long, meta long, tokens array<long>")
    own = made.join(_bounded(copies), ["doc", "cls"], "left_anti")
    # What is shuffled of each row: the shingle, its part, the class, and n, place and l in one number (30, 30 and 3 bits).
    each = own.select("cls", "meta", F.posexplode("tokens").alias("at", "shingle"))
    each = each.select("shingle", "cls", F.col("meta").bitwiseOR(F.shiftleft(F.col("at").cast("long"), 3)).alias("meta"))
    part, split = F.lit(0), F.lit(False)
    if hot.any():  # at most COUNTED rows
        parts = pa.table({"shingle": listed[hot].view(np.int64), "parts": _parts(often[hot])})
        parts = texts.sparkSession.createDataFrame(parts, "shingle long, parts long")
        each = each.join(F.broadcast(parts), "shingle", "left")
        part, split = F.coalesce(F.pmod(F.xxhash64("cls"), "parts") + 1, F.lit(0)), F.col("part") > 0
    each = each.select("shingle", part.cast("int").alias("part"), "cls", "meta")
    # An id given twice with one text would stand in a group twice; such groups are only larger than need be.
    w = Window.partitionBy("shingle", "part")
    lead = F.struct(_at("meta").alias("at"), "cls", "meta")  # the one with the fewest rarer shingles, as what others were copied from has
    grouped = each.withColumns({"group": F.count(F.lit(1)).over(w), "least": _n(F.min("meta").over(w)), "lead": F.min(lead).over(w)}).where((F.col("group") > 1) | split)
    whole = F.struct(F.col("lead.cls").alias("cls"), _n("lead.meta").alias("n"), F.col("lead.at").alias("at"), _l("lead.meta").alias("l"))
    rows = grouped.select("shingle", "part", "cls", _n("meta").alias("n"), _at("meta").alias("at"), _l("meta").alias("l"), whole.alias("lead"), F.when(split, 0).otherwise(F.col("least")).alias("least"), F.when(F.col("group") > 2 * PART, F.col("group")).alias("crowd"))
    shared = materialize(_useful(rows).drop("least"), path, f"shared{k}")
    order_b.destroy()
    return shared


def _n(meta: str | Column) -> Column:
    return F.shiftright(meta, 33)


def _at(meta: str | Column) -> Column:
    return F.shiftright(meta, 3).bitwiseAND(F.lit((1 << 30) - 1)).cast("int")


def _l(meta: str | Column) -> Column:
    return F.col(meta).bitwiseAND(F.lit(7)).cast("int")


def _fits(a: str, b: str) -> Column:
    """Whether sets of these sizes may link and, if so, the shingle's places are within the prefixes for just these sizes.

    Two sets of n and m need ceil(80 (n + m) / 180) in common; the first l of these stand
    among the first n less that plus l of either.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    least = F.floor((80 * (n + m) + 179) / 180)
    l = F.least(F.col(f"{a}.l"), F.col(f"{b}.l"))
    return (n * 100 >= m * 80) & (m * 100 >= n * 80) & (F.col(f"{a}.at") < n - least + l) & (F.col(f"{b}.at") < m - least + l)


def _useful(rows: DataFrame) -> DataFrame:
    """Rows that can still link: with its shingle at this place a set links with ones of at most so many, and the group's least has no more."""
    most = F.floor((F.col("n") - F.col("at") + F.col("l") - 1) * 180 / 80) - F.col("n")
    return rows.where((most >= F.col("least")) & (most * 100 >= F.col("n") * 80))


def _often(met: DataFrame, a: Column, b: Column) -> DataFrame:
    """Pairs (a, b) that meet under as many shingles as the smaller l of the two."""
    each = met.where(_fits("p", "q")).select(a.alias("a"), b.alias("b"), F.least(F.col("p.l"), F.col("q.l")).alias("low"))
    return each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.max("low").alias("low")).where(F.col("met") >= F.col("low")).select("a", "b")


def _leader_pairs(shared: DataFrame, labels: None, seen: None, path: str, most: int) -> DataFrame:
    """Each class with leaders of its groups, where it meets one often enough under its lead; what meets less often is left to the rest."""
    own = shared.select("shingle", F.struct("cls", "n", "at", "l").alias("p"), F.col("lead").alias("q"))
    parts = shared.where(F.col("part") > 0).select("shingle", "lead").distinct()
    top = parts.groupBy("shingle").agg(F.min(F.struct("lead.at", "lead.cls", "lead")).alias("top")).select("shingle", F.col("top.lead").alias("q"))
    met = own.unionByName(parts.join(top, "shingle").select("shingle", F.col("lead").alias("p"), "q")).where(F.col("p.cls") != F.col("q.cls"))
    return materialize(_often(met, F.col("p.cls"), F.col("q.cls")), path, "pairs0", most)


def _rest_pairs(shared: DataFrame, labels: DataFrame, seen: DataFrame, path: str, most: int) -> DataFrame:
    """Every pair of classes of different components that shares prefix shingles enough.

    Only groups with several components take part. The component of a group's smallest label, as
    a rule its largest, is not joined with itself, so that its size enters once. Of a group of more than ``PART``
    classes each block of those outside that component meets each block of all, as a key of its own.
    """
    comp = _bounded(labels.select(F.col("node").alias("cls"), "label"))
    rows = shared.select("shingle", "cls", "n", "at", "l").join(comp, "cls", "left").withColumn("comp", F.coalesce("label", "cls")).drop("label")
    rows = materialize(rows, path, "labelled")
    mixed = rows.groupBy("shingle").agg(F.min("comp").alias("main"), F.max("comp").alias("z"), F.min("n").alias("least"), F.count(F.lit(1)).alias("holders")).where(F.col("main") != F.col("z")).select("shingle", "main", "least", "holders")
    rows = materialize(_useful(rows.join(mixed, "shingle")), path, "open")
    few, many = rows.where(F.col("holders") <= PART), rows.where(F.col("holders") > PART)
    met = _meet(few.where(F.col("comp") != F.col("main")), few, ["shingle"])
    if many.limit(1).count():
        met = met.unionByName(_meet(*_blocks(many, path), ["shingle", "i", "j"]))
    pairs = _often(met, F.least("p.cls", "q.cls"), F.greatest("p.cls", "q.cls"))
    tried = seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialize(pairs.join(_bounded(tried), ["a", "b"], "left_anti"), path, "pairs1")


def _meet(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """(p, q) of classes of different components at one key, each pair once."""
    p, q = p.alias("p"), q.alias("q")
    met = p.join(q, reduce(and_, [F.col(f"p.{k}") == F.col(f"q.{k}") for k in keys]) & (F.col("p.comp") != F.col("q.comp")) & ((F.col("q.comp") == F.col("q.main")) | (F.col("p.cls") < F.col("q.cls"))))
    return met.select(*[F.struct(*[f"{side}.{c}" for c in ("cls", "n", "at", "l")]).alias(side) for side in ("p", "q")])


def _blocks(many: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The two sides of the join of large groups: a class of block i outside the main component once for each block j of all, and the other way round."""
    outside = many.where(F.col("comp") != F.col("main"))
    sizes = outside.groupBy("shingle").agg(F.count(F.lit(1)).alias("outside"), F.first("holders").alias("all"))
    sizes = sizes.select("shingle", F.floor(F.col("outside") / PART).cast("int").alias("is"), F.floor(F.col("all") / PART).cast("int").alias("js"))
    sizes = _bounded(materialize(sizes, path, "blocks"))

    def dealt(rows: DataFrame, own: str, blocks: str, other: str, others: str) -> DataFrame:
        return rows.join(sizes, "shingle").withColumn(own, F.pmod(F.xxhash64("cls"), F.col(blocks) + 1).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), others)))

    return dealt(outside, "i", "is", "j", "js"), dealt(many, "j", "js", "i", "is")


def _verify(texts: DataFrame, classes: DataFrame, pairs: DataFrame, path: str, k: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole sets."""
    most = pairs.count()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes, "cls").select(F.col("rep").alias("doc"), "cls")
    wanted = materialize(wanted, path, f"wanted{k}", 2 * most)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column(2).to_pylist()
            for a, z, data, offs in T.blocks(b.column(1)):
                got = [(c, x.tobytes()) for c, x in zip(want[a:z], shingle_sets(data, offs), strict=True) if class_of(x) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())], ["cls", "s"])

    made = materialize(in_arrow(texts.join(_bounded(wanted), "doc").select("doc", "text", "cls"), sets, "cls long, s binary"), path, f"sets{k}")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * n >= 80 * (len(x) + len(y) - n))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = made.select(F.col("cls").alias("a"), F.col("s").alias("x")), made.select(F.col("cls").alias("b"), F.col("s").alias("y"))
    both = left.join(_bounded(pairs), "a").join(right, "b").select("a", "b", "x", "y")
    return materialize(in_arrow(both, check, "a long, b long").distinct(), path, f"links{k}", most)


def components(links: DataFrame, path: str, name: str, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node reachable by links (a, b), for every node of a link.

    Each round takes the least label among a node's neighbours and then the label of that
    label; each is written and read again, which ends its lineage.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    most = 2 * links.count()
    both = materialize(both, path, f"{name}-links", most)
    now = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
    if labels is not None:
        now = now.join(labels.withColumnRenamed("label", "had"), "node", "left").select("node", F.least("label", F.coalesce("had", "label")).alias("label"))
    now, k = materialize(now, path, f"{name}-0", most), 0
    while True:
        k += 1
        least = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = now.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = now.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = new.join(far, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        new = materialize(new, path, f"{name}-{k}", most)
        changed = new.where(F.col("label") != F.col("old")).limit(1).count()
        now = new.select("node", "label")
        if not changed:
            return now
