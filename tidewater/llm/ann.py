"""Approximate nearest neighbours by additive quantisation.

A vector's direction is the sum of one codeword from each of several full-dimensional codebooks,
trained one after another on what the ones before leave over. Encoding is a beam search
over these sums. An index keeps the codes, and the exact norm over that of the sum.
Search adds table entries (query times codeword) along a vector's codes, scales the total
by the stored norms, keeps the best ``shortlist`` per query, and ranks these by the exact
inner product of the original vectors in double precision. Norms are doubles and directions
have length one, so that components of any finite size take part.

Copies of one vector are indexed at most k + 1 times, with the smallest ids: no more can
be among the k nearest. A task holds a slice of the index, past which all queries go in
blocks, and keeps only their shortlists: what is sent is the queries, once a slice.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
nor do those whose length is not the commonest; ties go to the smaller id, and products
that overflow to no number come last; an id given
twice counts once, with its larger score; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm._tasks import in_arrow
from tidewater.runtime import materialize, shared_dir


@dataclass(frozen=True)
class Codebooks:
    """``words``: (books, words a book, dimensions)."""

    words: np.ndarray


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that take part, as arrays of double."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (common.d if common else 0))


def books_for(d: int, words: int = 256, most: int = 1 << 26) -> int:
    """How many codebooks serve ``d`` dimensions: a bit and a half for each, 24 at least, and beyond that as many as ``most`` bytes hold, which are broadcast."""
    return max(24, min(3 * d // 16, most // (words * d * 4), (1 << 16) // words))


def shortlist_for(d: int) -> int:
    """How many candidates are ranked exactly for vectors of ``d`` dimensions: 200 up to 64, from there on with the square, up to 12,800.

    Without structure the nearest stand out the less the more dimensions there are: of 20,000 directions of 256, a shortlist of 200
    holds half of the 20 nearest and one of 3,200 with 48 codebooks 96 %.
    """
    return min(12_800, max(200, 200 * d * d // 4096))


def fit(rows: DataFrame, books: int | None = None, words: int = 256, max_sample: int = 8192, rounds: int = 6) -> Codebooks | None:
    """Codebooks, by default ``books_for`` the dimensions, from at most ``max_sample`` vectors, those of the smallest hash of the id; only the fit is so bounded."""
    sample = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(max_sample).select("v").collect()]
    if not sample:
        return None
    x = _directions(np.array(sample, np.float64))[0]
    rng, out = np.random.default_rng(3), []
    for _ in range(books or books_for(x.shape[1], words)):
        c = x[rng.permutation(len(x))[:words]]
        c = np.concatenate([c, np.zeros((words - len(c), x.shape[1]), np.float32)])
        for _ in range(rounds):
            near = (0.5 * (c * c).sum(1) - x @ c.T).argmin(1)
            n = np.bincount(near, minlength=words)
            total = np.zeros_like(c)
            total[n > 0] = np.add.reduceat(x[np.argsort(near, kind="stable")], (np.cumsum(n) - n)[n > 0])
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), words)])
        out.append(c)
        x = x - c[(0.5 * (c * c).sum(1) - x @ c.T).argmin(1)]
    return Codebooks(np.stack(out))


def encode(x: np.ndarray, books: Codebooks, beam: int = 4) -> np.ndarray:
    """(vectors, books) codes whose sum is near, by beam search; code = book * words a book + word."""
    m, k, d = books.words.shape
    n = len(x)
    codes, left, cost = np.zeros((n, 1, 0), np.int64), x[:, None, :], np.zeros((n, 1), np.float32)
    for j, c in enumerate(books.words):
        flat = (cost[:, :, None] + (c * c).sum(1) - 2 * (left @ c.T)).reshape(n, -1)
        b = min(beam if j + 1 < m else 1, flat.shape[1])
        pick = np.argpartition(flat, b - 1, 1)[:, :b]
        cost = np.take_along_axis(flat, pick, 1)
        parent, word = pick // k, pick % k
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None] + j * k], 2)
        left = np.take_along_axis(left, parent[:, :, None], 1) - c[word]
    return codes[:, 0]


def index(rows: DataFrame, books: Codebooks, k: int = 20, block: int = 4096) -> DataFrame:
    """Blocks of up to ``block`` encoded vectors: block, ids, codes, scale (binary columns)."""
    books_b = rows.sparkSession.sparkContext.broadcast(books)

    def first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, list[int]] = {}
            v = _matrix(b.column(1))
            for i, x in zip(b.column(0).to_pylist(), v, strict=True):
                seen.setdefault(x.tobytes(), []).append(i)
            pairs = [(i, x) for x, ids in seen.items() for i in sorted(set(ids))[: k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.binary())], ["id", "raw"])

    # Equal rows become one across all batches: repeats would use up shortlists.
    copies = in_arrow(rows.select("id", "v"), first_copies, "id long, raw binary").distinct()
    copies = copies.withColumn("n", F.dense_rank().over(Window.partitionBy("raw").orderBy("id"))).where(F.col("n") <= k + 1).select("id", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_b.value
        for b in batches:
            for a in range(0, b.num_rows, block):
                part = b.slice(a, block)
                x, norm = _directions(np.frombuffer(b"".join(part.column(1).to_pylist()), np.float64).reshape(part.num_rows, -1))
                codes = np.concatenate([encode(x[i : i + 256], books) for i in range(0, len(x), 256)])
                sums = books.words.reshape(-1, x.shape[1])[codes].sum(1)
                scale = norm / np.maximum(np.linalg.norm(sums, axis=1), 1e-6)
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_pydict({"block": pa.array([int(ids.min())]), "ids": [ids.tobytes()], "codes": [codes.astype(np.uint16).tobytes()], "scale": [scale.tobytes()]})

    return in_arrow(copies, run, "block long, ids binary, codes binary, scale binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one (float32), and the lengths; lengths past 1e300 count as that."""
    top = np.abs(x).max(1)
    x = x / top[:, None]
    n = np.sqrt((x * x).sum(1))
    with np.errstate(over="ignore"):
        return (x / n[:, None]).astype(np.float32), np.minimum(top * n, 1e300)


def search(rows: DataFrame, queries: DataFrame, k: int = 20, shortlist: int | None = None, query_block: int = 256, slice_rows: int = 1 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among ``rows``, both (id, v) of ``valid``.

    The shortlist, by default ``shortlist_for`` the dimensions, is longer than k; more of it finds more. Each query meets each code, so that work is
    the product of both sizes: the query set is the caller's to state. (Cells around centroids would not
    spare enough: on directions without structure 30 % of 1,024 cells hold 86 % of the nearest.) A slice has at most
    about ``slice_rows`` vectors, 70 MB, so that shortlists are a small share of it; with fewer slices than cores, the
    queries go in groups, each past a copy of the slice.
    """
    spark = rows.sparkSession
    path = shared_dir(spark)
    books = fit(rows)
    if books is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    shortlist = shortlist or max(2 * k, shortlist_for(books.words.shape[2]))
    found = materialize(index(rows, books, k), path, "index")
    books_b = spark.sparkContext.broadcast(books)
    hashes = rows.groupBy("id").agg(F.min(F.xxhash64("v")).alias("a"), F.max(F.xxhash64("v")).alias("z"))
    several = bool(hashes.where(F.col("a") != F.col("z")).limit(1).count())  # an id with several vectors

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, query_block):
                part = b.slice(a, query_block)
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "raw": [_directions(_matrix(part.column(1)))[0].tobytes()]})

    asked = queries.select("id", "v").distinct()
    # A number of its own for each block of queries, fixed by being written.
    packed = in_arrow(asked.coalesce(max(1, -(-asked.count() // 20_000))), pack, "ids binary, raw binary").withColumn("number", F.monotonically_increasing_id())
    packed = materialize(packed, path, "queries")
    total = found.agg(F.sum(F.octet_length("ids") / 8)).first()[0]
    slices = max(1, -(-int(total) // slice_rows))
    groups = -(-spark.sparkContext.defaultParallelism // slices)
    of_index = found.select(F.pmod(F.xxhash64("block", "ids"), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(-1).cast("long").alias("number"), "ids", F.col("codes").alias("raw"), "scale")
    of_queries = packed.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.pmod("number", F.lit(groups)).cast("int").alias("group"), "number", "ids", "raw", F.lit(None).cast("binary").alias("scale"))
    paired = of_index.unionByName(of_queries).repartition(2 * slices * groups, "slice", "group").sortWithinPartitions("slice", "group", "number")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_b.value
        m, words, d = books.words.shape
        flat = books.words.reshape(m * words, d)
        at, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if at != (r["slice"], r["group"]):
                    at, held = (r["slice"], r["group"]), []
                ids = np.frombuffer(r["ids"], np.int64)
                if r["number"] < 0:  # a block of the index, all of which come before the queries
                    held.append((ids, np.frombuffer(r["raw"], np.uint16).reshape(len(ids), m), np.frombuffer(r["scale"], np.float64)))
                    continue
                tables = np.ascontiguousarray((np.frombuffer(r["raw"], np.float32).reshape(len(ids), d) @ flat.T).T)
                best = np.full((len(ids), 0), 0, np.int64), np.full((len(ids), 0), 0.0)
                for mine, codes, scale in held:
                    near = tables[codes[:, 0]]
                    for j in range(1, m):
                        near += tables[codes[:, j]]
                    near = (near * scale[:, None]).T
                    near[mine[None, :] == ids[:, None]] = -np.inf
                    both = np.concatenate([best[0], np.broadcast_to(mine, near.shape)], 1), np.concatenate([best[1], near], 1)
                    if several:
                        _once(*both)
                    best = _best(*both, shortlist)
                q, c = np.nonzero(np.isfinite(best[1]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best[0][q, c]), pa.array(best[1][q, c])], ["query_id", "vec_id", "near"])

    near = in_arrow(paired, score, "query_id long, vec_id long, near double")
    if slices > 1:
        if several:
            near = near.groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))).where(F.col("n") <= shortlist)
    exact = near.select("query_id", "vec_id").join(rows.select(F.col("id").alias("vec_id"), F.col("v").alias("a")), "vec_id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("b")), "query_id")
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    scored = exact.select("query_id", "vec_id", product.alias("score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(-float("inf")))), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _once(ids: np.ndarray, near: np.ndarray) -> None:
    """Leaves each id of a row only its largest value; the others become minus infinity."""
    for i, x in zip(ids, near, strict=True):
        order = np.argsort(-x, kind="stable")
        again = np.ones(len(x), bool)
        again[order[np.unique(i[order], return_index=True)[1]]] = False
        x[again] = -np.inf


def _best(ids: np.ndarray, near: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the n largest, ties to smaller ids."""
    if near.shape[1] <= n:
        return ids.copy(), near
    edge = np.partition(near, near.shape[1] - n, 1)[:, near.shape[1] - n]
    out_ids, out = np.empty((len(near), n), np.int64), np.empty((len(near), n), near.dtype)
    for i in range(len(near)):
        above, level = np.flatnonzero(near[i] > edge[i]), np.flatnonzero(near[i] == edge[i])
        if len(above) + len(level) > n:
            level = level[np.argsort(ids[i, level], kind="stable")[: n - len(above)]]
        keep = np.concatenate([above, level])
        out_ids[i], out[i] = ids[i, keep], near[i, keep]
    return out_ids, out
