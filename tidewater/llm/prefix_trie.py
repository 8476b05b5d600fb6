"""The prefix trie of conversations: which turns they share from the first on, and what sharing them would save.

Turns are known by 128-bit digests of role and text. A conversation is the array of its turns' digests, kept as one
binary value, which sorts as the array does. All arrays are range-sorted over the cluster. In each range one
sweep takes them in order: with the longest common prefix (LCP) of an array and the one before it, in turns, the nodes deeper than
that end, and the array's further turns begin new ones, so that the stack holds just the current path. A node that
begins and ends within a range is whole. Those on the path of a range's first array may have begun
in a range before, and those left on the stack may go on in the next: both paths are written as one row each, with the sums
of their nodes so far, and one more sweep over these two rows a range stitches them together. Nodes below an open node refer to it by
its place (range, depth, side), and get its smallest member once that is known.

Arrays are cut into levels of ``depth`` turns. A level's array has the digest of all turns before it as ``head``, and
levels are swept from the deepest on, each handing what lies below its roots to the level above: so no row grows with
the length of a conversation, and one conversation may hold any share of all turns. Arrays are sorted by conversation
last, so that equal ones, however many, are spread over ranges.

Hashing who ends at a node, in one order, is one sequence by its nature: an open node's members are written as
lists by range and hashed, 8 bytes each, as the stitching sweep reads them, one list at a time.

Defined results: rows without conv_id take no part; null turns come first; turns of equal number are ordered by their digest,
repeated ones are turns like others; null role or text is empty; ``rebuilt`` takes the remainder of a negative number
as SQL does; an empty table gives no node, not even a root; texts are taken whole, other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm._tasks import in_arrow
from tidewater.runtime import materialize, shared_dir
from tidewater.streaming.transforms import number

#: Bytes of a turn's digest.
WIDTH = 16
#: Turns of a level.
DEPTH = 256
#: Open nodes up to which a table of them is broadcast.
BROADCAST = 1_000_000
#: Conversations that share their first turns, and the most of these, in ``rebuilt``.
FAMILY, SHARED = 5, 9


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, digest, n_bytes) of every turn, with its number ``_n`` among all.

    Turns of all conversations are stored in one order by ranges and numbered; a turn's place in its own is its
    number less the first one's, so that no task holds a whole conversation.
    """
    said, says = F.coalesce(text, F.lit("")), F.coalesce(role, F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(says).cast("string"), F.lit(":"), says, said).cast("binary")))
    each = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("n_bytes"))
    return number(each, F.asc("conv"), F.asc_nulls_first("turn"), F.asc("digest"))


def lengths(numbered: DataFrame) -> DataFrame:
    """(conv, first, size) of every conversation."""
    return numbered.groupBy("conv").agg(F.min("_n").alias("first"), F.count(F.lit(1)).alias("size"))


def plain(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv, pos, digest, n_bytes), and (conv, size)."""
    own = lengths(numbered)
    return numbered.join(own.select("conv", "first"), "conv").select("conv", (F.col("_n") - F.col("first")).alias("pos"), "digest", "n_bytes"), own.select("conv", "size")


def rebuilt(numbered: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family does, as ``plain`` gives them: of conversation c the first
    h = crc32(c) % 9 turns are those of conversation c - c % 5, and its own after its first h follow."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    own = materialize(lengths(numbered).select("*", h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base")), path, "own")
    had = own.select(F.col("conv").alias("base"), F.least("size", F.lit(SHARED - 1)).alias("had"))
    own = own.join(had, "base", "left").withColumn("given", F.least("h", F.coalesce("had", F.lit(0)))).drop("had")
    own = materialize(own.withColumn("left", F.greatest(F.col("size") - F.col("h"), F.lit(0))), path, "plan")
    placed = numbered.join(own, "conv").withColumn("at", F.col("_n") - F.col("first"))
    rest = placed.where(F.col("at") >= F.col("h")).select("conv", (F.col("at") - F.col("h") + F.col("given")).alias("pos"), "digest", "n_bytes")
    # A base's first eight turns at most go to its family.
    heads = placed.where((F.col("conv") == F.col("base")) & (F.col("at") < SHARED - 1)).select("base", "at", "digest", "n_bytes")
    taken = heads.join(own.select("base", "conv", "given"), "base").where(F.col("at") < F.col("given")).select("conv", F.col("at").alias("pos"), "digest", "n_bytes")
    return rest.unionByName(taken), own.select("conv", (F.col("given") + F.col("left")).alias("size"))


def arrays(each: DataFrame, sizes: DataFrame, path: str, depth: int) -> DataFrame:
    """(level, head, key, bytes, conv, ends, next): a row for each level that a conversation reaches, the last of which may be empty.

    ``next`` is the head of the level after, and ``ends`` whether the conversation ends here.
    """
    cut = each.groupBy("conv", F.floor(F.col("pos") / depth).cast("int").alias("level")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n_bytes"))).alias("t"))  # ``depth`` at most
    key = F.unhex(F.array_join(F.transform("t.digest", lambda d: F.hex(d)), ""))
    cut = materialize(cut.select("conv", "level", key.alias("key"), F.col("t.n_bytes").alias("bytes")), path, "cut")
    none = F.lit(b"")
    # Every conversation has a level 0, and one after each full level.
    after = cut.where(F.size("bytes") == depth).select("conv", (F.col("level") + 1).alias("level"))
    reached = sizes.select("conv", F.lit(0).alias("level")).unionByName(after)
    empty = reached.join(cut, ["conv", "level"], "left_anti").select("conv", "level", none.alias("key"), F.array().cast("array<long>").alias("bytes"))
    rows = cut.unionByName(empty).join(sizes, "conv")
    rows = rows.withColumn("ends", F.col("size") == F.col("level") * depth + F.size("bytes"))
    # A conversation that fills its last level ends there, not in the empty one after it.
    rows = rows.withColumn("ends", F.col("ends") & ((F.size("bytes") > 0) | (F.col("level") == 0)))
    one = rows.where(F.col("size") < depth).select("level", none.alias("head"), "key", "bytes", "conv", "ends", F.lit(None).cast("binary").alias("next"))
    long = rows.where(F.col("size") >= depth)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The heads of a conversation's levels: digests of all before them."""
        for b in batches:
            conv, level, head, then = [], [], [], []
            for c, digests in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                so_far = hashlib.md5()
                for k, d in enumerate(digests):
                    conv.append(c)
                    level.append(k)
                    head.append(so_far.digest() if k else b"")
                    so_far.update(d["d"])
                    then.append(so_far.digest() if k + 1 < len(digests) else None)
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(level, pa.int32()), pa.array(head, pa.binary()), pa.array(then, pa.binary())], ["conv", "level", "head", "next"])

    # 16 bytes for each ``depth`` turns of a conversation come together.
    digests = long.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("level", F.unhex(F.md5("key")).alias("d")))).alias("d"))
    heads = in_arrow(digests, chain, "conv long, level int, head binary, next binary")
    many = long.join(heads, ["conv", "level"]).select("level", "head", "key", "bytes", "conv", "ends", "next")
    return materialize(one.unionByName(many), path, "arrays")


@dataclass
class Node:
    """A node on the current path; sums are of what lies below it, as far as it is whole."""

    size: int  # of its last text
    conv: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    below: tuple[int, int, int] | None = None  # children, leaves and saved of the level below
    ends: list[int] = field(default_factory=list)
    slot: int | None = None  # where it is written as an open node that began before
    held: list = field(default_factory=list)  # closed children, until their parent's smallest member is known
    hash: object = None
    slots: list[int] = field(default_factory=list)

    def close(self) -> tuple[int, int, int]:
        """(children, leaves, saved) of the node and all below it."""
        children, leaves, saved = self.children, self.leaves, self.saved
        if self.below:
            children, leaves, saved = children + self.below[0], leaves + self.below[1], saved + self.below[2]
        return children, leaves if children else 1, saved + (self.n - 1) * self.size


def _hash(ends: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common from the first on."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    low = 0
    while low + 1 < n:  # equal up to ``low`` turns, and not up to n
        mid = (low + n) // 2
        low, n = (mid, n) if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH] else (low, mid)
    return low


#: A node, an open path or what lies below a root; columns of other kinds are null.
OUT = (
    "kind int, head binary, conv long, depth long, parent long, slot long, n long, children long, leaves long, saved long, ends string, "
    "part int, side int, key binary, first int, sizes array<long>, convs array<long>, ns array<long>, cs array<long>, ls array<long>, ss array<long>, bc array<long>, bl array<long>, bs array<long>, who array<array<long>>"
)
NODE, PATH, BELOW, SLOT = range(4)
_FIELDS = [x.split()[0] for x in OUT.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}
_TYPES = {x.split()[0]: _TYPES[x.split()[1]] for x in OUT.split(", ")}


class Rows:
    """Rows of ``OUT`` to be written."""

    def __init__(self):
        self.rows: list[dict] = []

    def node(self, x: Node, depth: int, total: tuple[int, int, int], parent: int | None, slot: int | None, ends: str) -> None:
        self.rows.append({"kind": NODE, "conv": x.conv, "depth": depth, "parent": parent, "slot": slot, "n": x.n, "children": total[0], "leaves": total[1], "saved": total[2], "ends": ends})

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _TYPES[c]) for c in _FIELDS], _FIELDS)


def _place(part: int, depth: int, side: int) -> int:
    """Where an open node is written: its range, its depth in the level, and whether it began before (0) or goes on (1)."""
    return (part << 20 | depth) << 1 | side


def _sweep(level: int, depth: int):
    """A range's arrays, in order, to whole nodes, the two open paths, and what lies below roots of deeper levels."""
    start = level * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, stack, head, key = Rows(), [], None, b""
        first_head = first_key = None
        left: list[Node] = []
        part = 0

        def hand(x: Node, conv: int | None, slot: int | None) -> None:
            for r in x.held:
                r["parent"], r["slot"] = conv, slot
                out.rows.append(r)
            x.held = []

        def pop() -> None:
            x, at = stack.pop(), len(stack)
            if x.slot is not None:  # it may have begun before: what is known of it is written with the path
                return
            total = x.close()
            hand(x, x.conv, None)
            if at == 0 and level:
                out.rows.append({"kind": BELOW, "head": head, "children": total[0], "leaves": total[1] if total[0] else 0, "saved": total[2]})
                return
            row = Rows()
            row.node(x, start + at, total, None, None, _hash(x.ends))
            if at == 0:
                out.rows += row.rows
                return
            up = stack[-1]
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + total[1], up.saved + total[2]
            up.held += row.rows
            if up.slot is not None:
                hand(up, None, up.slot)

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for part, h, k, sizes, conv, ends, below in zip(*cols, strict=True):
                common = lcp(key, k) if h == head else -1
                while len(stack) > common + 1:
                    pop()
                begins = first_head is None
                if begins:
                    first_head, first_key = h, k
                head, key = h, k
                while len(stack) <= len(sizes):
                    at = len(stack)
                    stack.append(Node(sizes[at - 1] if at else 0))
                    if begins:
                        stack[-1].slot = _place(part, at, 0)
                        left.append(stack[-1])
                for x in stack:
                    x.n += 1
                    if x.conv is None or conv < x.conv:
                        x.conv = conv
                if ends:
                    stack[-1].ends.append(conv)
                if below is not None:
                    stack[-1].below = (below["children"], below["leaves"], below["saved"])
            if len(out.rows) > 20_000:
                yield out.batch()
        if first_head is None:
            return

        def path(h: bytes, k: bytes, nodes: list[Node], at: int, side: int) -> None:
            b = [x.below or (None, None, None) for x in nodes]
            out.rows.append({"kind": PATH, "part": part, "side": side, "head": h, "key": k, "first": at, "sizes": [x.size for x in nodes], "convs": [x.conv for x in nodes], "ns": [x.n for x in nodes], "cs": [x.children for x in nodes], "ls": [x.leaves for x in nodes], "ss": [x.saved for x in nodes], "bc": [x[0] for x in b], "bl": [x[1] for x in b], "bs": [x[2] for x in b], "who": [x.ends for x in nodes]})

        path(first_head, first_key, left, 0, 0)
        at = next((i for i, x in enumerate(stack) if x.slot is None), len(stack))
        for i in range(at, len(stack)):
            hand(stack[i], None, _place(part, i, 1))
        path(head, key, stack[at:], at, 1)
        yield out.batch()

    return run


def _stitch(level: int, depth: int):
    """Open paths of all ranges, in order, to whole nodes, and where each of them was written."""
    start = level * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, stack, head, key = Rows(), [], None, b""

        def pop() -> None:
            x, at = stack.pop(), len(stack)
            total = x.close()
            for s in x.slots:
                out.rows.append({"kind": SLOT, "slot": s, "conv": x.conv})
            if at == 0 and level:
                out.rows.append({"kind": BELOW, "head": head, "children": total[0], "leaves": total[1] if total[0] else 0, "saved": total[2]})
                return
            out.node(x, start + at, total, None, stack[-1].slots[0] if stack else None, x.hash.hexdigest())
            if stack:
                up = stack[-1]
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + total[1], up.saved + total[2]

        for b in batches:
            for r in b.to_pylist():
                common = lcp(key, r["key"]) if r["head"] == head else -1
                while len(stack) > common + 1:
                    pop()
                head, key = r["head"], r["key"]
                for i, size in enumerate(r["sizes"]):
                    at = r["first"] + i
                    if at == len(stack):
                        stack.append(Node(size, hash=hashlib.sha256()))
                    x = stack[at]
                    x.slots.append(_place(r["part"], at, r["side"]))
                    x.conv = min(c for c in (x.conv, r["convs"][i]) if c is not None)
                    x.n, x.children, x.leaves, x.saved = x.n + r["ns"][i], x.children + r["cs"][i], x.leaves + r["ls"][i], x.saved + r["ss"][i]
                    if r["bc"][i] is not None:
                        x.below = (r["bc"][i], r["bl"][i], r["bs"][i])
                    if r["who"][i]:
                        x.hash.update((("," if x.ends else "") + ",".join(map(str, r["who"][i]))).encode())
                        x.ends = [0]  # some are hashed
            if len(out.rows) > 20_000:
                yield out.batch()
        while stack:
            pop()
        yield out.batch()

    return run


def _few(rows: DataFrame) -> DataFrame:
    """Broadcast if the counted rows are few, else as it is."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def trie(each: DataFrame, sizes: DataFrame, path: str, depth: int = DEPTH) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node, from
    conversations as ``plain`` and ``rebuilt`` give them."""
    if not 0 < depth < 1 << 20:
        raise ValueError("a level has between 1 and 2**20 - 1 turns")
    rows = arrays(each, sizes, path, depth)
    top = rows.agg(F.max("level")).first()[0] or 0
    below, made = None, []
    for level in range(top, -1, -1):
        own = rows.where(F.col("level") == level).drop("level")
        if below is None:
            own = own.withColumn("below", F.lit(None).cast("struct<children:long,leaves:long,saved:long>"))
        else:
            # Few reach a deeper level: only they meet what lies there.
            met = own.where(F.col("next").isNotNull()).join(below, "next", "left")
            own = met.unionByName(own.where(F.col("next").isNull()), allowMissingColumns=True)
        ranged = own.select("head", "key", "bytes", "conv", "ends", "below").repartitionByRange("head", "key", "conv").sortWithinPartitions("head", "key", "conv")
        swept = ranged.select(F.spark_partition_id().alias("part"), "*")
        swept = materialize(in_arrow(swept, _sweep(level, depth), OUT), path, f"swept-{level}")
        # Two rows for each range, in their order.
        paths = swept.where(F.col("kind") == PATH).select("part", "side", "head", "key", "first", "sizes", "convs", "ns", "cs", "ls", "ss", "bc", "bl", "bs", "who")
        stitched = materialize(in_arrow(paths.repartition(1).sortWithinPartitions("part", "side"), _stitch(level, depth), OUT), path, f"stitched-{level}")
        both = swept.unionByName(stitched)
        below = both.where(F.col("kind") == BELOW).select(F.col("head").alias("next"), F.struct("children", "leaves", "saved").alias("below"))
        slots = _few(stitched.where(F.col("kind") == SLOT).select("slot", F.col("conv").alias("_parent")))
        nodes = both.where(F.col("kind") == NODE)
        referred = nodes.where(F.col("slot").isNotNull()).join(slots, "slot").withColumn("parent", F.col("_parent")).select("conv", "depth", "parent", "n", "children", "leaves", "saved", "ends")
        made.append(referred.unionByName(nodes.where(F.col("slot").isNull()).select(*referred.columns)))
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    names = {"conv": "conv_id", "depth": "depth", "parent": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "ends": "ends_sha256"}
    return out.select(*[F.col(a).alias(b) for a, b in names.items()])


def build(conversations: DataFrame, rebuild: bool = False, depth: int = DEPTH, conv: str = "conv_id") -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text), of the conversations as they are or as ``rebuilt`` makes them."""
    path = shared_dir(conversations.sparkSession)
    numbered = turns(conversations, conv)
    each, sizes = rebuilt(numbered, path) if rebuild else plain(numbered)
    return trie(each, sizes, path, depth)
