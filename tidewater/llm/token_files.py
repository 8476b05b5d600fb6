"""Token-ID output: Arrow files of fixed-size lists, for zero-copy access to equal-length sequences.

``write`` encodes every whole text with a byte-level BPE file of the tokenizers library,
appends an end id to each document, and packs the ids, in ascending order of the key, into
sequences of one length. A range of keys is a shard: ``tokens-N.arrow`` holds record
batches of ``tokens`` and ``mask``, fixed-size lists of ``sequence`` entries (mask: real
ids; only the end of a shard is padded), and ``index-N.arrow`` holds key, offset and
number of ids of each document. Sequence ``s`` of a shard is row ``s % rows`` of batch
``s // rows``, so that a memory-mapped reader finds any of them by arithmetic. A shard
is written under a name of its own and then renamed: a repeated task leaves the same file.

Defined results: a null or empty text is the end id alone; rows with equal keys stand in
the order of their texts within a shard, and of hashes of these between shards; rows with a null key come first; an empty table leaves no
files and an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm._pieces import Pieces
from tidewater.llm._tasks import in_arrow, kept
from tidewater.runtime import materialize, shared_dir

#: White space that is not ASCII, or that not all libraries take for white space: such texts are encoded whole.
ODD = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _encoder(path: str) -> tuple[Pieces, int, str]:
    """Pieces, vocabulary size and pattern of odd texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    many = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    added = [pc_escape(x.content) for x in t.get_added_tokens_decoder().values()]
    return Pieces(many, lambda x: many([x])[0], True), t.get_vocab_size(True), "|".join([ODD, *added])


def pc_escape(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


class _Writer:
    """The two files of a shard; ids go in as they come, in batches of ``rows`` sequences."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, sequence: int, rows: int):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.root, recursive=True)
        self.names = [f"{kind}-{shard:06d}.arrow" for kind in ("tokens", "index")]
        self.temp = [f".{x}.{uuid.uuid4().hex}" for x in self.names]
        self.dtype, self.sequence, self.batch = dtype, sequence, sequence * rows
        ids = pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), False), sequence)
        self.schema = pa.schema([("tokens", ids), ("mask", pa.list_(pa.field("item", pa.bool_(), False), sequence))])
        self.sinks = [self.files.open_output_stream(posixpath.join(self.root, x)) for x in self.temp]
        self.out = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], pa.schema([("key", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())]))
        self.held: list[np.ndarray] = []
        self.waiting = self.total = self.docs = 0

    def add(self, keys: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(self.total + cuts[:-1]), pa.array(np.diff(cuts))], self.index_names))
        self.total += len(ids)
        self.docs += len(keys)
        self.held.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        if self.waiting >= self.batch:
            self._flush(False)

    index_names = ["key", "offset", "n_tokens"]

    def _flush(self, end: bool) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, self.dtype)])
        while len(ids) >= self.batch or end and len(ids):
            part, ids = ids[: self.batch], ids[self.batch :]
            n = -(-len(part) // self.sequence) * self.sequence
            lists = [np.concatenate([part, np.zeros(n - len(part), self.dtype)]), np.arange(n) < len(part)]
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip(lists, self.schema, strict=True)], schema=self.schema))
        self.held, self.waiting = [ids], len(ids)

    def close(self) -> None:
        self._flush(True)
        for w, s, a, b in zip((self.out, self.index), self.sinks, self.temp, self.names, strict=True):
            w.close()
            s.close()
            self.files.move(posixpath.join(self.root, a), posixpath.join(self.root, b))


def write(docs: DataFrame, tokenizer: str, end_id: int, text_col: str = "text", key_col: str = "doc_id", folder: str | None = None, sequence: int = 2048, rows: int = 32) -> DataFrame:
    """Write all texts; returns the manifest: folder, shard, n_docs, n_tokens, start (ids of all shards before)."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    folder = folder or f"{path}/tokens"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, vocabulary, odd = kept(f"token files {tokenizer}", lambda: _encoder(tokenizer))
        dtype = np.dtype(np.uint16 if max(vocabulary - 1, end_id) < 1 << 16 else np.uint32)
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            out = out or _Writer(folder, TaskContext.get().partitionId(), dtype, sequence, rows)
            texts = pc.fill_null(b.column(1), "")
            for a, z, ids, cuts in pieces.texts(texts, np.asarray(pc.match_substring_regex(texts, odd))):
                n = np.arange(z - a)
                ended = np.insert(ids, cuts[1:], end_id)
                out.add(b.column(0).slice(a, z - a), ended, cuts + np.append(n, z - a))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "n_docs": pa.array([out.docs]), "n_tokens": pa.array([out.total])})

    rows_in = docs.select(F.col(key_col).cast("long").alias("k"), F.col(text_col).alias("t")).repartitionByRange("k", F.xxhash64("t")).sortWithinPartitions("k", "t")
    shards = materialize(in_arrow(rows_in, run, "shard int, n_docs long, n_tokens long", f"token files {tokenizer}"), path, "shards")
    start = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.select(F.lit(folder).alias("folder"), "shard", "n_docs", "n_tokens", start.alias("start"))


def open_shard(folder: str, shard: int) -> tuple[pa.ipc.RecordBatchFileReader, pa.Table]:
    """Reader of a shard's sequences (memory-mapped where the file is local) and its index."""
    files, root = fs.FileSystem.from_uri(folder)
    names = [posixpath.join(root, f"{kind}-{shard:06d}.arrow") for kind in ("tokens", "index")]
    tokens, index = (pa.memory_map(x) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(x) for x in names)
    return pa.ipc.open_file(tokens), pa.ipc.open_file(index).read_all()


def ids_of(reader: pa.ipc.RecordBatchFileReader, offset: int, n: int, kept: dict) -> np.ndarray:
    """``n`` ids from ``offset``; only the batches that hold them are touched. kept: the last batch, between calls."""
    if not n:
        return np.zeros(0, np.uint32)
    size = kept.setdefault("size", reader.get_batch(0).num_rows * reader.schema.field("tokens").type.list_size)
    parts = []
    for k in range(offset // size, (offset + n - 1) // size + 1):
        if kept.get("k") != k:
            kept["k"], kept["ids"] = k, reader.get_batch(k).column(0).flatten().to_numpy()
        parts.append(kept["ids"][max(0, offset - k * size) : offset + n - k * size])
    return np.concatenate(parts)


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, shard, start in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                reader, index = open_shard(folder, shard)
                offset, n, kept = index["offset"].to_numpy(), index["n_tokens"].to_numpy(), {}
                crc = [zlib.crc32(ids_of(reader, o, k, kept).astype("<u4").tobytes()) for o, k in zip(offset.tolist(), n.tolist(), strict=True)]
                for a in range(0, len(n), 10_000):
                    cut = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_arrays([index["key"].combine_chunks()[cut], pa.array(start + offset[cut]), pa.array(n[cut]), pa.array(crc[cut], pa.int64())], names)

    shards = manifest.select("folder", "shard", "start")
    return in_arrow(shards.repartition(max(1, manifest.count())), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
