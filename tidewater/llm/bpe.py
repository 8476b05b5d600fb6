"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each leaf holds the merge rank of a symbol with its right neighbour. The root yields
the lowest rank, and of equal ones the leftmost; a merge changes three leaves, each in
a logarithmic number of steps, until no pair is left that merges. Each distinct piece
of text is encoded once by a process; ids of a text are those of its pieces in order.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated
rows get the same ids; an empty table gives an empty result; other columns of the input
are not read. Special tokens in a text are taken as such, as the file says.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidewater.llm._pieces import Pieces
from tidewater.llm._tasks import in_arrow, kept

#: Above any packed leaf: ranks of a file and positions in a word of memory's size stay far below.
NONE = 1 << 100


class RankTree:
    """Minimum over leaves, packed as rank times the number of leaves plus position; position breaks ties to the left."""

    def __init__(self, ranks: list[int]):
        self.bits = bits = max(0, (len(ranks) - 1).bit_length())
        self.size = size = 1 << bits
        self.node = node = [NONE] * size + [NONE if r < 0 else r << bits | i for i, r in enumerate(ranks)] + [NONE] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def set(self, i: int, rank: int) -> None:
        node = self.node
        k = i + self.size
        node[k] = NONE if rank < 0 else rank << self.bits | i
        while k > 1:
            k >>= 1
            a, b = node[2 * k], node[2 * k + 1]
            low = a if a < b else b
            if node[k] == low:
                break
            node[k] = low

    def lowest(self) -> int:
        """Position of the leftmost lowest rank, or -1."""
        top = self.node[1]
        return -1 if top == NONE else top & (self.size - 1)


class Bpe:
    """A BPE file of the tokenizers library whose words end in a suffix, and whose white space is dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special, self.token = special, {i: t for t, i in {**vocab, **special}.items()}
        self.cut = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.merges = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        t = Tokenizer.from_file(path)
        self.normal, self.split = t.normalizer, t.pre_tokenizer
        # The byte alphabet as the file's pre-tokenizer writes it; characters up to U+017F need no composing.
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.plain = regex.compile(r"[\x21-\x7e\xa1-ſ]*")
        shown = list(range(0x21, 0x7F)) + list(range(0xA1, 0xAD)) + list(range(0xAE, 0x100))
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.first = [vocab[letter[b]] for b in range(256)]
        self.last = [vocab[letter[b] + self.suffix] for b in range(256)]
        self.byte = {c: b for b, c in letter.items()}
        self.known: dict[bytes, list[int]] = {}

    def word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = got = self.merge(word)
        return got

    def merge(self, word: bytes) -> list[int]:
        symbols = [self.first[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        n, merges = len(symbols), self.merges
        if n == 1:
            return symbols
        none = (-1, -1)
        made = [merges.get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        tree = RankTree([r for r, _ in made])
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while (i := tree.lowest()) >= 0:
            j = right[i]
            symbols[i], symbols[j] = made[i][1], -1
            right[i] = k = right[j]
            if j < n - 1:
                tree.set(j, -1)
            if k < n:
                left[k] = i
                made[i] = merges.get((symbols[i], symbols[k]), none)
                tree.set(i, made[i][0])
            else:
                tree.set(i, -1)
            h = left[i]
            if h >= 0:
                made[h] = merges.get((symbols[h], symbols[i]), none)
                tree.set(h, made[h][0])
        return [s for s in symbols if s >= 0]

    def encode(self, text: str, word: Callable[[bytes], list[int]] | None = None) -> list[int]:
        """Ids of any text, special tokens in it included. word: ids of one word; by default they are kept for the next."""
        word = word or self.word
        out: list[int] = []
        at = 0
        for m in self.cut.finditer(text):
            out += self._between(text[at : m.start()], word)
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._between(text[at:], word) if at else self._between(text, word)

    def _between(self, text: str, word: Callable[[bytes], list[int]]) -> list[int]:
        if not text:
            return []
        if self.plain.fullmatch(text):
            words = [w.encode() for w in self.words.findall("".join(map(str.lower, text)) if "Σ" in text else text.lower())]
        else:
            words = [bytes(map(self.byte.__getitem__, w)) for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))]
        if len(words) == 1:
            return word(words[0])
        return [i for w in words for i in word(w)]

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by one space, as a file without a decoder has it."""
        return " ".join(map(self.token.__getitem__, ids))


def _made(path: str) -> tuple[Bpe, Pieces]:
    b = Bpe(path)
    # A piece is asked for once and then kept there, so that its words are not kept a second time.
    return b, Pieces(lambda pieces: [b.encode(p, b.merge) for p in pieces], b.encode, False)


def _pattern(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def encode_decode(docs: DataFrame, tokenizer: str, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``key_cols``, ``ids`` (array of int) and ``decoded`` (text) of every whole text."""
    schema = docs.select(*key_cols).schema.add("ids", ArrayType(IntegerType(), False), False).add("decoded", "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, pieces = kept(f"bpe {tokenizer}", lambda: _made(tokenizer))
        special = "|".join(map(_pattern, b.special)) or "(?:^.)^"
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            for a, z, ids, cuts in pieces.texts(texts, np.asarray(pc.match_substring_regex(texts, special))):
                listed = ids.tolist()
                decoded = [b.decode(listed[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for c in batch.columns[1:]), lists, pa.array(decoded, pa.string())], schema.names)

    return in_arrow(docs.select(F.col(text_col), *key_cols), run, schema, f"bpe {tokenizer}")
