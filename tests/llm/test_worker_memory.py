"""What a task's Python process keeps while it encodes texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidewater.llm import _pieces, _tasks, bpe, queries


def test_words_of_pieces_are_kept_once():
    path = queries.tokenizer("word_bpe_49k.json")
    b, pieces = bpe._made(path)
    texts = [" ".join(f"Word{k} \u00e9t\u00e9{k},{k}" for k in range(a, a + 300)) for a in range(0, 3000, 250)]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        got = [ids[i:j].tolist() for _, _, ids, cuts in pieces.texts(pa.array(texts), np.zeros(len(texts), bool)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        assert got == want
    assert pieces.at.n > 3000 and not b.known
    # A text that pieces can't be used for keeps its words, as nothing else does.
    odd = [ids.tolist() for _, _, ids, _ in pieces.texts(pa.array(texts[:1]), np.ones(1, bool))]
    assert odd == want[:1] and b.known


def test_tables_grow_by_what_takes_no_memory_yet():
    x = np.arange(5, dtype=np.int16)
    assert _pieces._doubled(x).tolist() == [0, 1, 2, 3, 4, 0, 0, 0, 0, 0] and _pieces._doubled(x).dtype == x.dtype


def test_what_is_made_for_tasks_is_made_once_and_trimmed(monkeypatch):
    made, trimmed = [], []
    monkeypatch.setattr(_tasks, "_KEPT", {})
    monkeypatch.setattr(_tasks, "_trim", lambda: trimmed.append(len(made)))
    assert [_tasks.kept("k", lambda: made.append(1) or 7) for _ in range(3)] == [7, 7, 7]
    assert made == [1] and trimmed == [1]
    _tasks.drop_others("k")
    assert trimmed == [1] and "k" in _tasks._KEPT
    _tasks.drop_others("other")
    assert trimmed == [1, 1] and not _tasks._KEPT
