"""Counting of terms in a task, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest

from quillstack.llm import source_audit


def batches(rows, size):
    for k in range(0, len(rows), size):
        part = rows[k : k + size]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.string()) for i in range(3)], ["lang", "source", "text"])


def counted(rows, size=7):
    n, docs, groups, emitted = Counter(), Counter(), set(), 0
    for b in source_audit._count(batches(rows, size)):
        for lang, source, term, x, y in zip(*(c.to_pylist() for c in b.columns)):
            if term is None:
                groups.add((lang, source))
                assert x == y == 0
            else:
                n[lang, source, term] += x
                docs[lang, source, term] += y
                emitted += 1
    return n, docs, groups, emitted


def plain(rows):
    n, docs = Counter(), Counter()
    for lang, source, text in rows:
        words = [w.decode() for w in source_audit._TERM.findall((text or "").encode().lower())]
        n.update((lang, source, w) for w in words)
        docs.update((lang, source, w) for w in set(words))
    return n, docs, {r[:2] for r in rows}


@pytest.mark.parametrize("block, held", [(1 << 23, 1 << 20), (40, 1 << 20), (40, 30), (1 << 23, 1)])
def test_counts_of_odd_texts(monkeypatch, block, held):
    monkeypatch.setattr(source_audit, "BLOCK", block)
    monkeypatch.setattr(source_audit, "HELD", held)
    draw = random.Random(5)
    texts = [None, "", " ", "a", "A", "É", "é", "a1b", "x\x00y", "[a]{B}@`Z", "計約 ÀÉ", "🙂🙂", "the The THE", "end", "start " * 30, "q" * 90]
    rows = [(draw.choice("de"), draw.choice("st"), "".join(draw.choice(["", " ", "-"]) + (draw.choice(texts) or "") for _ in range(draw.randrange(4))) if draw.random() < 0.9 else draw.choice(texts)) for _ in range(400)]
    rows += [("only", "empty", None), ("only", "blank", "12 34")]
    assert counted(rows)[:3] == plain(rows)
    assert counted(rows[::-1], 500)[:3] == plain(rows)


def test_counts_of_nothing():
    assert counted([])[:3] == (Counter(), Counter(), set())


def test_a_task_adds_up_its_counts():
    """A term comes out of a task once, also if there are some hundred thousand."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in letters[:18])
    n, docs, _, emitted = counted([("l", "s", text)] * 3, 1)
    assert emitted == len(n) == 26**3 * 18 and set(n.values()) == set(docs.values()) == {3}
