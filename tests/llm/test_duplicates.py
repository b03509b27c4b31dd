"""Near-duplicates, components and repeated paragraphs: against plain Python."""

from __future__ import annotations

import collections
import random
import re

import pytest

from quillstack.llm.components import components
from quillstack.llm.minhash_join import near_duplicates
from quillstack.llm.paragraph_dedup import recall, remove_repeats, repeated_lines, repeated_paragraphs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, k=5):
    w = word_list(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def expected_components(rows, percent):
    sets, u = [shingle_set(t) for _, t in rows], Union(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                u.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = u.find(i)
        least[r] = min(least.get(r, 1 << 60), d)
    return [(d, len(sets[i]), least[u.find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_near_duplicates(documents):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: rng.choices(vocabulary, k=n)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two three four"), (6, "one two three four five"), (7, "One  two\nthree four five")]
    centre = text(60)
    for _ in range(40):  # a group in which some are near and some are not
        w = list(centre)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(w)))
    for _ in range(30):
        rows.append((len(rows), " ".join(text(rng.randrange(1, 80)))))
        rows.append((len(rows), rows[-1][1]))
        chained = rows[-1][1].split()
        rows.append((len(rows), " ".join(chained[:-1] + ["end"])))
    rows += [rows[10], (len(rows) + 5, "x" * 100_000)]
    got = near_duplicates(documents(rows), matches=20).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(expected_components(rows, 85))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_tables(documents):
    assert near_duplicates(documents([])).count() == 0
    got = near_duplicates(documents([(None, "a b c d e f"), (7, "a b c d e f"), (7, "other words are in here now")])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in got) == [(False, 7), (False, 7), (True, 7)]


def test_crowded_lists(documents, monkeypatch):
    """Lists that are handled in several blocks, with the full sets brought to them."""
    from quillstack.llm import minhash_join

    monkeypatch.setattr(minhash_join, "MEMBERS", 20)
    monkeypatch.setattr(minhash_join, "SHORT", 4)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    centre, rows = rng.choices(vocabulary, k=70), []
    for d in range(90):
        w = list(centre)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((d, " ".join(w)))
    got = near_duplicates(documents(rows), matches=16).collect()
    want = expected_components(rows, 85)
    assert len({c for *_, c in want}) > 3
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)] + [(200, 201), (200, 201), (201, 200), (300, 300)]
    u = Union(400)
    for a, b in edges:
        u.join(a, b)
    least = {}
    for n in range(400):
        least.setdefault(u.find(n), n)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*edges, (None, 5)], "a long, b long")).collect()}
    assert got == {n: least[u.find(n)] for a, b in edges for n in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall():
    assert recall(0.8) > 0.99 and recall(1.0) == 1.0


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n)) + "."


def test_repeated_paragraphs(documents):
    rng = random.Random(8)
    passage = " ".join(sentence(rng, n) for n in (12, 9, 15, 11, 8, 10))
    near = passage.replace("w1", "w1x", 1)
    clean = [sentence(rng, 30) + " " + sentence(rng, 14) for _ in range(6)]
    short = sentence(rng, 9)
    line = sentence(rng, 25)
    rows = [
        (1, f"{sentence(rng, 5)} {passage} {sentence(rng, 20)}"),
        (2, f"{sentence(rng, 21)}\n{passage}"),
        (3, f"{sentence(rng, 10)} {near}"),
        *((10 + i, c) for i, c in enumerate(clean)),
        (20, f"{sentence(rng, 15)} {short} {sentence(rng, 15)}"),
        (21, f"{short} {sentence(rng, 25)}"),
        (30, None),
        (31, ""),
        (32, "few words here"),
        (40, line),
    ]
    rows += [(2, rows[1][1]), (41, line)]
    docs = documents(rows)
    found = repeated_paragraphs(docs)
    got = found.collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 40, 41}
    texts = dict(rows)
    for r in got:
        part = texts[r["doc_id"]][r["start"] : r["end"]]
        assert len(word_list(part)) == r["n_words"] and part == part.strip()
    assert {r["component_id"] for r in got if r["kept"]} == {r["doc_id"] for r in got if r["kept"]}
    spans = {d: [(r["start"], r["end"]) for r in got if r["doc_id"] == d and not r["kept"]] for d in (2, 41)}  # lines and pieces overlap
    covered = {d: sum(any(a <= m.start() < b for a, b in spans[d]) for m in re.finditer(r"\S+", texts[d])) for d in spans}
    assert covered[2] >= 30 and covered[41] >= 19
    left = {r["doc_id"]: r["text"] for r in remove_repeats(docs, found).collect()}
    assert left[1] == texts[1] and len(word_list(left[2])) == len(word_list(texts[2])) - covered[2]
    assert left[30] is None and left[10] == texts[10] and len(word_list(left[41])) == 25 - covered[41]


def word_hash(word):
    import numpy as np

    from quillstack.llm.grams import NON_SPACE, words

    raw = word.encode()
    return int(words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NON_SPACE).hashes[0])


def pair_hash(a, b):
    import numpy as np

    from quillstack.llm.grams import mix

    return int(mix(np.array([(word_hash(a) * 3 + word_hash(b)) % (1 << 64)], np.uint64))[0])


def plain_pieces(text, reach=4, least=5):
    """``(start, end, lower-cased words)`` by the definition, across lines."""
    out, top = [], (1 << 64) - 1
    found = [(m.start(), m.end(), m[0].translate(LOWER)) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    pairs = [pair_hash(a[2], b[2]) for a, b in zip(found, found[1:])] + [top]
    begin = 0
    for i, p in enumerate(pairs if found else []):
        before, behind = pairs[max(0, i - reach) : i], pairs[i + 1 : i + 1 + reach]
        if i + 1 == len(pairs) or (all(p <= x for x in before) and all(p < x for x in behind)):
            if i + 1 - begin >= least:
                out.append((found[begin][0], found[i][1], [w for *_, w in found[begin : i + 1]]))
            begin = i + 1
    return out


def plain_lines(text, least=5):
    out = []
    for line in re.finditer("[^\n]+", text):
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", line[0]))
        if len(found) >= least:
            out.append((line.start() + found[0].start(), line.start() + found[-1].end(), [m[0].translate(LOWER) for m in found]))
    return out


PLAIN = {"line": plain_lines, "piece": plain_pieces}


def test_paragraphs_by_the_definition():
    import numpy as np

    from quillstack.llm.paragraph_dedup import paragraphs

    rng = random.Random(12)
    texts = ["", "one", "the the the the the the the the the the the the the the the", *("".join(rng.choice(["w%d" % rng.randrange(30), "Wé"]) + rng.choice([" ", "  ", "\n", " ", " "]) for _ in range(rng.randrange(90))) for _ in range(30))]
    raw = [t.encode() for t in texts]
    p = paragraphs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    starts = np.cumsum([0, *map(len, raw)])
    names = {}
    for d, t in enumerate(texts):
        for kind, level in (("line", p.lines), ("piece", p.pieces)):
            mine = np.flatnonzero(level.doc == d)
            got = [(len(raw[d][: p.starts[level.first[x]] - starts[d]].decode()), len(raw[d][: p.ends[level.last[x] - 1] - starts[d]].decode()), int(level.last[x] - level.first[x])) for x in mine]
            want = PLAIN[kind](t)
            assert got == [(s, e, len(w)) for s, e, w in want], t
            assert [int(x) for x in level.place[mine]] == list(range(len(got)))
            for x, (*_, w) in zip(mine, want):  # equal words, equal names
                assert names.setdefault((kind, *w), (level.name[x], level.second[x])) == (level.name[x], level.second[x])
    assert len(set(names.values())) == len(names)


def longest_run(a, b):
    """Words of the longest run of pieces of text ``a`` that text ``b`` has."""
    others, best, now, last = {tuple(w) for *_, w in plain_pieces(b)}, 0, 0, None
    for place, (*_, w) in enumerate(plain_pieces(a)):
        if tuple(w) in others:
            now = now + len(w) if last is not None and place - last <= 2 else len(w)
            last, best = place, max(best, now)
    return best


@pytest.mark.parametrize("size, per_line, edits, least", [(52, 60, 0, 0.98), (52, 7, 0, 0.98), (120, 6, 0, 1.0), (80, 100, 1, 0.97), (55, 100, 1, 0.65)])
def test_a_passage_is_cut_alike_wherever_it_stands(size, per_line, edits, least):
    rng = random.Random(13)
    words_ = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    lines = lambda w: "\n".join(" ".join(w[i : i + per_line]) for i in range(0, len(w), per_line))
    found = 0
    for _ in range(100):
        passage = words_(size)
        other = list(passage)
        for _ in range(edits):
            other[rng.randrange(size)] = "edit"
        a, b = (" ".join(words_(20)) + " " + lines(p) + " " + " ".join(words_(20)) for p in (passage, other))
        found += longest_run(a, b) >= 20
    assert found >= 100 * least


def test_whole_lines_with_a_changed_word(documents):
    """The similarity of 50 words with one changed is 0.8; all of the line is found."""
    rng, rows = random.Random(21), []
    for k in range(60):
        w = [f"k{k}w{rng.randrange(3000)}" for _ in range(52)]
        other = list(w)
        other[rng.randrange(8, 44)] = "edit"
        filler = lambda: sentence(rng, 15)
        rows += [(2 * k, f"{filler()}\n{' '.join(w)}\n{filler()}"), (2 * k + 1, f"{filler()}\n{' '.join(other)}\n{filler()}")]
    got = repeated_paragraphs(documents(rows)).filter("level = 'line' and n_words = 52").collect()
    assert len({r["doc_id"] for r in got}) >= 116 and all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got)


def test_short_repeats_are_left_alone_but_listed(documents):
    rng = random.Random(22)
    short = ["All rights reserved.", "Click here to read the rest of this story now"]
    rows = [(i, f"{sentence(rng, 30)}\n  {short[0]} \n{sentence(rng, 30)}\n{short[1].upper() if i % 2 else short[1]}\n{short[0]}") for i in range(12)] + [(20, None), (21, ""), (22, "\n \n")]
    assert repeated_paragraphs(documents(rows)).count() == 0
    got = {r["line"]: (r["documents"], r["first_id"]) for r in repeated_lines(documents([*rows, rows[0]]), 10).collect()}
    assert got == {x.lower(): (12, 0) for x in short}
    assert repeated_lines(documents([])).count() == 0


@pytest.mark.parametrize("n", [5, 8, 12, 19])
def test_short_texts_that_are_copies_as_a_whole(documents, n):
    """A repeat under 20 words counts where it is four fifths of its text, and not within a longer one."""
    rng = random.Random(n)
    copy = sentence(rng, n)
    rows = [(i, copy) for i in range(50)] + [(100, f"{copy} {'end ' * (n // 8)}"), (200, f"{sentence(rng, 40)}\n{copy}\n{sentence(rng, 40)}"), (300, sentence(rng, n))]
    got = repeated_paragraphs(documents(rows)).filter("level = 'line'").collect()
    assert {r["doc_id"] for r in got} - {100} == set(range(50)) and {r["component_id"] for r in got} == {0}
    assert [r["doc_id"] for r in got if r["kept"]] == [0]


def test_repeats_within_one_document_stay(documents):
    rng = random.Random(9)
    passage = " ".join(sentence(rng, 12) for _ in range(3))
    assert repeated_paragraphs(documents([(1, f"{passage}\n{passage}"), (2, sentence(rng, 30))])).count() == 0
    assert repeated_paragraphs(documents([])).count() == 0


def test_paragraphs_against_plain_python(documents):
    """Repeats found through bands are those found by comparing all pairs."""
    rng = random.Random(10)
    base = [[f"v{rng.randrange(60)}" for _ in range(rng.randrange(20, 45))] for _ in range(12)]
    rows = []
    for d in range(40):
        parts = []
        for _ in range(2):
            w = list(rng.choice(base))
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "edit"
            parts.append(" ".join(w))
        rows.append((d, "\n".join(parts)))
    want = set()
    for kind, cut in PLAIN.items():
        found = [(d, p, len(w), shingle_set(" ".join(w)) if kind == "line" else tuple(w)) for d, t in rows for p, (_, _, w) in enumerate(cut(t))]
        u = Union(len(found))
        for i, (*_, a) in enumerate(found):
            for j in range(i):
                b = found[j][3]
                if a == b if kind == "piece" else 100 * len(a & b) >= 80 * len(a | b):
                    u.join(i, j)

        def across(chosen):
            docs_of = collections.defaultdict(set)
            for i in chosen:
                docs_of[u.find(i)].add(found[i][0])
            return [i for i in chosen if len(docs_of[u.find(i)]) > 1], docs_of

        chosen, _ = across(range(len(found)))
        runs, run_of = collections.Counter(), {}
        for k, i in enumerate(chosen):
            follows = k and found[chosen[k - 1]][0] == found[i][0] and found[i][1] - found[chosen[k - 1]][1] <= 2
            run_of[i] = run_of[chosen[k - 1]] if follows else i
            runs[run_of[i]] += found[i][2]
        words_of = {d: len(word_list(t)) for d, t in rows}
        chosen, docs_of = across([i for i in chosen if runs[run_of[i]] >= 20 or 5 * runs[run_of[i]] >= 4 * words_of[found[i][0]]])
        want |= {(kind, found[i][0], found[i][1], min(docs_of[u.find(i)])) for i in chosen}
    got = {(r["level"], r["doc_id"], r["paragraph"], r["component_id"]) for r in repeated_paragraphs(documents(rows)).collect()}
    assert len(want) > 50 and len(want ^ got) <= 0.01 * len(want)


@pytest.mark.parametrize("n", [0, 1])
def test_no_collisions(documents, n):
    assert repeated_paragraphs(documents([(1, "only one document with a handful of words in it, no more.")][:n])).count() == 0
