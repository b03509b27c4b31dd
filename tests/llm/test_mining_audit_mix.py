"""Hard negatives, the source audit and the mix against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillstack.llm import hard_negatives, mixing, source_audit
from quillstack.llm.queries import oracle_sql, queries

# Hard negatives -----------------------------------------------------------------------------------


def plain_negatives(rows, wanted, scale=256, least=80, k=5):
    usable = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * scale) for x in vector):
            continue
        usable[i] = min(usable.get(i, (label, vector)), (label, vector))
    whole = {i: (label, [math.floor(scale * x) for x in v]) for i, (label, v) in usable.items()}
    out = []
    for a in filter(wanted, whole):
        label, v = whole[a]
        hold = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
        scores = sorted((-hold(sum(x * y for x, y in zip(v, w))), i, own == label) for i, (own, w) in whole.items() if i != a)
        for minus, p, _ in [s for s in scores if s[2]][:k]:
            fit = [(i, -s) for s, i, same in scores if not same and least * -minus <= 100 * -s <= 100 * -minus]
            out += [(a, p, rank, i, -minus, s) for rank, (i, s) in enumerate(fit[:k], 1)]
    return sorted(out)


def vectors_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.select("*", *(F.lit("x").alias(c) for c in ("id", "hash", "anchor", "block", "vector", "rank", "a")))


@pytest.mark.parametrize("labels", [2, 64])
def test_hard_negatives(spark, monkeypatch, labels):
    for name, value in (("ROWS", 16), ("ANCHORS", 4), ("WIDTH", 2), ("LABELS", labels)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.3, 1.0, 2.0, 2.001]) for _ in range(5)], 0 if i % 3 else rng.randrange(6)) for i in range(150)]
    rows += [rows[10], (20, [9.0] * 5, 99), (20, [9.0] * 5, -1), (200, [1.0, 2.0], 0), (210, [], 0), (220, [1.0] * 7, 1), (230, [0.0] * 5, 3)]
    rows += [(None, [1.0] * 5, 0), (240, None, 0), (250, [1.0, None], 0), (260, [math.nan] * 5, 0), (270, [math.inf] * 5, 0), (280, [1.0] * 5, None), (290, [1e308] * 5, 0)]
    got = hard_negatives.mine(vectors_of(spark, rows), F.col("id") % 10 == 0)
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 40 and sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("scale", [1e9, 1e12, 1e30])
def test_scores_beyond_53_62_and_64_bits(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "ROWS", 8)
    monkeypatch.setattr(hard_negatives, "WIDTH", 2)
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.1, 0.7, 0.71]) for _ in range(4)], i % 3) for i in range(40)]
    got = hard_negatives.mine(vectors_of(spark, rows), F.col("id") % 4 == 0, scale=scale)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 4 == 0, scale)


def test_hard_negatives_of_little(spark):
    one = [(1, [1.0], 1)]
    assert hard_negatives.mine(vectors_of(spark, []), F.lit(True)).count() == 0
    assert hard_negatives.mine(vectors_of(spark, one), F.lit(False)).count() == 0
    assert hard_negatives.mine(vectors_of(spark, one), F.lit(True)).count() == 0
    same = [(i, [1.0, 1.0], i % 2) for i in range(30)]  # ties everywhere
    got = hard_negatives.mine(vectors_of(spark, same), F.col("id") == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(same, lambda i: i == 0)


# Source audit -------------------------------------------------------------------------------------


def plain_audit(rows, least=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(lower))) for r in rows]
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for lang, source, w in words:
        groups.add((lang, source))
        docs.update((lang, t) for t in set(w))
        counts[lang, source].update(w)
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for (g, t), n in docs.items() if g == lang and n >= least)
        mine = {s: counts[g, s] for g, s in groups if g == lang}
        whole = sum(mine.values(), Counter())

        def shares(c):
            size = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // size for t in kept}

        p, q = {s: shares(c) for s, c in mine.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in mine:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if mine[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i, -v, r) for part, ranked in (("pair", pairs), ("term", terms)) for r, (v, _, i) in enumerate(ranked, 1)]
    return sorted(out)


def odd_documents():
    rng = random.Random(7)
    vocabulary = [rng.choice(["the", "Straße", "naïve", "𝔘nic", "ß"]) + chr(97 + i % 26) * (i % 4) for i in range(60)] + ["É", "é", "Éa", "common"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 80))) + ("! 42\t\x00" if i % 5 else ""), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", None, "Ä", "😀"])) for i in range(120)]
    rows += [rows[3]] * 4 + [(500, None, "en", "only-null"), (501, "", "xx", "a"), (502, "", "xx", "b"), (503, "solo", "yy", "a"), (None, "THE the The", "en", "a")]
    rows += [(600 + i, ("common " * 5 + "hot ") * (40_000 if i == 0 else 3), "en", "b") for i in range(30)]
    return rows


def test_audit(spark, documents, monkeypatch):
    monkeypatch.setattr(source_audit, "SLACK", 1)
    rows = odd_documents()
    assert len(rows[-30][1]) > source_audit.STRETCH
    got = source_audit.audit(documents(rows), k=9)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain_audit(rows, top=9)


def test_audit_ranks_ties_by_bytes(spark, documents, monkeypatch):
    monkeypatch.setattr(source_audit, "SLACK", 1)
    tied = [("z" * 3000) + f"é{chr(97 + i)}" for i in range(9)] + ["z" * 3000, "z", "zz", "ä", "😀x", "￿x"]
    rows = [(i, " ".join(tied), "en", "a") for i in range(3)] + [(9, "other " * 9, "en", "b")] * 3
    got = source_audit.audit(documents(rows), k=7)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain_audit(rows, top=7)


def test_audit_of_little(spark, documents):
    assert source_audit.audit(documents([])).count() == 0
    got = source_audit.audit(documents([(1, None, None, None), (2, "a b", None, "s")])).collect()
    assert sorted(map(tuple, got)) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_stretches_cut_no_term():
    text = ("é" * 7 + " ").encode() * 200_000
    parts = list(source_audit._stretches(text))
    assert len(parts) > 1 and b"".join(parts) == text
    assert sum(len(source_audit._TERM.findall(p)) for p in parts) == 200_000


# Mix ----------------------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        left = sum(w for s, w in weight.items() if s not in full)
        each = Fraction(total - sum(full.values()), left) if left else 0
        more = {s: 3 * sizes[s] for s in order if s not in full and weight[s] * each > 3 * sizes[s]}
        if not more:
            return {s: float(full.get(s, weight[s] * each)) for s in order}
        full.update(more)


def check_mix(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, size(t)) for i, t, _, s in rows)
    words = Counter()
    for _, t, _, s in rows:
        words[s] += size(t)
    targets = plain_targets(words)
    taken, least, expected, rates = Counter(), {}, Counter(), {}
    for r in got:
        assert r["source_size"] == words[r["source"]] and r["target"] == pytest.approx(targets[r["source"]], rel=1e-12)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        expected[r["source"]] += r["rate"] * r["size"]
        if r["size"]:
            least[r["source"]] = min(least.get(r["source"], r["size"]), r["size"])
            rates.setdefault(r["source"], {})[r["size"]] = r["rate"]
    for s, t in targets.items():
        assert expected[s] == pytest.approx(t, abs=1)
        assert abs(taken[s] - t) <= max(2 * least.get(s, 0) + 1 if len(rows) < 150 else 2, t / 500)
        # Exponentially tilted: below the bound, the logarithms of the rates are in proportion to the sizes.
        slopes = [math.log(r) / n for n, r in rates.get(s, {}).items() if 1e-4 < r < 3]
        assert not slopes or max(slopes) - min(slopes) < 1e-4
    return targets, taken


def mixed_documents():
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)) + "\x0b\x85  \t", "en", rng.choice(["a", "a", "a", "b", "B", "ü", None, "z", "😀"])) for i in range(400)]
    rows += [(1000 + i, "one two three", "en", "hot") for i in range(300)]
    rows += [(2000, "long " * 5000, "en", "a"), (2001, None, "en", "nothing"), (2002, " \t\n", "en", "nothing"), (2003, "single", "en", "tiny"), (None, "x y", "en", "a"), (None, None, None, None)]
    return rows + [rows[0]] * 7 + [(None, "x y", "en", "a")] * 20


def test_mix(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    monkeypatch.setattr(mixing, "REPEAT", 3)
    rows = mixed_documents()
    got = mixing.mix(documents(rows)).collect()
    targets, taken = check_mix(rows, got)
    assert targets["tiny"] == 3 and taken["tiny"] == 3 and targets["nothing"] == 0
    # Which of alike rows has the copy more is not told apart; all else is the same in any order.
    mixed = rows[::-1]
    again = mixing.mix(documents(mixed).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    hot = [r["copies"] for r in got if r["source"] == "hot"]
    assert len(hot) == 300 and max(hot) - min(hot) <= 1


def test_mix_of_little(spark, documents):
    assert mixing.mix(documents([])).count() == 0
    nothing = mixing.mix(documents([(1, None, None, None), (2, "", None, "a")])).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in nothing) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    rows = [(1, "a b c", None, "a")]
    check_mix(rows, mixing.mix(documents(rows)).collect())
    # All sources but one at three times their size.
    rows = [(i, "w " * (5 if i % 4 else 400), None, f"s{i % 4}") for i in range(40)]
    check_mix(rows, mixing.mix(documents(rows)).collect())


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(9)
    got = mixing.numbered(df, "place", F.col("x"))
    assert got.count() == 1000 and got.filter("place <> x").count() == 0


# Queries ------------------------------------------------------------------------------------------


def test_the_new_queries_are_registered():
    assert {"op11_hard_negatives", "op12_source_audit", "op13_source_mix"} <= set(queries())
    assert {"op11_hard_negatives", "op12_source_audit"} <= set(oracle_sql())


def test_the_mix_of_the_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], None, r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_mix(rows, queries()["op13_source_mix"](spark, sf_dir).collect())
