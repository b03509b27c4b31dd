"""URL filter, language ID and segmentation: against slow, plain versions."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import langid, sentencepiece_nbest, url_filter
from quillstack.llm.url_filter import RULES, judge

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# URL filter ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
        ("http://com/de/", "com", "/de/", "com/de/", "block"),
        ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        ("http://x.org", "x.org", "", None, None),
        ("http://x.net/a://b/c", "x.net", "/a://b/c", None, None),
        ("no scheme.org/", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    r = judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
    assert r["verdict"] == (verdict or "allow")  # without URLs of both kinds nothing is blocked by the models


def plain_markov(urls, min_context):
    """Probability of each byte by the definition: Witten-Bell over all kept contexts."""
    counts = [collections.Counter() for _ in range(7)]
    follow = [collections.defaultdict(set) for _ in range(7)]
    for u in urls:
        raw = b"\0" * 5 + u
        for i in range(5, len(raw)):
            for order in range(6):
                c = raw[i - order : i]
                counts[order][c + raw[i : i + 1]] += 1
                follow[order][c].add(raw[i])
    totals = [collections.Counter() for _ in range(7)]
    for order in range(6):
        for g, n in counts[order].items():
            totals[order][g[:-1]] += n

    def log_likelihood(u):
        raw, out = b"\0" * 5 + u, 0.0
        for i in range(5, len(raw)):
            p = 1 / 256
            for order in range(6):
                c = raw[i - order : i]
                n = totals[order][c]
                if n >= min_context:
                    kinds = len(follow[order][c])
                    p = (counts[order][c + raw[i : i + 1]] + kinds * p) / (n + kinds)
            out += math.log(p)
        return out

    return log_likelihood


def test_ratios_against_the_definition(spark):
    rng = random.Random(1)
    hosts = ["a.org", "b.example.org", "c.com", "d.net", "e.net"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(300)}" for _ in range(400)] + [None, "", "x" * 3000, "http://é.net/ü"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("label", F.lit(1)).withColumn("ratio", F.lit("x"))
    got = {r["page_id"]: r for r in judge(pages).collect()}
    assert len(got) == len(urls)
    low = lambda u: (u or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode()
    ruled = {v: [low(urls[i]) for i, r in got.items() if r["rule"] and r["verdict"] == v] for v in ("allow", "block")}
    allowed, blocked = (plain_markov(ruled[v], 4) for v in ("allow", "block"))
    scores = {}
    for i, r in got.items():
        u = low(urls[i])
        ratio = (allowed(u) - blocked(u)) / max(len(u), 1)
        if r["rule"] is None:
            assert r["ratio"] == pytest.approx(ratio, abs=1e-9)
            scores[i] = ratio
        else:
            assert r["ratio"] is None
    assert max([scores[i] for i in scores if got[i]["verdict"] == "block"], default=-9) < min([scores[i] for i in scores if got[i]["verdict"] == "allow"], default=9)


def test_no_urls(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert len(RULES) == 5


def test_a_url_filter_with_one_kind_allows(spark):
    assert url_filter.train(spark.createDataFrame([("http://a.org/", "allow")], "url string, verdict string")) is None


def test_no_gram_is_dropped_from_the_url_models(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "TASK_GRAMS", 500)
    rng = random.Random(7)
    word = lambda letters: "".join(rng.choices(letters, k=9))
    rows = [(f"http://{word('abcd')}.com/{word('ab')}", "allow") for _ in range(300)] * 3 + [(f"http://{word('wxyz')}.org/{word('yz')}", "block") for _ in range(12)]
    labelled, others = spark.createDataFrame(rows, "url string, verdict string"), spark.createDataFrame([(f"http://{word(x)}.net",) for x in ("abcd", "wxyz", "aw")] * 4, "url string")
    models = url_filter.train(labelled, others, block_grams=300)  # the blocked kind is rare, and no block holds all
    assert models.blocks > 5
    allowed, blocked = (plain_markov([u.encode() for u, v in rows if v == x], 4) for x in ("allow", "block"))
    for r in [*url_filter._scored(others, models).collect(), *url_filter._scored(others, models, held=2).collect()]:
        u = r["url"].encode()
        assert r["ratio"] == pytest.approx((allowed(u) - blocked(u)) / len(u), abs=1e-9)


def test_the_threshold_is_set_on_hosts_that_the_models_have_not_seen(spark):
    """Against plain models of the other half of the hosts."""
    rng = random.Random(17)
    word = lambda letters, k: "".join(rng.choices(letters, k=k))
    rows = [(f"http://{word('abcd', 2)}.com/{word('abcdwx', 6)}", "allow") for _ in range(150)] + [(f"http://{word('wxyz', 2)}.org/{word('cdwxyz', 6)}", "block") for _ in range(60)]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    models = url_filter.train(labelled)
    halves = {r["url"]: r["half"] for r in labelled.select("url", F.pmod(F.xxhash64(url_filter.host_and_path(F.col("url"))[0]), F.lit(2)).alias("half")).collect()}
    scores = []
    for half in (0, 1):
        allowed, blocked = (plain_markov([u.encode() for u, v in rows if v == x and halves[u] != half], 4) for x in ("allow", "block"))
        scores += [((allowed(u.encode()) - blocked(u.encode())) / len(u), v) for u, v in rows if halves[u] == half]
    error = lambda t: sum(s < t for s, v in scores if v == "allow") / 150 + sum(s >= t for s, v in scores if v == "block") / 60
    best = min(error(t / 100) for t in range(-1000, 1001))
    assert error(models.threshold) == pytest.approx(best, abs=0.03) and len(set(halves.values())) == 2


def test_ratio_verdicts_on_urls_of_known_kind(spark):
    rng = random.Random(19)
    word = lambda letters: "".join(rng.choices(letters, k=6))
    good = lambda: f"{word('aeiou') + word('tns')}"
    bad = lambda: f"{word('qxz')}-{word('jkv')}"
    pages = [(i, f"http://h{i}.com/fr/{good()}") for i in range(200)] + [(1000 + i, f"http://h{i}.com/de/{bad()}") for i in range(200)]
    pages += [(2000 + i, f"http://n{i}.net/x/{good()}") for i in range(50)] + [(3000 + i, f"http://n{i}.net/x/{bad()}") for i in range(50)]
    got = {r["page_id"]: r["verdict"] for r in judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert sum(got[2000 + i] == "allow" for i in range(50)) >= 48 and sum(got[3000 + i] == "block" for i in range(50)) >= 48


def test_a_rare_kind_still_blocks(spark):
    pages = [(i, f"http://h{i}.com/fr/{i * 7919 % 1000}") for i in range(400)] + [(1000 + i, f"http://example.org/es/zzqq{i}") for i in range(2)] + [(2000, "http://q.net/zzqq1")]
    got = {r["page_id"]: r for r in judge(spark.createDataFrame(pages, "page_id long, url string"), block_grams=400).collect()}
    assert got[2000]["rule"] is None and got[2000]["ratio"] < 0 and len(got) == len(pages)


# Language ID --------------------------------------------------------------------------------------


def plain_kneser_ney(texts):
    """Interpolated Kneser-Ney by the definition, as a function of (three symbols before, symbol)."""
    grams = [collections.Counter() for _ in range(5)]
    for t in texts:
        s = "   " + t
        for i in range(3, len(s)):
            if i > 3:
                grams[4][s[i - 3 : i + 1]] += 1
    for order in (3, 2, 1):
        for g in grams[order + 1]:
            grams[order][g[1:]] += 1
    discount = {}
    for order in range(1, 5):
        one, two = (sum(n == k for n in grams[order].values()) for k in (1, 2))
        discount[order] = one / (one + 2 * two) if one and two else 0.5

    def p(context, c, uniform):
        if len(context) == 0:
            order = 1
        order = len(context) + 1
        lower = uniform if order == 1 else p(context[1:], c, uniform)
        follow = {g[-1]: n for g, n in grams[order].items() if g[:-1] == context}
        total = sum(follow.values())
        if not total:
            return lower
        return max(follow.get(c, 0) - discount[order], 0) / total + discount[order] * len(follow) / total * lower

    return p, {g for g in grams[1]}


def check_against_the_definition(spark, train, tests, **sizes):
    """Every text's cross-entropy in every language, by plain counting; returns the model."""
    model = langid.train(spark.createDataFrame(train, "text string, lang string"), spark.createDataFrame([(t,) for t in tests], "text string"), **sizes)
    assert model.langs == sorted({x for _, x in train})
    plain = [plain_kneser_ney([f" {t.lower()} " for t, x in train if x == lang]) for lang in model.langs]
    uniform = 1 / (len(set().union(*(seen for _, seen in plain))) + 1)
    assert model.uniform == pytest.approx(math.log(uniform))
    blocks = [shared for shared, _ in langid.passes(model.table, model.blocks, langid._pack(len(model.langs)), held=1 << 10)]
    sums, n, has = langid.cross_entropies(tests, blocks[0], len(model.langs))
    assert has.all() and len(blocks) == 1
    for k, t in enumerate(tests):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        s = "   " + " ".join(["", *words, ""])
        assert n[k] == len(s) - 4
        for c, (p, _) in enumerate(plain):
            want = sum(math.log(p(s[i - 3 : i], s[i], uniform)) for i in range(4, len(s)))
            assert sums[k, c] == pytest.approx(want, rel=1e-5)
    return model


@pytest.mark.parametrize("sizes", [{}, {"block_cells": 40, "task_cells": 100}])
def test_kneser_ney_against_the_definition(spark, sizes):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randrange(1, 6))) for _ in range(12))
    train = [(make("abcé"), "aa") for _ in range(8)] + [(make("bcdß"), "bb") for _ in range(8)]
    tests = [make("abcdz") for _ in range(6)] + ["q", "ABC  1,2 bc"]
    model = check_against_the_definition(spark, train, tests, **sizes)
    assert model.blocks > 5 if sizes else model.blocks == 1


def test_a_rare_language_keeps_its_whole_model(spark, documents):
    rng = random.Random(12)
    make = lambda letters, k: " ".join("".join(rng.choices(letters, k=5)) for _ in range(k))
    train = [(make("abcdefgh", 20), "aa") for _ in range(150)] + [(make("stuvwxyz", 20), "zz")]
    check_against_the_definition(spark, train, [make("abcdwxyz", 5), make("stuvwxyz", 5)], block_cells=500, task_cells=700)
    rows = [(i, t, x) for i, (t, x) in enumerate(train)] + [(1000, make("stuvwxyz", 8), None), (1001, make("abcdefgh", 8), None)]
    plain = {r["doc_id"]: tuple(r) for r in langid.identify(documents(rows), "doc_id").collect()}
    assert plain[1000][1] == plain[150][1] == "zz" and plain[1001][1] == "aa"
    small = {r["doc_id"]: tuple(r) for r in langid.identify(documents(rows), "doc_id", block_cells=300, task_cells=500).collect()}
    for i, r in plain.items():  # the size of blocks and tasks changes nothing
        assert small[i][1] == r[1] and small[i][5] == r[5] and small[i][2] == pytest.approx(r[2]) and small[i][3] == pytest.approx(r[3])


def test_several_passes_add_up(spark, documents):
    rows = [(i, f"some words of text number {'abcdefgh'[i % 8] * 3}", "en" if i % 2 else "de") for i in range(20)] + [(20, None, "en")]
    docs = documents(rows)
    model = langid.train(docs, block_cells=20)
    assert model.blocks > 6
    want = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in langid.score(docs, model, "doc_id").collect())
    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in langid.score(docs, model, "doc_id", held=2).collect())
    assert got == want and len(got) == 21


def test_grams_that_all_occur_once(spark, documents):
    docs = documents([(1, "abc", "aa"), (2, "xyz", "bb"), (3, "ab", None)])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, "doc_id").collect()}
    assert got == {1: "aa", 2: "bb", 3: "aa"}


def test_long_texts_go_in_pieces():
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab é1, ", k=n)) for n in (0, 5, 3000, 7, 900, 1, 999, 1000, 1001)] + [" ", "12 " * 700, None]
    whole = [langid.grams(*langid.symbols([t])[:2])[0].tolist() for t in texts]
    letters = [bool(langid.symbols([t])[2][0]) for t in texts]
    for chars in (1, 2, 3, 10, 333, 1000, 1 << 20):
        keys, has = [[] for _ in texts], [False] * len(texts)
        for x in langid.stretches(texts, chars):
            for k in range(len(x.has)):
                keys[x.first + k] += x.keys[x.ends[k] : x.ends[k + 1]].tolist()
                has[x.first + k] |= bool(x.has[k])
        assert keys == whole and has == letters, chars


def test_language_id_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.op5_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.count() > 20
    assert got.filter("lang = lang_pred").count() / got.count() > 0.95
    assert got.filter("rejected or score <= 0 or score > 1").count() == 0


def test_held_out_rows_teach_nothing(spark, documents):
    rows = [(i, "the cat and the dog sat on the mat", "en") for i in range(40)]
    out = [r["doc_id"] for r in documents(rows).filter(langid.held_out()).collect()]
    assert out
    rows = [(i, "der hund und die katze", "de") if i in out else r for i, r in enumerate(rows)]
    got = langid.identify(documents(rows), "doc_id", training=~langid.held_out()).collect()
    assert {r["lang_pred"] for r in got} == {"en"} and len(got) == 40


def test_odd_documents(spark, documents):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "en"), (4, "the cat and the dog", "en"), (5, "der hund und die katze", "de"), (6, "the dog " * 200000, None), (4, "the cat and the dog", "en"), (7, "𝒜𝒷 ǅ İ", "en"), (8, "text", None)]
    docs = documents(rows)
    got = langid.identify(docs, "doc_id").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1, 2, 3))
    assert by[4]["lang_pred"] == by[6]["lang_pred"] == "en" and by[5]["lang_pred"] == "de"
    assert by[6]["symbols"] == len("the dog ") * 200000
    assert langid.train(docs.filter("lang is null")) is None and langid.train(docs.filter("doc_id < 4")) is None
    assert {r["lang_pred"] for r in langid.identify(docs, "doc_id", training=F.lit(False)).collect()} == {"und"}
    assert langid.identify(documents([]), "doc_id").count() == 0
    with pytest.raises(ValueError):
        langid.train(documents([(i, "a text", f"x{i}") for i in range(langid.MAX_LANGS + 1)]))


def test_what_no_model_explains_is_rejected(spark, documents):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["the", "cat", "and", "dog", "sat", "mat"], k=60)), "en") for i in range(60)]
    noise = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(500))
    got = {r["doc_id"]: r["rejected"] for r in langid.identify(documents([*rows, (999, noise)]), "doc_id").collect()}
    assert got.pop(999) and not any(got.values())
    # Junk that bears a language's name does not set its limit: every tenth row here.
    junk = [(2000 + i, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(40)), "en" if i < 20 else None) for i in range(26)]
    many = [(i, " ".join(rng.choices(["the", "cat", "and", "dog", "sat", "mat"], k=60)), "en") for i in range(200)]
    got = {r["doc_id"]: r["rejected"] for r in langid.identify(documents([*many, *junk]), "doc_id").collect()}
    assert not any(got[i] for i in range(200)) and all(got[2020 + i] for i in range(6))


# Segmentation -------------------------------------------------------------------------------------


def all_paths(lat, s):
    if not s:
        return [(0, ())]
    out = []
    for j in range(1, min(len(s), lat.longest) + 1):
        edge = lat.edges.get(s[:j])
        if edge and edge[0] >= 0:
            out += [(c + edge[1], (edge[0], *p)) for c, p in all_paths(lat, s[j:])]
    edge = lat.edges.get(s[0])
    if edge is None or edge[0] < 0:
        ids, cost = lat.unknown(s[0])
        out += [(c + cost, ids + p) for c, p in all_paths(lat, s[1:])]
    return out


def test_n_best_against_all_segmentations():
    lat, rng = sentencepiece_nbest.Lattice(MODEL, 200), random.Random(4)
    alphabet = [*"theransion. ,▁é中😀\n12", "the", "tion", " "]
    texts = ["", " ", *("".join(rng.choices(alphabet, k=rng.randrange(1, 10))) for _ in range(300))]
    units = lat.prepare(texts)
    for text, u in zip(texts, units):
        want = sorted(all_paths(lat, lat.prefix + text.replace(" ", "▁"))) if text else [(0, ())]
        got = [(c, tuple(np.frombuffer(b"".join(ids), "<i4").tolist())) for c, ids, _, right in lat.n_best(text, 5, u) if right]
        assert [c for c, _ in got] == [c for c, _ in want[:5]], text
        assert len({ids for _, ids in got}) == len(got) and set(got) <= set(want)
        assert all(lat.decode(np.array(ids, "<i4")) == text.replace("▁", " ") for _, ids in got)


def unigram_model(path):
    """A small model made by hand: pieces with scores of their own, and all bytes."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m, rng = pb.ModelProto(), random.Random(12)
    kinds = pb.ModelProto.SentencePiece

    def add(piece, score, kind):
        m.pieces.add(piece=piece, score=score, type=kind)

    add("<unk>", 0, kinds.UNKNOWN)
    add("<s>", 0, kinds.CONTROL)
    add("</s>", 0, kinds.CONTROL)
    for b in range(256):
        add(f"<0x{b:02X}>", -30, kinds.BYTE)
    pieces = {*"▁abcdé", *("".join(rng.choices("▁abcdé", k=rng.randrange(2, 6))) for _ in range(150))}
    for piece in sorted(p for p in pieces if "▁" not in p[1:]):
        add(piece, -round(rng.uniform(2, 12), 3), kinds.NORMAL)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = m.trainer_spec.UNIGRAM, True
    m.trainer_spec.vocab_size = len(m.pieces)
    n = m.normalizer_spec
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", True, False, True
    path.write_bytes(m.SerializeToString())
    return str(path)


def n_best(lat, text, n):
    """``(cost, ids)`` of the segmentations that spell the text."""
    return [(c, np.frombuffer(b"".join(ids), "<i4").tolist()) for c, ids, _, right in lat.n_best(text, n) if right]


def test_n_best_of_a_unigram_model_are_the_librarys(tmp_path):
    import sentencepiece

    path = unigram_model(tmp_path / "unigram.model")
    lat, library = sentencepiece_nbest.Lattice(path, 200), sentencepiece.SentencePieceProcessor(model_file=path)
    scores, rng = {i: library.get_score(i) for i in range(library.get_piece_size())}, random.Random(13)
    for text in ["a", "abcd", " ", "  a  b", "éé", *("".join(rng.choices("abcdé ", k=rng.randrange(1, 14))) for _ in range(300))]:
        got, want = n_best(lat, text, 4), library.nbest_encode_as_ids(text, 4)
        cost = lambda ids: sum(-round(1e6 * scores[i]) for i in ids)
        assert [c for c, _ in got] == pytest.approx([cost(ids) for _, ids in got], abs=20)
        assert [c for c, _ in got] == pytest.approx([cost(ids) for ids in want], abs=20), text


def test_spaces_take_the_fewest_pieces_and_words_their_own():
    """No merge makes a run of spaces: such a piece is taken only where nothing else can be."""
    import sentencepiece

    lat, library = sentencepiece_nbest.Lattice(MODEL, 200), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = lambda text: [library.id_to_piece(i) for i in n_best(lat, text, 1)[0][1]]
    assert pieces("the") == ["▁the"]
    for n in range(1, 40):
        got = pieces(" " * n + "the")
        spaces = [p for p in got if not p.strip("▁")]
        assert got[-1] in ("▁the", "the") and "".join(got) == "▁" * (n + 1) + "the" and len(got) == len(spaces) + 1 and len(spaces) <= n // 16 + 2
    for text in ("x  y", "a   b c    d"):
        assert library.decode([library.piece_to_id(p) for p in pieces(text)]) == text


def test_decoding_agrees_with_the_library():
    import sentencepiece

    lat, library = sentencepiece_nbest.Lattice(MODEL, 200), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ["Hello  wörld\n\n!", " a", "a ", "中😀\0x", "x" * 300]:
        assert lat.decode(np.array(library.encode(text))) == library.decode(library.encode(text))


def test_encoding_and_decoding(spark, documents):
    rows = [(1, None), (2, ""), (3, "Some text."), (4, "aaaa " * 3000 + "b" * 2000), (3, "Some text."), (None, "▁ x")]
    got = sentencepiece_nbest.encode(documents(rows), MODEL, 4, "doc_id", "n", with_ids=True)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 6 and all(r["decodes"] for r in by.values())
    assert by[1]["n_pieces"] == by[2]["n_pieces"] == 0 and by[1]["costs"] == [0]
    assert all(r["costs"] == sorted(r["costs"]) and len(r["costs"]) == len(set(r["ids_sha256"])) for r in by.values())
    back = {r["doc_id"]: r["text"] for r in sentencepiece_nbest.decode(got, MODEL, "doc_id").collect()}
    assert back == {1: "", 2: "", 3: "Some text.", 4: rows[3][1], None: "  x"}
    assert sentencepiece_nbest.encode(documents([]), MODEL, 4, "doc_id").count() == 0
