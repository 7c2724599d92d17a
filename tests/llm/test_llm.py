"""The training-data operators against brute force, libraries and round trips, and their defined cases."""

import hashlib
import heapq
import itertools
import json
import math
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from cuelattice.llm import ann, bpe, huffman, langid, mixing, neardup, ogg, passages, registry, spans, toolcalls, urlrep

BYTE, WORD, PATTERN = registry.BYTE_BPE, registry.WORD_BPE, public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, media string"
ODD = [(1, None), (2, ""), (3, "A b.\nC  d\t\u00a0e"), (None, "no id"), (4, "x" * 5000 + " ab" * 3000), (3, "A b.\nC  d\t\u00a0e"), (5, "\u05d0\u0301 \U0001f600 \x1c\x85 S\u03a3"), (6, "   ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None if i == 3 else "s", None, "clash", "clash") for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(spark, odd, none):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(BYTE), special_tokens={})
    for r in bpe.tokenized(odd, BYTE, PATTERN).collect():
        texts = [t for i, t in ODD if i == r.doc_id]
        assert list(array("I", bytes(r.ids))) == library.encode_ordinary(texts[0] or "")
        assert bytes(r.decoded) == (texts[0] or "").encode()
        assert r.n_tokens == len(r.ids) // 4
    assert bpe.digests(odd, BYTE, PATTERN).count() == len(ODD)
    assert bpe.digests(none, BYTE, PATTERN).count() == 0
    rng, codec = random.Random(3), bpe.codec(BYTE, PATTERN)
    for _ in range(3000):
        t = "".join(rng.choice(" \n\t\u00a0a B's\u00e91\u0663!\u4e2d\x1c\u0301") for _ in range(rng.randint(0, 12)))
        assert list(array("I", codec.encode(t))) == library.encode_ordinary(t)
    texts = ["".join(rng.choice(["the ", "ab\n", "x.", "\n\n", " a", "'s", "\u00e9 ", " ", "oft"]) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    assert [list(array("I", x)) for x in codec.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]
    long = " ".join(texts)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bpe, "UNIT", 5000)
        assert list(array("I", codec.encode(long))) == library.encode_ordinary(long)
    with pytest.raises(KeyError):
        bpe.merge_ids({b"a": 0}, b"ab")
    piece = "ab" * 5000 + "a" * 5000
    assert bpe.merge_ids(bpe.read_ranks(BYTE), piece.encode()) == library._encode_single_piece(piece.encode())


def test_mixing(spark, odd, none):
    sizes = spark.createDataFrame([("a", 1000, 10), ("b", 100, 5), ("c", 10, 1), ("z", 0, 2)], "source string, tokens long, docs long")
    w = {r.source: r for r in mixing.source_weights(sizes, 3.0).collect()}
    assert w["a"].budget == 1000 and w["z"].epochs == 1
    assert 29 <= w["c"].budget <= 30 and abs(sum(r.weight for r in w.values()) - 1) < 1e-9
    e = mixing.source_weights(sizes, entropy=0.9).collect()
    h = -sum(r.weight * math.log(r.weight) for r in e if r.weight) / math.log(3)
    assert 0.9 <= h < 0.9001
    docs = spark.createDataFrame([(i, "w " * (i % 5 + 1), f"s{0 if i % 3 else i % 7}") for i in range(600)], "doc_id long, text string, source string")
    plan = mixing.planned(docs).collect()
    by = {}
    for r in plan:
        by.setdefault(r.source, []).append(r)
    large = max(by, key=lambda s: sum(r.n_tokens for r in by[s]))
    assert len(plan) == 600 and {r.copies for r in by[large]} == {1}
    for rows in by.values():
        assert {r.copies for r in rows} <= {1, 2, 3} and sum(r.copies * r.n_tokens for r in rows) <= 2 * sum(r.n_tokens for r in rows) + 5
    nameless = mixing.planned(spark.createDataFrame([(None, f"w{i}", "s") for i in range(2000)], "doc_id long, text string, source string"))
    assert nameless.groupBy("block").count().agg({"count": "max"}).first()[0] < 200
    clash = docs.selectExpr("*", "1 AS name", "2 AS copies", "3 AS block", "map('a', 1) AS whole_row")
    twice = {(r.doc_id, r.name, r.copies, r.block): 0 for r in clash.collect()}
    for r in (rows := mixing.repeated(clash)).collect():
        twice[r.doc_id, r.name, r.copies, r.block] += 1
    assert rows.columns == clash.columns and {k[0]: n for k, n in twice.items()} == {r.doc_id: r.copies for r in plan}
    assert mixing.mixed(none).count() == 0
    assert mixing.mixed(odd).count() >= len(ODD)


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, n, percent):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, passage = rng.choices(vocabulary, k=120), rng.choices(vocabulary, k=50)
    docs = []
    for _ in range(90):
        d = list(rng.choice(docs)) if docs and rng.random() < 0.4 else list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 7])):
            i = rng.randrange(len(d))
            d[i : i + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
        docs.append(d)
    for _ in range(60):
        d = rng.choices(vocabulary, k=rng.randint(5, 120))
        docs.append(d[:3] + passage + d[3:])
    docs += [rng.choices(vocabulary, k=rng.randint(0, 7)) for _ in range(30)]
    docs += rng.sample(docs, 20)
    texts = [" ".join(d) for d in docs]
    shingles = [{tuple(d[i : i + n]) for i in range(max(1, len(d) - n + 1))} if d else set() for d in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(docs)), 2):
        if shingles[a] and shingles[b] and 100 * len(shingles[a] & shingles[b]) >= percent * len(shingles[a] | shingles[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n, percent).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {i: (root(i), len(shingles[i]), root(i) == i) for i in range(len(docs))}


def test_near_duplicates_defined_cases(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(i, i, True) for i, _ in ODD}
    assert {r.n_shingles for r in got if r.doc_id in (1, 2, 6)} == {0}
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_work_by_row(spark):
    text = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(900)], k=60))
    rows = [(1, text(1)), (2, text(2)), (2, text(1)), (2, text(3)), (3, text(3) + " end"), (4, text(4)), (4, text(4)), (4, text(5)), (5, ""), (5, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted([(1, 1, True), (2, 2, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 4, True), (4, 4, True), (4, 4, True), (5, 5, True), (5, 5, True)])
    docs = spark.createDataFrame([(*r, "s", "map", 3) for r in rows], "doc_id long, text string, source string, own_id string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.where("doc_id < 5").collect()) == sorted([(1, text(1)), (2, text(2)), (2, text(3)), (4, text(4)), (4, text(5))])


def test_sets_of_long_texts(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "bc", "Def", "gh\ti", "x" * 300], k=4000)) + "\n end " + "y" * 5000
    want = [s.tolist() for s in neardup.shingle_sets([text, "a b", text[:900]], 3)]
    monkeypatch.setattr(neardup, "STEP", 1000)
    assert [s.tolist() for s in neardup.shingle_sets([text, "a b", text[:900]], 3)] == want
    words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    assert len(want[0]) == len({tuple(words[i : i + 3]) for i in range(len(words) - 2)})


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n)).astype(np.uint64) for n in rng.integers(1, 6000, 12)]
    assert neardup._intersections(sets[:5], sets[5:]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 16))
    x[300:340] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [None] * 16), (9400, [1.0] * 3), (None, x[0].tolist()), (5, x[5].tolist())]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10].tolist()
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for _, i, s in own)
        hit += len(set(want) & {i for _, i, _ in own})
    assert set(got) == set(range(0, 600, 100)) and hit >= 54
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize(("offset", "spread"), [(0.0, 1.0), (1e7, 1e-2), (-3e5, 50.0)])
def test_nearest_of_a_block_equals_brute_force(offset, spread):
    rng = np.random.default_rng(3)
    x = offset + rng.normal(0, spread, (500, 8))
    x[100:140] = x[0]  # ties
    q, names = x[:20], rng.permutation(500)
    i, j, d = ann.closest(x, names, q, 11)
    for k in range(20):
        true = ann.distances(x, q[k])
        want = np.lexsort((names, true))[:11]
        assert j[i == k].tolist() == want.tolist() and (d[i == k] == true[want]).all()


def test_neighbours_defined_cases(spark):
    rows = [(i * 50, [float(i), 1.0, 2.0], "clash", 1.0) for i in range(5)] + [(1, [0.0, 1.0, 2.0], "clash", 2.0), (100, [5.0, 5.0], "clash", 0.0), (7, [5.0, 6.0], "clash", 0.0)]
    rows += [(1000 + i, [100.0, 0.0, float(i % 2)], "clash", 0.0) for i in range(1, 30)] + [(1000, [100.0, 0.0, 0.5], "clash", 0.0)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, score double")).orderBy("query_id", "score", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[0][:3] == [(1, 0.0), (50, 1.0), (100, 2.0)]
    assert [v for v, _ in got[1000]] == list(range(1001, 1011))  # 29 at the same distance
    assert (7, 1.0) in got[100] and len(got[100]) == 11  # two vectors go by this id; one has a single candidate


def test_spans_defined_cases(spark, odd, none):
    p = "One two three four five six seven. Eight nine ten eleven twelve thirteen. "
    rows = [(1, f"Start here now. {p}End."), (2, f"Other words come. {p}Last."), (3, f"{p}{p}"), (4, None), (5, ""), (None, p)]
    got = {r.doc_id: r for r in spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "Other words come. Last." and got[2].n_removed == 2
    assert got[3].text == "" and got[4].text is None and got[5].text == "" and got[None].text == p
    assert spans.without_repeats(odd).select("doc.*").columns == odd.columns
    assert spans.deduplicated(none).count() == 0
    for text in ("a.b", "...", "x\n\n y! z", "a"):
        assert "".join(spans.sentences(text)) == text


def test_passages_of_short_sentences(spark, odd, none):
    verse = "".join(f"Line {i} is this short. " for i in range(12))
    han = "".join(chr(0x4E00 + i * 37 % 5000) + ("\u3002" if i % 9 == 8 else "") for i in range(90))
    p = "One two three four five six seven. Eight nine ten eleven twelve thirteen. "
    rows = [(1, f"Here. {verse}End."), (2, f"There it is. {verse}Last."), (3, f"\u524d\u3002{han}"), (4, f"\u540e\u6765\u3002{han}"), (5, f"Start. {p}"), (6, f"{p}{p}"), (7, None), (8, ""), (None, verse)]
    got = {r.doc_id: r for r in passages.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].text for i in (1, 3, 5, 7, 8, None)] == [dict(rows)[i] for i in (1, 3, 5, 7, 8, None)]
    assert got[2].text == "There it is. Last." and got[4].text == "\u540e\u6765\u3002" and got[6].text == ""
    assert passages.without_repeats(odd).select("doc.*").columns == odd.columns
    assert passages.deduplicated(none).count() == 0
    for text in ("a.b", "...", "\n x\n\n y! z", "a", *[t for _, t in ODD if t]):
        assert "".join(passages.tokens(text)) == text


def test_passages_at_any_offset(spark):
    """Of a passage of 51 words or more, at most WINDOW words stay at each end, against brute force over words."""
    rng = random.Random(8)
    words = lambda n, marks: [rng.choice("abcdefghij") + str(rng.randrange(300)) + rng.choice(marks) for _ in range(n)]
    texts, where = {}, {}
    for i in range(120):
        passage = words(rng.randint(51, 90), [["", "", ",", "."], [""], ["", "", "", "", "", "", "", "."]][i % 3])
        a, b = words(rng.randint(0, 40), ["", "", ".", "!"]), words(rng.randint(0, 40), ["", ".", ";"])
        texts[i] = " ".join([*words(rng.randint(0, 40), ["", "."]), *passage, *words(rng.randint(0, 9), ["", "."])])
        texts[1000 + i] = " ".join([*a, *passage, *b])
        where[1000 + i] = (len(a), len(a) + len(passage), len(a) + len(passage) + len(b))
    got = {r.doc_id: r for r in passages.deduplicated(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i in range(120):
        assert got[i].text == texts[i]
        full, (a, b, n) = texts[1000 + i].split(), where[1000 + i]
        core = full[a + passages.WINDOW : b - passages.WINDOW]
        left = got[1000 + i].text.split()
        assert not set(zip(core, core[1:])) & set(zip(left, left[1:]))
        assert left[: a] == full[: a] and left[len(left) - (n - b) :] == full[b:]
    one = " ".join(words(60, [""]))
    same = {r.doc_id: r.text for r in passages.deduplicated(spark.createDataFrame([(1, one), (2, one), (3, "x y " * 100), (4, one[:60]), (5, one[:60])], "doc_id long, text string")).collect()}
    assert same[1] == one and same[2] == "" and same[3].startswith("x y ") and same[4] == one[:60] and same[5] == ""


@pytest.mark.parametrize("module", [spans, passages])
def test_rows_that_repeat_a_doc_id(spark, module):
    """Each row loses its own repeats alone; only the same text is the same document."""
    p = "One two three four five six seven. Eight nine ten eleven twelve thirteen. "
    q = "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu nu. "
    rows = [(1, f"Head one. {p}Tail."), (2, f"Head two. {p}Rest of it."), (2, f"Nothing. To see. Here at all. {q}"), (3, f"{q}End."), (3, f"{q}End.")]
    got = sorted((r.doc_id, r.text) for r in module.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, rows[0][1]), (2, "Head two. Rest of it."), (2, rows[2][1]), (3, "End."), (3, "End.")]
    twice = [(5, f"A. {p}"), (5, f"B. {p}")]
    got = sorted(r.text for r in module.deduplicated(spark.createDataFrame(twice, "doc_id long, text string")).collect())
    assert got in (["A. ", twice[1][1]], [twice[0][1], "B. "])


def test_passages_cover_what_spans_do():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a b. ", "c\n", "d e f g h i j! ", "k.l ", "\n", "m n o p q r s t u v w x y z ", ", ", "... "]) for _ in range(rng.randint(2, 14)))
        own, parts = spans.sentences(text), passages.tokens(text)
        starts = list(itertools.accumulate(map(len, parts), initial=0))
        gone = {c for a, b, _ in passages.runs(parts) for c in range(starts[a], starts[b])}
        ends = list(itertools.accumulate(map(len, own), initial=0))
        for at, _ in spans.runs(own, spans.SPAN, spans.MIN_WORDS):
            assert {c for c in range(ends[at], ends[at + 2]) if not text[c].isspace()} <= gone


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/x?y", "https://b.com", None, "nothing", "x://com/fr/#", "x://a.com/de/", "http://org", "http://www.example.org/en/12", "x://notorg/", "x://bad.net/a"]
    pages = spark.createDataFrame([*enumerate(urls), *[(100 + i, "x://bad.net/") for i in range(30)], *[(300 + i, f"x://h{i}.good.com/") for i in range(60)]], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, 0, 1) for i in range(30)] + [(1, 1, 0), (5, 1, None), (None, 0, 0), (4, None, None)] + [(200 + i, 1, 0) for i in range(5)] + [(300 + i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urlrep.judged(pages, labels).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("", "", None, "allow")
    assert [got[i].rule for i in (4, 5, 6, 7, 8)] == ["com/fr/", "com/de/", None, "example.org/en/1", None]
    assert got[9].verdict == "block" and got[1].verdict == "allow"
    more = spark.createDataFrame([(0, urls[0], "x"), (0, urls[0], "y"), (9000, "http://" + "a." * 50_000 + "org/" + "p" * 200_000, "z")], "page_id long, url string, host string")
    again = sorted((r.page_id, len(r.host), r.rule or "", r.verdict) for r in urlrep.judged(more, labels.selectExpr("*", "1 AS page_id", "2 AS host")).collect())
    assert again == [(0, 13, "example.org/es/", "block")] * 2 + [(9000, 100_003, "org/", "allow")]
    assert urlrep.judged(pages.limit(0), labels.limit(0)).count() == 0
    assert {r.verdict for r in urlrep.judged(pages, labels.limit(0)).where("rule IS NULL").collect()} == {"allow"}


def test_language_id(spark, odd, none):
    rng = random.Random(4)
    kinds = {"en": "the and ing ed tion", "de": "ung sch ich ein heit"}
    rows = [(i, " ".join("".join(rng.choices(kinds[k].split(), k=2)) for _ in range(40)), k) for i, k in enumerate(rng.choices(sorted(kinds), k=240))]
    docs = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "12 34", "en"), (1002, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predicted(docs).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([got[i].lang_pred == k for i, _, k in held]) > 0.95
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert langid.predicted(none).count() == 0
    assert {r.lang_pred for r in langid.predicted(odd.where("doc_id < 3")).collect()} == {"und"}
    nameless = langid.predicted(docs.unionByName(spark.createDataFrame([(None, "the the ing", "en")], docs.schema))).where("doc_id IS NULL").collect()
    assert [(r.held_out, r.lang_pred in kinds) for r in nameless] == [(False, True)]
    repeated = langid.sampled_windows(docs.crossJoin(spark.range(30)).drop("id"), 50)
    assert len(repeated) == 100 and len({w for _, w in repeated}) > 80
    assert {w for _, w in langid.sampled_windows(docs)} == {t.encode()[i : i + 256] for i, t, k in rows if not got[i].held_out for i in range(0, len(t), 256)}


def test_byte_network_equals_plain_loops():
    rng = np.random.default_rng(1)
    net = langid.Net(["a", "b", "c"], [rng.normal(0, 1, (w, 257, 5)) for w in (2, 3)], [rng.normal(0, 1, 5) for _ in range(2)], rng.normal(0, 1, (10, 3)), rng.normal(0, 1, 3))
    texts = ["hello", "\u00e9" * 300, "x"]
    langs, scores = langid.judge(net, texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        data = list(text.encode())
        data += [256] * (-len(data) % 256)
        mean = np.zeros(3)
        for at in range(0, len(data), 256):
            window, features = data[at : at + 256], []
            for table, bias in zip(net.tables, net.biases, strict=True):
                for f in range(5):
                    features.append(max(0.0, bias[f] + max(sum(table[k, window[i + k], f] for k in range(len(table))) for i in range(256 - len(table) + 1))))
            z = np.exp(np.array(features) @ net.weights + net.bias)
            mean += z / z.sum() / (len(data) // 256)
        assert lang == "abc"[mean.argmax()] and abs(score - mean.max()) < 1e-9


CALLS, RESULTS = "conv_id long, turn long, call_id string, tool string, arguments string, after array<string>", "conv_id long, turn long, call_id string, content string"


def test_tool_calls(spark):
    a = '{"query": "x", "limit": 2}'
    calls = [(1, 0, "a", "search", a, None), (1, 2, "b", "search", '{"limit": 900, "query": "y"}', ["a"]), (1, 4, "c", "none", a, ["b"]), (2, 0, "d", "search", None, None), (2, 1, "e", "search", a, ["f"]), (2, 2, "f", "search", a, ["e"]), (3, 0, None, "search", a, None), (1, 0, "a", "search", a, None), (4, 0, "g", "search", a, ["missing"]), (2, 3, "h", "search", a, ["d", "e"])]
    results = [(1, 1, "a", "r\u00e9\n"), (5, 1, "z", None), (1, 3, "a", "later")]
    c, r = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    got = {x.call_id: x for x in toolcalls.linked(c.withColumn("content", c.turn), r.withColumn("tool", r.turn)).collect()}
    assert {k: x.status for k, x in got.items()} == {"a": "ok", "b": "invalid", "c": "unknown_tool", "d": "invalid", "e": "cycle", "f": "cycle", None: "unnamed", "z": "orphan", "g": "unanswered", "h": "cycle"}
    assert [got[k].depth for k in "abcg"] == [0, 1, 2, 0] and got["a"].copies == 2
    assert got["a"].message == '{"arguments":{"limit":2,"query":"x"},"call":"a","result":"r\u00e9\\n","tool":"search"}'
    assert toolcalls.linked(c.limit(0), r.limit(0)).count() == 0


def test_tool_calls_keep_to_their_conversation(spark):
    a = '{"query": "x"}'
    calls = [(1, 0, "call_1", "search", a, None), (2, 0, "call_1", "search", a, None), (None, 0, "call_1", "search", a, None), (2, 2, "call_2", "search", a, ["call_1"])]
    results = [(1, 1, "call_1", "one"), (2, 1, "call_1", "two"), (1, 2, None, "x"), (1, 2, None, "x"), (2, 4, None, None)]
    got = sorted((x.conv_id or 0, x.turn, x.call_id or "", x.status, json.loads(x.message)["result"] or "") for x in toolcalls.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)).collect())
    assert got == [(0, 0, "call_1", "unanswered", ""), (1, 0, "call_1", "ok", "one"), (1, 2, "", "orphan", "x"), (1, 2, "", "orphan", "x"), (2, 0, "call_1", "ok", "two"), (2, 2, "call_2", "unanswered", ""), (2, 4, "", "orphan", "")]


def test_tool_call_arguments(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows = ['{"query": "\\ud800"}', f'{{"query": {deep}}}', '{"query": NaN}', '{"query": "x", "limit": 1e999}', '{"query": "' + "y" * 3_000_000 + '"}', '{"query": ""}', "{"]
    calls = spark.createDataFrame([(1, i, f"c{i}", "search", x, None) for i, x in enumerate(rows)], CALLS)
    got = [x for x in sorted(toolcalls.linked(calls, spark.createDataFrame([], RESULTS)).collect(), key=lambda x: x.turn)]
    assert [x.status for x in got] == ["unanswered", "invalid", "invalid", "invalid", "unanswered", "invalid", "invalid"]
    assert '"query":"\\ud800"' in got[0].message and got[1].message.startswith('{"arguments":null') and len(got[4].message) > 3_000_000


def test_tool_call_depths_equal_brute_force(spark):
    rng = random.Random(9)
    calls = []
    for conv in range(3):
        for i in range(40):
            kind = rng.random()
            after = None if kind < 0.1 else [f"c{rng.randrange(i)}" for _ in range(rng.randint(1, 3))] if i and kind < 0.6 else [f"c{i - 1}"] if i else []
            calls.append((conv, i, f"c{i}", "search", None, after))
    calls += [(7, i, f"c{i}", "search", None, [f"c{i - 1}"] if i else None) for i in range(70)]
    calls += [(8, 0, "c0", "search", None, ["c1", "c2"]), (8, 1, "c1", "search", None, None), (8, 2, "c2", "search", None, ["c0"]), (8, 3, "c3", "search", None, ["c2", "c1"])]
    want = {}
    for conv, i, _, _, _, after in calls:
        want[conv, i] = None if conv == 8 and i != 1 else max([want[conv, int(x[1:])] + 1 for x in after or () if conv != 8], default=0)
    got = {(x.conv_id, x.turn): x.depth for x in toolcalls.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS)).collect()}
    assert got == want


def plain_ogg(media: bytes) -> bytes:
    """Another reader, straight from the format: pages one after the other, packets by turns of the streams."""
    at, packets, heads = 0, {}, []
    while at < len(media):
        assert media[at : at + 5] == b"OggS\0"
        serial, n = int.from_bytes(media[at + 14 : at + 18], "little"), media[at + 26]
        body, packet = at + 27 + n, b""
        for size in media[at + 27 : at + 27 + n]:
            packet += media[body : body + size]
            body += size
            if size < 255:
                packets.setdefault(serial, []).append(packet)
                packet = b""
        if serial not in heads:
            heads.append(serial)
        at = body
    streams = [packets[s][1:] for s in heads]
    return b"".join(x for turn in itertools.zip_longest(*streams, fillvalue=b"") for x in turn)


def test_ogg(odd, none):
    for r in ogg.media_features(odd).collect():
        texts = [t or "" for i, t in ODD if i == r.doc_id]
        payload = ogg.padded(texts[0].encode())
        assert len(payload) % 576 == 0 and len(payload) > 0
        media = ogg.mux(payload)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256, r.n_bytes) == (len(media), hashlib.sha256(media).hexdigest(), len(texts[0].encode()))
    assert ogg.media_features(none).count() == 0
    crc = 0
    for byte in b"123456789":  # the checksum bit by bit
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    assert ogg.page_crc(b"123456789") == crc
    payload = random.Random(1).randbytes(576 * 400)
    media = ogg.mux(payload)
    back, line = ogg.payload_of(ogg.demux(media))
    assert back == payload and f"samples={len(payload)};ms={len(payload) // 8}" in line
    broken = bytearray(media)
    broken[-10] ^= 1
    assert ogg.demux(bytes(broken)).bad_pages >= 1
    assert ogg.payload_of(ogg.demux(b""))[0] == b"" and plain_ogg(media) == payload
    # Whatever byte is damaged: no error, and what is left is the payload without whole packets, all of which are counted.
    short = ogg.mux(payload[: 576 * 7])
    whole = {payload[576 * i : 576 * (i + 1)] for i in range(7)}
    for at in range(len(short)):
        hurt = bytearray(short)
        hurt[at] ^= 0x55
        left, line = ogg.payload_of(ogg.demux(bytes(hurt)))
        assert {left[i : i + 576] for i in range(0, len(left), 576)} < whole and ";bad=0;lost=0;" not in line
    left, line = ogg.payload_of(ogg.demux(media[:3000] + media[60_000:]))
    assert "lost=0" not in line and all(left[i : i + 576] in payload for i in range(0, len(left), 576))
    # A packet over two pages, one of them lost.
    p = b"z" * 600
    one, two = ogg._page(2, -1, 9, 0, b"\xff\xff", p[:510]), ogg._page(1, 600, 9, 1, b"\x5a", p[510:])
    assert ogg.demux(one + two).packets == [ogg.Packet(9, p, 600)]
    assert ogg.demux(one).lost_packets == 1 and ogg.demux(two).lost_packets == 1


def test_ogg_cut_at_a_page_border():
    payload = random.Random(2).randbytes(576 * 400)
    media = ogg.mux(payload)
    borders = [at for at in range(len(media)) if media[at : at + 4] == b"OggS"]
    assert ";bad=0;lost=0;open=0;" in ogg.payload_of(ogg.demux(media))[1]
    for at in borders[1:]:
        left, line = ogg.payload_of(ogg.demux(media[:at]))
        assert len(left) < len(payload) and ";open=0;" not in line and ";bad=0;" in line
    assert ogg.demux(media[: borders[2]]).open_streams == 2 and ogg.demux(media[: borders[-1]]).open_streams == 1 and ogg.demux(b"").open_streams == 0


def test_fit_of_neighbour_search_reaches_its_goal():
    """The cheapest fit is taken; clear neighbours need a small share of all rows, and where no tried width will do, buckets grow until the goal is met."""
    rng = np.random.default_rng(3)
    clear = (rng.normal(0, 20, (100, 1, 16)) + rng.normal(0, 1, (100, 12, 16))).reshape(-1, 16)
    noise = rng.normal(0, 1, (1200, 16))
    for x, unit in ((clear, 4.0), (noise, 4.0), (noise, 1e-3)):
        asked = x[:48]
        near = np.stack([np.argsort(ann.distances(x, q))[: ann.TOP + 1] for q in asked])
        fit = ann.fit_of(x, asked, np.repeat(np.arange(48), ann.TOP + 1), x[near.reshape(-1)], unit)
        assert fit.recall >= ann.GOAL and 0 < fit.candidate_share <= 1
        assert x is noise or fit.candidate_share < 0.1
        assert unit > 1 or (fit.m == 1 and fit.width > ann.WIDTHS[-1] * unit)


def test_huffman(spark, odd, none):
    fresh = Tokenizer.from_file(WORD)
    texts = ["hello <|endoftext|> world", "a<|STARTOFTEXT|>b", "<|endoftext", "x, y. z! (w)", "don't  <|endoftext|>\n", "Stra\u00dfe \u0130 \u03a3 \u1e9e"]
    assert [np.frombuffer(x, huffman.words_of(WORD).width).tolist() for x in huffman.words_of(WORD).encode(texts)] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    want, start = [], 0
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = fresh.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in huffman.stored_ids(odd, WORD).collect())
    assert [(i, s, n, c) for s, i, n, c in got] == want
    assert huffman.stored_ids(none, WORD).count() == 0
    for n in (1, 2, 300, 30000):
        ids = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, 40000)
        lengths = huffman.code_lengths(np.bincount(ids), 17)
        assert lengths.max() <= 17 and sum(2.0 ** -int(x) for x in lengths if x) <= 1
        code = huffman.Code(lengths)
        block = huffman.write_block(code, ids, np.array([n]))
        assert (huffman.read_block(code, block)[0] == ids).all()
        if n > 2:  # without a limit that binds, the lengths cost as much as Huffman's tree
            counts = np.bincount(ids)
            heap = counts[counts > 0].tolist()
            heapq.heapify(heap)
            cost = 0
            while len(heap) > 1:
                cost += (a := heapq.heappop(heap) + heapq.heappop(heap))
                heapq.heappush(heap, a)
            assert (counts * huffman.code_lengths(counts, 40)[: len(counts)]).sum() == cost
        with pytest.raises(ValueError):
            huffman.read_block(code, block[:-5] + bytes([block[-5] ^ 1]) + block[-4:])


def test_limited_code_lengths_equal_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        counts, limit = np.array([rng.randint(1, 200) ** 2 for _ in range(rng.randint(3, 7))]), 3
        best = min((sum(c * n for c, n in zip(counts.tolist(), w)) for w in itertools.product(range(1, limit + 1), repeat=len(counts)) if sum(2.0**-n for n in w) <= 1))
        assert (counts * huffman.code_lengths(counts, limit)).sum() == best


def test_pipeline(spark, odd, none):
    text = lambda seed: " ".join(random.Random(seed).choices([f"word{i}" for i in range(500)], k=80)) + "."
    rows = [(i, text(i), "en", f"s{i % 2 if i < 12 else 0}", None) for i in range(20)] + [(50, text(3), "en", "s0", None), (51, text(4) + " more", "en", "s0", None), (52, "12345", "en", "s0", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "tokens":
            assert out.columns == docs.columns
        docs = out.cache()
        seen.append({r.doc_id for r in docs.collect()})
    assert seen[0] == set(range(20)) | {50, 51} and seen[1] == set(range(20)) and seen[-1] == set(range(20))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == odd.columns
        assert stage(spark, none, "").count() == 0


def test_pipeline_evaluates_once(spark):
    """A second evaluation in a task takes a second Python worker, which the executor keeps through the other stages."""
    docs = spark.createDataFrame([(i, "So it was that we went up the hill and down again. And then they all came home late.", "en", "s", 80) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.span_dedup(spark, docs, "")
    assert str(out._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1
    assert [tuple(r) for r in out.collect()] == [tuple(docs.first())]
