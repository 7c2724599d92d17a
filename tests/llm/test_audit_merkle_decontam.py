"""The filter audit, the manifest and decontamination against plain versions, and their defined cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from cuelattice.llm import audit, decontam, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, key string, whole_row string"


def frame(spark, rows):
    """Rows of (doc_id, text, source) with columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, s, None if t is None else len(t), "clash", "clash", "clash") for i, t, s in rows], DOCS)


def audit_rows(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    out = {}
    for i, text, source in rows:
        t = text or ""
        w = words(t)
        smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller}
        good, toxic = (any(k == i and row[c] == 1 for k, *row in labels) and i is not None for c in (0, 1))
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                x = out.setdefault((source or "", order, step), [0] * 6)
                x[0] += not gone and not fails[f]
                x[1] += not gone and fails[f]
                x[2] += gone and fails[f]
                x[3] += fails[f] and sum(fails.values()) == 1
                x[4] += not gone and fails[f] and good
                x[5] += not gone and fails[f] and toxic
                gone |= fails[f]
    share = {}
    for (part, order, step), x in out.items():
        share[part, order[step - 1]] = share.get((part, order[step - 1]), 0) + x[1]
    return {k: (*x, share[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


LABELS = "doc_id long, quality int, toxic int, part string"


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice(["aa", "b", "C", "d$", "eé", " "] + [f"w{k}" for k in range(60)]) for _ in range(rng.randrange(90))) for _ in range(12)] + ["", None, "   ", "A" * 60, "same text " * 40]
    rows = [(rng.choice([*range(25), None]), rng.choice(pool), rng.choice(["s", "t", "", None])) for _ in range(120)]
    labels = [(rng.choice([*range(25), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(30)]
    got = audit.audit(frame(spark, rows), spark.createDataFrame([(*r, "clash") for r in labels], LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == audit_rows(rows, labels)
    assert len(got) == 3 * 600
    assert audit.audit(frame(spark, []), spark.createDataFrame([], LABELS)).count() == 0
    assert audit.audit(frame(spark, [(1, None, None)]), spark.createDataFrame([], LABELS)).count() == 600


def test_audit_fields_hold_any_count():
    most = (1 << 63) - 1
    total = audit.packed(5) * (most - 3) + audit.packed(0) * 3
    assert np.array_equal(audit.unpacked(total), audit.outcome_fields(5).astype("int64") * (most - 3) + audit.outcome_fields(0).astype("int64") * 3)
    assert len({audit.packed(m) for m in range(32)}) == 32


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[2], row[3], row[4], text)])


def runs_of(nodes):
    return [nodes[i : i + 16] for i in range(0, len(nodes), 16)]


def paths_of(leaves):
    """Root of a list of digests and, for each, its siblings before and after it, level by level."""
    paths, owners = [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        at = 0
        for run in runs_of(leaves):
            for k in range(len(run)):
                for o in owners[at + k]:
                    paths[o].append((run[:k], run[k + 1 :]))
            at += len(run)
        leaves, owners = [digest(*r) for r in runs_of(leaves)], [sum(r, []) for r in runs_of(owners)]
    return leaves[0], paths


def manifest_of(rows):
    """Sorted rows of the manifest; rows: (doc_id, text, source, lang, n_chars)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: paths_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, above = paths_of([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (_, _, leaf, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path = path + above[k]
            own = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                own = leaf_of(r, None if r[1] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
            for left, right in path:
                own = digest(*left, own, *right)
            out.append((r[0], leaf, trees[s][0], root, digest(*[d for left, right in path for d in (*left, *right)]), own, own == root))
    return sorted(out, key=str)


def test_manifest_equals_plain_trees(spark):
    rng = random.Random(8)
    rows = []
    for source, n in (("a", 300), (None, 17), ("", 16), ("é", 1), ("B", 33), ("z", 2)):
        for i in range(n):
            rows.append((rng.choice([None, rng.randrange(10**6), 7]) if i % 5 == 0 else rng.randrange(10**6), rng.choice([None, "", "Text É", "plain", f"T{i}"]), source))
    rows += [(5, "twice", "a")] * 3
    df = frame(spark, rows)
    full = [(r.doc_id, r.text, r.source, r.lang, r.n_chars) for r in df.collect()]
    got = merkle.verified(df.repartition(7)).collect()
    assert sorted((tuple(r) for r in got), key=str) == manifest_of(full)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[(1, "One", "s")], [(i, None, None) for i in range(20)], [(i, "x", f"s{i:03}") for i in range(40)]])
def test_manifest_of_small_tables(spark, rows):
    df = frame(spark, rows)
    assert sorted((tuple(r) for r in merkle.verified(df).collect()), key=str) == manifest_of([(r.doc_id, r.text, r.source, r.lang, r.n_chars) for r in df.collect()])


def test_manifest_of_nothing(spark):
    assert merkle.verified(frame(spark, [])).count() == 0


def test_path_and_fold_are_the_operators_own(spark):
    df = merkle.manifest(frame(spark, [(i, f"t{i}", "s") for i in range(40)]))
    r = df.where("doc_id = 17").first()
    own = r.leaf
    for x in r.path:
        own = digest(x.left, own, x.right)
    assert own == r.root and len(r.path) == 2


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits_of(text, items):
    words, hit, found = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        n = min(10, len(own))
        wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add("" if name is None else str(name))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = "item_id long, text string, words string"


def planted(rng):
    words = ["a", "b", "c", "dé", "中", "x1"]
    say = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randrange(1, 40))) for i in range(20)] + [(None, say(12)), (3, say(15)), (50, None), (51, "... !"), (52, "unmatched"), (53, say(9))]
    docs = [(i, " ".join([say(rng.randrange(30)), *([str(rng.choice(items)[1])] if rng.random() < 0.5 else []), say(rng.randrange(30))]), "s") for i in range(80)]
    docs += [(None, say(30), "s"), (7, say(40), None), (100, None, "s"), (101, "", "s"), (102, "?!", "s"), (103, "one" * 50, "s"), (7, say(40), "s")]
    return docs, items


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_decontamination_equals_brute_force(spark, monkeypatch, most):
    rng = random.Random(11)
    docs, items = planted(rng)
    monkeypatch.setattr(decontam, "MOST_WINDOWS", most)
    monkeypatch.setattr(decontam, "PIECE", 8)
    bench = spark.createDataFrame([(*r, "clash") for r in items], ITEMS)
    got = decontam.audited(frame(spark, docs), bench).collect()
    want = sorted(((i, *hits_of(t, items)) for i, t, _ in docs), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)
    empty = spark.createDataFrame([], ITEMS)
    assert not any(r.contaminated for r in decontam.audited(frame(spark, docs), empty).collect())
    assert decontam.audited(frame(spark, []), bench).count() == 0


def test_words_over_several_units():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aZ9 -é中") for _ in range(rng.randrange(120))) for _ in range(60)] + ["q" * 300, "", "a"]
    want = [[w.encode() for w in words_of(t)] for t in texts]
    blobs = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([len(b) for b in blobs])
    whole = decontam.Reader().split(data, ends)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(decontam, "UNIT", 16)
        parts = decontam.Reader().split(data, ends)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    s, e, _, first = whole
    low = decontam._FOLD[data]
    got = [[low[a:b].tobytes() for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in itertools.pairwise(first)]
    assert got == want


def test_runs_and_documents_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = frame(spark, [(1, f"Keep this. {item.upper()}! And é that.", "s"), (2, "clean text", "s"), (3, None, "s"), (4, item, "s")])
    bench = spark.createDataFrame([(9, item, "clash")], ITEMS)
    cut = {r.doc_id: r.text for r in decontam.without_runs(docs, bench).collect()}
    assert cut == {1: "Keep this. ! And é that.", 2: "clean text", 3: None, 4: ""}
    assert decontam.without_runs(docs, bench).columns == docs.columns
    assert sorted(r.doc_id for r in decontam.without_documents(docs, bench).collect()) == [2, 3]
    assert sorted(r.doc_id for r in decontam.without_documents(docs, bench, 0.9).collect()) == [1, 2, 3]
