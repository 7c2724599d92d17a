"""Loops and stock phrases against plain scans."""

import random

from cuelattice.operators import hallucinations as H

WORDS, FRAMES = "job_id long, idx long, norm string, start_ms long, end_ms long", "job_id long, start_ms long, end_ms long, p long"


def rows(text, job=1, at=0, step=300):
    return [(job, i, w, at + i * step, at + i * step + 200) for i, w in enumerate(text.split())]


def plain(tokens):
    out, i = [], 0
    while i < len(tokens):
        best = None
        for n in range(1, 9):
            gram = tokens[i : i + n]
            if i + 2 * n > len(tokens) or not any(gram):
                continue
            r = 1
            while tokens[i + r * n : i + (r + 1) * n] == gram:
                r += 1
            if r >= (4 if n == 1 else 3) and (best is None or r * n > best[0] * best[1]):
                best = (n, r)
        if best:
            out.append((i, *best))
        i += best[0] * best[1] if best else 1
    return out


def test_loops_equal_a_plain_scan(spark):
    rng = random.Random(6)
    texts = {j: [rng.choice("ab") if rng.random() < 0.9 else rng.choice(["c", ""]) for _ in range(rng.randrange(1, 40))] for j in range(60)}
    texts[98] = "a b a b a b c".split()
    texts[99] = ["you"] * 9
    got = {}
    for r in H.loops(spark.createDataFrame([(j, i, w, 0, 0) for j, ws in texts.items() for i, w in enumerate(ws)], WORDS)).orderBy("job_id", "first").collect():
        got.setdefault(r.job_id, []).append((r.first, r.n, r.repeats))
    assert got == {j: p for j, ws in texts.items() if (p := plain(ws))}
    assert got[98] == [(0, 2, 3)] and got[99] == [(0, 1, 9)]


def test_loops_go_for_sure_or_where_little_is_said(spark):
    words = spark.createDataFrame(rows(" ".join(["you"] * 9), 1) + rows("no no no no I said", 2) + rows("the end the end the end", 3), WORDS)
    frames = spark.createDataFrame([(1, 0, 9000, 95), (2, 0, 9000, 95), (3, 0, 600, 90), (3, 600, 9000, 5)], FRAMES)
    gone = sorted((r.job_id, r.idx) for r in H.loop_removals(words, frames).collect())
    assert gone == [(1, i) for i in range(1, 9)] + [(3, i) for i in range(2, 6)]


def test_stock_phrases_go_only_in_silence(spark):
    words = rows("we will start now", 1) + [(1, 4 + i, w, 10000 + i * 300, 10200 + i * 300) for i, w in enumerate("thank you for watching".split())]
    words += rows("so thank you for that", 2) + rows("thank you", 3)
    frames = [(1, 0, 2000, 95), (1, 2000, 20000, 3), (2, 0, 9000, 3), (3, 0, 9000, 60)]
    gone = sorted((r.job_id, r.idx, r.phrase) for r in H.stock_removals(spark.createDataFrame(words, WORDS), spark.createDataFrame(frames, FRAMES)).collect())
    assert gone == [(1, i, "thank you for watching") for i in range(4, 8)]
