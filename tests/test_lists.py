"""The derived tables made by one kernel: equal to plain loops, and without a shuffle of words."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelattice import catalog
from cuelattice.operators import align as A
from cuelattice.plans import fixtures as X
from cuelattice.plans import lists as L

DATA = "/root/testdata/sf0.001"


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def plainly_matched(ref, heard, n=3):
    """As align.aligned says, by loops over one pair of lists."""
    grams = lambda x: {g: at[0] for g in {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if len(at := [i for i in range(len(x) - n + 1) if tuple(x[i : i + n]) == g]) == 1}
    r, h = grams(ref), grams(heard)
    p = next((i for i in range(min(len(ref), len(heard))) if ref[i] != heard[i]), min(len(ref), len(heard)))
    q = next((i for i in range(min(len(ref), len(heard))) if ref[-1 - i] != heard[-1 - i]), min(len(ref), len(heard)))
    q = min(q, len(ref) - p, len(heard) - p)
    found = {}
    for i, j in [(r[g], h[g]) for g in r.keys() & h.keys()] + ([(p - 1, p - 1)] if p else []) + ([(len(ref) - q, len(heard) - q)] if q else []):
        found[i] = min(found.get(i, j), j)
    clean = lambda m: {i: j for i, j in m.items() if all((a < i and b < j) or (a > i and b > j) or a == i for a, b in m.items())}
    around = lambda m, i: (max((k for k in m if k <= i), default=None), min((k for k in m if k > i), default=None))
    found, hits = clean(found), {}
    for i, w in enumerate(ref):
        low, high = around(found, i)
        ways = [found[low] + i - low if low is not None else None, found[high] + i - high if high is not None else None]
        if ways[0] is not None and high is not None and ways[0] >= found[high]:
            ways[0] = None
        if ways[1] is not None and low is not None and ways[1] <= found[low]:
            ways[1] = None
        hit = [k for k in ways if k is not None and 0 <= k < len(heard) and heard[k] == w]
        if hit:
            hits[i] = hit[0]
    hits, out = clean(hits), []
    for i in range(len(ref)):
        low, high = around(hits, i)
        if i in hits:
            out.append((hits[i], True))
        else:
            out.append((hits[low] + i - low if low is not None and high is not None and high - low == hits[high] - hits[low] else -1, False))
    return out


def test_many_lists_at_once_are_matched_as_each_alone(spark):
    random.seed(5)
    pairs = [([], [1]), ([1], []), ([], [])]
    for _ in range(300):
        ref = [random.randrange(random.choice([3, 40])) for _ in range(random.randrange(40))]
        heard = [w for x in ref for w in random.choice([[x]] * 8 + [[], [x, 50], [51]])]
        pairs.append((ref, heard))
    ends = lambda k: np.cumsum([0, *[len(p[k]) for p in pairs]])
    flat = lambda k: np.array([w for p in pairs for w in p[k]], np.int64)
    pos, same = A.matched(flat(0), ends(0), flat(1), ends(1))
    assert list(zip(pos.tolist(), same.tolist(), strict=True)) == [x for ref, heard in pairs for x in plainly_matched(ref, heard)]


def plain_costs(x, y):
    """Errors and of these fewest substitutions, by the whole table."""
    row = [(j, 0) for j in range(len(y) + 1)]
    more = lambda c, errors, changed: (c[0] + errors, c[1] + changed)
    for w in x:
        new = [more(row[0], 1, 0)]
        for j, v in enumerate(y):
            new.append(min(more(row[j + 1], 1, 0), more(new[j], 1, 0), row[j] if v == w else more(row[j], 1, 1)))
        row = new
    return row[-1]


def test_costs_of_many_lists_equal_the_whole_tables():
    rng = random.Random(7)
    pairs = [([], []), ([1], []), ([], [2, 3]), ([4] * 30, [4] * 7)]
    for _ in range(200):
        x = [rng.randrange(rng.choice([2, 3, 30])) for _ in range(rng.randrange(45))]
        near = [w for u in x for w in rng.choice([[u]] * 6 + [[], [u, 50], [51]])]
        pairs.append((x, near if rng.random() < 0.7 else [rng.randrange(3) for _ in range(rng.randrange(60))]))
    (x, y), (x0, y0) = ([np.array([w for p in pairs for w in p[k]], np.int64) for k in (0, 1)], [np.cumsum([0, *[len(p[k]) for p in pairs]]) for k in (0, 1)])
    upper = A.reached(x, x0, y, y0)
    wrong, changed = A.edit_costs(x, x0, y, y0, upper)
    assert list(zip(wrong.tolist(), changed.tolist(), strict=True)) == [plain_costs(*p) for p in pairs]
    assert A.edit_costs(x, x0, y, y0, upper, split=False)[0].tolist() == wrong.tolist() and (wrong <= upper).all()


def test_the_split_of_a_long_list_takes_no_whole_table():
    """4000 lists of 1000 words: their whole tables have 4e9 cells, a band of them 1e8."""
    words = np.arange(1000)
    heard = np.delete(words, [3, 500, 501])
    count = 4000
    began = time.process_time()
    wrong, changed = A.edit_costs(np.tile(words, count), np.arange(count + 1) * 1000, np.tile(heard, count), np.arange(count + 1) * 997, np.full(count, 10))
    assert set(wrong.tolist()) == {3} and not changed.any() and time.process_time() - began < 20


def test_a_job_of_two_documents_one_without_text_and_one_without_id(spark, tmp_path):
    rows = [(1, "a b. c", "en", "s", 6), (1, "d e", "de", "s", 3), (2, None, "en", "s", 0), (3, "  ", "en", "s", 2), (None, "x y", "fr", "s", 3), (-9, "one two three " * 20, "en", "s", 1)]
    d = documents(spark, tmp_path, rows)
    words = L.tok(spark, d).collect()
    assert sorted((r.job_id or 0, r.idx) for r in words) == sorted([(1, 0), (1, 0), (1, 1), (1, 1), (1, 2), (0, 0), (0, 1)] + [(-9, i) for i in range(60)])
    assert {r.lang for r in words if r.job_id == 1} == {"en", "de"} and not {"fr"} - {r.lang for r in words if r.job_id is None}
    aligned = L.aligned(spark, d)
    assert aligned.where("job_id IS NULL").count() == 0
    heard = X.heard(spark, d).where("job_id = -9").select("job_id", "engine", "pos", "norm", "start_ms", "end_ms", "conf")
    free = L.alone(spark, d, *heard.columns).where("job_id = -9").unionByName(aligned.where("job_id = -9").select(*heard.columns))
    assert sorted(map(tuple, free.select([F.col(c).cast("string") for c in heard.columns]).collect())) == sorted(map(tuple, heard.select([F.col(c).cast("string") for c in heard.columns]).collect()))


#: At most so many shuffles: one of the documents for each pass over them, and of what is summed up or left after that.
SHUFFLES = {
    "j07_aligned_words": 1, "a01_weighted_vote": 1, "a06_timing_error": 2, "a15_anchor_spans": 1, "j10_carried_confidence": 1, "j15_correction_labels": 2, "j20_edited_spans": 2,
    "a03_word_errors": 1, "a03_error_split": 1, "a04_blockwise_errors": 1, "a08_error_rollup": 2, "a12_engine_leaderboard": 3, "a24_error_pivot": 3, "s21_benchmark_report": 4,
    "a05_time_consensus": 1, "j13_second_talker": 1, "a09_second_talker_share": 1, "a22_triage_features": 1, "s07_textgrid_words": 1, "s08_engine_answers": 1, "p15_balanced_lines": 1, "a02_vote_network": 1, "a01_network_vote": 1, "j08_alignment_pairs": 2,
    "w20_ngram_repetition": 1, "w17_loop_removals": 1, "p20_voter_languages": 2, "a33_triage_examples": 1, "a07_invented_words": 4, "a33_calibration_examples": 4, "a10_triage_quality": 5,
}


@pytest.mark.parametrize("name", SHUFFLES)
def test_words_are_not_shuffled(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") - plan.count("BroadcastExchange ") <= SHUFFLES[name]


def test_each_step_of_a_fit_is_one_pass_without_a_shuffle(spark):
    """Equal to Newton's method on all rows at once; 19 features had 230 sums of generated code a step."""
    from cuelattice.operators import budget as B

    rng = np.random.default_rng(3)
    x = rng.random((400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.5] - 0.3)))).astype(int)
    rows = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1)], "a double, b double, c double, y int").repartition(5)
    w = start = np.array([1.0, 1.0, 1.0, 0.0])
    full, ridge = np.column_stack([x, np.ones(400)]), np.array([0.05 * 401] * 3 + [0.0])
    for _ in range(12):
        p = 1 / (1 + np.exp(-full @ w))
        w = w - np.clip(np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(ridge + 1e-9), (p - y) @ full + ridge * (w - start)), -2, 2)
    began = time.monotonic()
    got = B.calibrated(rows, ["a", "b", "c"], "y", [1.0, 1.0, 1.0], 0.0, pull=0.0, pull_each=0.05)
    assert [r.weight for r in got.collect()] == [round(float(v), 6) for v in w] and time.monotonic() - began < 60


def test_repeats_and_loops_of_repetitive_jobs_equal_the_operators(spark, tmp_path):
    from cuelattice.operators import cues as C
    from cuelattice.operators import hallucinations as H
    from cuelattice.plans import hallucination_queries as Q

    rng = random.Random(11)
    text = lambda: " ".join(rng.choice(["a", "b", "-", "c d e", "a a a a a", "b c b c b c b c", "x. y z x. y z x. y z", "w" + str(rng.randrange(9))]) for _ in range(rng.randrange(90)))
    d = documents(spark, tmp_path, [(i, text(), "en", "s", 0) for i in range(40)])
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(L.repeats(spark, d)) == rows(C.repeats(X.tok(spark, d)))
    said = Q._said(spark, d)
    assert rows(L.loop_removals(spark, d)) == rows(H.loop_removals(said, said.select("job_id", "start_ms", "end_ms", "p")))


def test_words_of_odd_texts_are_those_of_the_column_functions(spark, tmp_path):
    texts = ["Été, naïve!  x\u000by\tz\r\n...", " \n", "", "don't [Tag] 一二 १२ a_b É́ «Ω»", " x y end.", "Straße ĲSSEL ẞ"]
    d = documents(spark, tmp_path, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    rows = lambda df: sorted(map(str, df.select("job_id", "idx", "word", "start_ms", "end_ms", "norm", "chunk_id").collect()))
    assert rows(L.tok(spark, d)) == rows(X.tok(spark, d))
    assert sorted(map(str, L.aligned(spark, d).select("pos", "norm").collect()))
