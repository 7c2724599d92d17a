"""Review of cues: features, tiers and reasons by hand, weights against plain gradient descent."""

import math

import numpy as np
import pytest

from cuelattice.operators import cues as C
from cuelattice.operators import triage as R

CUE = "job_id long, cue_id int, start_ms long, end_ms long, text string"
WORD = "job_id long, cue_id int, start_ms long, end_ms long, text_conf long, timing_conf long, heard_by long, interpolated boolean"
SOUND, GONE = "job_id long, start_ms long, end_ms long, label string", "job_id long, start_ms long"


@pytest.fixture
def review(spark):
    def of(cues, words, sounds=(), gone=(), mode="reference"):
        sides = [spark.createDataFrame(list(rows), schema) for rows, schema in ((cues, CUE), (words, WORD), (sounds, SOUND), (gone, GONE))]
        return {(r.job_id, r.cue_id): r for r in R.scored(R.features(*sides, mode=mode), mode).collect()}

    return of


def good(job, cue, at, n=4):
    return [(job, cue, at + 300 * i, at + 300 * i + 250, 100, 90, 3, False) for i in range(n)]


def test_a_clean_cue_is_accepted_without_reasons(review):
    got = review([(1, 0, 0, 1200, "all is well here")], good(1, 0, 0))[1, 0]
    assert (got.tier, got.reasons, got.est_error) == ("accept", [], 0.0)
    assert got.risk == pytest.approx(1 / (1 + math.exp(3.2)))
    assert all(got[f] == 0 for f in R.FEATURES)


def test_one_name_nobody_heard_is_checked_and_a_cue_nobody_heard_is_done_anew(review):
    name = [*good(1, 0, 0, 3), (1, 0, 900, 1200, 33, 40, 0, True)]
    lost = [(1, 1, 5000 + 200 * i, 5200 + 200 * i, 0, 20, 0, True) for i in range(4)]
    got = review([(1, 0, 0, 1200, "a b c Xanthippe"), (1, 1, 5000, 5800, "d e f g")], name + lost)
    assert (got[1, 0].tier, got[1, 0].est_error, got[1, 0].unheard, got[1, 0].unheard_any) == ("quick_check", 0.0, 0.25, 1)
    assert got[1, 0].reasons == ["no engine heard 1 word (check the transcript)", "0.3 s interpolated (1 word)"]
    assert (got[1, 1].tier, got[1, 1].est_error) == ("redo", 0.75)
    assert got[1, 1].reasons == ["no engine heard 4 words (check the transcript)", "0.8 s interpolated (4 words)"]


def test_voted_words(review):
    words = [(1, 0, 0, 200, 50, 90, 0, False), (1, 0, 300, 500, 100, 90, 2, False)]
    got = review([(1, 0, 0, 500, "a b")], words, mode="ensemble")[1, 0]
    assert (got.text_error, got.low_text, got.disputed_any, got.unheard, got.unheard_any) == (0.25, 0.5, 1, 0.0, 0)
    assert (got.tier, got.est_error, got.reasons) == ("redo", 0.3125, ["voters disagree on 1 word"])


def test_sound_beneath_removed_words_and_odd_lengths(review):
    words = [(1, 0, 1000, 1010, 100, 90, 3, False), (1, 0, 1100, 4000, 100, 49, 3, False), (1, 0, 4000, 4300, 100, 90, 3, False)]
    sounds = [(1, 0, 1001, "music"), (1, 0, 1001, "music"), (1, 0, 1000, "crowd"), (1, 4300, 9000, "noise"), (1, 4000, 4100, "clipping"), (2, 0, 9000, "overlap"), (1, 0, 9000, "other"), (1, 0, 9000, None)]
    got = review([(1, 0, 1000, 4300, "a b c")], words, sounds, [(1, 750), (1, 749), (1, 4550), (1, 4551), (2, 1000)])[1, 0]
    assert {c for c in R.CONDITIONS if got[c]} == {"music", "clipping"}
    assert (got.removed, got.hallucination, got.implausible, got.weak_timing) == (2, pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(1 / 3))
    assert got.reasons == ["music under speech", "clipped (distorted) audio", "uncertain timing on 1 word", "hallucination filter removed 2 words here", "implausible word durations"]


def test_sound_tags_count_for_neighbours_but_marks_do_not(review):
    texts = ["before", "[applause]", "after", "far", "[inaudible 00:01:02] word", "[?]", "last [Laughter]"]
    got = review([(1, i, 1000 * i, 1000 * i + 500, t) for i, t in enumerate(texts)], [w for i in range(7) for w in good(1, i, 1000 * i, 1)])
    assert [got[1, i].beside_tag for i in range(7)] == [1, 0, 1, 0, 0, 1, 1]


def test_nulls_cues_without_words_and_empty_tables(review):
    got = review([(1, 0, 0, 0, None), (1, 1, 50, 60, "x")], [(1, 1, None, None, None, None, None, None)], [(1, 0, 100, "music")])
    assert (got[1, 0].n, got[1, 0].text_error, got[1, 0].music, got[1, 0].tier) == (0, 0.0, 1, "accept")
    assert (got[1, 1].n, got[1, 1].unheard, got[1, 1].implausible, got[1, 1].reasons) == (1, 0.0, 0.0, ["music under speech"])
    assert review([], []) == {}


def test_fitted_weights_equal_plain_gradient_descent(spark):
    rng = np.random.default_rng(5)
    x = (rng.random((300, len(R.FEATURES))) < 0.3).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 9] * 4 - 1)))).astype(int)
    prior = np.array([C.WEIGHTS[f] for f in R.FEATURES])
    w, b = prior.copy(), C.BIAS
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w - 0.2 * (x.T @ (p - y) / len(y) + 0.05 * (w - prior)), b - 0.2 * (p - y).mean()
    rows = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], [*R.FEATURES, "label"])
    got = {r.feature: r.weight for r in R.fitted(rows).collect()}
    assert len(got) == 20 and got["bias"] == pytest.approx(b, abs=1e-4)
    assert [got[f] for f in R.FEATURES] == pytest.approx(list(w), abs=1e-4)
    none = {r.feature: r.weight for r in R.fitted(rows.limit(0)).collect()}
    assert none == {"bias": C.BIAS} | C.WEIGHTS
