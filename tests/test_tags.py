"""Tags: one-to-one matches, tags beside dialogue, tags in pauses."""

from cuelattice.operators import tags as G

TAGS, EVENTS = "job_id long, tag_id long, tag string", "job_id long, event_id long, label string, start_ms long, end_ms long"
CUES = "job_id long, place long, text string, start_ms long, end_ms long, is_tag boolean"


def test_tags_take_events_in_order(spark):
    tags = [(1, 0, "Laughs"), (1, 1, "dog barks"), (1, 2, "laughter"), (1, 3, "laughs"), (1, 4, "silence"), (1, 5, "Dogs"), (2, 0, "music")]
    events = [(1, 10, "Laughter", 5000, 6000), (1, 11, "Dog", 1000, 2000), (1, 12, "Laughter", 1000, 3000), (1, 13, "Dog", 9000, 9500), (3, 1, "Music", 0, 1)]
    got = {(r.job_id, r.tag_id): (r.event_id, r.start_ms) for r in G.matched(spark.createDataFrame(tags, TAGS), spark.createDataFrame(events, EVENTS)).collect()}
    assert got[1, 0] == (12, 1000) and got[1, 3] == (10, 5000)
    assert got[1, 1] == (11, 1000) and got[1, 5] == (13, 9000)
    assert got[1, 2] == (12, 1000) and got[1, 4] == (None, None) and got[2, 0] == (None, None)


def test_tags_leave_dialogue(spark):
    tags = [(1, 0, "a", 800, 1500), (1, 1, "b", 1800, 2600), (1, 2, "c", 1200, 1400), (1, 3, "d", 990, 2010), (1, 4, "e", 5000, 6000)]
    cues = spark.createDataFrame([(1, 1000, 2000)], "job_id long, start_ms long, end_ms long")
    got = {r.tag_id: (r.start_ms, r.end_ms) for r in G.beside_dialogue(spark.createDataFrame(tags, "job_id long, tag_id long, tag string, start_ms long, end_ms long"), cues).collect()}
    assert got == {0: (800, 950), 1: (2050, 2600), 2: (1200, 1400), 3: (0, 950), 4: (5000, 6000)}


def shown(spark, rows, **layout):
    out = G.placed(spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], CUES), **layout).orderBy("start_ms", "place").collect()
    return [(r.text, r.start_ms, r.end_ms, r.is_tag) for r in out]


def test_tags_in_pauses_and_beside_speech(spark):
    tag = lambda t: (t, None, None, True)
    assert shown(spark, [tag("[music]"), ("Good.", 3000, 4000, False), tag("[laughter]"), ("Okay.", 4100, 5000, False), tag("[end]")]) == [
        ("[music]", 0, 2999, True), ("Good. [laughter]", 3000, 4000, False), ("Okay.", 4100, 5000, False), ("[end]", 5001, 7001, True),
    ]
    assert shown(spark, [("One", 0, 1000, False), tag("[a]"), tag("[b]"), ("Two", 3002, 4000, False)]) == [("One", 0, 1000, False), ("[a]", 1001, 2000, True), ("[b]", 2001, 3001, True), ("Two", 3002, 4000, False)]
    long = "x" * 42
    assert shown(spark, [(long, 0, 1000, False), tag("[a]"), (long, 1100, 2000, False)]) == [(f"{long}\n[a]", 0, 1000, False), (long, 1100, 2000, False)]
    assert shown(spark, [(long + "\n" + long, 0, 1000, False), tag("[a]"), ("Two", 1100, 2000, False)]) == [(long + "\n" + long, 0, 1000, False), ("[a] Two", 1100, 2000, False)]
    full = long + "\n" + long
    assert shown(spark, [(full, 0, 1000, False), tag("[a]"), (full, 1100, 2000, False)]) == [(full, 0, 1000, False), ("[a]", 1001, 1099, True), (full, 1100, 2000, False)]
    assert shown(spark, [tag("[a]")]) == [("[a]", 0, 2000, True)]
    assert shown(spark, [("One", 0, 1000, False), tag("[a]"), ("Two", 30000, 31000, False)])[1] == ("[a]", 1001, 8001, True)
