"""Small hand-made inputs for the library's own operators."""

import numpy as np
from pyspark.sql import functions as F

from cuelattice.functions import text as T
from cuelattice.operators import align as A
from cuelattice.operators import cues as C
from cuelattice.operators import intervals as I
from cuelattice.operators import signals as S
from cuelattice.plans import vote_queries as V
from cuelattice.sources import files
from cuelattice.streaming import live


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("r")).first().r


def test_words(spark):
    assert one(spark, T.normalize_word(F.col("w")), w="Über-Straße!") == "überstraße"
    assert one(spark, T.sentence_end(F.col("w")), w="go to St.") is False
    assert one(spark, T.sentence_end(F.col("w")), w='He said "Go."') is True
    assert one(spark, T.extract_tags(F.col("w")), w="[music] a [00:01:02] [END OF AUDIO]") == ["music"]
    assert one(spark, T.metric_words(F.col("w")), w="I can't hear uh twenty [noise]") == ["i", "can", "not", "hear", "20"]
    assert one(spark, T.script_of(F.col("w")), w="слово") == "ru"


def test_timecodes(spark):
    assert one(spark, T.to_ms(F.col("t")), t="01:02:03,004") == 3723004
    assert one(spark, T.to_ms(F.col("t")), t="nonsense") == 0
    assert one(spark, T.timecode(F.col("t")), t=3723004) == "01:02:03,004"


def test_sql_functions(spark):
    T.register_sql(spark)
    r = spark.sql("SELECT cl_normalize_word('Tea!') a, cl_spoken_ms('tea') b, cl_timecode_ms('00:00:01,500') c").first()
    assert tuple(r) == ("tea", 260, 1500)


def test_words_to_chunks(spark):
    words = spark.createDataFrame([(1, i, t, t + 400) for i, t in enumerate((0, 5000, 10000, 15000))], "job_id long, word long, start_ms long, end_ms long")
    chunks = spark.createDataFrame([(1, 0, 0, 6000), (1, 1, 9000, 12000)], "job_id long, chunk long, start_ms long, end_ms long")
    got = I.nearest(I.at_midpoint(words), chunks, "word", "chunk", 5000, 500)
    assert {r.word: r.chunk for r in got.collect()} == {0: 0, 1: 0, 2: 1, 3: None}


def test_interval_join_is_whole_and_without_repeats(spark):
    import random

    random.seed(2)
    rows = lambda n: [(random.randrange(2), i, s := random.randrange(5000), s + random.randrange(1, 900)) for i in range(n)]
    a, b = rows(60), rows(60)
    schema = "job_id long, i long, start_ms long, end_ms long"
    got = I.interval_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 250).select("l.i", F.col("r.i").alias("k")).collect()
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert sorted((r.i, r.k) for r in got) == want


def test_overlap_regions(spark):
    turns = spark.createDataFrame([(1, 0, 5000), (1, 4000, 8000), (1, 7500, 9000), (1, 20000, 21000)], "job_id long, start_ms long, end_ms long")
    assert sorted((r.start_ms, r.end_ms) for r in I.crowded(turns, 2, 50, 100).collect()) == [(4000, 5000), (7500, 8000)]


def test_word_errors(spark):
    df = spark.createDataFrame([("the cat sat on the mat".split(), "the cat sat on a mat".split()), ([], ["x"]), (["a", "b"], [])], "a array<string>, b array<string>")
    got = df.select(A.distance(F.col("a"), F.col("b")).alias("d"), A.errors("a", "b").alias("e")).collect()
    assert [r.d for r in got] == [1, 1, 2]
    assert [(r.e // A.EDIT, r.e % A.EDIT) for r in got] == [(1, 1), (1, 0), (2, 0)]


def test_votes(spark):
    rows = [(1, 0, "a", 1000, "sail"), (1, 0, "b", 950, "sail"), (1, 0, "c", 400, "sale"), (1, 1, "a", 1000, None), (1, 1, "b", 950, None), (1, 1, "c", 400, "thanks"), (1, 2, "b", 500, "x"), (1, 2, "a", 500, "y")]
    got = {r.idx: r for r in V.votes(spark.createDataFrame(rows, "job_id long, idx long, engine string, w long, token string")).collect()}
    assert got[0].token == "sail" and got[0].agreement == 829
    assert got[1].token is None  # silence wins
    assert got[2].token == "y"  # a tie goes to the backbone


def test_loops(spark):
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b a b a b c".split())], "job_id long, idx long, norm string")
    assert [(r.first, r.repeats) for r in C.loops(words, 2).collect()] == [(0, 3)]


def test_cue_timing_and_files(spark):
    cues = spark.createDataFrame([(1, 0, 0, 1500, "One & two"), (1, 1, 1000, 2000, "Three\nfour"), (1, 2, 2500, 3000, "End")], "job_id long, cue_id int, start_ms long, end_ms long, text string")
    fixed = {r.cue_id: r.end_ms for r in C.without_overlap(cues).collect()}
    assert fixed == {0: 999, 1: 2000, 2: 3000}
    assert {r.cue_id: r.end_ms for r in C.chained(C.without_overlap(cues)).collect()} == {0: 999, 1: 2499, 2: 3250}
    back = C.from_srt(C.srt(cues)).orderBy("n").collect()
    assert [(r.n, r.start_ms, r.end_ms, r.text) for r in back] == [(1, 0, 1500, "One & two"), (2, 1000, 2000, "Three\nfour"), (3, 2500, 3000, "End")]
    assert "&amp;" in C.vtt(cues.withColumn("who", F.lit("A")), "who").first().vtt


def test_stream_replay_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("id AS event_id", "id % 7 AS user_id", "timestamp_micros(id * 1700000000) AS at", "if(id % 5 = 0, 'error', 'view') AS event_type")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for k, job in enumerate((live.utterances, live.rates, live.latest)):
        got = live.replayed(job(stream), f"replay{k}", str(tmp_path / f"at{k}"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, job(rows).collect()))


def test_files(spark, tmp_path):
    cues = spark.createDataFrame([("a", 0, 0, 1500, "One"), ("b", 0, 10, 20, "Two\nlines")], "job_id string, cue_id int, start_ms long, end_ms long, text string")
    files.write_srt(cues, str(tmp_path / "out"))
    for job in "ab":
        part = next((tmp_path / "out" / f"job_id={job}").glob("part-*"))
        (tmp_path / f"{job}.srt").write_bytes(part.read_bytes())
    got = sorted((r.job_id, r.n, r.start_ms, r.end_ms, r.text) for r in files.read_srt(spark, str(tmp_path / "*.srt")).collect())
    assert got == [("a", 1, 0, 1500, "One"), ("b", 1, 10, 20, "Two\nlines")]
    (tmp_path / "x.json").write_text('[{"word": "hi", "start": 0.5, "end": 0.75, "conf": 0.9}]')
    (tmp_path / "y.json").write_text("[]")
    got = sorted((r.job_id, r.word, r.start_ms) for r in files.read_words(spark, str(tmp_path / "*.json")).collect())
    assert got == [("x", "hi", 500), ("y", None, None)]
    pairs = files.paired(spark.createDataFrame([("/d/a.mp4",), ("/d/a.srt",), ("/d/a.txt",), ("/d/b.mp3",)], "path string")).collect()
    assert {r.media: r.transcript for r in pairs} == {"/d/a.mp4": "/d/a.txt", "/d/b.mp3": None}


def test_alignment_pairs(spark):
    df = spark.createDataFrame([("we sailed to the island".split(), "we sale to island now".split()), ([], ["x"]), (["a"], []), (None, None)], "a array<string>, b array<string>")
    got = [[(p.a, p.b, p.same) for p in r.p] for r in A.with_pairs(df, "a", "b", "p").collect()]
    assert got[0] == [(0, 0, True), (1, 1, False), (2, 2, True), (3, None, False), (4, 3, True), (None, 4, False)]
    assert got[1:] == [[(None, 0, False)], [(0, None, False)], []]


def test_alignment_pairs_cost_what_the_errors_say(spark):
    import random

    random.seed(3)
    rows = [([random.choice("abc") for _ in range(random.randrange(9))], [random.choice("abcd") for _ in range(random.randrange(9))]) for _ in range(80)]
    for r in A.with_pairs(spark.createDataFrame(rows, "a array<string>, b array<string>"), "a", "b", "p").withColumn("e", A.errors("a", "b")).collect():
        assert [p.a for p in r.p if p.a is not None] == list(range(len(r.a))) and [p.b for p in r.p if p.b is not None] == list(range(len(r.b)))
        wrong = [p for p in r.p if not p.same]
        assert r.e == A.EDIT * len(wrong) + sum(p.a is not None and p.b is not None for p in wrong)
        assert all(r.a[p.a] == r.b[p.b] for p in r.p if p.same)


def test_wrapped(spark):
    assert one(spark, C.wrapped(F.col("t"), 7), t="one two  three\nseventeen a b") == "one two\nthree\nseventeen\na b"
    assert one(spark, C.wrapped(F.col("t"), 7), t="  ") == ""


def test_grown_cues_and_script_files(spark):
    cues = spark.createDataFrame([(1, 0, 0, 100, "Hi {there}\n\n you", "A,b"), (1, 1, 500, 600, "x", None)], "job_id long, cue_id int, start_ms long, end_ms long, text string, who string")
    assert {r.cue_id: r.end_ms for r in C.grown(cues).collect()} == {0: 499, 1: 1200}
    text = C.ass(cues, "who", "T").first().ass
    assert text.startswith("[Script Info]\nTitle: T\n") and text.endswith("\n")
    assert text.splitlines()[-2:] == [r"Dialogue: 0,0:00:00.00,0:00:00.10,Default,A b,0,0,0,,Hi \{there\}\Nyou", "Dialogue: 0,0:00:00.50,0:00:00.60,Default,,0,0,0,,x"]


def test_transcript(spark):
    cues = spark.createDataFrame([(1, 0, 0, 900, "Good\nmorning", "A"), (1, 1, 1000, 1900, "all.", "A"), (1, 2, 3661000, 3662000, "Yes", "B")], "job_id long, cue_id int, start_ms long, end_ms long, text string, who string")
    assert C.transcript(C.speaker_runs(cues, "who", 1750), "who").first().txt == "[00:00:00] A: Good morning all.\n\n[01:01:01] B: Yes"


def test_grouped_within_budget(spark):
    from cuelattice.operators import budget as B

    s = spark.createDataFrame([(1, 0, 1000), (1, 1500, 2500), (1, 2600, 4000), (1, 9000, 9500), (2, 0, 9000)], "job_id long, start_ms long, end_ms long")
    got = sorted(tuple(r) for r in B.grouped(s, 2000, 3000).collect())
    assert got == [(1, 0, 0, 0, 2500, 2), (1, 0, 1, 2600, 4000, 1), (1, 1, 0, 9000, 9500, 1), (2, 0, 0, 0, 9000, 1)]


def test_calibration_raises_a_telling_weight(spark):
    from cuelattice.operators import budget as B

    df = spark.createDataFrame([(1, 1)] * 60 + [(0, 0)] * 60, "music int, label int")
    got = {r.feature: r.weight for r in B.calibrated(df, ["music"], "label", [0.7], -3.2).collect()}
    assert got["music"] > 0.7


def test_aligned_with_own_positions(spark):
    """What was heard has its own positions: dropped, extra and changed words, a repeated one, and an engine without a match."""
    ref = "the quick brown fox jumps over the lazy dog and then it sleeps for a long long while".split()
    a = "the quick brown fox uh jumps over the crazy dog and it sleeps for a long long while".split()
    ref_rows = spark.createDataFrame([(1, i, w) for i, w in enumerate(ref)], "job_id long, idx long, norm string")
    heard = spark.createDataFrame([(1, "a", i, w) for i, w in enumerate(a)] + [(1, "b", 0, "nothing"), (1, "b", 1, "alike")], "job_id long, engine string, pos long, norm string")
    got = {(r.engine, r.idx): (r.pos, r.same) for r in A.aligned(ref_rows, heard).collect()}
    assert all(e == "a" for e, _ in got)
    want = {0: 0, 1: 1, 2: 2, 3: 3, 4: 5, 5: 6, 6: 7, 8: 9, 9: 10} | {i: i for i in range(11, 18)}
    assert {i: p for (_, i), (p, same) in got.items() if same} == want
    assert got["a", 7] == (8, False) and ("a", 10) not in got


def test_edit_costs_of_long_lists(spark):
    df = spark.createDataFrame([([f"a{i}" for i in range(5000)], [f"b{i}" for i in range(5000)])], "x array<string>, y array<string>")
    assert df.select(A.errors("x", "y").alias("c")).first().c == 5000 * A.SUBSTITUTION
    words = [f"w{i}" for i in range(50000)]
    far = spark.createDataFrame([(words, [*words[:43519], "x", *words[43521:]])], "x array<string>, y array<string>")
    assert far.select(A.distance(F.col("x"), F.col("y")).alias("d")).first().d == 2


def test_signals(spark):
    clip = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.1, 0.9, 0.9, 0.9, 0.2, -0.9, 0.9, 0.3])] + [(2, i, 0.2) for i in range(5)], "k long, at long, x double")
    assert {r.k: (r.n, r.clipped) for r in S.clipped(clip, ["k"]).collect()} == {1: (8, 3), 2: (5, 0)}
    frames = spark.createDataFrame([(1, i, p) for i, p in enumerate([9, 1, 5, 7])] + [(2, 0, 3), (2, 1, 8)], "job_id long, frame long, p long")
    assert sorted((r.job_id, r.frame, r.smooth) for r in S.running_median(frames, 1).collect()) == [(1, 0, 9.0), (1, 1, 5.0), (1, 2, 5.0), (1, 3, 7.0), (2, 0, 3.0), (2, 1, 8.0)]
    t = np.arange(512) / 16000
    waves = spark.createDataFrame([(1, np.sin(2 * np.pi * 6000 * t).tolist()), (2, np.sin(2 * np.pi * 500 * t).tolist()), (3, [0.0] * 512)], "k long, frame array<double>")
    share = {r.k: r.share for r in S.high_share(waves, "k").collect()}
    assert share[1] > 0.99 and share[2] < 0.01 and share[3] is None
    rng = np.random.default_rng(1)
    rows = [(1, float(x)) for x in rng.normal(0, 1, 4000)] + [(2, 0.0)] * 9 + [(3, float(x)) for x in rng.gamma(0.4, 1, 4000)]
    snr = {r.k: r.snr_db for r in S.blind_snr(spark.createDataFrame(rows, "k long, x double"), ["k"]).collect()}
    assert snr[1] < 0 and snr[2] is None and snr[3] > 40  # noise, silence, clean speech amplitudes


def test_edit_log_upsert_and_textgrid(spark, tmp_path):
    edits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "job_id long, cue long, text string")
    files.append_edits(edits, f"file://{tmp_path}/log")
    files.append_edits(edits.limit(1).withColumn("text", F.lit("c")), f"file://{tmp_path}/log")
    assert sorted(r.text for r in files.read_edits(spark, f"file://{tmp_path}/log", "job_id long, cue long, text string").collect()) == ["a", "b", "c"]
    store = spark.createDataFrame([(1, 1, "old"), (2, 1, "kept")], "id long, at long, v string")
    assert sorted((r.id, r.v) for r in files.upserted(store, spark.createDataFrame([(1, 2, "new"), (3, 0, "x")], store.schema), ["id"], ["at"]).collect()) == [(1, "new"), (2, "kept"), (3, "x")]
    grid = 'item [1]:\n name = "words"\n intervals [1]:\n xmin = 0\n xmax = 0.5\n text = "hi"\n intervals [2]:\n xmin = 0.5\n xmax = 0.75\n text = "<eps>"\n intervals [3]:\n xmin = 0.75 \n xmax = 1.25 \n text = "say ""x""" \nitem [2]:\n name = "phones"\n intervals [1]:\n xmin = 0\n xmax = 9\n text = "no"'
    got = files.from_textgrid(spark.createDataFrame([(1, grid)], "job_id long, grid string")).collect()
    assert [(r.n, r.start_ms, r.end_ms, r.word) for r in got] == [(0, 0, 500, "hi"), (2, 750, 1250, 'say "x"')]
    keys = spark.createDataFrame([("a", "b"), ("ab", ""), ("a", "b")], "x string, y string").select(files.settings_key(F.col("x"), F.col("y")).alias("k")).collect()
    assert keys[0] == keys[2] != keys[1]


def test_cues_without_speaker_or_text(spark):
    cues = spark.createDataFrame([(1, 1, 0, 900, "A & B", "Hi\n \n there "), (1, 2, 1000, 1900, None, "who?"), (1, 3, 2000, 2900, "B", None)], "job_id long, cue_id int, start_ms long, end_ms long, who string, text string")
    assert C.vtt(cues, "who").first().vtt == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:00.900\n<v A &amp; B>Hi\nthere\n\n2\n00:00:01.000 --> 00:00:01.900\nwho?\n\n3\n00:00:02.000 --> 00:00:02.900\n"
    assert C.srt(cues).first().srt.count(" --> ") == 3
    assert C.transcript(C.speaker_runs(cues, "who", 1750), "who").first().txt == "[00:00:00] A & B: Hi    there \n\n[00:00:01] who?\n\n[00:00:02] B: "
    T.register_sql(spark)
    r = spark.sql("SELECT cl_timecode_ms('nonsense') a, cl_timecode_ms(NULL) b, cl_timecode_ms('01:02:03.004') c, cl_timecode(3723004) d, cl_strip_tags('[x] a  [y]b') e").first()
    assert tuple(r) == (0, 0, 3723004, "01:02:03,004", "a b")


def test_tags(spark):
    rows = spark.createDataFrame([("[music]",), ("[?]",), ("[inaudible 00:01:02]",), ("[]",)], "t string")
    assert [r[0] for r in rows.select(T.sound_tag(F.col("t"))).collect()] == [True, False, False, False]
    assert [r[0] for r in rows.select(T.keepable_tags(F.col("t"))).collect()] == [True, True, True, False]


def test_capitals_letter_by_letter(spark):
    import duckdb

    texts = ["erß", "Äßk", "ﬁx", "ŉa", "ᾳΐ", "ıǆǳ", "abc", "", "naïve straße"]
    got = [r.u for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.upper(F.col("t")).alias("u")).collect()]
    assert got == [duckdb.execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts] and got[0] == "ERẞ"
