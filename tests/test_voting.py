"""Word errors of repetitive text, and voting without a transcript."""

import random

from pyspark.sql import functions as F

from cuelattice.operators import align as A
from cuelattice.operators import voting as V
from cuelattice.plans import vote_queries as Q

PRIORS = {"cohere": 1000, "qwen": 950, "parakeet": 850, "whisperx": 800}
SAID = "u int, engine string, words array<struct<norm:string,word:string,start_ms:long,end_ms:long>>"


def said(text, start=None):
    return [(w.lower().strip(".,"), w, None if start is None else start + 500 * i, None if start is None else start + 500 * i + 400) for i, w in enumerate(text.split())]


def vote(spark, **hyps):
    df = spark.createDataFrame([(1, e, None if w is None else w) for e, w in hyps.items()], SAID)
    net = V.network(df, ["u"], PRIORS)
    return net, sorted(V.decided(net, ["u"], PRIORS, ["qwen", "parakeet"]).collect(), key=lambda r: r.slot)


def test_unanimous_words_keep_the_first_engines_spelling(spark):
    _, out = vote(spark, cohere=said("The quick brown fox."), qwen=said("the quick brown fox"), parakeet=said("The quick brown fox"))
    assert [r.word for r in out] == ["The", "quick", "brown", "fox."] and {r.agreement for r in out} == {1000}


def test_an_engine_without_times_can_correct(spark):
    _, out = vote(spark, cohere=said("we sailed to the island"), parakeet=said("we sailed to the island", 0), qwen=said("we sale to the island", 0))
    assert [r.word for r in out] == "we sailed to the island".split()
    assert out[1].agreement < 1000 and out[1].alternatives == "sale:339" and out[1].start_ms == 500 and out[1].voters == "cohere,parakeet"


def test_silence_is_a_candidate(spark):
    _, out = vote(spark, cohere=said("thanks for coming"), qwen=said("thanks for coming"), whisperx=said("thanks for coming thank you"))
    assert [r.word for r in out] == ["thanks", "for", "coming"]
    assert vote(spark, cohere=[], qwen=[], whisperx=said("thank you"))[1] == []
    _, out = vote(spark, cohere=said("hello world"), qwen=None)
    assert [r.word for r in out] == ["hello", "world"] and {r.agreement for r in out} == {1000}
    assert vote(spark, cohere=[])[1] == []


def test_slots_of_an_insertion(spark):
    net, _ = vote(spark, cohere=said("a b c"), qwen=said("a x b c"))
    first = net.first()
    assert first.placed == ["cohere", "qwen"] and len(first.slots) == 4
    got = {(r.slot, r.engine): r.token for r in V.tokens(net, ["u"]).collect()}
    assert got[1, "cohere"] is None and got[1, "qwen"] == "x" and got[2, "cohere"] == got[2, "qwen"] == "b"


def test_similar_words_share_a_slot(spark):
    df = spark.createDataFrame([(["we", "sailed", "home"], ["we", "oh", "sailes", "home"])], "a array<string>, b array<string>")
    p = A.with_pairs(df, "a", "b", "p", A.similarity_cost, A.LONE).first().p
    assert [(x.a, x.b) for x in p] == [(0, 0), (None, 1), (1, 2), (2, 3)]
    cost = spark.createDataFrame([("abc", "abd"), ("a", "a"), ("", "x"), ("ab", "xy"), ("é", "e")], "a string, b string").select(A.similarity_cost(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in cost] == [667, 0, 1000, 1000, 1000]


def table(x, y):
    """Rows of the plain cost table."""
    row = list(range(len(y) + 1))
    for i, v in enumerate(x, 1):
        old, row = row, [i]
        for j, w in enumerate(y, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (v != w)))
    return row[-1]


def test_distance_equals_the_plain_table(spark):
    rng = random.Random(5)
    for _ in range(400):
        x, y = ([rng.choice("abcdefgh"[: rng.choice([1, 2, 8])]) for _ in range(rng.randrange(70))] for _ in range(2))
        assert A.words_apart(x, y) == table(x, y)


def test_repetitive_text_that_is_heard_perfectly_has_no_errors(spark):
    text = "one two three four five six seven eight nine ten".split() * 40
    ref = spark.createDataFrame([(1, i, w) for i, w in enumerate(text)], "job_id long, idx long, norm string")
    less = text[:203] + text[204:]
    rows = [(1, e, i, w) for e, ws in (("a", text), ("b", less), ("c", ["x", *text])) for i, w in enumerate(ws)]
    heard = spark.createDataFrame(rows, "job_id long, engine string, pos long, norm string")
    assert {r.engine: r.errors for r in Q.blockwise_errors(ref, heard).collect()} == {"a": 0, "b": 1, "c": 1}
    same = {r.engine: r["count"] for r in A.aligned(ref, heard).where("same").groupBy("engine").count().collect()}
    assert same == {"a": 400, "b": 399, "c": 400}


def test_blocks_never_have_fewer_errors_than_the_whole(spark):
    rng = random.Random(9)
    ref, heard, least = [], [], {}
    for job in range(12):
        x = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 90))]
        y = [w if rng.random() > 0.1 else rng.choice("xyzab") for w in x if rng.random() > 0.1]
        ref += [(job, i, w) for i, w in enumerate(x)]
        heard += [(job, "a", i, w) for i, w in enumerate(y)]
        if y:
            least[job] = table(x, y)
    got = Q.blockwise_errors(spark.createDataFrame(ref, "job_id long, idx long, norm string"), spark.createDataFrame(heard, "job_id long, engine string, pos long, norm string")).collect()
    assert {r.job_id for r in got} == set(least)
    assert all(least[r.job_id] <= r.errors for r in got)
    assert sum(r.errors for r in got) <= 1.3 * sum(least.values())


def test_similar_pairs_equal_those_of_the_whole_table(spark):
    """Of equal costs the same path is chosen, also where words have accents or none at all and lists are far apart."""
    rng = random.Random(21)
    words = ["", "a", "ab", "abc", "abd", "xyz", "été", "ete", "sailed", "sailes", "sale", "island"]
    near = lambda x: [v for w in x for v in rng.choice([[w]] * 5 + [[], [w, "uh"], [w[::-1]]])]
    lists = [[rng.choice(words) for _ in range(rng.randrange(25))] for _ in range(200)]
    rows = [(i, x, near(x) if i % 3 else lists[-1 - i]) for i, x in enumerate(lists)]
    df = spark.createDataFrame([*rows, (1000, None, ["a"]), (1001, [], None)], "i int, a array<string>, b array<string>")
    # Another function of the same values takes the whole table.
    whole = A.with_pairs(df, "a", "b", "p", lambda v, w: A.similarity_cost(v, w), A.LONE)
    assert sorted(map(str, A.with_pairs(df, "a", "b", "p", A.similarity_cost, A.LONE).collect())) == sorted(map(str, whole.collect()))


def test_most_cells_of_similar_lists_are_not_compared():
    similar = A.Similar()
    x = [f"word{i}x" for i in range(300)]
    assert [p[:2] for p in similar.path(x, x[:100] + ["uh"] + x[100:200] + x[201:])][100:102] == [(None, 100), (100, 101)]
    assert len(similar.costs) < 3000


def test_votes_side_by_side_equal_the_votes_of_rows(spark):
    rng = random.Random(4)
    rows = [(i, *[rng.choice([None, "x", "y", "z"]) for _ in range(3)], rng.random() > 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "idx long, a string, b string, c string, there boolean").withColumn("job_id", F.lit(1).cast("long"))
    for weights in ({"a": 1000, "b": 950, "c": 400}, {"a": 1, "b": 1, "c": 1}, {"a": 1, "b": 1, "c": 2}):
        side = V.voted(df, ["job_id", "idx"], [(e, F.lit(w).cast("long"), F.col(e), F.col("there") if e == "c" else F.lit(True)) for e, w in weights.items()])
        slots = [(1, i, e, w, t) for i, a, b, c, there in rows for (e, w), t in zip(weights.items(), (a, b, c), strict=True) if e != "c" or there]
        plain = Q.votes(spark.createDataFrame(slots, "job_id long, idx long, engine string, w long, token string"))
        assert sorted(map(str, side.collect())) == sorted(map(str, plain.select(side.columns).collect()))
