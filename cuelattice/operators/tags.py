"""Sound tags: which detected event a tag stands for, and where it is shown beside speech."""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.operators import intervals as I

# Tags as editors write them, and the class of sound that detectors name.
SOUNDS = {
    "laughs": "Laughter", "laughter": "Laughter", "chuckles": "Chuckling", "giggles": "Laughter", "cries": "Crying, sobbing", "crying": "Crying, sobbing", "weeps": "Crying, sobbing",
    "whimpering": "Whimper", "whimpers": "Whimper", "sobbing": "Crying, sobbing", "groans": "Groan", "grunts": "Grunt", "screaming": "Screaming", "screams": "Screaming", "shouts": "Shout",
    "yelling": "Yell", "gasps": "Gasp", "sighs": "Sigh", "yawns": "Yawn", "coughs": "Cough", "chokes": "Choke", "hiccup": "Hiccup", "snores": "Snoring", "snoring": "Snoring", "gulps": "Gulp",
    "breathing": "Breathing", "vomits": "Vomiting", "music": "Music", "eerie music": "Music", "dissonant music": "Music", "background music": "Music", "singing": "Singing", "sings": "Singing",
    "cheering": "Cheering", "applause": "Applause", "background chatter": "Chatter", "wind": "Wind", "wind blows": "Wind", "thunder": "Thunder", "thunderstorm": "Thunderstorm", "rain": "Rain",
    "raining": "Rain", "rain pours": "Rain", "heartbeat": "Heartbeat", "beeping": "Beep, bleep", "scanner whirring": "Electronic music", "explosion": "Explosion", "crashing sound": "Crash",
    "banging": "Banging", "stairs creaking": "Creak", "snip sound": "Scissors", "horses neighing": "Horse", "dog barks": "Dog", "cat meowing": "Cat", "sheep bleating": "Bleat",
    "crows scatter": "Crow", "birds chirping": "Bird", "phone ringing": "Telephone ringing", "bell": "Bell", "bell ringing": "Bell", "bell tolls": "Bell", "bell tolling": "Bell",
    "door knock": "Knock", "door squeaking": "Squeak", "car door opens": "Car door", "motorcycle engine": "Motorcycle", "scooter engine": "Motorcycle", "car engine": "Vehicle",
    "car brakes": "Skidding", "tires screeching": "Skidding", "car screeching": "Skidding", "helicopter": "Helicopter", "helicopter whumping": "Helicopter", "train horn": "Train horn",
}
# Space between a tag and dialogue, least pause for a tag of its own, how long the last one stays, how long any may, space between cues.
BUFFER_MS, OWN_MS, LAST_MS, MOST_MS, GAP_MS = 50, 500, 2000, 7000, 1


def matched_events(tags: list[str], events: list[tuple[str, int]], sounds: dict[str, str]) -> list[int | None]:
    """For each tag of one job, in order, the number of the event that it stands for. Events wait in queues by their name and by every editor's word for it; a tag takes the
    first of the first queue, by name, that its own text, one of its words, or a word with or without a final s names."""
    words = defaultdict(list)
    for word, name in sounds.items():
        words[name.lower()].append(word)
    queues: dict[str, deque[int]] = defaultdict(deque)
    for name, number in events:
        for key in (name.lower(), *words[name.lower()]):
            queues[key].append(number)
    out: list[int | None] = []
    for tag in tags:
        text = tag.strip().lower()
        names = {text}.union(*({w, w.rstrip("s"), w + "s"} for w in re.split(r"[-\s]", text)))
        out.append(next((queues[n].popleft() for n in sorted(names) if queues.get(n)), None))
    return out


def matched(tags: DataFrame, events: DataFrame, sounds: dict[str, str] = SOUNDS) -> DataFrame:
    """(job_id, tag_id, tag, event_id, start_ms, end_ms): tags of transcripts and the detected events that they stand for; null without one. tags: job_id, tag_id (in order of
    the text), tag; events: job_id, event_id, label, start_ms, end_ms.

    What one tag takes the next ones cannot have, so a job's tags and events are one row; a recording has few of either."""
    t = tags.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("tag_id", "tag"))).alias("tags"))
    e = events.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("start_ms", "event_id", "label"))).alias("events"))
    rows = t.join(e, "job_id", "left").select("job_id", "tags", F.coalesce("events", F.array().cast(e.schema["events"].dataType)).alias("events"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [matched_events([x["tag"] for x in own], [(x["label"], x["event_id"]) for x in ev], sounds) for own, ev in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], ["job_id", "tags", "found"])

    done = rows.mapInArrow(run, f"job_id long, tags {rows.schema['tags'].dataType.simpleString()}, found array<bigint>")
    one = done.select("job_id", F.explode(F.arrays_zip("tags", "found")).alias("x")).select("job_id", "x.tags.tag_id", "x.tags.tag", F.col("x.found").alias("event_id"))
    return one.join(events.select("job_id", F.col("event_id").cast("long").alias("event_id"), "start_ms", "end_ms"), ["job_id", "event_id"], "left").select("job_id", "tag_id", "tag", "event_id", "start_ms", "end_ms")


def beside_dialogue(tags: DataFrame, dialogue: DataFrame, bucket_ms: int = 10000) -> DataFrame:
    """tags (job_id, tag_id, tag, start_ms, end_ms) moved out of dialogue: one that reaches into a cue ends before it, one that a cue reaches into begins after it; one that lies
    within a cue stays. One that would vanish keeps its length beside the cue. dialogue: job_id, start_ms, end_ms.

    Cues meet a tag in time buckets; those that it overlaps, in order, are a fold (a tag only shrinks, so no others matter)."""
    near = I.interval_join(tags, dialogue, bucket_ms).groupBy("l.tag_id").agg(F.sort_array(F.collect_list(F.struct("r.start_ms", "r.end_ms"))).alias("cues"))
    t = tags.join(near, "tag_id", "left")
    start, end = F.col("start_ms").cast("long"), F.col("end_ms").cast("long")

    def step(acc: Column, c: Column) -> Column:
        until = F.when((acc["s"] < c["start_ms"]) & (acc["e"] > c["start_ms"]), c["start_ms"] - BUFFER_MS).otherwise(acc["e"])
        since = F.when((acc["s"] < c["end_ms"]) & (until > c["end_ms"]), c["end_ms"] + BUFFER_MS).otherwise(acc["s"])
        return F.struct(since.cast("long").alias("s"), until.cast("long").alias("e"))

    cues = F.coalesce("cues", F.array().cast(near.schema["cues"].dataType))
    own = F.exists(cues, lambda c: (c["start_ms"] <= start) & (c["end_ms"] >= end))
    t = t.withColumn("m", F.when(own, F.struct(start.alias("s"), end.alias("e"))).otherwise(F.aggregate(cues, F.struct(start.alias("s"), end.alias("e")), step)))
    gone, cut = F.col("m.e") <= F.col("m.s"), F.col("m.e") != end
    s = F.when(gone & cut, F.greatest(F.lit(0), F.col("m.e") - (end - start))).otherwise(F.col("m.s"))
    e = F.when(gone & ~cut & (F.col("m.s") != start), F.col("m.s") + (end - start)).otherwise(F.col("m.e"))
    return t.select("job_id", "tag_id", "tag", s.alias("start_ms"), e.alias("end_ms"))


def placed(cues: DataFrame, cpl: int = 42, lines: int = 2) -> DataFrame:
    """(job_id, place, text, start_ms, end_ms, is_tag): transcripts' tags with times. cues: job_id, place, text, start_ms, end_ms (of speech; null for tags), is_tag.

    Tags between the same two cues share the pause: from half a second on it is theirs, in turns if each gets half a second (the last ones of a job stay two seconds). In a
    shorter pause they go to the cue before or, where that is full, after: on its line, or on a line of their own. If neither has room they are shown for what time
    there is. A cue takes tags from both sides only if both still fit."""
    w = W.partitionBy("job_id").orderBy("place")
    ahead = W.partitionBy("job_id").orderBy(F.desc("place"))
    speech = F.struct("place", "text", "start_ms", "end_ms")
    c = cues.withColumn("before", F.last(F.when(~F.col("is_tag"), speech), ignorenulls=True).over(w)).withColumn("after", F.last(F.when(~F.col("is_tag"), speech), ignorenulls=True).over(ahead))
    group = ["job_id", "before", "after"]
    g = c.where("is_tag").groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("tags"))
    lo = F.coalesce(F.col("before.end_ms") + GAP_MS, F.lit(0))
    hi = F.coalesce(F.col("after.start_ms") - GAP_MS, lo + LAST_MS)
    n, joined = F.size("tags"), F.array_join(F.transform("tags", lambda t: t["text"]), " ")
    g = g.select(*group, "tags", n.alias("n"), joined.alias("joined"), lo.alias("lo"), hi.alias("hi"), F.least(hi, lo + MOST_MS).alias("until"))
    own = g.where(F.col("hi") - F.col("lo") >= OWN_MS)
    length = F.col("until") - F.col("lo")
    turns = (F.col("n") > 1) & (F.floor(length / F.col("n")) >= OWN_MS)
    step = F.floor((length + GAP_MS) / F.col("n"))
    show = lambda place, text, a, b: F.struct(place.alias("place"), text.alias("text"), a.cast("long").alias("start_ms"), b.cast("long").alias("end_ms"))
    each = F.transform("tags", lambda t, k: show(t["place"], t["text"], F.col("lo") + k * step, F.when(k == F.col("n") - 1, F.col("until")).otherwise(F.col("lo") + (k + 1) * step - GAP_MS)))
    first = F.get("tags", F.lit(0))["place"]
    alone = own.select("job_id", F.explode(F.when(turns, each).otherwise(F.array(show(first, F.col("joined"), F.col("lo"), F.col("until"))))).alias("x")).select("job_id", "x.*", F.lit(True).alias("is_tag"))
    # Short pauses: the cue before takes the tag if it has room, else the one after.
    fits = lambda text: (F.length(text) + 1 + F.length("joined") <= cpl) | ((F.lit(lines) >= 2) & (F.length(text) <= cpl) & (F.length("joined") <= cpl))
    short = g.where(F.col("hi") - F.col("lo") < OWN_MS)
    to_before, to_after = F.coalesce(fits(F.col("before.text")), F.lit(False)), F.coalesce(fits(F.col("after.text")), F.lit(False))
    short = short.withColumn("side", F.when(to_before, "before").when(to_after, "after"))
    given = lambda side: short.where(F.col("side") == side).select("job_id", F.col(f"{side}.place").alias("place"), F.col("joined").alias(f"tag_{side}"))
    own_cues = cues.where("NOT is_tag").join(given("before"), ["job_id", "place"], "left").join(given("after"), ["job_id", "place"], "left")
    line = lambda a, b: F.when(F.length(a) + 1 + F.length(b) <= cpl, F.concat(a, F.lit(" "), b)).otherwise(F.concat(a, F.lit("\n"), b))
    with_before = F.when(F.col("tag_before").isNotNull(), line(F.col("text"), F.col("tag_before"))).otherwise(F.col("text"))
    room = F.col("tag_after").isNotNull() & (F.col("tag_before").isNull() | (F.length("tag_after") + 1 + F.length("text") + 1 + F.length("tag_before") <= cpl))
    text = F.when(room, line(F.col("tag_after"), with_before)).otherwise(with_before)
    told = own_cues.select("job_id", "place", text.alias("text"), "start_ms", "end_ms", F.lit(False).alias("is_tag"), (F.col("tag_after").isNotNull() & ~room).alias("refused"))
    back = told.where("refused").select("job_id", F.col("place").alias("refused"))
    squeezed = lambda df: df.select("job_id", F.get("tags", F.lit(0))["place"].alias("place"), F.col("joined").alias("text"), F.col("lo").cast("long").alias("start_ms"), F.greatest(F.col("lo") + 1, F.col("hi")).cast("long").alias("end_ms"), F.lit(True).alias("is_tag"))
    left = squeezed(short.where("side IS NULL")).unionByName(squeezed(short.where("side = 'after'").withColumn("refused", F.col("after.place")).join(back, ["job_id", "refused"])))
    shown = told.drop("refused").select("job_id", "place", "text", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "is_tag")
    return shown.unionByName(alone).unionByName(left)
