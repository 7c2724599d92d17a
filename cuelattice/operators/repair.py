"""Moving the border between neighbouring cues to a better word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.functions import breaks as B
from cuelattice.operators import layout as L

# Longest pause in which a border may be moved, a border that is good as it is, what a line break may cost, gain that is asked for, space between cues.
MOST_PAUSE_MS, GOOD_BREAK, CLEAN_BREAK, LEAST_GAIN, GAP_MS = 300, -8, 10, 5, 1
# Reading speeds that are comfortable and the most, what a better break may cost of them, weights of speed and of distance.
TARGET_CPS, MOST_CPS, MORE_CPS, BY_SPEED, BY_DISTANCE = 20.0, 25.0, 3.5, 0.5, 0.2

CUE = "array<struct<token:string,start_ms:bigint,end_ms:bigint>>"


def better_border(tokens: list[dict], n_left: int, start: int, end: int, limits: L.Layout) -> tuple[int, int, int] | None:
    """(tokens on the left, end of the left cue, start of the right one) of the best border of two cues, or None if the present one stays.

    The present border must part words that belong together, without a pause; another one must be cleaner, leave both cues within layout and time, neither of them
    hurried, and pull no other sentence into a cue. tokens: both cues', as layout's kernel describes them."""
    unit = L.Unit(tokens, [], limits)
    n, old = unit.n, unit.points[n_left] if 0 < n_left < unit.n else None
    if old is None or old <= GOOD_BREAK:
        return None
    pause = unit.starts[n_left] - unit.ends[n_left - 1]
    if pause > MOST_PAUSE_MS:
        return None
    fits, lines = unit.layouts()
    closes = unit.points == B.SENTENCE_END
    ends = np.concatenate([[0], np.cumsum(closes)])
    width = lambda a, b: int(unit.before[b] - unit.before[a] - 1)
    inner = lambda a, b: int(ends[b] - ends[a + 1])  # noqa: E731  (borders inside a to b after a sentence)
    clean = lambda a, b: b - a <= fits.shape[1] and fits[a, b - a - 1] and unit.allowed[a, b - a - 1] and lines[a, b - a - 1] < CLEAN_BREAK
    words = np.concatenate([[0], np.cumsum(~unit.tag)])

    def speed(k: int, until: float, since: float) -> float:
        return max(width(0, k) * 1000.0 / max(until - start, 1), width(k, n) * 1000.0 / max(end - since, 1))

    def times(k: int) -> tuple[int, int] | None:
        last, first = [i for i in range(k) if not unit.tag[i] and not np.isnan(unit.ends[i])], [i for i in range(k, n) if not unit.tag[i] and not np.isnan(unit.starts[i])]
        if not last or not first:
            return None
        until = max(unit.ends[last[-1]], unit.starts[first[0]] - GAP_MS)
        return int(until), int(max(unit.starts[first[0]], until + GAP_MS))

    now = times(n_left)
    was = speed(n_left, *now) if now else 0.0
    best = None
    for k in range(1, n):
        points = unit.points[k]
        if k == n_left or not words[k] or words[k] == words[n] or points >= CLEAN_BREAK or points > old - LEAST_GAIN:
            continue
        if inner(0, k) > inner(0, n_left) or inner(k, n) > inner(n_left, n):
            continue
        at = times(k)
        if at is None or min(at[0] - start, end - at[1]) < limits.least_ms or max(at[0] - start, end - at[1]) > limits.most_ms:
            continue
        fast = speed(k, *at)
        if fast > min(MOST_CPS, max(was, TARGET_CPS) + MORE_CPS) or not clean(0, k) or not clean(k, n):
            continue
        found = (points + BY_SPEED * max(0.0, fast - TARGET_CPS) + BY_DISTANCE * abs(k - n_left), k, *at)
        best = found if best is None or found < best else best
    return best[1:] if best else None


def _moved(cues: DataFrame, odd: int, limits: L.Layout) -> DataFrame:
    """One pass over the pairs whose first cue has an even (odd) place: no cue is in two pairs."""
    pair = F.floor((F.col("place") + odd) / 2)
    listed = cues.groupBy("job_id", pair.alias("pair")).agg(F.sort_array(F.collect_list(F.struct("place", "tokens", "start_ms", "end_ms", "speaker", "english"))).alias("c"))
    a, b = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    words = lambda c: F.exists(c["tokens"], lambda t: t["start_ms"].isNotNull())
    # English or not is one answer per job; a border between speakers stays.
    open_ = (F.size("c") == 2) & a["speaker"].eqNullSafe(b["speaker"]) & words(a) & words(b)
    both = F.when(open_, L._described(F.concat(a["tokens"], b["tokens"]), a["english"]))
    told = listed.select("job_id", "c", both.alias("told"), F.size(a["tokens"]).alias("n"), a["start_ms"].alias("s"), b["end_ms"].alias("e"))
    kind = pa.struct([("k", pa.int32()), ("until", pa.int64()), ("since", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, n, s, e in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                found = better_border(t, n, s, e, limits) if t and s is not None and e is not None else None
                out.append(dict(zip(("k", "until", "since"), found, strict=True)) if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["job_id", "c", "m"])

    done = told.mapInArrow(run, f"job_id long, c {listed.schema['c'].dataType.simpleString()}, m struct<k:int,until:bigint,since:bigint>")
    every = F.concat(a["tokens"], b["tokens"])

    def cue(c: Column, tokens: Column, start: Column, end: Column) -> Column:
        return F.struct(c["place"].alias("place"), tokens.alias("tokens"), start.alias("start_ms"), end.alias("end_ms"), c["speaker"].alias("speaker"), c["english"].alias("english"))

    m = F.col("m")
    new = F.array(cue(a, F.slice(every, F.lit(1), m["k"]), a["start_ms"], m["until"]), cue(b, F.slice(every, m["k"] + 1, F.size(every)), m["since"], b["end_ms"]))
    return done.select("job_id", F.explode(F.when(m.isNotNull(), new).otherwise(F.col("c"))).alias("x")).select("job_id", "x.*")


def repaired(cues: DataFrame, limits: L.Layout = L.Layout()) -> DataFrame:
    """cues whose borders part words that belong together, with a cleaner border where both cues still fit and read well; times follow the words.

    cues: job_id, place (0, 1, ... in a job), tokens (array of token, start_ms, end_ms), start_ms, end_ms, speaker, english. Neighbours meet in two passes, pairs that begin
    at even places and then those at odd ones, so that no cue is changed twice at once."""
    return _moved(_moved(cues, 0, limits), 1, limits)
