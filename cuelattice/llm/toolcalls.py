"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Calls and results meet in a hash join by conversation and identifier. A call may name any number of calls whose results it uses; its depth
is the longest chain of calls before it. Along calls that name one other, pointer doubling leads to the nearest call above that names none or
several, so a chain of n calls takes log2(n) rounds of joins; what is left are edges between those, and each further round settles the calls all of
whose own are settled. No conversation is gathered in one place. Ordered by (depth, turn), every call follows what it uses. Arguments are
checked against the tool's schema, and each call with its result becomes one line of canonical JSON: keys sorted, no
blanks, no escapes but the necessary ones.

status: ok, unanswered, unknown_tool, invalid (arguments against the schema), cycle (it uses itself, or what does), unnamed (call without
identifier), orphan (result without call); the first that applies from the right end of this list.

Defined cases: of calls with the same identifier in a conversation the one of the earliest turn counts, ties to the smaller content, `copies` says
how many there were; likewise of results; identifiers of different conversations, also of none (null), have nothing to do with each other; a result
without identifier is an orphan by itself; arguments that are null, broken JSON (also NaN and numbers out of range) or nested too deep to read are
invalid, and shown as null; lone surrogates stay escaped; a named call that does not exist is no predecessor, and one named twice counts once; very
long values are read whole; other columns, whatever their names, are ignored; empty tables give no rows.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.shared import bound_batches, dropped, written

Schema = dict[str, dict[str, Any]]
#: tool -> field -> type, whether required, bounds; no other fields may come.
SCHEMAS: dict[str, Schema] = {
    "search": {"query": {"type": "string", "required": True, "min": 1}, "limit": {"type": "integer", "min": 1, "max": 200}},
    "translate": {"query": {"type": "string", "required": True}, "limit": {"type": "integer"}},
}
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def fits(value: Any, schema: Schema) -> bool:
    if not isinstance(value, dict) or any(k not in schema for k in value):
        return False
    for name, rule in schema.items():
        if name not in value:
            if rule.get("required"):
                return False
            continue
        v = value[name]
        if not isinstance(v, _KINDS[rule["type"]]) or (isinstance(v, bool) and rule["type"] in ("integer", "number")):
            return False
        size = len(v) if isinstance(v, (str, list, dict)) else v
        if not rule.get("min", -math.inf) <= size <= rule.get("max", math.inf):
            return False
    return True


def _no_number(text: str) -> float:
    raise ValueError(text)


def _number(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _no_number(text)


def parsed(arguments: str | None) -> Any:
    """The value of a JSON text, None if it has none."""
    try:
        return json.loads(arguments, parse_constant=_no_number, parse_float=_number) if arguments is not None else None
    except (ValueError, RecursionError):
        return None


_LONE = re.compile("[\ud800-\udfff]").sub


def canonical(value: Any) -> str:
    return _LONE(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def message_of(name: str | None, tool: str | None, value: Any, content: str | None) -> tuple[Any, str]:
    """The arguments and the line; without arguments if they are nested too deep to write."""
    line = lambda v: canonical({"arguments": v, "call": name, "result": content, "tool": tool})
    try:
        return value, line(value)
    except RecursionError:
        return None, line(None)


def _depths(calls: DataFrame) -> DataFrame:
    """(conv, call, depth), depth null where it has no end. calls: conv, call (unique together), after (array of names)."""
    spark = calls.sparkSession
    key = ["conv", "call"]
    nodes = calls.select(*key)
    named = calls.select(*key, F.explode(F.array_distinct("after")).alias("up")).where("up IS NOT NULL")
    edges, edges_at = written(named.join(nodes.select("conv", F.col("call").alias("up")).hint("merge"), ["conv", "up"], "left_semi"), "edges")
    ups = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("up").alias("up"))
    # top: the nearest call above (or itself) that names none or several; steps to it. Null top: a cycle of single names.
    state, at = written(nodes.join(ups.hint("merge"), key, "left").select(*key, F.when(F.col("n") == 1, F.col("up")).alias("up"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("steps"), (F.coalesce("n", F.lit(0)) != 1).alias("done")), "tops")
    state = state.select(*key, F.coalesce("up", "call").alias("top"), "steps", "done")
    for _ in range(math.ceil(math.log2(max(2, state.count()))) + 1):
        if state.where("NOT done").isEmpty():
            break
        above = state.select("conv", F.col("call").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        on = state.where("NOT done").join(above.hint("merge"), ["conv", "top"]).select(*key, F.col("next").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"))
        before = at
        state, at = written(state.where("done").unionByName(on), "tops")
        dropped(spark, before)
    tops = state.select(*key, F.when(F.col("done"), F.col("top")).alias("top"), "steps")
    # Edges between calls that name several and the tops of those; a call that names none has depth 0.
    several = edges.groupBy(*key).count().where("count > 1").select(*key)
    links = edges.join(several.hint("merge"), key, "left_semi").join(tops.select("conv", F.col("call").alias("up"), "top", "steps").hint("merge"), ["conv", "up"])
    links, links_at = written(links.select(*key, "top", (F.col("steps") + 1).alias("steps")), "links")
    settled, settled_at = written(nodes.join(edges.select(*key).hint("merge"), key, "left_anti").withColumn("depth", F.lit(0).cast("long")), "settled")
    while not links.isEmpty():
        of_top = settled.select("conv", F.col("call").alias("top"), "depth")
        found = links.join(of_top.hint("merge"), ["conv", "top"], "left").groupBy(*key).agg(F.count_if(F.col("depth").isNull()).alias("open"), F.max(F.col("depth") + F.col("steps")).alias("depth")).where("open = 0")
        found, found_at = written(found.select(*key, "depth"), "found")
        if found.isEmpty():
            break
        before = [settled_at, links_at]
        settled, settled_at = written(settled.unionByName(found), "settled")
        links, links_at = written(links.join(found.select(*key).hint("merge"), key, "left_anti"), "links")
        dropped(spark, found_at, *before)
    depth = settled.select("conv", F.col("call").alias("top"), "depth")
    out, _ = written(tops.join(depth.hint("merge"), ["conv", "top"], "left").select(*key, (F.col("depth") + F.col("steps")).alias("depth")), "depths")
    dropped(spark, edges_at, at, links_at, settled_at)
    return out


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema] = SCHEMAS) -> DataFrame:
    """conv_id, turn, call_id, depth, copies, status, message of every call and orphan result.
    calls: conv_id, turn, call_id, tool, arguments (JSON), after (array of call_ids, or null). results: conv_id, turn, call_id, content."""
    bound_batches(calls.sparkSession)
    # Identifiers are compared within a conversation; no conversation is one, too.
    conv = F.to_json(F.struct("conv_id")).alias("conv")
    key = ["conv", "call"]
    named = calls.where("call_id IS NOT NULL").groupBy(conv, F.col("call_id").alias("call")).agg(F.min(F.struct("turn", "conv_id", "tool", "arguments", "after")).alias("c"), F.count("*").alias("copies"))
    named, _ = written(named.select(*key, "c.*", "copies"), "calls")
    depths = _depths(named.select(*key, "after"))
    answers = results.where("call_id IS NOT NULL").groupBy(conv, F.col("call_id").alias("call")).agg(F.min(F.struct("turn", "conv_id", "content")).alias("r"), F.count("*").alias("answers"))
    text, number = F.lit(None).cast("string"), lambda x: F.lit(x).cast("long")
    both = named.join(depths, key).join(answers.hint("shuffle_hash"), key, "left").select("conv_id", "turn", F.col("call").alias("call_id"), "tool", "arguments", "depth", "copies", F.col("r").isNotNull().alias("answered"), F.col("r.content").alias("content"))
    unnamed = calls.where("call_id IS NULL").select("conv_id", "turn", "call_id", "tool", "arguments", number(0).alias("depth"), number(1).alias("copies"), F.lit(False).alias("answered"), text.alias("content"))
    alone = lambda df, copies: df.select("conv_id", "turn", "call_id", text.alias("tool"), text.alias("arguments"), number(None).alias("depth"), copies.alias("copies"), F.lit(True).alias("answered"), "content")
    orphans = answers.join(named.select(*key).hint("shuffle_hash"), key, "left_anti").select("r.conv_id", "r.turn", F.col("call").alias("call_id"), "r.content", "answers")
    orphans = alone(orphans, F.col("answers")).unionByName(alone(results.where("call_id IS NULL"), number(1)))
    every = both.withColumn("kind", F.lit("call")).unionByName(unnamed.withColumn("kind", F.lit("unnamed"))).unionByName(orphans.withColumn("kind", F.lit("orphan")))

    def run(*cols: pa.Array) -> pa.Array:
        states, lines = [], []
        for kind, name, tool, arguments, depth, answered, content in zip(*(c.to_pylist() for c in cols), strict=True):
            value, line = message_of(name, tool, parsed(arguments), content)
            if kind != "call":
                state = kind
            elif depth is None:
                state = "cycle"
            elif tool not in schemas:
                state = "unknown_tool"
            elif not fits(value, schemas[tool]):
                state = "invalid"
            else:
                state = "ok" if answered else "unanswered"
            states.append(state)
            lines.append(line)
        return pa.StructArray.from_arrays([pa.array(states, pa.string()), pa.array(lines, pa.string())], ["status", "message"])

    done = F.arrow_udf(run, "status string, message string")("kind", "call_id", "tool", "arguments", "depth", "answered", "content")
    return every.select("conv_id", "turn", "call_id", "depth", "copies", done.alias("done")).select("conv_id", "turn", "call_id", "depth", "copies", "done.status", "done.message")


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as calls (user turns; each uses the call two turns earlier) and results (the assistant turns after them)."""
    name = lambda back: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - back).cast("string"))
    tool = F.element_at(F.array(F.lit("search"), F.lit("translate"), F.lit("archive")), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) + 1).cast("int"))
    words = F.regexp_count("text", F.lit(r"[^ \t\n\r\f]+"))
    calls = conversations.where("role = 'user'").select("conv_id", "turn", name(0).alias("call_id"), tool.alias("tool"), F.to_json(F.struct(F.col("text").alias("query"), words.alias("limit"))).alias("arguments"), F.array(name(2)).alias("after"))
    results = conversations.where("role = 'assistant'").select("conv_id", "turn", name(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


SQL = r"""WITH RECURSIVE u AS (SELECT 'c' || conv_id || '_' || turn AS call_id, min(conv_id) AS conv_id, min(turn) AS turn, min(text) AS text, count(*) AS copies FROM conversations WHERE role = 'user' GROUP BY 1),
r AS (SELECT 'c' || conv_id || '_' || (turn - 1) AS call_id, min(conv_id) AS conv_id, min(turn) AS turn, min(text) AS content, count(*) AS copies FROM conversations WHERE role = 'assistant' GROUP BY 1),
d AS (SELECT call_id, conv_id, turn, 0::BIGINT AS depth FROM u WHERE 'c' || conv_id || '_' || (turn - 2) NOT IN (SELECT call_id FROM u)
  UNION ALL SELECT u.call_id, u.conv_id, u.turn, d.depth + 1 FROM u JOIN d ON u.conv_id = d.conv_id AND u.turn = d.turn + 2),
c AS (SELECT u.*, d.depth, r.content, r.call_id IS NOT NULL AS answered, len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS words, ['search', 'translate', 'archive'][((u.conv_id + u.turn) % 3 + 1)::INT] AS tool FROM u JOIN d USING (call_id) LEFT JOIN r USING (call_id))
SELECT conv_id, turn, call_id, depth, copies, CASE WHEN tool = 'archive' THEN 'unknown_tool' WHEN tool = 'search' AND NOT (length(text) >= 1 AND words BETWEEN 1 AND 200) THEN 'invalid' WHEN answered THEN 'ok' ELSE 'unanswered' END AS status,
  '{"arguments":{"limit":' || words || ',"query":' || to_json(text)::VARCHAR || '},"call":"' || call_id || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"tool":"' || tool || '"}' AS message FROM c
UNION ALL SELECT conv_id, turn, call_id, NULL, copies, 'orphan', '{"arguments":null,"call":"' || call_id || '","result":' || to_json(content)::VARCHAR || ',"tool":null}' FROM r WHERE call_id NOT IN (SELECT call_id FROM u)"""
