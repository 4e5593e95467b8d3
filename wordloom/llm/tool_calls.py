"""Chat formatting: tool calls linked to their results.

Turns give calls and results. A turn whose text is a JSON object with `tool_calls`
(a list of {id, name, arguments, depends_on}) gives those calls; one with
`tool_call_id` gives a result, its `content`. Any other turn is plain chat: a user's
turn is a call of the tool `respond` with the argument `prompt`, named by its turn
and depending on the turn of the user before it; an assistant's turn is the result
of the nearest user's turn before it.

Calls and results are hash-joined by conversation and identifier. The calls of a
conversation are put in topological order of their dependencies, ties by turn and
place; arguments are held against the tool's schema; the whole is serialised as
canonical JSON (sorted keys, no spare white space, characters as they are).

Status of a call: `linked`, `unanswered` (no result), `invalid` (arguments break the
schema or are no object), `unknown` (no such tool), `duplicate` (an earlier call of the
conversation has its identifier; it gets no result), `cyclic` (on or behind a circle
of dependencies; such calls follow the others by turn). If several hold, the last
named counts. Dependencies on identifiers that do not exist are left out.

Defined cases: repeated rows count once. Of several results of one call the first by turn,
then text, counts. Results without a call are `orphans`. `linked` has the calls and
what answers them only; `transcribed` has every turn of every conversation beside
them, and counts the orphans. A null conversation is left out; a null role or text is
chat with an empty text; a null turn comes before all others. White space may stand
before a turn's JSON. Arguments that are no JSON, hold NaN or an infinite number, half
a surrogate pair, or nest too deeply stay the string they are. Texts of any length
stay whole. Columns other than conv_id, turn, role and text are not read, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Schemas by tool: type, required, properties (type, enum, minLength, minimum, maximum), additionalProperties.
SCHEMAS = {
    "respond": {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string", "minLength": 1}}, "additionalProperties": False},
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string", "minLength": 1}, "precision": {"type": "integer", "minimum": 0, "maximum": 30}}, "additionalProperties": False},
}
CALL = "array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>"
FORMATTED = "conv_id long, n_calls long, n_linked long, n_invalid long, n_cyclic long, chat string"
TRANSCRIBED = "conv_id long, n_turns long, n_calls long, n_linked long, n_invalid long, n_cyclic long, n_orphans long, chat string"
_KINDS = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parsed(text: str | None):
    """The value of a JSON text that canonical JSON in UTF-8 can hold; else the text."""
    try:
        value = json.loads(text)
        canonical([[[value]]]).encode()
    except (TypeError, ValueError, RecursionError):
        return text
    return value


def valid(value, schema: dict) -> bool:
    kind = schema.get("type")
    if kind and (not isinstance(value, _KINDS[kind]) or kind in ("integer", "number") and isinstance(value, bool)):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return False
    if isinstance(value, (int, float)) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return False
    if isinstance(value, list) and "items" in schema and not all(valid(x, schema["items"]) for x in value):
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())) or not all(valid(v, known[k]) for k, v in value.items() if k in known):
            return False
        return schema.get("additionalProperties", True) or all(k in known for k in value)
    return True


def ordered(calls: list[dict]) -> tuple[list[int], list[int]]:
    """Places of the calls in topological order, ties by place; those that a circle holds back."""
    place: dict[str, int] = {}
    for i, c in enumerate(calls):
        place.setdefault(c["id"], i)
    waits, after = [0] * len(calls), [[] for _ in calls]
    for i, c in enumerate(calls):
        for d in set(c["depends_on"] or ()):
            if d in place:
                after[place[d]].append(i)
                waits[i] += 1
    ready, out = [i for i, n in enumerate(waits) if not n], []
    heapq.heapify(ready)
    while ready:
        i = heapq.heappop(ready)
        out.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, j)
    return out, [i for i, n in enumerate(waits) if n]


def format_conversation(conv_id: int, calls: list[dict], schemas: dict = SCHEMAS) -> tuple[int, int, int, int, str]:
    """(calls, linked, invalid or unknown, cyclic, canonical JSON); calls in the order of turn and place."""
    first, cyclic = ordered(calls)
    stuck, rows, n = set(cyclic), [], {"linked": 0, "bad": 0}
    for i in first + cyclic:
        c = calls[i]
        arguments = parsed(c["arguments"])
        status = "linked" if c["answered"] else "unanswered"
        if c["name"] in schemas and not valid(arguments, schemas[c["name"]]):
            status = "invalid"
        if c["name"] not in schemas:
            status = "unknown"
        n["bad"] += status in ("invalid", "unknown")
        if c["again"]:
            status = "duplicate"
        if i in stuck:
            status = "cyclic"
        n["linked"] += status == "linked"
        rows.append({"arguments": arguments, "id": c["id"], "name": c["name"], "result": c["result"], "status": status, "turn": c["turn"]})
    return len(calls), n["linked"], n["bad"], len(cyclic), canonical({"calls": rows, "conv_id": conv_id})


def _formatter(schemas: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(c, *format_conversation(c, calls, schemas)) for c, calls in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 5 else pa.int64()) for k, x in enumerate(zip(*out))] if out else [pa.array([], pa.int64())] * 5 + [pa.array([], pa.string())], names=["conv_id", "n_calls", "n_linked", "n_invalid", "n_cyclic", "chat"])

    return run


def _rows(turns: DataFrame) -> DataFrame:
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).distinct()


def calls_and_results(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, id, turn, place, name, arguments, depends_on) and (conv_id, id, turn, content) of _rows()."""
    braces = F.col("text").rlike(r"^\s*\{")
    rows = rows.withColumns(
        {
            "calls": F.when(braces, F.from_json(F.get_json_object("text", "$.tool_calls"), CALL)),
            "answers": F.when(braces, F.get_json_object("text", "$.tool_call_id")),
        }
    )
    plain = F.col("calls").isNull() & F.col("answers").isNull()
    asks = plain & (F.col("role") == "user")
    before = Window.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("asked", F.last(F.when(asks, F.col("turn").cast("string")), True).over(before))
    own = F.array(F.struct(F.col("turn").cast("string").alias("id"), F.lit("respond").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"))).alias("arguments"), F.when(F.col("asked").isNotNull(), F.array("asked")).otherwise(F.array().cast("array<string>")).alias("depends_on")))
    calls = rows.select("conv_id", "turn", F.posexplode(F.when(asks, own).otherwise(F.col("calls"))).alias("place", "call")).select("conv_id", "turn", "place", "call.*").where("id is not null")
    answer = F.when(plain & (F.col("role") == "assistant"), F.col("asked")).otherwise(F.col("answers"))
    content = F.when(plain, F.col("text")).otherwise(F.get_json_object("text", "$.content"))
    results = rows.select("conv_id", answer.alias("id"), "turn", content.alias("content")).where("id is not null")
    return calls, results


def linked(turns: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """(conv_id, n_calls, n_linked, n_invalid, n_cyclic, chat) of every conversation that calls a tool."""
    return _linked(*calls_and_results(_rows(turns)), schemas)


def _linked(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    first = results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "content")).alias("answer"))
    again = F.row_number().over(Window.partitionBy("conv_id", "id").orderBy("turn", "place", "arguments")) > 1
    both = calls.withColumn("again", again).join(first, ["conv_id", "id"], "left")
    answered = F.col("answer").isNotNull() & ~F.col("again")
    call = F.struct("turn", "place", "arguments", "id", "name", "depends_on", "again", answered.alias("answered"), F.when(answered, F.col("answer.content")).alias("result"))
    return both.groupBy("conv_id").agg(F.array_sort(F.collect_list(call)).alias("calls")).mapInArrow(_formatter(schemas), FORMATTED)


def orphans(turns: DataFrame) -> DataFrame:
    """(conv_id, id, turn) of results without a call."""
    return _unclaimed(*calls_and_results(_rows(turns))).select("conv_id", "id", "turn")


def _unclaimed(calls: DataFrame, results: DataFrame) -> DataFrame:
    return results.join(calls.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = ("n_calls", "n_linked", "n_invalid", "n_cyclic")
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            lost = r["orphans"] or []
            # the keys that are added come behind those that are there
            chat = r["chat"] or canonical({"calls": [], "conv_id": r["conv_id"]})
            whole = f"{chat[:-1]},{canonical({'orphans': lost, 'turns': r['turns']})[1:]}"
            out.append((r["conv_id"], len(r["turns"]), *(r[c] or 0 for c in counts), len(lost), whole))
        columns = list(zip(*out)) if out else [()] * 8
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.string())], names=["conv_id", "n_turns", *counts, "n_orphans", "chat"])


def transcribed(turns: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """(conv_id, n_turns, n_calls, n_linked, n_invalid, n_cyclic, n_orphans, chat) of every conversation; the chat has each turn in order beside the calls."""
    # what three branches read is worked out once
    rows = written(_rows(turns), "turns")
    calls, results = (written(x, label) for x, label in zip(calls_and_results(rows), ("calls", "results")))
    said = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    lost = _unclaimed(calls, results).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "id", "content"))).alias("orphans"))
    both = said.join(_linked(calls, results, schemas), "conv_id", "left").join(lost, "conv_id", "left")
    return both.select("conv_id", "turns", "n_calls", "n_linked", "n_invalid", "n_cyclic", "orphans", "chat").mapInArrow(_whole, TRANSCRIBED)


def generated(turns: DataFrame) -> DataFrame:
    """Turns with tool calls made from every user's turn, the j-th of its conversation: a table that has what plain chat has not.

    Call c<j> looks for the text; each even one needs the odd one behind it. Every fourth
    names no tool, the one before it has no query, every third has no result. Every
    fifth conversation calls c0 again, every seventh has a result of no call, and in every tenth c1
    needs c0 as well.
    """
    asked = _rows(turns).where("role = 'user'").withColumn("j", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1)
    j, own = F.col("j"), F.concat(F.lit("c"), F.col("j"))
    none = F.array().cast("array<string>")
    needs = F.when(j % 2 == 0, F.array(F.concat(F.lit("c"), j + 1))).when((j == 1) & (F.col("conv_id") % 10 == 0), F.array(F.lit("c0"))).otherwise(none)
    query = F.when(j % 4 == 2, "").otherwise(F.col("text"))
    arguments = F.to_json(F.struct(query.alias("query"), (F.length("text") + 1).alias("limit")))
    call = F.struct(own.alias("id"), F.when(j % 4 == 3, "fly").otherwise("search").alias("name"), arguments.alias("arguments"), needs.alias("depends_on"))
    said = lambda calls: F.concat(F.lit(" "), F.to_json(F.struct(F.array(calls).alias("tool_calls"))))
    answer = lambda id, content: F.to_json(F.struct(id.alias("tool_call_id"), content.alias("content")))
    again = F.struct(F.lit("c0").alias("id"), F.lit("search").alias("name"), F.lit('{"query":"again"}').alias("arguments"), none.alias("depends_on"))
    row = lambda turn, role, text: ("conv_id", turn.cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    first = asked.where(j == 0)
    parts = [
        asked.select(*row(2 * j, "assistant", said(call))),
        asked.where(j % 3 != 1).select(*row(2 * j + 1, "tool", answer(own, F.length("text").cast("string")))),
        first.where("conv_id % 5 = 0").select(*row(F.lit(1 << 40), "assistant", said(again))),
        first.where("conv_id % 7 = 0").select(*row(F.lit(1 << 41), "tool", answer(F.lit("zz"), F.lit("?")))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def oracle() -> str:
    """linked() over turns of plain chat in DuckDB's SQL."""
    return """
WITH turns AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
asked AS (SELECT *, last_value(CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ask FROM turns),
results AS (SELECT conv_id, ask AS id, arg_min(text, turn) AS content FROM asked WHERE role = 'assistant' AND ask IS NOT NULL GROUP BY 1, 2),
calls AS (SELECT a.conv_id, a.turn, a.text, r.content, r.id IS NOT NULL AS answered,
       CASE WHEN a.text = '' THEN 'invalid' WHEN r.id IS NOT NULL THEN 'linked' ELSE 'unanswered' END AS status
  FROM asked a LEFT JOIN results r ON r.conv_id = a.conv_id AND r.id = CAST(a.turn AS VARCHAR) WHERE a.role = 'user')
SELECT conv_id, count(*) AS n_calls, count(*) FILTER (status = 'linked') AS n_linked, count(*) FILTER (status = 'invalid') AS n_invalid, CAST(0 AS BIGINT) AS n_cyclic,
  '{"calls":[' || string_agg('{"arguments":{"prompt":' || CAST(to_json(text) AS VARCHAR) || '},"id":"' || turn || '","name":"respond","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"status":"' || status || '","turn":' || turn || '}', ',' ORDER BY turn) || '],"conv_id":' || conv_id || '}' AS chat
FROM calls GROUP BY conv_id"""


def whole_oracle() -> str:
    """transcribed() over turns of plain chat in DuckDB's SQL."""
    return f"""
WITH called AS ({oracle()}),
turns AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
said AS (SELECT conv_id, count(*) AS n_turns, string_agg('{{"role":' || CAST(to_json(role) AS VARCHAR) || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '}}', ',' ORDER BY turn, role, text) AS list FROM turns GROUP BY conv_id)
SELECT s.conv_id, s.n_turns, coalesce(c.n_calls, 0) AS n_calls, coalesce(c.n_linked, 0) AS n_linked, coalesce(c.n_invalid, 0) AS n_invalid, CAST(0 AS BIGINT) AS n_cyclic, CAST(0 AS BIGINT) AS n_orphans,
  coalesce(left(c.chat, length(c.chat) - 1), '{{"calls":[],"conv_id":' || s.conv_id) || ',"orphans":[],"turns":[' || s.list || ']}}' AS chat
FROM said s LEFT JOIN called c ON c.conv_id = s.conv_id"""


def generated_oracle() -> str:
    """linked() over generated() in DuckDB's SQL."""
    return """
WITH turns AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
asked AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS j, count(*) OVER (PARTITION BY conv_id) AS n FROM turns WHERE role = 'user'),
calls AS (
  SELECT conv_id, j, 2 * j AS turn, 'c' || j AS id, CASE WHEN j % 4 = 3 THEN 'fly' ELSE 'search' END AS name, j % 4 = 3 AS unknown, j % 4 = 2 OR (text = '' AND j % 4 <> 3) AS invalid,
         '{"limit":' || (length(text) + 1) || ',"query":' || CASE WHEN j % 4 = 2 THEN '""' ELSE CAST(to_json(text) AS VARCHAR) END || '}' AS arguments,
         CASE WHEN j % 3 <> 1 THEN CAST(length(text) AS VARCHAR) END AS result, false AS again, conv_id % 10 = 0 AND n > 1 AND j < 2 AS cyclic FROM asked
  UNION ALL SELECT conv_id, 1099511627776, 1099511627776, 'c0', 'search', false, false, '{"query":"again"}', NULL, true, false FROM asked WHERE j = 0 AND conv_id % 5 = 0),
judged AS (SELECT *, CASE WHEN cyclic THEN 'cyclic' WHEN again THEN 'duplicate' WHEN unknown THEN 'unknown' WHEN invalid THEN 'invalid' WHEN result IS NOT NULL THEN 'linked' ELSE 'unanswered' END AS status FROM calls)
SELECT conv_id, count(*) AS n_calls, count(*) FILTER (status = 'linked') AS n_linked, count(*) FILTER (unknown OR invalid) AS n_invalid, count(*) FILTER (cyclic) AS n_cyclic,
  '{"calls":[' || string_agg('{"arguments":' || arguments || ',"id":"' || id || '","name":"' || name || '","result":' || coalesce('"' || result || '"', 'null') || ',"status":"' || status || '","turn":' || turn || '}', ','
    ORDER BY cyclic, CASE WHEN cyclic THEN j ELSE j // 2 END, CASE WHEN cyclic THEN 0 ELSE -(j % 2) END) || '],"conv_id":' || conv_id || '}' AS chat
FROM judged GROUP BY conv_id"""
