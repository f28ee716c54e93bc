"""Tool-call linking for chat formatting.

Calls and results are hash-joined by conversation and identifier, calls are ordered topologically by what
they depend on, arguments are validated against the tool's schema, and each linked call is serialised as
canonical JSON (sorted keys, no spaces, integral numbers without a fraction).

Every call is one row; its place is the triple (level, turn, call_id), where level is 0 for calls without
known dependencies and otherwise one more than the highest level they depend on. Sorting by it gives a
topological order without gathering a conversation in one row.

Defined results: calls without an identifier or a conversation link with nothing and have level 0; results
without a call are rows of kind "orphan_result"; of several results for an identifier the first turn counts
(then the smaller text) and all are counted; calls with equal identifiers all get the result; dependencies
on unknown calls are ignored; calls in a cycle, or behind one, get a null level and the error "cycle"; null
or unreadable arguments are errors, and so are numbers that JSON can't write (NaN, infinities, beyond a double),
half surrogate pairs and nesting that the parser can't follow: such arguments are null in the JSON; tools
without a schema are errors; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, stage

#: Conversations with more calls are ordered by rounds of joins instead of within one task.
TASK_CALLS = 20_000

SCHEMAS: dict[str, dict[str, Any]] = {
    "ask": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
    "configure": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 200}, "turn": {"type": "integer", "maximum": 0}}},
}

_TYPES: dict[str, Any] = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces; floats that are whole are written as integers."""

    def plain(x: Any) -> Any:
        if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 2**53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _finite(text: str) -> float:
    number = float(text)
    if not math.isfinite(number):
        raise ValueError(f"{text} is no finite number")
    return number


def read_arguments(text: str | None, schema: Mapping[str, Any] | None) -> tuple[Any, str | None]:
    """(value, error) of a call's arguments; the value is null where it can't be read or written as JSON."""
    try:
        value = json.loads(text or "", parse_float=_finite, parse_constant=_finite)
        canonical({"arguments": value}).encode()
        return value, "no schema" if schema is None else schema_error(value, schema)
    except RecursionError:
        return None, "arguments: nested too deeply"
    except UnicodeEncodeError:
        return None, "arguments: half a surrogate pair"
    except ValueError:
        return None, "arguments: not JSON"


def _is_kind(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, int | float):
            return False
        return kind == "number" or isinstance(value, int) or math.isfinite(value) and value == int(value)
    return isinstance(value, _TYPES[kind])


def schema_error(value: Any, schema: Mapping[str, Any], where: str = "") -> str | None:
    """The first thing wrong with value, or None; covers the keywords of SCHEMAS, enum and items."""
    here = where or "arguments"
    kinds = schema.get("type")
    if kinds and not any(_is_kind(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{here}: not of type {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{here}: not in enum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{here}: shorter than {schema['minLength']}"
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            return f"{here}: longer than {schema['maxLength']}"
    if isinstance(value, int | float) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            return f"{here}: below {schema['minimum']}"
        if "maximum" in schema and value > schema["maximum"]:
            return f"{here}: above {schema['maximum']}"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in sorted(schema.get("required", ())):
            if name not in value:
                return f"{here}: {name} is missing"
        for name in sorted(value):
            if name in known:
                if error := schema_error(value[name], known[name], f"{where}.{name}".lstrip(".")):
                    return error
            elif schema.get("additionalProperties", True) is False:
                return f"{here}: {name} is not allowed"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if error := schema_error(item, schema["items"], f"{where}[{i}]"):
                return error
    return None


def _levels(part: pd.DataFrame) -> pd.DataFrame:
    """Levels of the calls of some whole conversations: rows (conv_id, call_id, dep or null)."""
    waits: dict[tuple, set] = {}
    for conv, call, dep in zip(part["conv_id"], part["call_id"], part["dep"], strict=True):
        known = waits.setdefault((conv, call), set())
        if dep is not None:
            known.add((conv, dep))
    nexts: dict[tuple, list] = {}
    open_deps = {}
    for call, deps in waits.items():
        open_deps[call] = len(deps)
        for dep in deps:
            nexts.setdefault(dep, []).append(call)
    level = {call: 0 for call, n in open_deps.items() if not n}
    ready = list(level)
    while ready:
        call = ready.pop()
        for after in nexts.get(call, ()):
            level[after] = max(level.get(after, 0), level[call] + 1)
            open_deps[after] -= 1
            if not open_deps[after]:
                ready.append(after)
    done = [(*call, level[call]) for call in waits if not open_deps[call]]
    return pd.DataFrame(done, columns=["conv_id", "call_id", "level"])


def _levels_by_rounds(edges: DataFrame) -> DataFrame:
    """The same for conversations of any size: each round settles the calls whose dependencies are settled."""
    done = stage(edges.groupBy("conv_id", "call_id").agg(F.count("dep").alias("n")).where("n = 0").select("conv_id", "call_id", F.lit(0).alias("level")), "levels")
    waiting = stage(edges.where("dep IS NOT NULL"), "waiting")
    while True:
        settled = done.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("dep_level"))
        seen = waiting.join(settled, ["conv_id", "dep"], "left").groupBy("conv_id", "call_id").agg(F.sum(F.col("dep_level").isNull().cast("int")).alias("open"), (F.max("dep_level") + 1).alias("level"))
        ready = stage(seen.where("open = 0").select("conv_id", "call_id", "level"), "ready")
        if ready.isEmpty():
            return done
        done = stage(done.union(ready), "levels")
        waiting = stage(waiting.join(ready, ["conv_id", "call_id"], "left_anti"), "waiting")


def order_calls(calls: DataFrame, task_calls: int = TASK_CALLS) -> DataFrame:
    """(conv_id, call_id, level) of calls(conv_id, call_id, depends_on array<string>) with an identifier."""
    known = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    ids = known.select("conv_id", F.col("call_id").alias("dep")).distinct()
    wanted = known.select("conv_id", "call_id", F.explode("depends_on").alias("dep")).where("dep IS NOT NULL").distinct().join(ids, ["conv_id", "dep"]).select("conv_id", "call_id", "dep")
    edges = stage(known.select("conv_id", "call_id", F.lit(None).cast("string").alias("dep")).distinct().union(wanted), "dependencies")
    sizes = edges.groupBy("conv_id").count()
    large = stage(sizes.where(F.col("count") > task_calls).select("conv_id"), "large-conversations")
    total = edges.count()
    inside = edges if large.isEmpty() else edges.join(large, "conv_id", "left_anti")
    groups = F.pmod(F.xxhash64("conv_id"), F.lit(max(1, total // task_calls)))
    out = inside.withColumn("g", groups).groupBy("g").applyInPandas(lambda part: _levels(part), "conv_id long, call_id string, level int")
    return out if large.isEmpty() else out.union(_levels_by_rounds(edges.join(large, "conv_id", "left_semi")))


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Any]] | None = None) -> DataFrame:
    """Link calls(conv_id, call_id, turn, name, arguments JSON, depends_on) with results(conv_id, call_id, turn, content).

    Returns kind, conv_id, call_id, turn, name, level, result_turn, n_results, valid, error, json."""
    prepare(calls.sparkSession)
    schemas = dict(SCHEMAS if schemas is None else schemas)
    answers = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n_results"))
    levels = order_calls(calls)
    marked = calls.select("conv_id", "call_id", "turn", "name", "arguments", F.lit(True).alias("is_call"))
    # equal to nothing where an identifier is null, as joins are: such calls and results stay alone
    joined = marked.join(answers, ["conv_id", "call_id"], "full").join(levels, ["conv_id", "call_id"], "left")
    kind = F.when(F.col("is_call"), F.lit("call")).otherwise(F.lit("orphan_result"))
    known_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    rows = joined.select(
        kind.alias("kind"), "conv_id", "call_id", F.coalesce("turn", "answer.turn").cast("long").alias("turn"), "name", F.when(known_id, F.col("level")).otherwise(F.when(F.col("is_call"), 0)).cast("int").alias("level"),
        F.col("answer.turn").cast("long").alias("result_turn"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "arguments", F.col("answer.content").alias("content"),
    )
    names = ["kind", "conv_id", "call_id", "turn", "name", "level", "result_turn", "n_results", "valid", "error", "json"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, texts = [], []
            for row in batch.to_pylist():
                error, arguments = None, None
                if row["kind"] == "call":
                    arguments, error = read_arguments(row["arguments"], schemas.get(row["name"]))
                    if row["level"] is None:
                        error = "cycle"
                else:
                    error = "no call"
                errors.append(error)
                texts.append(canonical({"arguments": arguments, "id": row["call_id"], "level": row["level"], "name": row["name"], "result": row["content"]}))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names[:8]), pa.array([e is None for e in errors]), pa.array(errors, pa.string()), pa.array(texts, pa.string())], names
            )

    return rows.mapInArrow(run, "kind string, conv_id long, call_id string, turn long, name string, level int, result_turn long, n_results long, valid boolean, error string, json string")


def calls_and_results(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations(conv_id, turn, role, text) as calls and results.

    A user or system turn calls "ask" or "configure" under the identifier conversation-turn and depends on
    the call two turns before; any other turn is the result of the turn before it. So that everything a model may
    get wrong occurs, arguments of some lengths lose their last character, and the calls of some conversations
    depend on the call two turns later as well."""
    call_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    named = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), call_id)
    asks = F.coalesce(F.col("role").isin("user", "system"), F.lit(False))
    earlier = F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 2).cast("string"))
    later = F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + 2).cast("string"))
    calls = messages.where(asks).withColumn("arguments", F.to_json(F.struct("text", "turn"))).select(
        F.col("conv_id").cast("long"), named.alias("call_id"), F.col("turn").cast("long"), F.when(F.col("role") == "user", "ask").otherwise("configure").alias("name"),
        F.when(F.length("text") % 13 == 5, F.expr("left(arguments, length(arguments) - 1)")).otherwise(F.col("arguments")).alias("arguments"),
        F.when(F.col("conv_id") % 11 == 0, F.array(earlier, later)).otherwise(F.array(earlier)).alias("depends_on"),
    )
    before = F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    results = messages.where(~asks).select(
        F.col("conv_id").cast("long"), F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), before).alias("call_id"), F.col("turn").cast("long"), F.col("text").alias("content")
    )
    return calls, results


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_and_results(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link(calls, results)


OP1_SQL = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, role IN ('user', 'system') AS asks FROM conversations),
c AS (SELECT conv_id, turn, conv_id || '-' || turn AS call_id, conv_id || '-' || (turn - 2) AS dep, conv_id || '-' || (turn + 2) AS later, CASE role WHEN 'user' THEN 'ask' ELSE 'configure' END AS name, text,
             coalesce(length(text) % 13 = 5, false) AS cut FROM m WHERE asks),
a AS (SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, min({'turn': turn, 'content': text}) AS answer, count(*) AS n_results FROM m WHERE NOT asks GROUP BY ALL),
l(call_id, level) AS (SELECT call_id, 0 FROM c WHERE dep NOT IN (SELECT call_id FROM c) AND (conv_id % 11 <> 0 OR later NOT IN (SELECT call_id FROM c))
                      UNION SELECT c.call_id, level + 1 FROM l JOIN c ON c.dep = l.call_id WHERE c.conv_id % 11 <> 0),
j AS (SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, c.turn AS t, c.name, c.text, c.cut, a.answer, a.n_results,
             c.call_id IS NOT NULL AS is_call FROM c FULL JOIN a ON c.call_id = a.call_id),
e AS (SELECT j.*, l.level, CASE WHEN NOT is_call THEN 'no call' WHEN l.level IS NULL THEN 'cycle' WHEN cut THEN 'arguments: not JSON' WHEN text = '' THEN 'text: shorter than 1'
             WHEN name = 'configure' AND length(text) > 200 THEN 'text: longer than 200' WHEN name = 'configure' AND t > 0 THEN 'turn: above 0' END AS error
      FROM j LEFT JOIN l ON j.call_id = l.call_id)
SELECT CASE WHEN is_call THEN 'call' ELSE 'orphan_result' END AS kind, conv_id, call_id, coalesce(t, answer.turn) AS turn, name, level::INT AS level,
       answer.turn AS result_turn, coalesce(n_results, 0)::BIGINT AS n_results, error IS NULL AS valid, error,
       '{"arguments":' || CASE WHEN is_call AND NOT cut THEN '{"text":' || to_json(text)::VARCHAR || ',"turn":' || t || '}' ELSE 'null' END || ',"id":"' || call_id || '","level":' || coalesce(level::VARCHAR, 'null')
       || ',"name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(to_json(answer.content)::VARCHAR, 'null') || '}' AS json
FROM e
"""
