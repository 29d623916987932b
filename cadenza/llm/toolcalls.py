"""Chat formatting: tool-call linking and canonical JSON.

Method: tool calls and their results are hash-joined by conversation and call
identifier; calls are ordered topologically, round by round, by the calls that
they name as predecessors; arguments are validated against schemas; every
message is serialised as canonical JSON (keys sorted, no white space).
DataFrame functions only.

A message is a row of conv_id, turn, role and text.  An assistant's text may be a
JSON object with ``content`` and ``tool_calls`` (objects of id, name, arguments
and, optionally, after: ids of earlier calls); a tool's text is one with
``tool_call_id`` and ``content``.  Any other text is plain content.  A system's text
that is a JSON object with ``tools`` (objects of name and parameters, a JSON schema of
``properties`` with their ``type`` and of ``required``; or such an object as ``function``)
declares the tools of its conversation; it is plain content, too.

Plan: joins and groupings are by conversation and call, never by conversation
alone, so that one hot conversation is no single task; its calls meet the tools that
it declares by conversation and name, a join that Spark can split.  There is one topological
round per level of the deepest chain; a round reads and writes only the links of
calls that are still waiting, in the shared folder, and there is none without links.

Edge cases: null text is empty content.  A null conversation or call id is a value
like any other, in joins too.  A call without a result, a result without a call, a
repeated call or result id (the first turn counts), unknown tools, calls in a cycle:
each has its status.  A tool declared again in a conversation: the first counts; a type other
than the six is not looked at; calls of a conversation that declares no tools are not held against any.  An object with repeated keys has no canonical form: it stays
plain text.  Empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialise

TOOL = "name:string,parameters:struct<properties:map<string,struct<type:string>>,required:array<string>>"
TOOLS = f"struct<tools:array<struct<{TOOL},function:struct<{TOOL}>>>>"
TYPES = ("string", "integer", "number", "boolean", "array", "object")
MESSAGE = "struct<content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"


KEYS = ["conv", "call"]  # structs of one field, so that nulls are equal in joins


def parsed(messages: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = F.when(text.rlike(r"^\s*\{"), F.from_json(text, MESSAGE))
    structured = (body["tool_calls"].isNotNull() | body["tool_call_id"].isNotNull()) & canonical(text).isNotNull()
    return messages.select("conv_id", "turn", "role", text.alias("text"), F.when(structured, body).alias("body"))


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no white space; null where it is not JSON."""
    return F.to_json(F.try_parse_json(json))


def keys(call_id: Column) -> list[Column]:
    return [F.struct("conv_id").alias("conv"), F.struct(call_id.alias("call_id")).alias("call")]


def calls(messages: DataFrame) -> DataFrame:
    """conv, call, turn, place, name, arguments, after, repeated: one row per call id, its first."""
    each = parsed(messages).filter("role = 'assistant'").select("conv_id", "turn", F.posexplode("body.tool_calls").alias("place", "made"))
    rows = each.groupBy(*keys(F.col("made.id"))).agg(
        F.min(F.struct("turn", "place", F.struct("made.name", "made.arguments", "made.after").alias("made"))).alias("first"), F.count("*").alias("n")
    )
    first = [F.col(f"first.{c}").alias(c) for c in ("turn", "place")] + [F.col(f"first.made.{c}").alias(c) for c in ("name", "arguments", "after")]
    return rows.select(*KEYS, *first, (F.col("n") > 1).alias("repeated"))


def results(messages: DataFrame) -> DataFrame:
    """conv, call, result_turn and result: the first per call id."""
    rows = parsed(messages).filter("role = 'tool' and body.tool_call_id is not null")
    first = rows.groupBy(*keys(F.col("body.tool_call_id"))).agg(F.min(F.struct("turn", "body.content")).alias("first"))
    return first.select(*KEYS, F.col("first.turn").alias("result_turn"), F.col("first.content").alias("result"))


def levels(found: DataFrame) -> DataFrame:
    """conv, call and level: 0 without predecessors, else one more than the highest of them; null in or behind a cycle."""
    links = found.filter(F.size("after") > 0).select(*KEYS, F.explode(F.array_distinct("after")).alias("id")).select(*KEYS, F.struct(F.col("id").alias("call_id")).alias("before"))
    links = materialise(links.join(found.select("conv", F.col("call").alias("before")), ["conv", "before"]), "call-links")
    waiting = links.select(*KEYS).distinct()
    ready = found.select(*KEYS).join(waiting, KEYS, "left_anti")
    done, level = ready.withColumn("level", F.lit(0)), 0
    while links.head(1):
        links = materialise(links.join(ready.select("conv", F.col("call").alias("before")), ["conv", "before"], "left_anti"), "call-links")
        still = links.select(*KEYS).distinct()
        ready = materialise(waiting.join(still, KEYS, "left_anti"), "ready-calls")
        if not ready.head(1):  # what is left stands in or behind a cycle
            break
        level += 1
        done = done.unionByName(ready.withColumn("level", F.lit(level)))
        waiting = still
    return found.select(*KEYS).join(done, KEYS, "left")


def declared_tools(messages: DataFrame) -> DataFrame:
    """conv, name and properties (type and required by property) of the tools that conversations declare, the first by name."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = F.when(text.rlike(r"^\s*\{") & canonical(text).isNotNull(), F.from_json(text, TOOLS))
    each = messages.filter("role = 'system'").select(F.struct("conv_id").alias("conv"), "turn", F.posexplode(body["tools"]).alias("place", "tool"))
    given = each.select("conv", "turn", "place", F.coalesce("tool.name", "tool.function.name").alias("name"), F.coalesce("tool.parameters", "tool.function.parameters").alias("given"))
    types, required = F.col("given.properties"), F.coalesce("given.required", F.array().cast("array<string>"))
    names = F.array_compact(F.array_distinct(F.concat(F.coalesce(F.map_keys(types), F.array().cast("array<string>")), required)))

    def one(key: Column) -> Column:
        kind = F.try_element_at(types, key)["type"]
        return F.struct(F.when(kind.isin(*TYPES), kind).alias("type"), F.coalesce(F.array_contains(required, key), F.lit(False)).alias("required"))

    first = F.min_by(F.map_from_arrays(names, F.transform(names, one)), F.struct("turn", "place", F.to_json("given")))
    return given.filter("name is not null").groupBy("conv", "name").agg(first.alias("properties"))


def invalid_arguments(found: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv, call and problem, one row per problem.

    ``schemas``: name, property, type (string, integer, number, boolean, array, object)
    and required, one row per property of a tool; or what ``declared_tools`` returns, for the
    calls of the conversations in it.
    """
    if "conv" in schemas.columns:
        found = found.join(schemas.select("conv").distinct(), "conv", "left_semi")
        tools, by = schemas, ["conv", "name"]
    else:
        tools, by = schemas.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("property", F.struct("type", "required")))).alias("properties")), ["name"]
    keyed = found.select(*KEYS, "name", canonical(F.col("arguments")).alias("json")).join(tools, by, "left")
    given = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))

    values = F.from_json("json", "map<string,variant>")  # of the top level only, whatever is nested or how keys are spelled

    def wrong(key: Column) -> Column:
        kind = F.try_element_at("properties", key)["type"]
        own = F.schema_of_variant(F.try_element_at("values", key))
        whole = (own == "BIGINT") | own.rlike(r"^DECIMAL\(\d+,0\)$")
        fits = (
            F.when(kind == "string", own == "STRING")
            .when(kind == "integer", whole)
            .when(kind == "number", whole | own.startswith("DECIMAL") | own.isin("DOUBLE", "FLOAT"))
            .when(kind == "boolean", own == "BOOLEAN")
            .when(kind == "array", own.startswith("ARRAY"))
            .when(kind == "object", own.startswith("OBJECT"))
        )
        known = F.array_contains(F.map_keys("properties"), key)
        return F.when(~known, F.concat(F.lit("unknown:"), key)).when(kind.isNotNull() & ~F.coalesce(fits, F.lit(False)), F.concat(F.lit("type:"), key))

    missing = F.transform(F.filter(F.map_entries("properties"), lambda e: e["value"]["required"] & ~F.array_contains(given, e["key"])), lambda e: F.concat(F.lit("missing:"), e["key"]))
    found_wrong = F.when(F.col("properties").isNull(), F.array(F.lit("no such tool"))).when(F.col("json").isNull(), F.array(F.lit("not JSON")))
    keyed = keyed.withColumn("values", values)
    problems = found_wrong.otherwise(F.concat(F.array_compact(F.transform(given, wrong)), missing))
    return keyed.select(*KEYS, F.explode(problems).alias("problem"))


def linked(found: DataFrame, messages: DataFrame) -> DataFrame:
    """``found`` (what ``calls`` says of the messages) with level, result_turn, result and status."""
    joined = found.join(results(messages), KEYS, "left").join(levels(found), KEYS, "left")
    status = F.when(F.col("level").isNull(), "cycle").when(F.col("result_turn").isNull(), "no result").when(F.col("result_turn") < F.col("turn"), "result too early").otherwise("linked")
    return joined.withColumn("status", status)


def links_per_message(messages: DataFrame) -> DataFrame:
    """conv_id, turn, n_calls and n_linked of the messages that make calls; a call whose arguments do not fit the tools declared is not linked."""
    found = materialise(calls(messages), "tool-calls")
    each, fits = linked(found, messages), F.lit(True)
    if found.head(1):
        wrong = invalid_arguments(found, declared_tools(messages)).select(*KEYS).distinct()
        each, fits = each.join(wrong.withColumn("wrong", F.lit(True)), KEYS, "left"), F.col("wrong").isNull()
    return each.groupBy("conv.conv_id", "turn").agg(F.count("*").alias("n_calls"), F.count_if((F.col("status") == "linked") & fits).alias("n_linked"))


def linked_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Each call with its level, result and problems (sorted, comma-joined)."""
    found = materialise(calls(messages), "tool-calls")
    problems = invalid_arguments(found, schemas).groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_set("problem")), ",").alias("problems"))
    joined = linked(found, messages).join(problems, KEYS, "left")
    return joined.select("conv.conv_id", "call.call_id", "turn", "place", "level", "name", canonical(F.col("arguments")).alias("arguments"), "result_turn", "result", F.coalesce("problems", F.lit("")).alias("problems"), "repeated", "status")


def formatted(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, kind (text, calls or result) and json, the canonical message."""
    rows = parsed(messages)
    plain = F.to_json(F.struct(F.col("text").alias("content"), F.coalesce("role", F.lit("")).alias("role")))
    kind = F.when(F.col("body.tool_calls").isNotNull(), "calls").when(F.col("body.tool_call_id").isNotNull(), "result").otherwise("text")
    return rows.select("conv_id", "turn", "role", kind.alias("kind"), F.when(kind == "text", plain).otherwise(canonical(F.col("text"))).alias("json"))
