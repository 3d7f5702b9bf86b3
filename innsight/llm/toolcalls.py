"""Tool calls and their results: linked, ordered, checked and written as canonical JSON.

Input is a table of messages: conv_id, turn, role, content, ``tool_calls``
(array of struct id, name, arguments as JSON text) on assistant messages and
``tool_call_id`` on messages of the role ``tool``.  Calls meet their results in
a hash join on (conv_id, id).  A call whose arguments name another call of
its conversation as ``"$<id>"`` comes after it: calls are ordered by the length of
their longest chain of such references, then by turn and place.  Arguments are
parsed as variants and checked against the tool's schema; a variant's keys are
sorted, so that its JSON text is canonical.

Rows stay single calls: a conversation of any length is never gathered.

Defined results: a call without an id, or in a NULL conversation, has no
result; of calls with one id the first is linked, the others are marked
``repeated``; of several results of a call the first by turn is taken, the
others and those without a call are counted as ``stray`` by
:func:`stray_results`; arguments that are no JSON object have the error
``not an object``; calls that name each other in a circle are ``cyclic``
and come last; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.common import stage, with_running_total

#: Tool -> property -> (type, required, check); type as schema_of_variant names it.
SCHEMAS: dict[str, dict[str, dict]] = {
    "search": {"query": {"type": "STRING", "required": True, "min_length": 1}, "limit": {"type": "BIGINT", "required": True, "minimum": 1, "maximum": 50}},
    "lookup": {"key": {"type": "STRING", "required": True, "min_length": 2}, "after": {"type": "STRING", "required": False}},
    "translate": {"text": {"type": "STRING", "required": True, "min_length": 1}, "target": {"type": "STRING", "required": True, "enum": ["de", "en", "es", "fr"]}},
}


def schema_errors(name: Column, args: Column, text: Column, schemas: dict) -> Column:
    """Sorted array of what is wrong with the arguments (variant, and as text)."""
    kind = F.schema_of_variant(args)
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    keys = F.map_keys(F.from_json(F.when(is_object, text), "map<string,string>"))

    def of_tool(tool: str) -> Column:
        found = []
        for prop, rule in sorted(schemas[tool].items()):
            value = F.try_variant_get(args, f"$.{prop}", "variant")
            here = value.isNotNull() & ~F.is_variant_null(value)
            if rule["required"]:
                found.append(F.when(~F.coalesce(here, F.lit(False)), f"{prop}: missing"))
            fits = F.schema_of_variant(value) == rule["type"]
            found.append(F.when(here & ~fits, f"{prop}: not {rule['type'].lower()}"))
            as_text, number = F.try_variant_get(args, f"$.{prop}", "string"), F.try_variant_get(args, f"$.{prop}", "bigint")
            if "min_length" in rule:
                found.append(F.when(here & fits & (F.length(as_text) < rule["min_length"]), f"{prop}: too short"))
            if "minimum" in rule:
                found.append(F.when(here & fits & (number < rule["minimum"]), f"{prop}: below {rule['minimum']}"))
            if "maximum" in rule:
                found.append(F.when(here & fits & (number > rule["maximum"]), f"{prop}: above {rule['maximum']}"))
            if "enum" in rule:
                found.append(F.when(here & fits & ~as_text.isin(rule["enum"]), f"{prop}: not allowed"))
        extra = F.transform(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*[F.lit(p) for p in schemas[tool]])), lambda k: F.concat(k, F.lit(": unknown")))
        return F.array_sort(F.concat(F.array_compact(F.array(*found)), extra))

    out = F.array(F.lit("unknown tool"))
    for tool in schemas:
        out = F.when(name == tool, of_tool(tool)).otherwise(out)
    return F.when(~is_object, F.array(F.lit("not an object"))).otherwise(out)


def _calls(messages: DataFrame) -> DataFrame:
    at = messages.where("role = 'assistant'").select("conv_id", "turn", F.posexplode("tool_calls").alias("place", "c"))
    return at.select("conv_id", "turn", "place", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))


def _results(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'tool'").select("conv_id", F.col("tool_call_id").alias("id"), F.col("turn").alias("result_turn"), F.col("content").alias("result"))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level): longest chain of references below a call; NULL in or above a circle."""
    refs = F.regexp_extract_all("arguments", F.lit(r'"\$([^"]+)"'), F.lit(1))
    edges = calls.select("conv_id", "id", F.explode(refs).alias("needs")).distinct()
    edges = stage(edges.join(calls.select("conv_id", F.col("id").alias("needs")).distinct(), ["conv_id", "needs"]), "references")
    # calls with no open reference are ready; round by round, as many as the longest chain
    ready = stage(calls.select("conv_id", "id").where("conv_id is not null and id is not null").distinct()
                  .join(edges.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    done, level = ready, 0
    open_ = edges
    while not open_.isEmpty():
        level += 1
        open_ = stage(open_.join(ready.select("conv_id", F.col("id").alias("needs")), ["conv_id", "needs"], "left_anti"), "references")
        waiting = open_.select("conv_id", "id").distinct()
        left = edges.select("conv_id", "id").distinct().join(done.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
        ready = stage(left.join(waiting, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(level)), "levels")
        if ready.isEmpty():
            break
        done = done.unionByName(ready)
    return done


def link_tool_calls(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row per call: conv_id, position (0-based in its conversation), id, name, turn, result_turn, errors, status, json."""
    schemas = SCHEMAS if schemas is None else schemas
    calls = stage(_calls(messages), "calls")
    # the first call of an id stands for it; the first result of an id is its result
    named = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place")).alias("first")).select("conv_id", "id", F.col("first.turn").alias("turn"), F.col("first.place").alias("place"))
    result = _results(messages).groupBy("conv_id", "id").agg(F.min(F.struct("result_turn", "result")).alias("r")).select("conv_id", "id", "r.*")
    linked = named.join(result.hint("shuffle_hash"), ["conv_id", "id"], "left").join(_levels(calls), ["conv_id", "id"], "left")
    linked = linked.withColumn("known", F.lit(True))
    rows = calls.join(linked, ["conv_id", "id", "turn", "place"], "left")
    args = F.try_parse_json("arguments")
    rows = rows.withColumn("args", args).withColumn("errors", schema_errors(F.col("name"), F.col("args"), F.col("arguments"), schemas))
    identified = F.col("conv_id").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("status", F.when(~identified, "no id").when(F.col("known").isNull(), "repeated").when(F.col("level").isNull(), "cyclic")
                           .when(F.col("result_turn").isNull() & F.col("result").isNull(), "no result").otherwise("linked"))
    # fields in the order of their names; the arguments as the variant's own canonical text
    made = F.to_json(F.struct(F.coalesce("args", F.lit(None)).alias("arguments"), "conv_id", "errors", "id", "name", "result", "result_turn", "status", "turn"), {"ignoreNullFields": "false"})
    rows = rows.select("conv_id", F.coalesce("level", F.lit(2_147_483_647)).alias("level"), "turn", "place", "id", "name", "result_turn", "errors", "status", made.alias("json"))
    rows = stage(rows, "linked")
    order = ["conv_id", "level", "turn", "place", "json"]
    ranked = with_running_total(rows, order, F.lit(1).cast("bigint"), "rank", "call-order")
    starts = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    starts = with_running_total(starts, ["conv_id"], F.col("n"), "begin", "call-starts").select(F.col("conv_id").alias("c"), "begin")
    return ranked.join(stage(starts, "call-starts"), F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", (F.col("rank") - F.col("begin")).alias("position"), "id", "name", "turn", "result_turn", "errors", "status", "json")


def stray_results(messages: DataFrame) -> DataFrame:
    """(conv_id, n): results that belong to no call, or to one that has its result already."""
    named = _calls(messages).select("conv_id", "id").distinct().withColumn("known", F.lit(1))
    each = _results(messages).groupBy("conv_id", "id").agg(F.count("*").alias("n"))
    each = each.join(named, ["conv_id", "id"], "left")
    return each.groupBy("conv_id").agg(F.sum(F.when(F.col("known") == 1, F.col("n") - 1).otherwise(F.col("n"))).alias("n")).where("n > 0")


def messages_of(conversations: DataFrame) -> DataFrame:
    """Tool-call messages that the table ``conversations`` (conv_id, turn, role, text) stands for.

    Each answer of the assistant is taken as the result of one tool call that
    the user's message before it asks for: tool by turn, arguments from the
    user's words, in every third answer a reference to the answer before.
    Answers with a multiple of eleven characters get no result, those with a
    multiple of thirteen a second one.  Plain columns, whole tables.
    """
    c = conversations.select("conv_id", "turn", "role", "text")
    asked = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    said = c.where("role = 'assistant'").join(asked, ["conv_id", "turn"], "left").withColumn("asked", F.coalesce("asked", F.lit("")))
    call_id = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    words = F.size(F.split(F.trim("asked"), r"\s+"))
    step = F.pmod(F.expr("turn div 2"), F.lit(3))
    search = F.to_json(F.struct(F.col("asked").alias("query"), words.alias("limit")))
    look = F.to_json(F.struct(F.substring_index("asked", " ", 1).alias("key"), F.concat(F.lit("$"), call_id(F.col("turn") - 2)).alias("after")))
    target = F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", "xx")]), F.pmod(F.length("asked"), F.lit(5)) + 1)
    translate = F.to_json(F.struct(F.col("asked").alias("text"), target.alias("target")))
    name = F.when(step == 0, "search").when(step == 1, "lookup").otherwise("translate")
    arguments = F.when(step == 0, search).when(step == 1, look).otherwise(translate)
    call = F.array(F.struct(call_id(F.col("turn")).alias("id"), name.alias("name"), arguments.alias("arguments")))
    none = F.lit(None)
    kind = "array<struct<id:string,name:string,arguments:string>>"
    asks = said.select("conv_id", "turn", "role", none.cast("string").alias("content"), call.cast(kind).alias("tool_calls"), none.cast("string").alias("tool_call_id"))
    times = F.when(F.pmod(F.length("text"), F.lit(11)) == 0, 0).when(F.pmod(F.length("text"), F.lit(13)) == 0, 2).otherwise(1)
    answers = said.where(times > 0).select("conv_id", "turn", F.lit("tool").alias("role"), F.col("text").alias("content"), none.cast(kind).alias("tool_calls"),
                                           call_id(F.col("turn")).alias("tool_call_id"), F.explode(F.sequence(F.lit(1), times)).alias("again"))
    return asks.unionByName(answers.select("conv_id", F.expr("turn + again - 1").cast("bigint").alias("turn"), "role", "content", "tool_calls", "tool_call_id"))
