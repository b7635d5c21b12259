"""Tool-call linking for chats, in DataFrame operations only.

Calls and results meet in a hash join by (conversation, identifier), so even a
conversation that holds a third of all rows is spread by its identifiers.
Arguments are checked against the tools' schemas and written as canonical
JSON: sorted keys at every level, no blanks. A call can run once every call
it needs has run: (ready_turn, hops) orders the calls of a conversation
topologically, with the call's own turn first and, for needs that come later
in the text, the number of steps behind them. Long chains are followed by
pointer doubling, so their length costs rounds by its logarithm only.

Two kinds of calls are read from messages. Explicit ones stand in assistant
texts as <tool_call>{"id", "name", "arguments", "needs"}</tool_call>, and
their results are texts of role tool, {"tool_call_id", "content"}. And every
user turn is a call of the tool "reply" that the next turn answers, if an
assistant wrote it; it needs the user turn before it.

Defined cases: a null text counts as missing, so it is reported as a missing
prompt; a null conversation or identifier links with nothing and is reported; an
identifier used twice is reported on each of its calls; of several results the
first by (turn, content) is taken, and the others are reported on the call and
in rows of their own; a result without a call is reported in a row of its own,
without a name; system messages have a row with their text as canonical JSON,
and so have messages of a missing or unknown role, which are reported; calls in
or behind a cycle are reported and keep their own turn; repeated rows stay; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, stage

# Tool, argument, JSON type, required, longest text.
SCHEMAS = [("reply", "prompt", "STRING", True, 20000), ("reply", "turn", "BIGINT", True, None)]
CALLS = ["conv_id", "turn", "call_id", "name", "arguments", "needs"]


def quoted(text: Column) -> Column:
    """The text as a JSON string; null as null."""
    inside = F.to_json(F.array(text))
    return F.substr(inside, F.lit(2), F.length(inside) - 2)


def canonical(json: Column) -> Column:
    """Sorted keys, no blanks; null where the text is no JSON (repeated keys included)."""
    return F.to_json(F.try_parse_json(json))


def reply_calls(messages: DataFrame) -> DataFrame:
    name = lambda turn: F.concat(F.lit("u"), turn.cast("string"))
    users = messages.where("role = 'user'")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    needs = F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    return users.select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), needs.alias("needs"))


def reply_results(messages: DataFrame) -> DataFrame:
    name = F.concat(F.lit("u"), (F.col("turn") - 1).cast("string"))
    return messages.where("role = 'assistant'").select("conv_id", "turn", name.alias("call_id"), F.col("text").alias("content"))


def explicit_calls(messages: DataFrame) -> DataFrame:
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    rows = messages.where(F.col("role") == "assistant").where(F.contains("text", F.lit("<tool_call>"))).select("conv_id", "turn", F.explode(blocks).alias("block"))
    rows = rows.withColumn("v", F.try_parse_json("block"))
    needs = F.coalesce(F.try_variant_get("v", "$.needs", "array<string>"), F.array().cast("array<string>"))
    return rows.select(
        "conv_id", "turn", F.try_variant_get("v", "$.id", "string").alias("call_id"), F.try_variant_get("v", "$.name", "string").alias("name"),
        F.to_json(F.try_variant_get("v", "$.arguments", "variant")).alias("arguments"), needs.alias("needs"))


def explicit_results(messages: DataFrame) -> DataFrame:
    v = F.try_parse_json("text")
    return messages.where("role = 'tool'").select("conv_id", "turn", F.try_variant_get(v, "$.tool_call_id", "string").alias("call_id"), F.try_variant_get(v, "$.content", "string").alias("content"))


def problems_of(arguments: Column, name: Column, schemas: list[tuple]) -> Column:
    """What the schemas say against a call; a schema table is short, so each entry is one test."""
    v = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    tests = []
    for tool, argument, kind, required, longest in schemas:
        value = F.try_variant_get(v, f"$.{argument}", "variant")
        here = (name == tool) & v.isNotNull()
        missing = value.isNull() | F.is_variant_null(value)
        if required:
            tests.append(F.when(here & missing, f"missing {argument}"))
        tests.append(F.when(here & ~missing & (F.schema_of_variant(value) != kind), f"type {argument}"))
        if longest is not None:
            tests.append(F.when(here & ~missing & (F.length(F.try_variant_get(v, f"$.{argument}", "string")) > longest), f"long {argument}"))
    tests.append(F.when(v.isNull(), "not json"))
    known = sorted({s[0] for s in schemas})
    tests.append(F.when(name.isNull() | ~name.isin(known), "unknown tool"))
    for tool in known:
        own = F.array(*[F.lit(s[1]) for s in schemas if s[0] == tool])
        tests.append(F.when((name == tool) & (F.size(F.array_except(keys, own)) > 0), F.concat(F.lit("extra "), F.array_join(F.array_sort(F.array_except(keys, own)), " "))))
    return F.array_compact(F.array(*tests))


def _ready(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, ready_turn, hops, lost, stuck) of every identifier."""
    nodes = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    edges = calls.where("conv_id is not null and call_id is not null").select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    met = edges.join(nodes.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn")), ["conv_id", "need"], "left")
    lost = met.where("need_turn is null").groupBy("conv_id", "call_id").agg(F.count("*").alias("lost"))
    state = nodes.join(lost, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.struct(F.col("turn").alias("t"), F.lit(0).alias("h")).alias("ready"), F.coalesce("lost", F.lit(0)).alias("lost"), F.lit(False).alias("stuck"))
    later = met.join(nodes, ["conv_id", "call_id"]).where("need_turn >= turn").select("conv_id").distinct()
    later = stage(later, "later")
    if not later.isEmpty():
        # only conversations with a need that comes later have to be relaxed
        own = stage(met.where("need_turn is not null").join(later, "conv_id", "left_semi").select("conv_id", "call_id", "need"), "needs")
        calm = state.join(later, "conv_id", "left_anti")
        now = stage(state.join(later, "conv_id", "left_semi"), "ready")
        # after each round the state holds all paths of fewer than ``step`` needs, and jumps are the paths of just so many
        ids, step = ["conv_id", "call_id"], 1
        sizes = stage(now.groupBy("conv_id").agg(F.count("*").alias("size")), "sizes")
        jumps, caught = own, now.select(*ids).limit(0)
        while True:
            # a path as long as its conversation has calls comes by one of them twice
            long = jumps.join(sizes.where(F.col("size") <= step), "conv_id", "left_semi")
            caught = stage(caught.unionByName(long.select(*ids).distinct()), "caught")
            jumps = stage(jumps.join(sizes.where(F.col("size") > step), "conv_id", "left_semi"), "jumps")
            if jumps.isEmpty():
                break
            before = now.select("conv_id", F.col("call_id").alias("need"), F.struct(F.col("ready.t").alias("t"), (F.col("ready.h") + step).alias("h")).alias("after"))
            most = jumps.join(before, ["conv_id", "need"]).groupBy(*ids).agg(F.max("after").alias("after"))
            # null turns sort first, and so lose
            now = stage(now.join(most, ids, "left").select(*ids, F.when(F.col("after") > F.col("ready"), F.col("after")).otherwise(F.col("ready")).alias("ready"), "lost"), "ready")
            on = jumps.select("conv_id", F.col("call_id").alias("need"), F.col("need").alias("further"))
            jumps, step = stage(jumps.join(on, ["conv_id", "need"]).select(*ids, F.col("further").alias("need")).distinct(), "jumps"), step * 2
        # a call in or behind a cycle never gets ready: it keeps its own turn
        stays = now.join(nodes, ids).join(caught.withColumn("stuck", F.lit(True)), ids, "left").withColumn("stuck", F.coalesce("stuck", F.lit(False)))
        now = stays.select(*ids, F.when(F.col("stuck"), F.struct(F.col("turn").alias("t"), F.lit(0).alias("h"))).otherwise(F.col("ready")).alias("ready"), "lost", "stuck")
        state = calm.unionByName(now)
    return state.select("conv_id", "call_id", F.col("ready.t").alias("ready_turn"), F.col("ready.h").alias("hops"), "lost", "stuck")


def link(calls: DataFrame, results: DataFrame, schemas: list[tuple] = SCHEMAS) -> DataFrame:
    """Per call, and per result without one: conv_id, turn, call_id, name, ready_turn, hops, result_turn, valid, problems, json."""
    calls = calls.select(*CALLS)
    answers = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("answers"), F.min(F.struct("turn", "content")).alias("answer"))
    used = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("uses"))
    ids = ["conv_id", "call_id"]
    rows = calls.join(answers, ids, "left").join(used, ids, "left").join(_ready(calls), ids, "left")
    found = F.concat(
        problems_of(F.col("arguments"), F.col("name"), schemas),
        F.array_compact(F.array(
            F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no identifier"),
            F.when(F.col("uses") > 1, "repeated identifier"),
            F.when(F.col("answers").isNull(), "no result"),
            F.when(F.col("answers") > 1, "several results"),
            F.when(F.col("lost") > 0, "missing need"),
            F.when(F.col("stuck"), "cycle"),
        )),
    )
    rows = rows.withColumn("problems", F.array_join(found, ","))
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")),
        F.lit(',"call_id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")),
        F.lit(',"result":'), quoted(F.col("answer.content")), F.lit("}"),
    )
    linked = rows.select(
        "conv_id", "turn", "call_id", "name", F.coalesce("ready_turn", "turn").alias("ready_turn"), F.coalesce("hops", F.lit(0)).alias("hops"),
        F.col("answer.turn").alias("result_turn"), (F.col("problems") == "").alias("valid"), "problems", json.alias("json"))
    return linked.unionByName(_without_call(calls, results)).unionByName(_surplus(calls, results, answers))


def _result_row(rows: DataFrame, problems: Column) -> DataFrame:
    """Results (conv_id, turn, call_id, content) in the columns of ``link``, reported with ``problems``."""
    json = F.concat(F.lit('{"arguments":null,"call_id":'), F.coalesce(quoted(F.col("call_id")), F.lit("null")), F.lit(',"name":null,"result":'), F.coalesce(quoted(F.col("content")), F.lit("null")), F.lit("}"))
    return rows.select(
        "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.col("turn").alias("ready_turn"), F.lit(0).alias("hops"),
        F.col("turn").alias("result_turn"), F.lit(False).alias("valid"), problems.alias("problems"), json.alias("json"))


def _surplus(calls: DataFrame, results: DataFrame, answers: DataFrame) -> DataFrame:
    """The results that a call has besides the one it takes. Equal ones are counted first, so no identifier gathers rows."""
    ids = ["conv_id", "call_id"]
    several = answers.where("answers > 1").join(calls.select(*ids).distinct(), ids, "left_semi")
    counted = results.where("conv_id is not null and call_id is not null").groupBy(*ids, "turn", "content").agg(F.count("*").alias("n"))
    met = attach(counted, several, ids, "answers")
    taken = F.col("turn").eqNullSafe(F.col("answer.turn")) & F.col("content").eqNullSafe(F.col("answer.content"))
    left = met.withColumn("n", F.col("n") - taken.cast("int")).where("n > 0")
    return _result_row(left.select(*ids, "turn", "content", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))), F.lit("surplus result"))


def _without_call(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results that no call asks for, in the columns of ``link``."""
    asked = calls.select("conv_id", "call_id").distinct()
    rest = results.join(asked, ["conv_id", "call_id"], "left_anti")
    unnamed = F.col("conv_id").isNull() | F.col("call_id").isNull()
    return _result_row(rest, F.array_join(F.array_compact(F.array(F.when(unnamed, "no identifier"), F.lit("no call"))), ","))


def other_messages(messages: DataFrame) -> DataFrame:
    """Messages that neither call nor answer, in the columns of ``link``: system texts, and missing or unknown roles, which are reported."""
    role = F.col("role")
    rows = messages.where(role.isNull() | ~role.isin("user", "assistant", "tool"))
    problems = F.array_join(F.array_compact(F.array(
        F.when(F.col("conv_id").isNull(), "no identifier"), F.when(role.isNull(), "no role").when(role != "system", "unknown role"))), ",")
    json = F.concat(F.lit('{"content":'), F.coalesce(quoted(F.col("text")), F.lit("null")), F.lit(',"role":'), F.coalesce(quoted(role), F.lit("null")), F.lit("}"))
    return rows.select(
        "conv_id", "turn", F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("name"), F.col("turn").alias("ready_turn"), F.lit(0).alias("hops"),
        F.lit(None).cast("bigint").alias("result_turn"), (problems == "").alias("valid"), problems.alias("problems"), json.alias("json"))


def format_chats(messages: DataFrame, schemas: list[tuple] = SCHEMAS) -> DataFrame:
    """All calls of plain and tool-using conversations, linked, the results that none takes, and all other messages."""
    messages = messages.select("conv_id", "turn", "role", "text")
    linked = link(reply_calls(messages).unionByName(explicit_calls(messages)), reply_results(messages).unionByName(explicit_results(messages)), schemas)
    return linked.unionByName(other_messages(messages))
