"""Chat formatting: tool calls linked with their results, put in an order that respects their references, checked against
schemas, and written as canonical JSON. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurix.llm.common import Scratch

#: A schema names a tool's arguments with their type and whether they are required.
Schema = dict[str, tuple[str, bool]]
#: A reference to another call of the conversation: a string argument "$id".
REFERENCE = r'"\$([^"\\]+)"'
#: References to one call that a task takes at most, and rounds of levels in one job at most.
PART, ROUNDS = 50_000, 16


def has_type(value: Column, kind: str) -> Column:
    own = F.schema_of_variant(value)
    tests = {
        "string": own == "STRING", "integer": own == "BIGINT", "boolean": own == "BOOLEAN", "object": own.startswith("OBJECT"), "array": own.startswith("ARRAY"),
        "number": own.isin("BIGINT", "DOUBLE", "FLOAT") | own.startswith("DECIMAL"),
    }
    return tests[kind]


def problems(name: Column, arguments: Column, schemas: dict[str, Schema]) -> Column:
    """What is wrong with a call's arguments: an array of strings, in the order of the schema. Schemas are part of the
    plan, so checking is an expression and no join."""
    v = F.try_parse_json(arguments)
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        found = []
        for arg, (kind, required) in schema.items():
            value = F.try_variant_get(v, f"$['{arg}']", "variant")
            if required:
                found.append(F.when(value.isNull(), F.lit(f"missing {arg}")))
            found.append(F.when(value.isNotNull() & ~has_type(value, kind), F.lit(f"{arg} is no {kind}")))
        extra = F.transform(F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, schema)))), lambda x: F.concat(F.lit("unknown "), x))
        out = F.when(name == tool, F.concat(F.array_compact(F.array(*found)), F.coalesce(extra, F.array().cast("array<string>")))).otherwise(out)
    return F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.array(F.lit("arguments are no JSON object"))).otherwise(out)


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """A level for each call (conv_id, call_id, position, arguments), so that (level, position) puts each call after those
    that it refers to: conv_id, call_id, level, cyclic.

    A reference to an earlier call needs no higher level than that call's, one to a later call the next. A call on or
    behind a cycle is cyclic, and has the number of its conversation's forward references and one more.

    Conversations without forward references need nothing. In the others, calls with one reference are a step of a
    chain: chains are doubled, a step of 2^k calls joined with the one that it ends at, until they end at a call with
    none or several, in as many rounds as the logarithm of the longest chain; a chain still open when it has more steps
    than its conversation has such calls runs into a cycle. Calls with several references then get theirs from `peeled`;
    who never gets one is cyclic, however long the cycle.
    """
    nodes = calls.select("conv_id", "call_id", "position")
    refs = calls.select("conv_id", "call_id", "position", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("to"))
    edges = refs.join(nodes.select("conv_id", F.col("call_id").alias("to"), F.col("position").alias("to_position")), ["conv_id", "to"])
    step = F.coalesce(F.col("to_position") >= F.col("position"), F.lit(True))  # without a place in the conversation, a call is taken for later
    edges = scratch.table(edges.select("conv_id", "call_id", "to", step.cast("int").alias("step")), "references")
    most = scratch.table(edges.groupBy("conv_id").agg(F.sum("step").alias("most")).where("most > 0"), "forward")
    flat = nodes.select("conv_id", "call_id")
    if most.isEmpty():
        return flat.withColumns({"level": F.lit(0), "cyclic": F.lit(False)})
    edges = edges.join(most.select("conv_id"), "conv_id")
    degree = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("out"))
    edges = scratch.table(edges.join(degree, ["conv_id", "call_id"]), "edges")

    chains = scratch.table(edges.where("out = 1").select("conv_id", "call_id", "to", F.col("step").cast("long").alias("step")), "chains")
    longest = chains.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    steps = 1
    while steps <= longest:
        on = chains.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("end"), F.col("step").alias("more"))
        after = chains.join(on, ["conv_id", "to"], "left").select("conv_id", "call_id", F.coalesce("end", "to").alias("to"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"))
        chains, steps = scratch.table(after, "chains"), 2 * steps

    single = chains.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("end"), F.col("step").alias("more"))
    several = edges.where("out > 1").join(single, ["conv_id", "to"], "left")
    several = several.select("conv_id", "call_id", F.coalesce("end", "to").alias("to"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"), "out")
    several = scratch.table(several, "several")  # what a cycle's chain ends at is a step of it, and never has a level
    sources = edges.select("conv_id", "call_id").distinct()
    known = edges.select("conv_id", F.col("to").alias("call_id")).distinct().join(sources, ["conv_id", "call_id"], "left_anti")
    known = peeled(several, known, scratch)
    ends = known.select("conv_id", F.col("call_id").alias("to"), "level")
    known = known.union(chains.join(ends, ["conv_id", "to"]).select("conv_id", "call_id", (F.col("level") + F.col("step")).alias("level")))
    out = flat.join(most, "conv_id", "left").join(known, ["conv_id", "call_id"], "left").join(sources.withColumn("refers", F.lit(True)), ["conv_id", "call_id"], "left")
    cyclic = F.col("level").isNull() & F.col("refers").isNotNull()
    level = F.when(cyclic, F.col("most") + 1).otherwise(F.coalesce("level", F.lit(0))).cast("int")
    return out.select("conv_id", "call_id", level.alias("level"), cyclic.alias("cyclic"))


def told(state: DataFrame, edges: DataFrame) -> DataFrame:
    """One round: calls that have heard of all their references tell their level to those that refer to them."""
    ready = ~F.col("done") & (F.col("have") == F.col("out"))
    salts = F.when(ready, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(-1)))
    met = state.withColumn("salt", F.explode(salts)).join(edges, ["conv_id", "call_id", "salt"], "left")
    own = F.struct("call_id", "have", "out", "parts", "level", (F.col("done") | (F.col("salt") >= 0)).alias("done"))
    word = F.struct(
        F.col("from_id").alias("call_id"), F.lit(1).cast("long").alias("have"), F.col("from_out").alias("out"), F.col("from_parts").alias("parts"),
        (F.col("level") + F.col("step")).alias("level"), F.lit(False).alias("done"),
    )
    rows = met.select("conv_id", F.inline(F.array_compact(F.array(own, F.when(F.col("from_id").isNotNull(), word)))))
    return rows.groupBy("conv_id", "call_id").agg(F.sum("have").alias("have"), *[F.max(c).alias(c) for c in ("out", "parts", "level", "done")])


def peeled(several: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """Levels (conv_id, call_id, level) of the calls of `known` (conv_id, call_id), which refer to nothing, and of those
    whose references in `several` (conv_id, call_id, to, step, out: how many the call has) all get one.

    Only calls that are new or wait for some of their references are carried on: a round joins the new ones with what
    refers to them, and adds up what each call has heard. A job is 1, 2, 4, 8 and then 16 rounds, and writes one table;
    from there on the references that were used go as well. References to one call are dealt in parts of PART.
    """
    fan = several.groupBy("conv_id", F.col("to").alias("call_id")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    edges = several.join(fan, ["conv_id", "call_id"], "left").withColumn("from_parts", F.coalesce("parts", F.lit(1))).drop("parts")
    edges = edges.withColumnsRenamed({"call_id": "from_id", "to": "call_id", "out": "from_out"}).join(fan, ["conv_id", "call_id"])
    edges = scratch.table(edges.withColumn("salt", F.pmod(F.hash("from_id"), "parts")).drop("parts"), "dealt")
    nothing = F.lit(0).cast("long")
    state = known.join(fan, ["conv_id", "call_id"], "left").select("conv_id", "call_id", nothing.alias("have"), nothing.alias("out"), F.coalesce("parts", F.lit(1)).alias("parts"), nothing.alias("level"), F.lit(False).alias("done"))
    rounds, found = 1, []
    while True:
        for _ in range(rounds):
            state = told(state, edges)
        state = scratch.table(state, "peeled")
        new = state.where("done").select("conv_id", "call_id", "level")
        found.append(new)
        state = state.where("not done")
        if state.where("have = out").isEmpty():
            return reduce(DataFrame.union, found)
        if len(found) == ROUNDS:
            found = [scratch.table(reduce(DataFrame.union, found), "found")]
        if rounds == ROUNDS:
            edges = scratch.table(edges.join(new, ["conv_id", "call_id"], "left_anti"), "dealt")
        rounds = min(2 * rounds, ROUNDS)


def first_of(df: DataFrame, *rest: str) -> DataFrame:
    """The first row by position of each (conv_id, call_id). A minimum, so that an id repeated very often is summed up
    before it is shuffled."""
    return df.groupBy("conv_id", "call_id").agg(F.min(F.struct("position", *rest)).alias("x"), F.count("*").alias("times")).select("conv_id", "call_id", "x.*", "times")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema], spark: SparkSession) -> DataFrame:
    """Calls (conv_id, call_id, position, name, arguments: JSON) with their results (conv_id, call_id, position, content).

    Returns a row for each call and each result without one: conv_id, level, position (order a conversation by these,
    then call_id), call_id, status, problems and message, the canonical JSON (keys sorted, no blanks, null fields left
    out) of call, arguments and result. status is ok, invalid, unanswered, cyclic, early (the result stands before its
    call) or orphan (a result without a call). Of rows that repeat an id in a conversation the first counts, by
    position (null first) and then by content. Rows with a null id are left out, as nothing can link them; a null
    conversation is one. Arguments that are no JSON, or more than a variant holds, are invalid, and stand in the
    message as the text that they are; very long contents stand there whole. Empty tables give an empty one.

    The join is on conversation and id, both sides unique on them, so a conversation with a third of all rows is
    spread by its ids, and no conversation is gathered: its order is a pair of columns.
    """
    scratch = Scratch(spark, "chat")
    known = lambda df: df.where("call_id is not null").withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    calls = scratch.table(first_of(known(calls), "name", "arguments").drop("times"), "calls")
    results = first_of(known(results), "content").select("conv_id", "call_id", F.col("position").alias("result_position"), "content", F.lit(True).alias("answered"))
    out = calls.withColumn("called", F.lit(True)).hint("shuffle_hash").join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    out = out.join(levels(calls, scratch), ["conv_id", "call_id"], "left")
    wrong = F.when(F.col("called"), problems(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    status = (
        F.when(F.col("called").isNull(), "orphan").when(F.col("cyclic"), "cyclic").when(F.size("problems") > 0, "invalid")
        .when(F.col("answered").isNull(), "unanswered").when(F.col("result_position") < F.col("position"), "early").otherwise("ok")
    )
    # canonical arguments are put together with the rest as text, so that no message has to fit into one variant
    parsed = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    text = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.array(c))) - 2)
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))
    block = lambda *fields: F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    some = lambda c: F.when(F.col(c).isNotNull(), text(F.col(c)))
    call = F.when(F.col("called"), block(field("arguments", parsed), field("id", some("call_id")), field("name", some("name"))))
    result = F.when(F.col("answered"), block(field("call_id", some("call_id")), field("content", some("content"))))
    message = block(field("call", call), field("result", result), field("status", text(F.col("status"))))
    out = out.withColumn("problems", wrong).withColumn("status", status)
    out = out.select("conv_id", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("position", "result_position").alias("position"), "call_id", "status", "problems", message.alias("message"))
    return scratch.table(out, "linked")


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The exchanges of plain conversations (conv_id, turn, role, text), which hold no tool calls, as such by rule: a user's
    turn is a call of the tool `reply`, and an assistant's turn t the result of turn t - 1. Other roles do neither.

    With r = turn div 2 mod 5, a call refers to nothing (r = 4), or to turns after it: t + 2 and t + 6 (0), t + 2 (1),
    t + 4 (2); or before it: t - 2 (3). In every seventh conversation, r = 1 refers to t - 2, which closes a cycle.
    Every eleventh turn calls an unknown tool; a text of a multiple of 13 characters is left out of the arguments, the
    `limit` of r = 3 is no integer, and r = 1 has an argument that the schema doesn't know.
    """
    id_ = lambda at: F.concat(F.lit("t"), F.col("turn") + at)
    ref = lambda at: F.concat(F.lit("$"), id_(at))
    user, assistant = (conversations.where((F.col("role") == r) & F.col("turn").isNotNull()) for r in ("user", "assistant"))
    r = F.expr("turn div 2") % 5
    after = F.when((r == 1) & (F.col("conv_id") % 7 == 3), ref(-2)).when(r <= 1, ref(2)).when(r == 2, ref(4)).when(r == 3, ref(-2))
    plain = F.to_json(F.struct(
        after.alias("after"), F.when(r == 0, ref(6)).alias("also"), F.when(r == 1, F.lit(True)).alias("extra"), F.when(r != 3, F.col("turn")).alias("limit"),
        F.when(F.length("text") % 13 != 0, F.col("text")).alias("prompt"),
    ))
    arguments = F.when(r == 3, F.concat(F.lit('{"limit":"x",'), F.substring(plain, 2, 1 << 30))).otherwise(plain)
    name = F.when(F.col("turn") % 11 == 0, "answer").otherwise("reply")
    calls = user.select("conv_id", id_(0).alias("call_id"), F.col("turn").alias("position"), name.alias("name"), arguments.alias("arguments"))
    return calls, assistant.select("conv_id", id_(-1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))


REPLY: dict[str, Schema] = {"reply": {"prompt": ("string", True), "after": ("string", False), "also": ("string", False), "limit": ("integer", False)}}


def op2(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    return link(*turns(conversations), REPLY, spark).withColumn("problems", F.array_join("problems", ","))


SQL = """
WITH RECURSIVE u AS (SELECT conv_id, turn, text, turn // 2 % 5 AS r FROM conversations WHERE role = 'user'),
c AS (
  SELECT *, CASE WHEN r = 1 AND conv_id % 7 = 3 THEN turn - 2 WHEN r <= 1 THEN turn + 2 WHEN r = 2 THEN turn + 4 WHEN r = 3 THEN turn - 2 END AS after,
         CASE WHEN r = 0 THEN turn + 6 END AS also FROM u),
e AS (
  SELECT a.conv_id, a.turn, a.x AS to_turn, (a.x >= a.turn)::INTEGER AS step
  FROM (SELECT conv_id, turn, after AS x FROM c UNION SELECT conv_id, turn, also FROM c) a JOIN c d ON d.conv_id = a.conv_id AND d.turn = a.x),
walk AS (
  SELECT conv_id, turn, turn AS at, 0 AS level, 0 AS n FROM c
  UNION SELECT w.conv_id, w.turn, e.to_turn, w.level + e.step, n + 1 FROM walk w JOIN e ON e.conv_id = w.conv_id AND e.turn = w.at WHERE n < 12),
most AS (SELECT conv_id, sum(step) AS most FROM e GROUP BY conv_id),
lv AS (
  SELECT walk.conv_id, walk.turn, max(n) = 12 AS cyclic, CASE WHEN max(n) = 12 THEN any_value(most) + 1 ELSE max(level) END::INTEGER AS level
  FROM walk LEFT JOIN most ON most.conv_id = walk.conv_id GROUP BY walk.conv_id, walk.turn),
k AS (
  SELECT c.conv_id, c.turn, 't' || c.turn AS call_id, CASE WHEN c.turn % 11 = 0 THEN 'answer' ELSE 'reply' END AS name, lv.level, lv.cyclic,
         CASE WHEN c.turn % 11 = 0 THEN 'unknown tool' ELSE array_to_string(list_filter([CASE WHEN length(text) % 13 = 0 THEN 'missing prompt' END,
           CASE WHEN r = 3 THEN 'limit is no integer' END, CASE WHEN r = 1 THEN 'unknown extra' END], lambda x: x IS NOT NULL), ',') END AS problems,
         '{' || array_to_string(list_filter([
           CASE WHEN after IS NOT NULL THEN '"after":"$t' || after || '"' END, CASE WHEN also IS NOT NULL THEN '"also":"$t' || also || '"' END, CASE WHEN r = 1 THEN '"extra":true' END,
           CASE WHEN r = 3 THEN '"limit":"x"' ELSE '"limit":' || c.turn END, CASE WHEN length(text) % 13 <> 0 THEN '"prompt":' || to_json(text) END], lambda x: x IS NOT NULL), ',') || '}' AS arguments
  FROM c JOIN lv ON lv.conv_id = c.conv_id AND lv.turn = c.turn),
r AS (SELECT conv_id, 't' || (turn - 1) AS call_id, turn, text FROM conversations WHERE role = 'assistant'),
j AS (
  SELECT coalesce(k.conv_id, r.conv_id)::VARCHAR AS conv_id, coalesce(level, 0) AS level, coalesce(k.turn, r.turn) AS position, coalesce(k.call_id, r.call_id) AS call_id, coalesce(problems, '') AS problems,
         CASE WHEN k.turn IS NULL THEN 'orphan' WHEN cyclic THEN 'cyclic' WHEN problems <> '' THEN 'invalid' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
         name, arguments, r.text AS content, k.turn IS NOT NULL AS called, r.turn IS NOT NULL AS answered
  FROM k FULL JOIN r ON k.conv_id = r.conv_id AND k.call_id = r.call_id)
SELECT conv_id, level, position, call_id, status, problems,
       '{' || CASE WHEN called THEN '"call":{"arguments":' || arguments || ',"id":' || to_json(call_id) || ',"name":"' || name || '"},' ELSE '' END
           || CASE WHEN answered THEN '"result":{"call_id":' || to_json(call_id) || ',"content":' || to_json(content) || '},' ELSE '' END
           || '"status":"' || status || '"}' AS message
FROM j
"""
