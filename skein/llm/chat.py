"""Chat formatting with tool calls: link calls and results, order them, validate arguments, serialise canonical JSON.

An assistant's text that is a JSON object with ``tool_calls`` makes calls: a list of objects with id, name, arguments (an
object, or one written as a string) and, optionally, depends_on, a list of ids whose results the call needs. A text of
role ``tool`` that is a JSON object with ``tool_call_id`` and content is a result. All else is a plain message.

Results and calls of a conversation are hash-joined by identifier. The links order rows topologically: a row comes after
its own turn's place and after every row that it follows, so (order_turn, order_level, turn) sorts a conversation, and
rows already in order keep their turns. Chains of links are followed by doubling steps, so that a chain's length costs
rounds by its logarithm only; rows that wait for several others cost a round for each of those in a line. Arguments are
checked against the tool's schema, by property: type, enum, minimum, maximum, required properties and, where
additionalProperties is false, unknown ones; ``schema_table`` refuses schemas with other keywords that would restrict.
As in JSON schemas, 1.0 is an integer. Rows are serialised as JSON without white space, keys in order, nested arguments too.

Plain messages pass by; only rows with calls or results are joined, by (conversation, identifier) and never by
conversation alone, so a conversation with a third of all rows is no group here. The result has a row per row.

Defined results: a null text or role is a JSON null; a null turn sorts first; null conversations are one conversation.
Of calls that repeat an identifier the first (by turn, then place) is the one results link to, and the others have the
problem ``repeated id``. A result without a call has the problem ``no call``; a call without a result has none. Rows in
a circle of links, and those that follow it, keep their own turn and have the problem ``circular``. Text that isn't
valid JSON of these forms is a plain message. Repeated rows give repeated rows; an empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import small_or_shuffled, stage

CALLS = "struct<content:string,tool_calls:array<struct<arguments:string,depends_on:array<string>,id:string,name:string>>>"
RESULT = "struct<content:string,tool_call_id:string>"
SCHEMA = "name string, property string, types array<string>, required boolean, enum array<string>, minimum double, maximum double, closed boolean"
#: Keywords of schemas that are checked, of the arguments and of a property; and those that restrict nothing. Fixed values.
CHECKED = {"type", "properties", "required", "additionalProperties"}
CHECKED_OF_PROPERTY = {"type", "enum", "minimum", "maximum"}
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
#: What sorts before every turn.
FIRST = -(1 << 63)


def _one_form(value):
    """Whole numbers as integers, as canonical JSON has them."""
    return int(value) if isinstance(value, float) and value.is_integer() else value


def schema_table(spark: SparkSession, tools: dict[str, dict]) -> DataFrame:
    """A row for each property of the tools' JSON schemas, and one without a property for each tool.

    Raises ValueError for a schema with keywords that aren't checked.
    """
    rows = []
    for name, schema in tools.items():
        required, properties, more = set(schema.get("required", ())), schema.get("properties", {}), schema.get("additionalProperties", True)
        odd = {k for k in schema if k not in CHECKED | NOTES} | {k for own in properties.values() for k in own if k not in CHECKED_OF_PROPERTY | NOTES}
        if odd or schema.get("type", "object") != "object" or not isinstance(more, bool):
            raise ValueError(f"schema of {name}: can't check {', '.join(sorted(odd)) or 'its type or additionalProperties'}")
        rows.append((name, None, None, False, None, None, None, not more))
        for key in sorted(required | properties.keys()):
            own = properties.get(key, {})
            types = [own["type"]] if isinstance(own.get("type"), str) else own.get("type")
            enum = [json.dumps(_one_form(v), separators=(",", ":"), sort_keys=True, ensure_ascii=False) for v in own["enum"]] if "enum" in own else None
            limits = [None if own.get(k) is None else float(own[k]) for k in ("minimum", "maximum")]
            rows.append((name, key, types, key in required, enum, *limits, False))
    return spark.createDataFrame(rows, SCHEMA)


def json_of(value: Column) -> Column:
    """A scalar as JSON."""
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def canonical(text: Column) -> Column:
    """JSON text without white space and with each object's keys in order; null if it isn't valid JSON."""
    return F.to_json(F.try_parse_json(text))


def _object(*fields: tuple[str, Column]) -> Column:
    """A JSON object of fields that are JSON already; those that are null are left out. Keys come in the given order."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), value) for name, value in fields)), F.lit("}"))


def _call_json(call: Column) -> Column:
    return _object(
        ("arguments", F.coalesce(canonical(call["arguments"]), json_of(call["arguments"]))),
        ("depends_on", F.to_json(call["depends_on"], {"ignoreNullFields": "false"})),
        ("id", json_of(call["id"])),
        ("name", json_of(call["name"])),
    )


def _kind(kind: Column) -> Column:
    """The JSON schema type of a variant's type."""
    return (
        F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("null")
    )


def _argument_problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(rid, problem) for the calls (rid, call, name, arguments) whose arguments break their tool's schema."""
    named = F.concat(F.col("name"), F.lit("."), F.col("property"), F.lit(": "))
    tools = schemas.filter("property IS NULL").select(F.col("name").alias("known"), "closed")
    known = calls.join(small_or_shuffled(tools), F.col("name") == F.col("known"), "left")
    unknown = known.filter("known IS NULL").select("rid", F.concat(F.lit("unknown tool "), F.coalesce("name", F.lit("null"))).alias("problem"))
    parsed = known.filter("known IS NOT NULL").select("rid", "call", "name", "closed", F.try_parse_json("arguments").alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    shapeless = parsed.filter(~is_object).select("rid", F.concat("name", F.lit(": arguments are no object")).alias("problem"))
    objects = parsed.filter(is_object)
    tvf = calls.sparkSession.tvf.variant_explode(F.col("v").outer())
    given = objects.lateralJoin(tvf).select(
        "rid", "call", "name", "closed", F.col("key").alias("property"), _kind(F.schema_of_variant("value")).alias("kind"), F.to_json("value").alias("value")
    )
    properties = schemas.filter("property IS NOT NULL").drop("closed")
    wanted = objects.select("rid", "call", "name").join(small_or_shuffled(properties), "name")
    pairs = wanted.join(given.drop("name", "closed"), ["rid", "call", "property"], "left")
    is_number = F.col("kind").isin("integer", "number")
    number = F.when(is_number, F.col("value").try_cast("double"))
    kind = F.when(is_number & (number == F.floor(number)), "integer").otherwise(F.col("kind"))
    fits = F.col("types").isNull() | F.array_contains("types", kind) | (F.array_contains("types", F.lit("number")) & (kind == "integer"))
    problem = (
        F.when(F.col("kind").isNull(), F.when(F.col("required"), F.concat(named, F.lit("missing"))))
        .when(~fits, F.concat(named, kind, F.lit(" instead of "), F.array_join("types", " or ")))
        .when(F.col("enum").isNotNull() & ~F.array_contains("enum", F.col("value")), F.concat(named, F.lit("not allowed")))
        .when(number < F.col("minimum"), F.concat(named, F.lit("too small")))
        .when(number > F.col("maximum"), F.concat(named, F.lit("too large")))
    )
    broken = pairs.select("rid", problem.alias("problem")).filter("problem IS NOT NULL")
    extra = given.filter("closed AND property IS NOT NULL").join(small_or_shuffled(properties.select("name", "property")), ["name", "property"], "left_anti").select("rid", F.concat(named, F.lit("unknown")).alias("problem"))
    return unknown.unionByName(shapeless).unionByName(broken).unionByName(extra)


def _chain_steps(single: DataFrame) -> DataFrame:
    """Rows that follow one other, with the row that their chain begins after: (rid, ptr, m, c, n).

    ``single``: rid, the row that it follows (ptr), and its turn (t). What comes after a place (t, level) gets (m, c) if
    m > t, else (t, level + n). Each round doubles the length of the chains. Rows in a circle, or after one, are left out.
    """
    jumps = stage(single.select("rid", "ptr", F.col("t").alias("m"), F.lit(0).cast("long").alias("c"), F.lit(1).cast("long").alias("n")), "jumps")
    ids = jumps.select(F.col("rid").alias("ptr"))
    found, left = jumps.join(ids, "ptr", "left_anti").withColumn("open", F.lit(False)), jumps.join(ids, "ptr", "left_semi").withColumn("open", F.lit(True))
    found, left = stage(found.select("rid", "ptr", "m", "c", "n", "open"), "chains"), stage(left.select("rid", "ptr", "m", "c", "n", "open"), "chains")
    while not left.isEmpty():
        steps = found.unionByName(left).toDF("ptr", "to", "m0", "c0", "n0", "goes_on")
        later = F.col("m") > F.col("m0")
        moved = left.join(steps, "ptr").select(
            "rid", F.col("to").alias("ptr"), F.greatest("m", "m0").alias("m"), F.when(later, F.col("c")).otherwise(F.col("c0") + F.col("n")).alias("c"), (F.col("n0") + F.col("n")).alias("n"), F.col("goes_on").alias("open")
        )
        moved = stage(moved, "chains")
        ends = moved.filter("NOT open")
        if ends.isEmpty():  # no chain is this long, so what is left goes in circles
            break
        found, left = found.unionByName(ends), moved.filter("open")
    return found.drop("open")


def _places(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(rid, order_turn, order_level, circular): each row after its predecessors."""
    nodes = rows.select("rid", F.coalesce("turn", F.lit(FIRST)).alias("t"))
    degree = stage(edges.groupBy(F.col("to").alias("rid")).agg(F.count(F.lit(1)).alias("degree"), F.min("from").alias("ptr")), "degrees")
    follows = _chain_steps(degree.filter("degree = 1").select("rid", "ptr").join(nodes, "rid"))
    place = F.struct("t", F.lit(0).cast("long").alias("level"))
    after = F.when(F.col("m") > F.col("place.t"), F.struct(F.col("m").alias("t"), F.col("c").alias("level"))).otherwise(F.struct(F.col("place.t").alias("t"), (F.col("place.level") + F.col("n")).alias("level")))
    # rows that follow none, then those that follow several, as soon as the last of these has its place
    front = stage(nodes.join(degree, "rid", "left_anti").select("rid", place.alias("place")), "placed")
    heads, several = front, degree.filter("degree > 1").select("rid", "degree")
    links = edges.join(several.select(F.col("rid").alias("to")), "to", "left_semi").join(follows.withColumnRenamed("rid", "from"), "from", "left")
    links = stage(links.select("to", F.coalesce("ptr", "from").alias("ptr"), "m", "c", "n"), "waits")
    arrived = None
    while not links.isEmpty() and not front.isEmpty():
        own = F.when(F.col("m").isNull(), F.col("place")).otherwise(after)
        got = links.join(front.withColumnRenamed("rid", "ptr"), "ptr").select(F.col("to").alias("rid"), own.alias("last"), F.lit(1).cast("long").alias("had"))
        got = got if arrived is None else got.unionByName(arrived)
        arrived = stage(got.groupBy("rid").agg(F.max("last").alias("last"), F.sum("had").alias("had")), "arrived")
        own = F.when(F.col("t") > F.col("last.t"), place).otherwise(F.struct(F.col("last.t").alias("t"), (F.col("last.level") + 1).alias("level")))
        front = stage(arrived.join(several, "rid").filter("had = degree").join(nodes, "rid").select("rid", own.alias("place")), "placed")
        arrived = arrived.join(front, "rid", "left_anti")
        heads = heads.unionByName(front)
    done = heads.unionByName(follows.join(heads.withColumnRenamed("rid", "ptr"), "ptr").select("rid", after.alias("place")))
    done = stage(done, "placed")
    circular = nodes.join(done, "rid", "left_anti").select("rid", place.alias("place"), F.lit(True).alias("circular"))
    both = done.withColumn("circular", F.lit(False)).unionByName(circular)
    return both.select("rid", F.expr(f"nullif(place.t, {FIRST})").alias("order_turn"), F.col("place.level").alias("order_level"), "circular")


def _tool_rows(rows: DataFrame, schemas: DataFrame | None) -> DataFrame:
    """The formatted rows that make calls or hold results. ``rows``: staged, with rid."""
    calling = rows.filter("made IS NOT NULL")
    calls = calling.select("rid", "conv_id", "turn", F.posexplode("made.tool_calls").alias("call", "c")).select("rid", "conv_id", "turn", "call", "c.*")
    first = calls.filter("id IS NOT NULL").groupBy(F.col("conv_id").alias("conv"), F.col("id").alias("call_id")).agg(
        F.min(F.struct("turn", "rid", "call", "name")).alias("first")
    )
    first = stage(first, "calls")
    results = rows.filter("made IS NULL").select("rid", "conv_id", "turn", "got.tool_call_id")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("tool_call_id") == F.col("call_id"))
    linked = stage(results.join(first, same, "left").select("rid", "conv_id", "turn", "tool_call_id", "first"), "results")
    got = linked.groupBy(F.col("conv_id").alias("conv"), F.col("tool_call_id").alias("call_id")).agg(F.min(F.struct("turn", "rid")).alias("result"))
    needs = calls.select("rid", "conv_id", F.explode("depends_on").alias("tool_call_id")).join(got, same).select(F.col("result.rid").alias("from"), F.col("rid").alias("to"))
    follows = linked.filter("first IS NOT NULL").select(F.col("first.rid").alias("from"), F.col("rid").alias("to"))
    edges = stage(follows.unionByName(needs).distinct(), "tool-links")

    own = F.col("first.rid").eqNullSafe(F.col("rid")) & F.col("first.call").eqNullSafe(F.col("call"))
    again = calls.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("id") == F.col("call_id"))).filter(~own)
    problems = again.select("rid", F.lit("repeated id").alias("problem")).unionByName(linked.filter("first IS NULL").select("rid", F.lit("no call").alias("problem")))
    if schemas is not None:
        problems = problems.unionByName(_argument_problems(calls.select("rid", "call", "name", "arguments"), schemas))
    places = _places(rows, edges)
    problems = problems.unionByName(places.filter("circular").select("rid", F.lit("circular").alias("problem")))
    problems = problems.groupBy("rid").agg(F.concat_ws("; ", F.array_sort(F.collect_set("problem"))).alias("problems"))

    call_list = F.concat(F.lit("["), F.array_join(F.transform("made.tool_calls", _call_json), ","), F.lit("]"))
    call_text = _object(("content", json_of(F.col("made.content"))), ("role", json_of(F.col("role"))), ("tool_calls", call_list))
    result_text = _object(("content", json_of(F.col("got.content"))), ("name", json_of(F.col("name"))), ("role", json_of(F.col("role"))), ("tool_call_id", json_of(F.col("got.tool_call_id"))))
    names = linked.select("rid", F.col("first.name").alias("name"), F.col("first.turn").alias("call_turn"))
    whole = rows.join(places, "rid").join(names, "rid", "left").join(problems, "rid", "left")
    return whole.select(
        "conv_id", "turn",
        F.when(F.col("made").isNotNull(), "calls").otherwise("result").alias("kind"),
        "order_turn", "order_level",
        F.coalesce(F.size("made.tool_calls"), F.lit(0)).cast("long").alias("n_calls"),
        "call_turn",
        F.coalesce("problems", F.lit("")).alias("problems"),
        F.when(F.col("made").isNotNull(), call_text).otherwise(result_text).alias("message"),
    )


def format_chat(turns: DataFrame, schemas: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per row: conv_id, turn, kind, order_turn, order_level, n_calls, call_turn, problems, message.

    ``schemas``: the table that ``schema_table`` makes; without one arguments aren't validated.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    begins = F.coalesce(F.ltrim("text").startswith("{"), F.lit(False))
    may_call = begins & (F.col("role") == "assistant") & F.contains("text", F.lit('"tool_calls"'))
    may_answer = begins & (F.col("role") == "tool") & F.contains("text", F.lit('"tool_call_id"'))
    # valid JSON only, so that what is read is what is there
    valid = F.try_parse_json("text").isNotNull()
    made = F.when(may_call & valid, F.from_json("text", CALLS))
    made = F.when(F.size(made["tool_calls"]) > 0, made)
    got = F.when(may_answer & valid, F.from_json("text", RESULT))
    got = F.when(got["tool_call_id"].isNotNull(), got)
    some = F.coalesce((may_call & made.isNotNull()) | (may_answer & got.isNotNull()), F.lit(False))
    null = F.lit(None)
    plain = rows.filter(~some).select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_level"), F.lit(0).cast("long").alias("n_calls"),
        null.cast("long").alias("call_turn"), F.lit("").alias("problems"), _object(("content", json_of(F.col("text"))), ("role", json_of(F.col("role")))).alias("message"),
    )
    tools = stage(rows.filter(some).select("conv_id", "turn", "role", made.alias("made"), got.alias("got"), F.monotonically_increasing_id().alias("rid")), "tool-rows")
    return plain if tools.isEmpty() else plain.unionByName(_tool_rows(tools, schemas))
