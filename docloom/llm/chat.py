"""Chat records with linked tool calls, as canonical JSON lines.

Calls and results are joined by conversation and identifier in a shuffled hash join, so a conversation of any length is
dealt over many tasks. A call that names another call's identifier in `after` waits for it: a call's place is the later
of its own turn and the places of the calls it waits for, and how many steps it is behind that turn's call. Places are
found in rounds on the table of waits: a wait for a call that waits for none is settled, and one for a call that waits
for one other is moved on to that other, so a chain of L calls takes some log L rounds; where calls wait for several
others, rounds grow with the depth of such calls. A call on or behind a cycle keeps its own turn and is marked: either
a wait becomes longer than its conversation has calls, or a round changes nothing. Arguments are checked against a
table of schemas (name, field, type, required). Objects are serialised with sorted keys and no spaces (the order in
which the variant type keeps keys).

Records are numbered inside a conversation without gathering it: rows are numbered inside stretches of turns, and each
stretch starts where the counts of those before it end.

Defined results: arguments that are null or no JSON object are errors and serialised as null; a call without a result
is an `open_call`, a result without a call an `orphan_result`; of results that share an identifier the first in turn
order (then by content) is linked and the others are `extra_result`s; of calls that share one, every call gets that
result; a call without an identifier links with nothing; a wait for an identifier that no call has counts for nothing;
null texts serialise as null; rows with a null conversation form one conversation; a null turn sorts first; repeated
rows are records each; other columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import store

STRETCH = 64
LEAST = -(2**63)
#: JSON type names and what the variant type calls them.
TYPES = {"string": "^STRING", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY"}

#: A conversation (a null one has a key of its own) and a call within it.
CONV = ("conv_id", "no_conv")
KEY = [*CONV, "call_id"]

CALL_BLOCK = r"(?s)<tool_call>(.*?)</tool_call>"


def schema_table(spark: SparkSession, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row for each tool: name and its fields (field, type, required)."""
    tools = [F.struct(F.lit(name).alias("name"), F.array(*[F.struct(F.lit(f).alias("field"), F.lit(TYPES[t]).alias("type"), F.lit(r).alias("required")) for f, (t, r) in fields.items()]).alias("fields")) for name, fields in schemas.items()]
    return spark.range(1).select(F.inline(F.array(*tools)))


def embedded_calls(conversations: DataFrame) -> DataFrame:
    """Calls written as <tool_call>{"id", "name", "arguments", "after"}</tool_call> in assistant turns."""
    blocks = conversations.where("role = 'assistant' and text like '%<tool_call>%'").select(*CONV, "turn", F.posexplode(F.regexp_extract_all("text", F.lit(CALL_BLOCK), 1)).alias("seq", "block"))
    get = lambda key: F.get_json_object("block", f"$.{key}")
    return blocks.select(
        *CONV, "turn", "seq", get("id").alias("call_id"), get("name").alias("name"), get("arguments").alias("arguments"),
        F.coalesce(F.from_json(get("after"), "array<string>"), F.array().cast("array<string>")).alias("after"),
    )


def embedded_results(conversations: DataFrame) -> DataFrame:
    """Results: turns of the role tool; their text is {"tool_call_id", "content"}, or else as a whole the content."""
    tool = conversations.where("role = 'tool'")
    keys = F.json_object_keys("text")
    whole = F.coalesce(F.array_contains(keys, "tool_call_id") & F.array_contains(keys, "content"), F.lit(False))
    content = F.when(whole, F.get_json_object("text", "$.content")).otherwise(F.col("text"))
    return tool.select(*CONV, "turn", F.get_json_object("text", "$.tool_call_id").alias("call_id"), content.alias("content"))


def _errors(fields: Column, values: Column) -> Column:
    """Names of fields that are missing, mistyped or unknown; one entry "arguments" where they are no object."""
    kind = lambda f: F.schema_of_variant(values[f["field"]])
    missing = F.transform(F.filter(fields, lambda f: f["required"] & ~F.map_contains_key(values, f["field"])), lambda f: F.concat(F.lit("missing:"), f["field"]))
    mistyped = F.transform(F.filter(fields, lambda f: F.map_contains_key(values, f["field"]) & ~F.coalesce(F.regexp_like(kind(f), f["type"]), F.lit(False))), lambda f: F.concat(F.lit("type:"), f["field"]))
    unknown = F.transform(F.array_except(F.map_keys(values), F.transform(fields, lambda f: f["field"])), lambda k: F.concat(F.lit("unknown:"), k))
    checked = F.array_sort(F.concat(missing, mistyped, unknown))
    return F.when(fields.isNull(), F.array(F.lit("tool"))).when(values.isNull(), F.array(F.lit("arguments"))).otherwise(checked)


def _at(turn: Column, steps: Column) -> Column:
    return F.struct(turn.alias("turn"), steps.alias("steps"))


def _places(calls: DataFrame) -> DataFrame:
    """`calls` with place (the turn it waits for, and how many steps behind that turn's call) and cyclic."""
    own = _at(F.col("turn"), F.lit(0).cast("bigint"))
    waits = calls.where("call_id is not null").select(*CONV, "call_id", F.explode("after").alias("other"))
    known = calls.where("call_id is not null").groupBy(*CONV, "call_id").agg(F.min("turn").alias("turn"))
    targets = known.select(*CONV, F.col("call_id").alias("other"))
    edges = store(waits.join(targets, [*CONV, "other"]).distinct().withColumn("steps", F.lit(1).cast("bigint")), "waits")
    if edges.df.isEmpty():
        edges.drop()
        return calls.withColumns({"place": own, "cyclic": F.lit(False)})
    # Calls that take part in a wait; all others keep their own turn. No path is longer than the most of a conversation.
    ends = edges.df.select(*CONV, "call_id").union(edges.df.select(*CONV, F.col("other").alias("call_id"))).distinct()
    nodes = store(known.join(ends, KEY, "left_semi").select(*KEY, own.alias("place"), F.lit(False).alias("cyclic")), "places")
    limit = nodes.df.groupBy(*CONV).count().agg(F.max("count")).first()[0]
    while True:
        single = edges.df.groupBy(*KEY).agg(F.count("*").alias("waits"), F.first("other").alias("next"), F.first("steps").alias("more"))
        other = nodes.df.join(single, KEY, "left").select(*CONV, F.col("call_id").alias("other"), F.col("place").alias("p"), F.col("cyclic").alias("lost"), F.coalesce("waits", F.lit(0)).alias("waits"), "next", "more")
        met = edges.df.join(other, [*CONV, "other"])
        moves = ~F.col("lost") & (F.col("waits") <= 1)
        length = F.col("steps") + F.col("more")
        seen = store(met.select(
            *KEY, F.when(moves, _at(F.col("p.turn"), F.col("p.steps") + F.col("steps"))).alias("push"), (F.col("lost") | F.coalesce(moves & (length > limit), F.lit(False))).alias("lost"),
            F.when(moves, F.col("next")).otherwise(F.col("other")).alias("other"), F.when(moves, length).otherwise(F.col("steps")).alias("steps"), moves.alias("moved"),
        ), "seen")
        pushed = seen.df.groupBy(*KEY).agg(F.max("push").alias("push"), F.max("lost").alias("lost"))
        settled = store(nodes.df.join(pushed, KEY, "left").select(*KEY, F.greatest("place", "push").alias("place"), (F.col("cyclic") | F.coalesce("lost", F.lit(False))).alias("cyclic")), "places")
        gone = settled.df.where("cyclic").select(*KEY)
        left = store(seen.df.where("other is not null").groupBy(*KEY, "other").agg(F.max("steps").alias("steps")).join(gone, KEY, "left_anti"), "waits")
        changed = not seen.df.where("moved or lost").isEmpty()
        for table in (seen, nodes, edges):
            table.drop()
        nodes, edges = settled, left
        if edges.df.isEmpty():
            break
        if not changed:  # every call that is left waits for calls that are left
            stuck = edges.df.select(*KEY).distinct().withColumn("stuck", F.lit(True))
            last = store(nodes.df.join(stuck, KEY, "left").select(*KEY, "place", (F.col("cyclic") | F.coalesce("stuck", F.lit(False))).alias("cyclic")), "places")
            nodes.drop()
            nodes = last
            break
    edges.drop()
    merged = calls.join(nodes.df.select(*KEY, "place", "cyclic"), KEY, "left")
    return merged.withColumns({"cyclic": F.coalesce("cyclic", F.lit(False)), "place": F.when(F.coalesce("cyclic", F.lit(False)) | F.col("place").isNull(), own).otherwise(F.greatest("place", own))})


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with errors and place, and results with whether they are linked; a record column names each kind."""
    key = KEY
    first = results.groupBy(*key).agg(F.min(F.struct("turn", F.coalesce("content", F.lit("")).alias("c"))).alias("first"))
    answered = first.select(*key, F.lit(True).alias("answered"))
    checked = _places(calls).join(answered.hint("shuffle_hash"), key, "left").join(schemas, "name", "left")
    values = F.from_json(F.to_json(F.try_parse_json("arguments")), "map<string,variant>")
    placed = checked.select(
        *key, "turn", "seq", "place", "cyclic", F.when(F.col("answered"), "call").otherwise("open_call").alias("record"),
        _errors(F.col("fields"), F.when(F.trim("arguments").startswith("{"), values)).alias("errors"),
        F.concat(
            F.lit('{"arguments":'), F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null")), F.lit(',"id":'), _quoted("call_id"),
            F.lit(',"name":'), _quoted("name"), F.lit(',"type":"call"}'),
        ).alias("json"),
    )
    asked = calls.groupBy(*key).agg(F.min("turn").alias("call_turn"))
    found = results.join(asked.hint("shuffle_hash"), key, "left").join(first, key, "left")
    place = F.row_number().over(Window.partitionBy(*key, "turn", F.coalesce("content", F.lit(""))).orderBy(F.lit(1)))
    is_first = (F.struct("turn", F.coalesce("content", F.lit(""))) == F.col("first")) & (F.col("nth") == 1)
    returned = found.withColumn("nth", place).select(
        *key, "turn", F.lit(0).alias("seq"), _at(F.col("turn"), F.lit(0).cast("bigint")).alias("place"), F.lit(False).alias("cyclic"),
        F.when(F.col("call_turn").isNull(), "orphan_result").when(is_first, "result").otherwise("extra_result").alias("record"), F.array().cast("array<string>").alias("errors"),
        F.concat(F.lit('{"call_id":'), _quoted("call_id"), F.lit(',"content":'), _quoted("content"), F.lit(',"type":"result"}')).alias("json"),
    )
    return placed.unionByName(returned)


def _quoted(column: str) -> Column:
    """A string as JSON, or null."""
    text = F.to_json(F.struct(F.col(column).cast("string").alias("v")))  # {"v":...}
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(text.substr(F.lit(6), F.length(text) - 6))


def numbered(records: DataFrame) -> DataFrame:
    """`records` with `position` from 0 inside each conversation, by place, turn, then what they hold."""
    dealt = records.withColumn("stretch", F.coalesce(F.floor(F.col("place.turn") / STRETCH), F.lit(LEAST)).cast("bigint"))
    counts = dealt.groupBy(*CONV, "stretch").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*CONV).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*CONV, "stretch", F.coalesce(before, F.lit(0)).alias("start"))
    order = Window.partitionBy(*CONV, "stretch").orderBy("place", "turn", "seq", "record", "json")
    inside = dealt.withColumn("_n", F.row_number().over(order) - 1)
    return inside.join(starts, [*CONV, "stretch"]).withColumn("position", (F.col("start") + F.col("_n")).cast("bigint"))


def read_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, no_conv, turn, role and text of the turns: what the other functions take."""
    conv = F.col("conv_id").cast("bigint")
    return conversations.select(F.coalesce(conv, F.lit(0)).alias("conv_id"), conv.isNull().alias("no_conv"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))


def format_records(calls: DataFrame, results: DataFrame, messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each record: conv_id, position, turn, record, call_id, cyclic, errors (comma-joined) and json.

    Calls have conv_id, no_conv, turn, seq, call_id, name, arguments (JSON) and after; results have conv_id, no_conv,
    turn, call_id and content; messages are turns as `read_turns` gives them.
    """
    plain = messages.select(
        *CONV, F.lit(None).cast("string").alias("call_id"), "turn", F.lit(-1).alias("seq"), _at(F.col("turn"), F.lit(0).cast("bigint")).alias("place"), F.lit(False).alias("cyclic"),
        F.lit("message").alias("record"), F.array().cast("array<string>").alias("errors"),
        F.concat(F.lit('{"content":'), _quoted("text"), F.lit(',"role":'), _quoted("role"), F.lit(',"type":"message"}')).alias("json"),
    )
    rows = numbered(link(calls, results, schemas).unionByName(plain))
    return rows.select(F.when(~F.col("no_conv"), F.col("conv_id")).alias("conv_id"), "position", "turn", "record", "call_id", "cyclic", F.array_join("errors", ",").alias("errors"), "json")


def format_chats(conversations: DataFrame, schemas: DataFrame) -> DataFrame:
    """Records of conversations whose assistant turns hold tool calls and whose tool turns are their results."""
    rows = read_turns(conversations)
    return format_records(embedded_calls(rows), embedded_results(rows), rows.where("role is null or role != 'tool'"), schemas)
