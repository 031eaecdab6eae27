"""Model answers held against a JSON schema: a walk over VARIANT values that a table of fields drives.

A schema is a table with one row for each place: `path` ($, $.a, $.a[*], $.a[*].b), `types` (JSON type names that it
takes), `required` and `enum` (JSON texts of the values that it takes, null for all). The walk is one Column expression
made from these rows, so answers are checked where they are, without a join or a shuffle, and the depth of the expression
is that of the schema, whatever the answers hold. Fields that the schema doesn't name are left alone, as JSON Schema does.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schemas

SCHEMA_TABLE = "path string, types array<string>, required boolean, enum array<string>"
FAULT = "array<struct<path:string,fault:string,expected:string,found:string>>"


def schema_rows(schema: dict, path: str = "$", required: bool = True) -> Iterator[tuple]:
    """Rows of a schema in the form of JSON Schema: type, enum, properties, required and items."""
    types = schema.get("type", [])
    enum = schema.get("enum")
    yield path, [types] if isinstance(types, str) else list(types), required, None if enum is None else [json.dumps(x) for x in enum]
    for name, field in schema.get("properties", {}).items():
        yield from schema_rows(field, f"{path}.{name}", name in schema.get("required", ()))
    if "items" in schema:
        yield from schema_rows(schema["items"], f"{path}[*]", False)


def schema_table(spark: SparkSession, schema: dict) -> DataFrame:
    return spark.createDataFrame(list(schema_rows(schema)), SCHEMA_TABLE)


#: JSON types by the leading word of what schema_of_variant says.
TYPES = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "BOOLEAN": "boolean", "VOID": "null"}


def type_of(value: Column) -> Column:
    """JSON type of a variant: object, array, string, integer, number, boolean or null; any other is "other"."""
    names = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)), F.lit("other"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _one(path: Column, fault: str, expected: str, found: Column) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(fault).alias("fault"), F.lit(expected).alias("expected"), found.cast("string").alias("found")))


def _walk(value: Column, at: str, place: Column, rows: dict[str, dict]) -> Column:
    """Faults of a value that is there, at schema path `at` and concrete path `place`."""
    row = rows[at]
    none = F.array().cast(FAULT)
    takes = {*row["types"], *(["integer"] if "number" in row["types"] else [])}
    fields = [p for p in rows if p.startswith(f"{at}.") and not any(c in p[len(at) + 1 :] for c in ".[")]

    def below(x: Column) -> Column:
        """Faults of a value of a right type, x.v, whose type is x.t."""
        parts = []
        if row["enum"] is not None:
            text = F.to_json(x["v"])
            parts.append(F.when(text.isin(*row["enum"]), none).otherwise(_one(place, "enum", "|".join(row["enum"]), text)))
        if fields:
            parts.append(F.when(x["t"] == "object", F.concat(*[field(x["v"], p) for p in fields])).otherwise(none))
        if f"{at}[*]" in rows:
            items = F.try_variant_get(x["v"], F.lit("$"), "array<variant>")
            each = F.transform(items, lambda y, k: _walk(y, f"{at}[*]", F.concat(place, F.lit("["), k.cast("string"), F.lit("]")), rows))
            parts.append(F.when(x["t"] == "array", F.flatten(each)).otherwise(none))
        return F.concat(*parts) if parts else none

    def field(parent: Column, path: str) -> Column:
        name = path[len(at) + 1 :]
        inner = F.concat(place, F.lit(f".{name}"))
        absent = _one(inner, "missing", "|".join(rows[path]["types"]), F.lit("nothing")) if rows[path]["required"] else none
        return _let(F.try_variant_get(parent, F.lit(f"$['{name}']"), "variant"), lambda y: F.when(y.isNull(), absent).otherwise(_walk(y, path, inner, rows)))

    def judged(x: Column) -> Column:
        fits = x["t"].isin(*takes) if takes else F.lit(True)
        return F.when(fits, below(x)).otherwise(_one(place, "type", "|".join(row["types"]), x["t"]))

    return _let(F.struct(value.alias("v"), type_of(value).alias("t")), judged)


def with_faults(answers: DataFrame, schema: DataFrame, answer_col: str = "answer") -> DataFrame:
    """`answers` with value (a variant, null if the text is no JSON) and faults: path, fault, expected and found.

    Faults are json (no JSON at all), missing (a required field), type and enum; what lies below a fault is not looked
    at. The order is that of the schema, and of the elements within an array. `schema` has one row a field, which are
    read by the driver.
    """
    rows = {r["path"]: r.asDict() for r in schema.collect()}
    parsed = answers.withColumn("value", F.try_parse_json(F.col(answer_col)))
    no_json = _one(F.lit("$"), "json", "|".join(rows["$"]["types"]), F.lit("no JSON"))
    return parsed.withColumn("faults", F.when(F.col("value").isNull(), no_json).otherwise(_walk(F.col("value"), "$", F.lit("$"), rows)))


def faults(checked: DataFrame, *keep: str) -> DataFrame:
    """One row for each fault."""
    # The outer form: the inner one would have the walk evaluated again, as a filter for arrays that aren't empty.
    return checked.select(*keep, F.explode_outer("faults").alias("_f")).select(*keep, "_f.*").where("path is not null")


def accepted(checked: DataFrame, array: str, fields: dict[str, str], *keep: str) -> DataFrame:
    """One row for each element of `array` in answers without a fault: seq (from 0) and fields of the types given."""
    well = checked.where(F.size("faults") == 0)
    rows = well.select(*keep, F.posexplode(F.variant_get("value", F.lit(f"$['{array}']"), "array<variant>")).alias("seq", "_x"))
    return rows.select(*keep, "seq", *[F.try_variant_get("_x", F.lit(f"$['{name}']"), kind).alias(name) for name, kind in fields.items()])


def obligation_schema() -> dict:
    """What an answer on a clause must look like: obligations with closed vocabularies and typed fields."""
    text, optional = {"type": "string"}, {"type": ["string", "null"]}
    one_of = lambda words: {"type": "string", "enum": list(words)}
    fields = {
        "action_required": text, "obligation_type": one_of(schemas.OBLIGATION_TYPES), "applies_to": {"type": "array", "items": one_of(schemas.APPLIES_TO)}, "trigger_class": one_of(schemas.TRIGGER_CLASSES),
        "criticality": one_of(schemas.CRITICALITY), "evidence_artifact": optional, "evidence_class": {"type": ["string", "null"], "enum": [*schemas.EVIDENCE_CLASSES, None]}, "deadline_phrase": optional,
        "parameters": {"type": "object"}, "consequence": optional, "rationale": optional, "source_sentence": text, "confidence": {"type": "number"},
    }
    needed = ["action_required", "obligation_type", "applies_to", "trigger_class", "criticality", "source_sentence", "confidence"]
    return {"type": "object", "required": ["obligations"], "properties": {"obligations": {"type": "array", "items": {"type": "object", "required": needed, "properties": fields}}}}
