"""Schema faults by the VARIANT walk against a plain recursive validator."""

import json
import random

from docloom.operators import validation as V

SCHEMA = {
    "type": "object", "required": ["items", "n"],
    "properties": {
        "n": {"type": "integer"}, "ratio": {"type": ["number", "null"]}, "tag": {"type": ["string", "null"], "enum": ["a", "b", None]},
        "items": {"type": "array", "items": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "rows": {"type": "array", "items": {"type": "array", "items": {"type": "integer", "enum": [1, 2]}}}, "any": {}}}},
    },
}


def kind(x):
    return {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(x)]


def plain(x, schema=SCHEMA, at="$"):
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types and kind(x) not in types and not (kind(x) == "integer" and "number" in types):
        return [(at, "type", "|".join(types), kind(x))]
    out = []
    if "enum" in schema and not any(kind(x) == kind(y) and x == y for y in schema["enum"]):
        out.append((at, "enum", "|".join(json.dumps(y) for y in schema["enum"]), json.dumps(x)))
    if isinstance(x, dict):
        for name, field in schema.get("properties", {}).items():
            below = field.get("type", [])
            if name in x:
                out += plain(x[name], field, f"{at}.{name}")
            elif name in schema.get("required", ()):
                out.append((f"{at}.{name}", "missing", below if isinstance(below, str) else "|".join(below), "nothing"))
    if isinstance(x, list) and "items" in schema:
        for k, y in enumerate(x):
            out += plain(y, schema["items"], f"{at}[{k}]")
    return out


def value(rng, depth=0):
    pick = rng.randrange(9 if depth < 4 else 6)
    simple = [None, True, rng.randrange(4), rng.choice([0.5, 2.25]), rng.choice("abc"), "x y"]
    return simple[pick] if pick < 6 else [value(rng, depth + 1) for _ in range(rng.randrange(3))] if pick < 7 else {k: value(rng, depth + 1) for k in rng.sample(["id", "rows", "any", "n", "tag", "items", "ratio"], rng.randrange(5))}


def near(rng):
    """An answer that is mostly right."""
    item = {"id": "i", "rows": [[1, 2], []], "any": value(rng, 3)}
    out = {"n": 3, "ratio": rng.choice([None, 1, 1.5]), "tag": rng.choice(["a", None]), "items": [dict(item) for _ in range(rng.randrange(3))]}
    for _ in range(rng.randrange(3)):
        target = rng.choice([out, *out["items"]]) if isinstance(out.get("items"), list) and all(isinstance(i, dict) for i in out["items"]) else out
        if target:
            name = rng.choice(list(target))
            if rng.random() < 0.4:
                del target[name]
            else:
                target[name] = value(rng, 2)
    return out


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, answer string").repartition(2)
    return V.with_faults(df, V.schema_table(spark, SCHEMA))


def test_faults_equal_a_plain_validator(spark):
    rng = random.Random(3)
    answers = [near(rng) if rng.random() < 0.7 else value(rng) for _ in range(150)]
    rows = check(spark, [json.dumps(a) for a in answers]).select("k", "faults").collect()
    assert len(rows) == len(answers)
    for r in rows:
        assert [tuple(f) for f in r["faults"]] == plain(answers[r["k"]]), answers[r["k"]]
    assert sum(not r["faults"] for r in rows) > 10


def test_what_is_no_json_and_nothing_at_all(spark):
    rows = {r["k"]: [tuple(f) for f in r["faults"]] for r in check(spark, [None, "", "{", '{"n": 1', "nul", "[1,]"]).collect()}
    assert all(f == [("$", "json", "object", "no JSON")] for f in rows.values())
    assert V.faults(check(spark, ['{"n":1,"items":[]}']), "k").collect() == [] and V.faults(check(spark, []), "k").collect() == []


def test_accepted_rows_are_typed(spark):
    good, bad = {"n": 1, "items": [{"id": "a", "rows": [[1]]}, {"id": "b"}]}, {"n": "x", "items": [{"id": "c"}]}
    got = V.accepted(check(spark, [json.dumps(good), json.dumps(bad)]), "items", {"id": "string", "rows": "array<array<int>>"}, "k").collect()
    assert [tuple(r) for r in got] == [(0, 0, "a", [[1]]), (0, 1, "b", None)]


def test_the_schema_of_obligations_is_closed():
    rows = {r[0]: r for r in V.schema_rows(V.obligation_schema())}
    assert rows["$.obligations[*].evidence_class"][3][-1] == "null" and rows["$.obligations[*].criticality"][2]
    assert len(rows) == 17 and rows["$.obligations[*].applies_to[*]"][1] == ["string"]
