"""Templates as Column expressions."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import templates as T


def text(spark, template, row, schema):
    df = spark.createDataFrame([row], schema)
    return df.select(T.render(template, **{c: F.col(c) for c in df.columns}).alias("x")).first()["x"]


def test_values_filters_and_comments(spark):
    schema = "a string, n int, xs array<string>, r struct<b:string>"
    row = (" Mixed ", None, ["p", None, "q"], ("deep",))
    assert text(spark, "{# no #}[{{ a | trim | upper }}|{{n}}|{{ n | default('0') }}|{{ xs | join(', ') }}|{{ xs | length }}|{{ r.b }}]{", row, schema) == "[MIXED||0|p, , q|3|deep]{"
    assert text(spark, "", row, schema) == "" and text(spark, "a % } {", row, schema) == "a % } {"


def test_loops_in_loops(spark):
    schema = "xs array<struct<k:int,ys:array<struct<v:string>>>>, end string"
    template = "{% for x in xs %}{{ loop.index }}:{{ x.k }}({% for y in x.ys %}{{ loop.index }}{{ y.v }}{{ end }}{% endfor %}){% endfor %}{% for x in xs %}.{% endfor %}{{ end }}"
    assert text(spark, template, ([(7, [("a",), (None,)]), (8, []), (9, None)], "!"), schema) == "1:7(1a!2!)2:8()3:9()...!"
    assert text(spark, template, (None, "!"), schema) == "!"


@pytest.mark.parametrize("template", ["{{ nobody }}", "{{ a | shout }}", "{% if a %}x{% endif %}", "{% for x in a %}", "{% endfor %}", "{{ a + 1 }}"])
def test_what_a_template_cannot_hold_is_an_error(spark, template):
    with pytest.raises((KeyError, ValueError)):
        T.render(template, a=F.col("a"))


def test_rulebooks_keep_their_order(spark):
    df = spark.createDataFrame([([("b", "2"), ("c", "3"), ("a", "1")],), ([],)], "books array<struct<name:string,content:string>>")
    got = [[b["content"] for b in r["x"]] for r in df.select(T.in_order(F.col("books"), ["c", "zz", "a", "b"]).alias("x")).collect()]
    assert got == [["3", "1", "2"], []]
