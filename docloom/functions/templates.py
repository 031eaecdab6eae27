"""Message templates as Column expressions: values, joins and loops over nested arrays, rendered where the rows are.

    {{ name }}  {{ row.field }}  {{ list | join(', ') }}  {{ name | default('none') | upper }}
    {% for row in rows %} ... {{ loop.index }} ... {% endfor %}        {# left out #}

A template is read once, on the driver, into one expression: text is literal, a loop is a transform of an array whose
pieces are joined, and loops may stand in loops. A null value is empty text, a null array a loop of no turns; anything
else a template could hold is an error when it is read, not when it runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_FOR = re.compile(r"\{%\s*for\s+(\w+)\s+in\s+([\w.]+)\s*%\}")
_END = re.compile(r"\{%\s*endfor\s*%\}")
_VALUE = re.compile(r"\{\{\s*([\w.]+)((?:\s*\|\s*\w+(?:\('[^']*'\))?)*)\s*\}\}")
_FILTER = re.compile(r"\|\s*(\w+)(?:\('([^']*)'\))?")

_FILTERS: dict[str, Callable[[Column, str | None], Column]] = {
    "join": lambda c, by: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), by or ""),
    "default": lambda c, other: F.when(F.coalesce(c.cast("string"), F.lit("")) == "", other or "").otherwise(c.cast("string")),
    "upper": lambda c, _: F.upper(c),
    "lower": lambda c, _: F.lower(c),
    "trim": lambda c, _: F.regexp_replace(c, r"^\s+|\s+$", ""),
    "length": lambda c, _: F.size(c),
}


def _look_up(path: str, names: dict[str, Column]) -> Column:
    first, *rest = path.split(".")
    if first not in names:
        raise KeyError(f"the template names {first!r}, which it is not given")
    found = names[first]
    for field in rest:
        found = found[field]
    return found


def _value(token: str, names: dict[str, Column]) -> Column:
    parsed = _VALUE.fullmatch(token)
    if not parsed:
        raise ValueError(f"not a value of a template: {token}")
    out = names["loop"] if parsed[1] == "loop.index" and "loop" in names else _look_up(parsed[1], names)
    for name, argument in _FILTER.findall(parsed[2]):
        if name not in _FILTERS:
            raise ValueError(f"unknown filter {name!r} in {token}")
        out = _FILTERS[name](out, argument)
    return F.coalesce(out.cast("string"), F.lit(""))


def _turn(name: str, tokens: list[str], names: dict[str, Column], left: list[list[str]]) -> Callable[[Column, Column], Column]:
    """The text of one turn of a loop; `left` gets the tokens behind it."""

    def turn(row: Column, k: Column) -> Column:
        rest = list(tokens)
        body = _render(rest, names | {name: row, "loop": k + 1}, True)
        left.append(rest)
        return body

    return turn


def _render(tokens: list[str], names: dict[str, Column], inside: bool) -> Column:
    """Everything up to the end of the loop that is open, or of the template; takes the tokens it reads."""
    parts = []
    while tokens:
        token = tokens.pop(0)
        loop = _FOR.fullmatch(token)
        if loop:
            left: list[list[str]] = []
            turns = F.transform(_look_up(loop[2], names), _turn(loop[1], tokens, names, left))
            parts.append(F.coalesce(F.array_join(turns, ""), F.lit("")))
            tokens[:] = left[-1]
        elif _END.fullmatch(token):
            if not inside:
                raise ValueError("endfor without a loop")
            return F.concat(F.lit(""), *parts)
        elif token.startswith("{{"):
            parts.append(_value(token, names))
        elif token.startswith("{%"):
            raise ValueError(f"unknown statement of a template: {token}")
        elif token and not token.startswith("{#"):
            parts.append(F.lit(token))
    if inside:
        raise ValueError("a loop without endfor")
    return F.concat(F.lit(""), *parts)


def render(template: str, **names: Column) -> Column:
    """The template's text for each row, from the columns that stand for its names."""
    return _render(_TOKEN.split(template), names, False)


def in_order(rulebooks: Column, names: list[str]) -> Column:
    """Rulebooks (array of structs with a name) in the order of `names`; others are left out, missing ones skipped."""
    wanted = F.array(*[F.lit(n) for n in names])
    return F.filter(F.transform(wanted, lambda n: F.get(F.filter(rulebooks, lambda r: r["name"] == n), F.lit(0))), lambda r: r.isNotNull())
