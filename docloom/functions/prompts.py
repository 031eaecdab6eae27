"""Messages that go with clauses and audits to a hosted model, as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("None"))


def clause_message(circular_no: Column, circular_date: Column, intermediary: Column, part: Column, section_no: Column, title: Column, path: Column, page: Column, text: Column) -> Column:
    """A clause with its address, in the layout that extraction expects; what is missing reads None."""
    return F.concat(
        F.lit("Circular: "), _text(circular_no), F.lit(" ("), _text(circular_date), F.lit(")\nApplies to intermediary: "), _text(intermediary), F.lit("\nPart "), _text(part), F.lit(" · Section "), _text(section_no),
        F.lit(" — "), _text(title), F.lit("\nClause "), _text(path), F.lit(" (page "), _text(page), F.lit(")\n\nClause text:\n\"\"\"\n"), F.coalesce(text, F.lit("")), F.lit("\n\"\"\""),
    )


def counted(n: Column, noun: str) -> Column:
    """A count with its noun in the right number, or null for none."""
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s")))


def attachments(images: Column, documents: Column) -> Column:
    """"2 screenshots and 1 PDF", or null without either."""
    both = F.concat_ws(" and ", counted(images, "screenshot"), counted(documents, "PDF"))
    return F.when(both != "", both)


def rulebook_block(rulebooks: Column) -> Column:
    """Rulebooks (array of structs position, name, content) in order, each whole inside its tag."""
    one = lambda r: F.concat(F.lit("<rulebook file=\"references/"), r["name"], F.lit("\">\n"), r["content"], F.lit("\n</rulebook>"))
    return F.array_join(F.transform(F.array_sort(rulebooks), one), "\n\n")


def audit_message(images: Column, documents: Column, journey: Column, description: Column) -> Column:
    """What goes with an audit request: attachments, journey (null or "auto": to be found), description, and whether there
    is nothing to look at; paragraphs by an empty line, absent ones left out."""
    held, told = attachments(images, documents), F.trim(F.coalesce(description, F.lit("")))
    named = F.coalesce(journey, F.lit("")).isin("", "auto")
    return F.concat_ws(
        "\n\n", F.concat(F.lit("Attached: "), held, F.lit(". Look at every screen.")),
        F.when(named, "Find the journey from the artifacts and load its rulebooks.").otherwise(F.concat(F.lit("Journey: **"), journey, F.lit("**. Load its rulebook and any other that the screens touch; the checklist always runs."))),
        F.when(told != "", F.concat(F.lit("Description:\n\"\"\"\n"), told, F.lit("\n\"\"\""))),
        F.when(held.isNull(), "No images are attached: say what the description confirms and what cannot be seen."), F.lit("Submit the whole scorecard once."),
    )


def fill_vocabularies(template: str, vocabularies: dict[str, tuple[str, ...]]) -> str:
    """A template with each `{{ name | join(', ') }}` replaced by the vocabulary of that name; an unknown name is an error."""
    return re.sub(r"\{\{\s*(\w+)\s*\|\s*join\(', '\)\s*\}\}", lambda m: ", ".join(vocabularies[m[1]]), template)
