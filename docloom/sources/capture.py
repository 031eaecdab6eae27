"""One document's failure is a result too: exceptions are caught where they arise, row by row, and the others go on."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose results are turned into Arrow together.
ROWS = 512


def describe(fault: BaseException) -> str:
    return f"{type(fault).__name__}: {fault}"


def capture(rows: DataFrame, parse: Callable[[dict], dict | None], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` with ok (what `parse` made of the row, a struct of `schema`) and error (else its exception).

    `parse` gets a row as a dictionary. Its result fails as well if it doesn't fit the schema. Each task sees its rows
    in Arrow batches, so a fault costs its own row only; errors of the system (memory, interrupts) still end the task.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], f"ok struct<{schema}>, error string")
    arrow = empty.toArrow().schema.field("ok").type
    columns = [rows.schema[c] for c in keep]
    ddl = ", ".join([f"`{c.name}` {c.dataType.simpleString()}" for c in columns] + [f"ok struct<{schema}>", "error string"])

    def attempt(row: dict) -> tuple[dict | None, str | None]:
        try:
            out = parse(row)
            pa.array([out], arrow)
            return out, None
        except Exception as fault:  # noqa: BLE001  any fault of a document is that document's result
            return None, describe(fault)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                results = [attempt(row) for row in b.to_pylist()]
                kept = [b.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([r[0] for r in results], arrow), pa.array([r[1] for r in results], pa.string())], [*keep, "ok", "error"])

    return rows.mapInArrow(run, ddl)


def succeeded(captured: DataFrame, *keep: str) -> DataFrame:
    """Rows without a fault, with the fields of their results."""
    return captured.where("error is null").select(*keep, "ok.*")


def failed(captured: DataFrame, *keep: str) -> DataFrame:
    """Rows with a fault: its kind and its whole description."""
    return captured.where("error is not null").select(*keep, F.substring_index("error", ":", 1).alias("kind"), "error")


def outcome(captured: DataFrame) -> DataFrame:
    """How many rows ended how: kind (null: well) and n."""
    return captured.groupBy(F.substring_index("error", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def parse_payload(payload: str) -> dict:
    """Pages of a document given as JSON: an object whose `pages` are its page texts, one or more."""
    pages = json.loads(payload)["pages"]
    if not pages:
        raise ValueError("no pages")
    return {"pages": len(pages), "blank": [k for k, text in enumerate(pages, 1) if not text.strip()], "chars": sum(map(len, pages))}
