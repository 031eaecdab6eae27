"""A data source of document pages: files of a folder, read in parallel, one row for each page.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("path", folder).load()

Documents are text files (the whole file is one document, named by its stem) or rows of Parquet files (`id` and `text`
name their columns). A document is split into pages at `page_break`, a regular expression (a form feed by default).
Pages are numbered from 1, cleaned as `operators.documents.clean_page` does, and carry their running offset in code
points, which the reader counts as it goes: a document is read by one task, so offsets cost no shuffle. A page without
text has `gap` = no_text, and a document without any page is one row with page 0 and `gap` = no_pages.

Partitions are text files, several small ones together, and row groups of Parquet files; both are read in bounded
batches. Paths may have any scheme that pyarrow's file systems know.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docloom.functions.text import WORD, WS
from docloom.operators.documents import RUNNING_LINE

SCHEMA = "doc_id string, page_no int, text string, char_start bigint, gap string"
NO_TEXT, NO_PAGES = "no_text", "no_pages"
#: Bytes of text files that one partition holds, unless one file alone is larger.
PARTITION_BYTES = 64 << 20
BATCH_PAGES = 2048


def _python(pattern: str) -> str:
    """The Column functions' patterns in the dialect of `re`."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern).replace(r"[\p{L}\p{N}_]", r"\w")


_RUNNING = re.compile(RUNNING_LINE, re.ASCII)
_BROKEN = re.compile(_python(f"({WORD})-{WS}*\n{WS}*({WORD})"))


def clean_text(text: str) -> str:
    """A page without running headers and footers, dehyphenated, ended by a line end."""
    return _BROKEN.sub(r"\1\2", "\n".join(x for x in text.split("\n") if not _RUNNING.match(x))) + "\n"


def paginate(doc_id: str | None, text: str | None, page_break: re.Pattern) -> Iterator[tuple]:
    """Rows of one document."""
    if text is None:
        yield doc_id, 0, None, 0, NO_PAGES
        return
    offset = 0
    for number, raw in enumerate(page_break.split(text), 1):
        page = clean_text(raw)
        yield doc_id, number, page, offset, None if raw.strip() else NO_TEXT
        offset += len(page)


class Files(InputPartition):
    """Text files, or one row group of a Parquet file."""

    def __init__(self, paths: list[str], row_group: int | None = None):
        super().__init__((paths, row_group))
        self.paths, self.row_group = paths, row_group


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.glob = options.get("pathGlobFilter", "*")
        self.id, self.text = options.get("id", "doc_id"), options.get("text", "text")
        self.page_break = options.get("pageBreak", "\f")
        if re.compile(self.page_break).groups:
            raise ValueError("pageBreak must not have groups")

    def partitions(self) -> list[Files]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, root = _system(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        kept = sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and (info.is_file or fnmatch.fnmatch(f.base_name, self.glob))), key=lambda f: f.path)
        out, texts, size = [], [], 0
        for f in kept:
            if f.extension == "parquet":
                out += [Files([f.path], k) for k in range(pq.ParquetFile(system.open_input_file(f.path)).num_row_groups)]
                continue
            if texts and size + f.size > PARTITION_BYTES:
                out.append(Files(texts))
                texts, size = [], 0
            texts.append(f.path)
            size += f.size
        return out + ([Files(texts)] if texts else []) or [Files([])]

    def _documents(self, part: Files) -> Iterator[tuple[str | None, str | None]]:
        import pyarrow.parquet as pq

        system, _ = _system(self.path)
        if part.row_group is None:
            for path in part.paths:
                with system.open_input_stream(path) as stream:
                    yield re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]), stream.read().decode(errors="replace")
            return
        with system.open_input_file(part.paths[0]) as file:
            for batch in pq.ParquetFile(file).iter_batches(64, row_groups=[part.row_group], columns=[self.id, self.text]):
                for doc_id, text in zip(batch.column(self.id), batch.column(self.text), strict=True):
                    yield None if doc_id.as_py() is None else str(doc_id.as_py()), text.as_py()

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.string()), ("page_no", pa.int32()), ("text", pa.string()), ("char_start", pa.int64()), ("gap", pa.string())]
        page_break = re.compile(self.page_break)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

        for doc_id, text in self._documents(partition):
            for row in paginate(doc_id, text, page_break):
                rows.append(row)
                if len(rows) >= BATCH_PAGES:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


class PagedSource(DataSource):
    """Options: path; pathGlobFilter; pageBreak; for Parquet files id and text."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def read_paged(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """doc_id, page_no, text, char_start and gap of the documents of a file or folder."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(**options).load(path)


def pages_and_gaps(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages as the operators take them, and coverage gaps (doc_id, page, reason, detail)."""
    pages = rows.where("page_no > 0").select("doc_id", "page_no", "text", F.lit(None).cast("array<array<array<string>>>").alias("tables"), "char_start", F.col("gap").isNotNull().alias("blank"))
    detail = F.when(F.col("gap") == NO_TEXT, "empty text layer").otherwise("no page could be read")
    return pages, rows.where("gap is not null").select("doc_id", F.col("page_no").alias("page"), F.col("gap").alias("reason"), detail.alias("detail"))
