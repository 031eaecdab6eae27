"""Golden files as a data source: for each document one JSON file of each block, written once or not at all.

    spark.dataSource.register(FixtureFiles)
    rows.write.format("fixtures").option("folders", 256).mode("overwrite").save(folder)
    spark.read.format("fixtures").schema("doc_id string, toc string").load(folder)

Rows have a document's name first (its slug) and then blocks, each an array; block b of document d becomes the file
<folder>/b/d.json, indented, with a block that is null or empty as an explicit `[]`. With the option `folders`, documents
are dealt by the CRC-32 of their names: the file is <folder>/of=256/folder=<CRC-32 mod 256>/b/d.json.

A task writes into a staging folder of its own attempt. Only the attempts whose messages the driver gets are moved to
their places, when all tasks have ended well; files of attempts that failed or ran twice go with the staging folder, and
so does everything if the job fails. A reader never sees half a file, and a document that is written again is replaced
as a whole. The driver moves files one by one, or, where documents are dealt, whole folders, if the documents of each
come from one task as those of `write_fixtures` do: then neither its time nor its memory grows with the documents.

Read, a block is the text of its file. Tasks list the files, one task a folder; the driver sees folders only.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

STAGING = "_staging"
DEALT = "of="
ROWS = 500
#: Bytes of file texts that one batch holds, unless one document alone has more.
BATCH_BYTES = 16 << 20
#: Tasks that share a folder where documents are not dealt.
SHARES = 8


@dataclass
class Written(WriterCommitMessage):
    """The folder of one task attempt and how many files it holds."""

    folder: str
    files: int


def file_name(slug: str | None) -> str:
    """A document's name as a file's: what paths can't hold is escaped, so names stay apart."""
    if slug is None:
        raise ValueError("a document without a name can't be a file")
    return re.sub(r"[/\x00%+]|^[._]", lambda m: f"%{ord(m[0]):02x}", slug) + ".json"


def plain(array: pa.Array) -> list:
    """`array.to_pylist()`, column by column, without a scalar object for each value."""
    kind = array.type
    if pa.types.is_struct(kind) and 0 < len({f.name for f in kind}) == kind.num_fields:
        names = [f.name for f in kind]
        rows = [dict(zip(names, values, strict=True)) for values in zip(*[plain(x) for x in array.flatten()], strict=True)]
        return [row if valid else None for row, valid in zip(rows, array.is_valid().to_pylist(), strict=True)] if array.null_count else rows
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        values, out, at = plain(array.flatten()), [], 0
        for length in array.value_lengths().to_pylist():
            out.append(None if length is None else values[at : at + length])
            at += length or 0
        return out
    if pa.types.is_string(kind) or pa.types.is_integer(kind) and not array.null_count:
        return array.to_numpy(zero_copy_only=False).tolist()
    return array.to_pylist()


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.rstrip("/"))


def _listed(system, folder: str) -> list:
    from pyarrow import fs

    return system.get_file_info(fs.FileSelector(folder))


def _absent(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type == fs.FileType.NotFound


def _bring(system, source: str, target: str, replace: bool = False) -> int:
    """Move what a folder holds into another: folders that are not there yet as a whole, else their files one by one,
    which are counted."""
    moved = 0
    for entry in _listed(system, source):
        place = f"{target}/{entry.base_name}"
        free = _absent(system, place)
        if not entry.is_file and not free:
            moved += _bring(system, entry.path, place, replace)
            continue
        if entry.is_file and not free and not replace:
            raise RuntimeError(f"{place} was written twice: two documents share a name")
        system.move(entry.path, place)
        moved += entry.is_file
    return moved


class FixtureWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool, folders: int = 1):
        self.path, self.names, self.overwrite, self.folders = path, names, overwrite, folders
        self.staging = f"{STAGING}-{uuid.uuid4().hex}"
        self.tops = names[1:] if folders == 1 else [f"{DEALT}{folders}"]

    def _folder(self, slug: str) -> str:
        """Where a document's blocks stand, with a slash before."""
        return "" if self.folders == 1 else f"/{self.tops[0]}/folder={zlib.crc32(slug.encode()) % self.folders}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _system(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        part, files, made = "", 0, set()
        for batch in iterator:
            for at in range(0, batch.num_rows, ROWS):
                if self.folders == 1 or not part:
                    # Not dealt, a part holds the files of few rows: neither rows nor listings of parts grow with the task.
                    part = f"{folder}/{uuid.uuid4().hex}"
                    made.clear()
                for slug, *arrays in zip(*[plain(c) for c in batch.slice(at, ROWS).columns], strict=True):
                    name = file_name(slug)
                    own = part + self._folder(slug)
                    if own not in made:
                        for block in self.names[1:]:
                            system.create_dir(f"{own}/{block}", recursive=True)
                        made.add(own)
                    if not _absent(system, f"{own}/{self.names[1]}/{name}"):
                        raise RuntimeError(f"{name} was written twice: two documents share a name")
                    for block, array in zip(self.names[1:], arrays, strict=True):
                        with system.open_output_stream(f"{own}/{block}/{name}") as out:
                            out.write((json.dumps(array or [], indent=2, ensure_ascii=False, default=str) + "\n").encode())
                        files += 1
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        """Files of all attempts are brought together in a staging folder first, part by part; names that meet there fail
        the job before anything of old is touched. No list of all files is held."""
        system, root = _system(self.path)
        whole, old = f"{root}/{self.staging}/whole", f"{root}/{self.staging}/old"
        try:
            system.create_dir(old, recursive=True)
            for top in self.tops:
                system.create_dir(f"{whole}/{top}", recursive=True)
            for message in messages:
                if message is None or not message.files:
                    continue
                held = sum(_bring(system, part.path, whole) for part in _listed(system, message.folder))
                if self.folders == 1 and held != message.files:
                    raise RuntimeError(f"{message.folder} holds {held} files of {message.files}: two documents share a name")
            stand = [f for f in _listed(system, root) if f.base_name in self.names[1:] or f.base_name.startswith(DEALT)]
            if self.overwrite:
                for f in stand:
                    system.move(f.path, f"{old}/{f.base_name}")
            elif other := sorted(f.base_name for f in stand if f.base_name not in self.tops):
                raise RuntimeError(f"{root} has documents in other folders: {', '.join(other)}")
            _bring(system, whole, root, replace=True)
        finally:
            self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_system(self.path))

    def _clear(self, system, root: str) -> None:
        if not _absent(system, f"{root}/{self.staging}"):
            system.delete_dir(f"{root}/{self.staging}")


class Share(InputPartition):
    """A folder's documents, or one of `of` shares of them by their names."""

    def __init__(self, folder: str, nth: int = 0, of: int = 1):
        super().__init__((folder, nth, of))
        self.folder, self.nth, self.of = folder, nth, of


class FixtureReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[Share]:
        system, root = _system(self.path)
        tops = _listed(system, root)
        dealt = [f for f in tops if f.base_name.startswith(DEALT)]
        shares = [Share(folder.path) for f in dealt for folder in _listed(system, f.path)]
        if any(f.base_name in self.names[1:] for f in tops):
            shares += [Share(root, k, SHARES) for k in range(SHARES)]
        elif not dealt:
            raise FileNotFoundError(f"{self.path} holds no block {' or '.join(self.names[1:])}")
        return shares or [Share("")]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        rows, size = [], 0
        schema = pa.schema([(name, pa.string()) for name in self.names])
        if not partition.folder:
            return
        in_block = [{f.base_name for f in _listed(system, f"{partition.folder}/{block}") if f.is_file and re.fullmatch(r"([^._].*)?\.json", f.base_name, re.DOTALL)} for block in self.names[1:]]
        for name in set().union(*in_block):
            if zlib.crc32(name.encode()) % partition.of != partition.nth:
                continue
            row = [unquote(name.removesuffix(".json"))]
            for block, there in zip(self.names[1:], in_block, strict=True):
                text = None
                if name in there:
                    with system.open_input_stream(f"{partition.folder}/{block}/{name}") as file:
                        text = file.read().decode(errors="replace")
                row.append(text)
            rows.append(row)
            size += sum(len(x or "") for x in row)
            if len(rows) >= ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], schema=schema)


class FixtureFiles(DataSource):
    """Options: path; folders (for writing)."""

    @classmethod
    def name(cls) -> str:
        return "fixtures"

    def reader(self, schema) -> FixtureReader:
        if len(schema) < 2 or any(f.dataType.typeName() != "string" for f in schema):
            raise ValueError("fixtures are read as a name and one or more texts")
        return FixtureReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> FixtureWriter:
        names = schema.fieldNames()
        if len(names) < 2 or any(f.dataType.typeName() != "array" for f in schema.fields[1:]):
            raise ValueError("fixtures take a name and one or more arrays")
        return FixtureWriter(self.options["path"], names, overwrite, int(self.options.get("folders", "1")))


def write_fixtures(rows: DataFrame, path: str, folders: int = 1) -> None:
    """`rows` (name, then arrays) as golden files under `path`, in place of those that are there.

    With more folders than one, the documents of a folder come to one task, which writes the folder as a whole.
    """
    rows.sparkSession.dataSource.register(FixtureFiles)
    if folders > 1:
        rows = rows.repartition(F.crc32(F.col(rows.columns[0]).cast("binary")) % folders)
    rows.write.format("fixtures").option("folders", folders).mode("overwrite").save(path)


def read_fixtures(spark: SparkSession, path: str, blocks: dict[str, str], name: str = "doc_id") -> DataFrame:
    """The documents of golden files: name and one array for each block, given with its row type as DDL."""
    spark.dataSource.register(FixtureFiles)
    texts = spark.read.format("fixtures").schema(", ".join(f"`{c}` string" for c in [name, *blocks])).load(path)
    return texts.select(name, *[F.from_json(block, f"array<struct<{row}>>").alias(block) for block, row in blocks.items()])
