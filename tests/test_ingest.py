"""Sources and sinks: paged files, captured faults, golden files, scratch tables."""

import json
import os
import random
import zlib
from pathlib import Path

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docloom.operators import documents as docs
from docloom.sources import capture, fixtures, paged
from docloom.sources.scratch import Scratch


def write_texts(folder, texts):
    folder.mkdir(parents=True)
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode() if isinstance(text, str) else text)


# ------------------------------------------------------------------ paged


def test_paged_offsets_equal_those_of_the_window(spark, tmp_path):
    rng = random.Random(4)
    pieces = ["word", "é x", "bro-\nken", "ein- \n wort", "\n", " ", "\f", "Page 3 of 9\n", "\n123\n", "　", "\U0001f600"]
    texts = {f"doc{k}.txt": "".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for k in range(40)}
    write_texts(tmp_path / "in" / "deep", texts)
    rows = paged.read_paged(spark, str(tmp_path / "in"))
    raw = spark.createDataFrame([(name[:-4], k, page, None) for name, text in texts.items() for k, page in enumerate(text.split("\f"), 1)], "doc_id string, page_no int, text string, tables array<array<array<string>>>")
    windowed = {(r["doc_id"], r["page_no"]): (r["text"], r["char_start"]) for r in docs.load_pages(raw).collect()}
    got = rows.collect()
    assert {(r["doc_id"], r["page_no"]): (r["text"], r["char_start"]) for r in got} == windowed
    blank = {(name[:-4], k) for name, text in texts.items() for k, page in enumerate(text.split("\f"), 1) if not page.strip()}
    assert {(r["doc_id"], r["page_no"]) for r in got if r["gap"] == "no_text"} == blank and blank
    pages, gaps = paged.pages_and_gaps(rows)
    assert pages.count() == len(windowed) and {(r["doc_id"], r["page"]) for r in gaps.where("reason = 'no_text'").collect()} == blank


def test_paged_rows_of_parquet_and_their_nulls(spark, tmp_path):
    rows = [(1, "a\fb"), (2, None), (3, ""), (None, "only"), (4, "x" * 100_000 + "\f"), (1, "again")]
    spark.createDataFrame(rows, "id bigint, body string").repartition(3).write.parquet(str(tmp_path / "docs"))
    got = paged.read_paged(spark, str(tmp_path / "docs"), id="id", text="body").collect()
    assert sorted([(r["doc_id"], r["page_no"], len(r["text"] or ""), r["char_start"], r["gap"]) for r in got], key=str) == sorted(
        [("1", 1, 2, 0, None), ("1", 2, 2, 2, None), ("2", 0, 0, 0, "no_pages"), ("3", 1, 1, 0, "no_text"), (None, 1, 5, 0, None), ("4", 1, 100_001, 0, None), ("4", 2, 1, 100_001, "no_text"), ("1", 1, 6, 0, None)], key=str
    )


def test_paged_partitions_follow_files_and_row_groups(tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    write_texts(tmp_path / "t", {f"{k}.txt": "x" * 10 for k in range(9)} | {"_hidden.txt": "no", "note.md": "no"})
    monkeypatch.setattr(paged, "PARTITION_BYTES", 30)
    parts = paged.PagedReader({"path": str(tmp_path / "t"), "pathGlobFilter": "*.txt"}).partitions()
    assert [len(p.paths) for p in parts] == [3, 3, 3]
    pq.write_table(pa.table({"doc_id": list(range(10)), "text": ["a\fb"] * 10}), tmp_path / "g.parquet", row_group_size=4)
    reader = paged.PagedReader({"path": str(tmp_path / "g.parquet")})
    assert [p.row_group for p in reader.partitions()] == [0, 1, 2]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 20


def test_paged_source_of_nothing(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert paged.read_paged(spark, str(tmp_path / "empty")).collect() == []
    with pytest.raises(PySparkException):
        paged.read_paged(spark, str(tmp_path / "nowhere")).collect()
    with pytest.raises(ValueError, match="groups"):
        paged.PagedReader({"path": "x", "pageBreak": "(a)"})


def test_bad_bytes_do_not_stop_a_text_file(spark, tmp_path):
    write_texts(tmp_path / "b", {"bad.txt": b"ok\xff\x0cnext", "good.txt": "fine"})
    got = {(r["doc_id"], r["page_no"]): r["text"] for r in paged.read_paged(spark, str(tmp_path / "b")).collect()}
    assert got == {("bad", 1): "ok�\n", ("bad", 2): "next\n", ("good", 1): "fine\n"}


def test_slices_give_pages_back(spark):
    rows = [("d", 2, "second\U0001f600\n", 6), ("d", 1, "first\n", 0), ("e", 1, None, 0), ("e", 2, "x", 0), (None, 1, "n", 0)]
    got = docs.slices(spark.createDataFrame(rows, "doc_id string, page_no int, text string, char_start bigint")).collect()
    assert all(r["slice"] == (r["text"] or "") for r in got) and len(got) == 5
    assert {r["doc_id"]: r["whole"] for r in got} == {"d": "first\nsecond\U0001f600\n", "e": "x", None: "n"}


# ---------------------------------------------------------------- capture


def halver():
    def halve(row):
        if row["n"] % 7 == 0:
            raise ZeroDivisionError(f"row {row['n']}")
        if row["n"] % 11 == 0:
            return {"half": "no number", "name": "x"}
        return None if row["n"] % 13 == 0 else {"half": row["n"] / 2, "name": f"r{row['n']}"}

    return halve


def test_a_fault_costs_its_own_row_only(spark):
    rows = spark.range(3000).selectExpr("id + 1 as n", "id % 3 as k").repartition(5)
    got = capture.capture(rows, halver(), "half double, name string", keep=("n", "k"))
    by_n = {r["n"]: r for r in got.collect()}
    assert len(by_n) == 3000
    for n, r in by_n.items():
        if n % 7 == 0:
            assert r["ok"] is None and r["error"] == f"ZeroDivisionError: row {n}"
        elif n % 11 == 0:
            assert r["ok"] is None and r["error"].startswith(("ArrowInvalid", "ArrowTypeError", "TypeError"))
        elif n % 13 == 0:
            assert r["ok"] is None and r["error"] is None
        else:
            assert tuple(r["ok"]) == (n / 2, f"r{n}") and r["error"] is None and r["k"] == (n - 1) % 3
    well, ill = capture.succeeded(got, "n"), capture.failed(got, "n")
    assert well.columns == ["n", "half", "name"] and well.count() + ill.count() == 3000
    counts = {r["kind"]: r["n"] for r in capture.outcome(got).collect()}
    assert counts[None] == well.count() and counts["ZeroDivisionError"] == 428 and sum(counts.values()) == 3000


def test_capture_of_nothing_and_of_everything(spark):
    none = spark.range(0).selectExpr("id as n")
    assert capture.capture(none, halver(), "half double, name string", keep=("n",)).collect() == []
    every = capture.capture(spark.range(5).selectExpr("id * 7 as n"), halver(), "half double, name string").collect()
    assert [r["ok"] for r in every] == [None] * 5 and all(r["error"] for r in every)


# --------------------------------------------------------------- fixtures


def golden(spark, n, start=0):
    rows = spark.range(start, start + n).withColumn("doc_id", F.concat(F.lit("d"), F.col("id").cast("string")))
    toc = F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.transform(F.sequence(F.lit(1), F.col("id") % 3 + 1), lambda k: F.struct(k.cast("int").alias("no"), F.lit('a "é" \n').alias("title"))))
    return rows.select("doc_id", toc.alias("toc"), F.array().cast("array<struct<x:date>>").alias("changes"))


def files(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())


def test_golden_files_hold_whole_blocks_and_replace_older_ones(spark, tmp_path):
    folder = str(tmp_path / "golden")
    fixtures.write_fixtures(golden(spark, 9).repartition(4), folder)
    assert files(folder) == sorted(f"{b}/d{k}.json" for k in range(9) for b in ("toc", "changes"))
    assert json.loads(Path(folder, "toc/d2.json").read_text()) == [{"no": k, "title": 'a "é" \n'} for k in (1, 2, 3)]
    assert Path(folder, "toc/d4.json").read_text() == "[]\n"
    back = fixtures.read_fixtures(spark, folder, {"toc": "no int, title string", "changes": "x date"})
    want = {r["doc_id"]: (r["toc"] or [], []) for r in golden(spark, 9).collect()}
    assert {r["doc_id"]: (r["toc"], r["changes"]) for r in back.collect()} == want
    fixtures.write_fixtures(golden(spark, 3, start=7), folder)
    assert files(folder) == sorted(f"{b}/d{k}.json" for k in range(7, 10) for b in ("toc", "changes"))


def test_names_that_paths_cannot_hold(spark, tmp_path):
    names = ["a/b", "a%2fb", ".hidden", "_x", "a+b c", "é", "100%"]
    rows = spark.createDataFrame([(n, [n]) for n in names], "doc_id string, toc array<string>")
    fixtures.write_fixtures(rows.select("doc_id", F.transform("toc", lambda x: F.struct(x.alias("t"))).alias("toc")), str(tmp_path / "g"))
    back = fixtures.read_fixtures(spark, str(tmp_path / "g"), {"toc": "t string"}).collect()
    assert sorted((r["doc_id"], r["toc"][0]["t"]) for r in back) == sorted((n, n) for n in names)


def batch(*rows):
    return pa.RecordBatch.from_pylist([{"doc_id": d, "toc": t} for d, t in rows], pa.schema([("doc_id", pa.string()), ("toc", pa.list_(pa.int64()))]))


def test_only_committed_attempts_count(tmp_path):
    """A task that ran twice, one that broke off in the middle, and one that was retried."""
    folder = str(tmp_path / "g")
    writer = fixtures.FixtureWriter(folder, ["doc_id", "toc"], True)

    def breaks():
        yield batch(("a", [1]))
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(breaks())
    writer.write(iter([batch(("a", [1]), ("b", [9, 9]))]))  # ended, but its message never came
    kept = writer.write(iter([batch(("a", [1]), ("b", [2]))]))
    assert files(folder) and not any(f.startswith("toc/") for f in files(folder))
    writer.commit([kept, None])
    assert files(folder) == ["toc/a.json", "toc/b.json"] and json.loads(Path(folder, "toc/b.json").read_text()) == [2]


def test_an_aborted_job_leaves_what_was_there(spark, tmp_path):
    folder = str(tmp_path / "g")
    fixtures.write_fixtures(golden(spark, 4), folder)
    before = {f: Path(folder, f).read_text() for f in files(folder)}
    bad = golden(spark, 50, start=2).withColumn("doc_id", F.when(F.col("doc_id") == "d40", F.raise_error(F.lit("broken"))).otherwise(F.col("doc_id"))).repartition(3)
    with pytest.raises(PySparkException):
        fixtures.write_fixtures(bad, folder)
    assert {f: Path(folder, f).read_text() for f in files(folder)} == before
    assert not [d for d in os.listdir(folder) if d.startswith(fixtures.STAGING)]


def test_two_documents_of_one_name_are_an_error(tmp_path):
    folder = str(tmp_path / "g")
    writer = fixtures.FixtureWriter(folder, ["doc_id", "toc"], True)
    messages = [writer.write(iter([batch(("a", [1]))])), writer.write(iter([batch(("a", [2]))]))]
    with pytest.raises(RuntimeError, match="share a name"):
        writer.commit(messages)
    assert files(folder) == []
    with pytest.raises(ValueError, match="without a name"):
        writer.write(iter([batch((None, [1]))]))


def test_dealt_golden_files_are_read_back_without_a_list_of_files(spark, tmp_path):
    folder = str(tmp_path / "g")
    fixtures.write_fixtures(golden(spark, 60).repartition(4), folder, 4)
    assert files(folder) == sorted(f"of=4/folder={zlib.crc32(f'd{k}'.encode()) % 4}/{b}/d{k}.json" for k in range(60) for b in ("toc", "changes"))
    back = fixtures.read_fixtures(spark, folder, {"toc": "no int, title string", "changes": "x date"})
    assert back.inputFiles() == []
    assert back.rdd.getNumPartitions() == 4
    assert {r["doc_id"]: (r["toc"], r["changes"]) for r in back.collect()} == {r["doc_id"]: (r["toc"] or [], []) for r in golden(spark, 60).collect()}
    fixtures.write_fixtures(golden(spark, 2), folder)  # either way takes the place of the other
    assert files(folder) == sorted(f"{b}/d{k}.json" for k in range(2) for b in ("toc", "changes"))
    fixtures.write_fixtures(golden(spark, 0), folder, 4)
    assert files(folder) == [] and fixtures.read_fixtures(spark, folder, {"toc": "no int"}).collect() == []
    with pytest.raises(PySparkException, match="holds no block"):
        fixtures.read_fixtures(spark, str(tmp_path), {"toc": "no int"}).collect()


class Counted:
    """A file system that counts what is moved."""

    def __init__(self, system):
        self.system, self.moves = system, 0

    def __getattr__(self, name):
        return getattr(self.system, name)

    def move(self, *places):
        self.moves += 1
        self.system.move(*places)


def test_a_commit_moves_folders_not_documents(tmp_path, monkeypatch):
    folder, counted = str(tmp_path / "g"), Counted(fs.LocalFileSystem())
    monkeypatch.setattr(fixtures, "_system", lambda path: (counted, path))
    writer = fixtures.FixtureWriter(folder, ["doc_id", "toc"], True, 4)
    names = [f"d{k}" for k in range(1200)]
    of = lambda name: zlib.crc32(name.encode()) % 4
    messages = [writer.write(iter([batch(*[(n, [1]) for n in names if of(n) in some])])) for some in ((0, 1), (2, 3))]
    writer.commit(messages)
    assert len(files(folder)) == 1200 and counted.moves == 4 + 1
    # Where tasks share folders, files are moved into them, and names that meet are an error.
    writer = fixtures.FixtureWriter(folder, ["doc_id", "toc"], True, 4)
    writer.commit([writer.write(iter([batch(*[(n, [2]) for n in names[:9]])])), writer.write(iter([batch(*[(n, [3]) for n in names[9:20]])]))])
    assert sorted(f.split("/")[-1] for f in files(folder)) == sorted(f"{n}.json" for n in names[:20])
    with pytest.raises(RuntimeError, match="share a name"):
        writer.write(iter([batch(("a", [1]), ("a", [2]))]))
    with pytest.raises(RuntimeError, match="share a name"):
        writer.commit([writer.write(iter([batch(("a", [1]))])), writer.write(iter([batch(("a", [2]))]))])
    # More documents replace those of their names, and stand in the same folders.
    more = fixtures.FixtureWriter(folder, ["doc_id", "toc"], False, 4)
    more.commit([more.write(iter([batch(("d0", [7]), ("z", [8]))]))])
    assert len(files(folder)) == 21 and json.loads(Path(folder, f"of=4/folder={of('d0')}/toc/d0.json").read_text()) == [7]
    more = fixtures.FixtureWriter(folder, ["doc_id", "toc"], False)
    with pytest.raises(RuntimeError, match="in other folders: of=4"):
        more.commit([more.write(iter([batch(("d0", [9]))]))])


def test_blocks_that_lack_a_document_and_names_without_letters(spark, tmp_path):
    for path, text in {"toc/a.json": '[{"t": "x"}]', "toc/.json": "[]", "notes/b.json": "[]", "notes/b.txt": "", "notes/.b.json": "", "toc/_b.json": ""}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    back = fixtures.read_fixtures(spark, str(tmp_path), {"toc": "t string", "notes": "n int"})
    assert sorted((r.doc_id, r.toc and [x.t for x in r.toc], r.notes) for r in back.collect()) == [("", [], None), ("a", ["x"], None), ("b", None, [])]


def test_columns_of_python_values(spark):
    rows = pa.array([[{"a": 1, "b": None, "c": [1, None]}, None], None, [], [{"a": None, "b": "x", "c": None}]])
    for array in (rows, rows[1:], rows[:1], rows[:0], pa.array([None, None]), pa.array([1.5, None]), pa.array([{}, None], pa.struct([]))):
        assert fixtures.plain(array) == array.to_pylist()


def test_golden_files_are_made_without_a_table_in_the_driver(spark, monkeypatch):
    from docloom.plans import catalog

    made = []
    monkeypatch.setattr(fixtures, "write_fixtures", lambda rows, *_: made.append(rows._jdf.queryExecution().executedPlan().toString()))
    monkeypatch.setattr(fixtures, "read_fixtures", lambda spark, path, blocks: spark.range(1).select("id", *[F.array("id").alias(b) for b in blocks]).withColumnRenamed("id", "doc_id"))
    catalog.QUERIES["fixture_files"](catalog.Tables(spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in made[0] and "Broadcast" not in made[0]


def test_appendix_ends_at_the_first_page_without_entries(spark):
    """Against the definition, page by page, on random tables."""
    from docloom.operators import registers

    draw, pages, want = random.Random(5), [], []
    for doc in ["a", "b", "c", "d", None]:
        entries, over = 0, False
        for page in range(1, 12):
            kinds = [draw.choice(["entry", "head", "none"]) for _ in range(draw.randint(0, 2))]
            cells = {"entry": ["1", f"A/{page}", ""], "head": ["Sr", "A/9", ""], "none": ["1", "", ""]}
            pages.append((doc, page, [[cells[k] for k in kinds]] if kinds else [], 3))
            if page >= 3 and kinds and not over:
                here = kinds.count("entry")
                over = not here and entries > 0
                entries += here
                want += [(doc, page)] * here * (doc is not None)
    rows = spark.createDataFrame(pages, "doc_id string, page_no int, tables array<array<array<string>>>, appendix_page int")
    got = registers.appendix_entries(rows)
    assert sorted((r.doc_id, r.page_no) for r in got.collect()) == sorted(want) and want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- scratch


def test_scratch_tables_are_read_again_and_removed(spark):
    scratch = Scratch(spark, "test")
    first, second = scratch.save(spark.range(5), "a"), scratch.save(spark.range(7), "b")
    assert first.count() == 5 and second.count() == 7 and not first.isStreaming
    scratch.drop(keep=1)
    assert second.count() == 7
    with pytest.raises(PySparkException):
        spark.read.schema("id bigint").parquet(first.inputFiles()[0]).count()
    scratch.drop()


def test_rulebooks_are_files_or_folders_that_hold_one(spark, tmp_path):
    from docloom.sources import readers

    (tmp_path / "a.md").write_text("first")
    (tmp_path / "name=b.md").mkdir()
    (tmp_path / "name=b.md" / "part-0.txt").write_text("second\n")
    (tmp_path / "a.md2").write_text("other")
    got = [tuple(r) for r in readers.read_rulebooks(spark, str(tmp_path), ["name=b.md", "a.md"]).collect()]
    assert got == [(1, "name=b.md", "second\n"), (2, "a.md", "first")]


def test_covered_change_lists(spark):
    from docloom.operators import changes

    listed = spark.createDataFrame([("d", "41.9", 1), ("d", "50", 0), ("e", "7", 2)], "doc_id string, para string, n bigint")
    assert sorted(tuple(r) for r in changes.is_covered(listed).collect()) == [("d", 2, 1, False), ("e", 1, 0, True)]
