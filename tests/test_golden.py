"""Counts of whole documents: contents of the sizes of three versions of one circular, made by rule."""

from pyspark.sql import functions as F

from docloom.operators import changes, contents

# Sections and annexures of each version, and the place of one title that stays.
VERSIONS = {"may": (92, 45, 47), "aug": (94, 46, 47), "jun": (98, 45, 48)}
PARTS = {1: "I. REGISTRATION OF MEMBERS", 21: "II. SUPERVISION, AUDIT", 41: "III. DEALINGS WITH CLIENTS", 70: "IV. TECHNOLOGY"}
STAYS = "Settlement of Running Account of Client's Funds"


def titles():
    """Body titles by version: August adds two to May's; June drops two of August's and adds six."""
    may = [f"Subject number {k}" for k in range(1, 93)]
    may[46] = STAYS
    aug = [*may, "First of August", "Second of August"]
    jun = [t for t in aug if t not in (may[60], may[70])]
    jun[10:10] = ["June early"]  # moves what follows by one
    jun += [f"June late {k}" for k in range(5)]
    return {"may": may, "aug": aug, "jun": jun}


def rows_of(version):
    """Contents rows as tables hold them: heads, parts, sections with dot leaders, then annexures from 1 again."""
    body, annexures, _ = VERSIONS[version]
    rows = [["S. No.", "Subject", "Page"]]
    for k, title in enumerate(titles()[version], 1):
        if k in PARTS:
            rows.append(["", PARTS[k], ""])
        rows.append([f"{k}.", f"{title} ..........  {9 + k}", str(9 + k)])
    if version == "jun":  # two rows stand in each other's place, as printed
        at = [k for k, r in enumerate(rows) if r[0] in ("72.", "73.")]
        rows[at[0]], rows[at[1]] = rows[at[1]], rows[at[0]]
    rows.append(["Annexures", "", ""])
    return rows + [[str(k), f"Form {k}", str(200 + k)] for k in range(1, annexures + 1)]


def index(spark):
    table = [(v, n, cells) for v in VERSIONS for n, cells in enumerate(rows_of(v))]
    return contents.parse_rows(spark.createDataFrame(table, "doc_id string, row_no int, cells array<string>"))


def test_versions_have_their_sections_without_gaps(spark):
    found = index(spark)
    counts = {(r["doc_id"], r["block"]): (r["numbers"], r["largest"], r["missing"]) for r in contents.missing_numbers(found).collect()}
    for version, (body, annexures, _) in VERSIONS.items():
        assert counts[version, "body"] == (body, body, "") and counts[version, "annexure"] == (annexures, annexures, "")
    assert found.count() == 137 + 140 + 143


def test_one_title_keeps_its_part_and_moves_by_one(spark):
    placed = {r["doc_id"]: (r["section_no"], r["part"]) for r in index(spark).where(F.lower("title").contains("running account")).collect()}
    assert placed == {v: (at, "III") for v, (_, _, at) in VERSIONS.items()}


def test_titles_that_came_and_went(spark):
    body = index(spark).where("block = 'body'")

    def between(old, new):
        found = changes.title_changes(body.where(F.col("doc_id") == old), body.where(F.col("doc_id") == new))
        return {r["change"]: r["n"] for r in found.groupBy("change").agg(F.count("*").alias("n")).collect()}

    assert between("may", "aug") == {"added": 2} and between("aug", "jun") == {"added": 6, "removed": 2}


def test_file_order_and_contents_order_differ_in_june(spark):
    june = index(spark).where("doc_id = 'jun' and block = 'body'")
    numbers = [r["section_no"] for r in june.orderBy("row_no").collect()]
    assert numbers.index(73) < numbers.index(72)
    assert [r["section_no"] for r in contents.in_order(june).collect()] == sorted(numbers)
