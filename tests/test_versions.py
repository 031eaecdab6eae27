"""Histories and chains of versions against plain Python."""

import random

import pytest

from docloom.operators import versions


def history(issues, held):
    """Stretches as defined, one obligation at a time."""
    order = {}
    for family, version in sorted({(f, v) for f, v in issues if f is not None and v is not None}):
        order.setdefault(family, []).append(version)
    terms = {}
    for family, version, obligation, term in held:
        if version in order.get(family, []):
            key = (family, obligation, order[family].index(version))
            rank = (term is not None, term or 0)
            terms[key] = min(terms.get(key, rank), rank)
    out = []
    for family, obligation in {k[:2] for k in terms}:
        last = len(order[family]) - 1
        runs = []
        for at in range(last + 1):
            rank = terms.get((family, obligation, at))
            if rank is None:
                continue
            if runs and runs[-1][1] == at - 1 and runs[-1][2] == rank:
                runs[-1][1] = at
            else:
                runs.append([at, at, rank])
        for nth, (a, z, rank) in enumerate(runs, 1):
            began = ("original" if a == 0 else "added") if nth == 1 else "modified" if runs[nth - 2][1] == a - 1 else "reappeared"
            ended = "in_force" if z == last else "modified" if nth < len(runs) and runs[nth][0] == z + 1 else "superseded"
            out.append((family, obligation, nth, rank[1] if rank[0] else None, order[family][a], order[family][z], z - a + 1, began, ended))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_histories_equal_plain_stretches(spark, seed):
    rng = random.Random(seed)
    issues = [(f, v) for f in "ab" for v in rng.sample(range(30), 8)] + [("c", 1), ("a", None), (None, 3)]
    held = [(rng.choice("abcd"), rng.randrange(30), rng.randrange(12), rng.choice([None, 1, 1, 2])) for _ in range(900)] + [("c", 1, 5, 7), ("c", 1, 5, 7), ("c", 1, 5, 3), ("c", 1, None, 3)]
    got = versions.obligation_history(
        spark.createDataFrame(issues, "family string, version int"), spark.createDataFrame(held, "family string, version int, obligation_id bigint, terms int").repartition(3)
    ).collect()
    assert sorted(map(tuple, got), key=str) == history(issues, held)
    assert {r["began"] for r in got} == {"original", "added", "modified", "reappeared"} and {r["ended"] for r in got} == {"in_force", "modified", "superseded"}


def test_history_of_nothing(spark):
    none = spark.createDataFrame([], "family string, version int")
    held = spark.createDataFrame([("a", 1, 1, 1)], "family string, version int, obligation_id bigint, terms int")
    assert versions.obligation_history(none, held).collect() == [] and versions.obligation_history(none, held.where("false")).collect() == []


def chains(links):
    """Root, depth and cycle of each version by walking."""
    up, issued = {}, {}
    for version, other, when in sorted(links, key=lambda r: (str(r[0]), r[1] is None, str(r[1]), (r[2] is not None, r[2] or 0))):
        if version is not None and version not in up:
            up[version], issued[version] = other, when
    out = {}
    for version in up:
        at, seen = version, []
        while at in up and at not in seen:
            seen.append(at)
            at = up[at] if up[at] in up else None
        out[version] = (None, None, True) if at is not None else (seen[-1], len(seen) - 1, False)
    latest = {}
    for version, (root, _, _) in out.items():
        if root is not None:
            key = ((issued[version] is not None, issued[version] or 0), version)
            latest[root] = max(latest.get(root, key), key)
    return sorted(((v, r, d, c, latest[r][1] if r is not None else None) for v, (r, d, c) in out.items()), key=str)


def run_chains(spark, links):
    df = spark.createDataFrame(links, "version string, supersedes string, issued int").repartition(3)
    return sorted(map(tuple, versions.supersession_chains(df).collect()), key=str)


def test_chains_equal_walks(spark):
    rng = random.Random(7)
    for shape in range(3):
        links = [(f"v{k}", rng.choice([None, f"v{rng.randrange(80)}", f"v{max(0, k - 1)}", "lost"]), rng.choice([None, *range(9)])) for k in range(80)]
        links = [(v, None if v == w and shape == 0 else w, i) for v, w, i in links]
        assert run_chains(spark, links) == chains(links)


def test_long_chains_cycles_and_repeats(spark):
    long = [(f"v{k:03d}", f"v{k - 1:03d}" if k else None, k % 50) for k in range(200)]
    got = run_chains(spark, long)
    assert got == chains(long) and max(r[2] for r in got) == 199
    odd = [("a", "b", 1), ("b", "a", 2), ("c", "a", 3), ("s", "s", 4), ("r", None, 5), ("r", None, 5), ("x", "r", None), (None, "r", 1), ("y", "x", 5)]
    assert run_chains(spark, odd) == chains(odd) and {r[0] for r in run_chains(spark, odd) if r[3]} == {"a", "b", "c", "s"}
    many = [("hub", None, 0), *[(f"m{k}", "hub", 1) for k in range(500)]]
    assert run_chains(spark, many) == chains(many)
    assert run_chains(spark, []) == []
