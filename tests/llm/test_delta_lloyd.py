"""Delta Lloyd against plain Lloyd in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import delta_lloyd as dl

SCHEMA = "vec_id bigint, embedding array<double>, label int, x string, owner int, id string, was int"


def whole(vector):
    return [max(-(2**63), min(math.floor(1024 * x), 2**63 - 1)) for x in vector]


def plain(rows, clusters=8, rounds=10, size=4):
    """The rounds as defined: rows of (vec_id, vector)."""
    kept = [(i, whole(v)) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in named[:clusters]]
    if not centroids:
        return []

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        owners = [k for _, k in assigned()]
        for k in range(len(centroids)):
            own = [x for (_, x), o in zip(kept, owners, strict=True) if o == k]
            if own:
                centroids[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = assigned()
    cap = lambda n: min(n, 2**63 - 1)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((i, k, cap(d), cap(sum(cap(e) for e, o in last if o == k)), cap(sum(cap(e) for e, _ in last)), digest[k]) for (i, _), (d, k) in zip(kept, last, strict=True)),
        key=str,
    )


def run(spark, rows, size=4, **more):
    df = spark.createDataFrame([(i, v, 1, "x", 2, "id", 3) for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in dl.cluster_vectors(df, size=size, **more).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_delta_lloyd_equals_plain_lloyd(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(k, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for k in range(300)]
    assert run(spark, rows) == plain(rows)


def test_odd_vectors_ties_and_repeated_rows(spark):
    same = [(k, [0.5, 0.5, 0.0, 0.0]) for k in range(40)]  # all centroids start equal, seven stay empty
    assert run(spark, same) == plain(same)
    odd = [
        *same[:3], (1, None), (2, []), (3, [1.0, 2.0, 3.0]), (4, [1.0, None, 0.0, 0.0]), (5, [float("nan"), 0.0, 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3, 0.4]),
        (7, [-1.0, -1.0, 1.0, 1.0]), (7, [-1.0, -1.0, 1.0, 1.0]), (8, [3.0, 0.0, -3.0, 0.001]),
    ]
    got = run(spark, odd)
    assert got == plain(odd) and len(got) == 7
    assert run(spark, [(1, None), (None, [0.1, 0.2, 0.3, 0.4])]) == [] and run(spark, []) == []


def test_values_beyond_doubles_are_exact_and_beyond_64_bits_saturate(spark):
    rng = random.Random(5)
    for scale in (2.0**14, 2.0**20, 2.0**51, 1e300):
        rows = [(k, [rng.choice([-1, 1]) * scale * (1 + rng.randrange(1000) / 1024) for _ in range(4)]) for k in range(30)]
        assert run(spark, rows) == plain(rows), scale


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 40), st.integers(1, 6), st.booleans())
def test_comparing_changed_centroids_only_gives_what_all_would(seed, n, clusters, large):
    """Several rounds of random moves of some centroids."""
    rng = np.random.default_rng(seed)
    span = 1 << 30 if large else 4
    x, centroids = rng.integers(-span, span, (n, 3)), rng.integers(-span, span, (clusters, 3))
    owner, distance, moved = np.full(n, -1), np.full(n, dl.MOST), np.arange(clusters)
    for _ in range(4):
        owner, distance = dl.reassign(x, owner, distance, centroids, moved)
        full = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, c, strict=True)), k) for k, c in enumerate(centroids)) for row in x]
        assert [(int(d), int(k)) for d, k in zip(distance, owner, strict=True)] == full
        moved = np.flatnonzero(rng.random(clusters) < 0.4)
        centroids = centroids.copy()
        centroids[moved] += rng.integers(-2, 3, (len(moved), 3))


def test_sums_follow_signed_transfers(spark):
    """After each round the persisted sums are those of the owners."""
    rng = random.Random(9)
    df = spark.createDataFrame([(k, [rng.randrange(-50, 50) for _ in range(3)]) for k in range(200)], "id bigint, x array<bigint>").repartition(4)
    clusters = dl.Clusters(dl.seeds(df, 5, "3"))
    state, final = dl.lloyd(df, clusters, 4, 3)
    before = dl.Clusters(dl.seeds(df, 5, "3"))
    owners = None
    for _ in range(4):
        owners = [(r["x"], min(range(5), key=lambda k: (sum((a - b) ** 2 for a, b in zip(r["x"], before.centroids[k], strict=True)), k))) for r in df.collect()]
        before.sums = [[sum(x[d] for x, o in owners if o == k) for d in range(3)] for k in range(5)]
        before.counts = [sum(o == k for _, o in owners) for k in range(5)]
        before.update()
    assert final.counts == before.counts and final.sums == before.sums and final.centroids == before.centroids
    state.drop()
