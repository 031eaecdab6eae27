"""Centroid clustering by delta Lloyd: rounds that look only at what has changed.

Vectors of whole numbers keep, in a table, their owner (the nearest centroid) and the squared distance to it; the driver
keeps, for each centroid, the sum and the count of its vectors (`clusters` x `size` integers, whatever the input). In a
round

* a vector whose owner moved is compared with all centroids, any other only with the centroids that moved, because all
  that stay are no nearer than its owner;
* a vector that changes its owner is a signed transfer: minus its components and 1 from the old cluster, plus to the new.
  Tasks add their transfers up, one row for each cluster and component, and the global sums take in the totals.

The table of a round is written narrowly from the one before (no shuffle; only transfers are shuffled), and the one
before is removed. Where no centroid moves, all later rounds would repeat the last, so they are left out.

Components become floor(scale * x), x as double. Sums, means (exact floors) and comparisons are exact integers: doubles
hold them while |component| < 2^22, and beyond Python's integers take over.

Defined results: vectors that are null, of another length, or hold a null or non-finite component take no part and have
no row. A null identifier never starts a centroid, but its vector is assigned; vectors that share an identifier are
separate rows, and start centroids in the order of their components. With fewer vectors than `clusters` there are as many
centroids as vectors; an empty table gives an empty result. Centroids may start equal: ties go to the smaller number, and
a centroid that loses all its vectors keeps its place. Components beyond 64 bits count as the nearest 64-bit integer, and
so do distances and inertias that are returned. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Stored, sliced, store

MOST = 2**63 - 1
#: Below this, squared distances of 64 components and all steps to them are whole numbers that doubles hold.
SMALL = 1 << 22
STATE = "id bigint, x array<bigint>, owner int, distance bigint, was int"


@dataclass
class Clusters:
    """Centroids with the sums and counts of their vectors; all integers of any size."""

    centroids: list[list[int]]
    sums: list[list[int]] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    #: Numbers of the centroids that the last update moved.
    moved: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.sums = [[0] * len(c) for c in self.centroids]
        self.counts = [0] * len(self.centroids)
        self.moved = list(range(len(self.centroids)))

    def transfer(self, cluster: int, component: int, amount: int) -> None:
        """Add a total of signed transfers; component -1 is the count."""
        if component < 0:
            self.counts[cluster] += amount
        else:
            self.sums[cluster][component] += amount

    def update(self) -> None:
        """Every non-empty centroid becomes the floor of its vectors' mean; note which of them moved."""
        means = [[s // n for s in sums] if n else old for sums, n, old in zip(self.sums, self.counts, self.centroids, strict=True)]
        self.moved = [k for k, (a, b) in enumerate(zip(means, self.centroids, strict=True)) if a != b]
        self.centroids = means


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids, as int64 or, beyond it, Python's integers."""
    if not x.size or max(int(np.abs(np.clip(a, -MOST, MOST)).max()) for a in (x, centroids)) < SMALL // max(1, x.shape[1] // 64):
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    a, c = x.astype(object), centroids.astype(object)
    return ((a[:, None, :] - c) ** 2).sum(2)


def reassign(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after `moved` centroids moved; owner -1 stands for none yet.

    Saturated distances can't be compared any more, so their rows are compared with all centroids.
    """
    owner, distance = owner.copy(), distance.copy()
    stale = np.isin(owner, moved) | (owner < 0) | (distance == MOST)
    if stale.any():
        d = squared(x[stale], centroids)
        owner[stale] = d.argmin(1)  # the first of the least, so ties go to the smaller number
        distance[stale] = np.minimum(d.min(1), MOST).astype(np.int64)
    kept = np.flatnonzero(~stale)
    if len(kept) and len(moved):
        d = squared(x[kept], centroids[moved])
        best = d.argmin(1)
        least, who = d[np.arange(len(kept)), best], moved[best]
        nearer = (least < distance[kept]) | ((least == distance[kept]) & (who < owner[kept]))
        nearer = nearer.astype(bool)
        owner[kept[nearer]] = who[nearer]
        distance[kept[nearer]] = least[nearer].astype(np.int64)
    return owner, distance


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _assign(state: DataFrame, clusters: Clusters, size: int) -> DataFrame:
    """The table of the next round: owners, distances, and in `was` the owner before."""
    centroids = np.array(clusters.centroids, np.int64).reshape(-1, size)
    moved = np.array(clusters.moved, np.int64)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            was = b.column(2).to_numpy(zero_copy_only=False)
            owner, distance = reassign(_matrix(b.column(1), size), was, b.column(3).to_numpy(zero_copy_only=False), centroids, moved)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.array(was, pa.int32())], ["id", "x", "owner", "distance", "was"])

    return state.mapInArrow(step, STATE)


def _transfers(state: DataFrame, size: int, clusters: int) -> DataFrame:
    """cluster, component (-1: the count), amount: totals of what vectors with a new owner take along."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for b in sliced(batches, 4096):
            x = _matrix(b.column(1), size)
            owner, was = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
            wide = x if np.abs(np.clip(x, -MOST, MOST)).max(initial=0) < 1 << 48 else x.astype(object)
            for cluster in range(clusters):
                came, went = owner == cluster, was == cluster
                n = int(came.sum()) - int(went.sum())
                for component, amount in enumerate([n, *(wide[came].sum(0) - wide[went].sum(0)).tolist()], -1):
                    if amount:
                        total[cluster, component] = total.get((cluster, component), 0) + int(amount)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([str(total[k]) for k in keys], pa.string())], ["cluster", "component", "amount"])

    changed = state.where("owner <> was").mapInArrow(add_up, "cluster int, component int, amount string")
    return changed.groupBy("cluster", "component").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))


def usable(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """id and floor(scale * x) of the vectors that take part."""
    whole = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = (F.size(vector_col) == size) & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(sound).select(F.col(id_col).cast("bigint").alias("id"), F.transform(whole, lambda x: F.floor(x * scale).cast("bigint")).alias("x"))


def seeds(rows: DataFrame, clusters: int, salt: str) -> list[list[int]]:
    """The vectors with the least sha256 of `<salt>:<id>`, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").select(mark.alias("mark"), "x").orderBy("mark", "x").limit(clusters)
    return [list(r["x"]) for r in first.collect()]  # `clusters` rows


def lloyd(rows: DataFrame, clusters: Clusters, rounds: int, size: int) -> tuple[Stored, Clusters]:
    """The table of final owners and distances of `rows` (id, x), and the final centroids."""
    count = len(clusters.centroids)
    state = None
    for k in range(rounds + 1):
        source = state.df if state else rows.select("id", "x", F.lit(-1).alias("owner"), F.lit(MOST).alias("distance"), F.lit(-1).alias("was"))
        after = store(_assign(source, clusters, size), "assigned")
        if state:
            state.drop()
        state = after
        if k == rounds:
            break
        for t in _transfers(state.df, size, count).collect():  # at most `clusters` x (`size` + 1) totals
            clusters.transfer(t["cluster"], t["component"], int(t["amount"]))
        clusters.update()
        if not clusters.moved:
            break
    return state, clusters


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3",
) -> DataFrame:
    """id, cluster, squared distance, inertia of the cluster and of all, and a digest of the final centroid."""
    rows = usable(vectors, id_col, vector_col, size, scale)
    first = seeds(rows, clusters, salt)
    if not first:
        return rows.where("false").select(
            F.col("id").alias(id_col), F.lit(0).alias("cluster"), *(F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256")
        )
    state, final = lloyd(rows, Clusters(first), rounds, size)
    inertia = {r["owner"]: int(r["s"]) for r in state.df.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.centroids]
    sums = [min(inertia.get(k, 0), MOST) for k in range(len(digests))]
    per_cluster = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("owner") + 1)
    return state.df.select(
        F.col("id").alias(id_col), F.col("owner").alias("cluster"), "distance", per_cluster(sums).cast("bigint").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), MOST)).cast("bigint").alias("inertia"), per_cluster(digests).alias("centroid_sha256"),
    )
