"""Exact top-k by inner product with no-random-access aggregation (NRA).

Vectors are dealt into blocks of bounded size. In a block each dimension is a list sorted by its component, made once.
For a query all lists are read in order, from the end that is best for it, some entries at a time. What has been read
gives each vector a lower bound (unread lists count with their worst value) and an upper bound (unread lists count with
the value at the reading position), and gives those not met yet one upper bound in common. A vector whose upper bound
is under the k-th best lower bound, or under a score that k others are known to reach, cannot qualify and is set aside;
reading stops when no outsider can qualify, that is when k are left, or at the lists' ends; then final scores are
resolved. Blocks of every size and values of every size are read so. Bounds are doubles; where sums reach 2^53 they get
a margin for rounding, and final scores are whole numbers of any size.

Queries and blocks meet in two passes by shuffle, so a task holds one block and one part of the queries, and nothing is
broadcast. The first pass takes each query to its own block, which gives it a floor: the score of its k-th best there.
The second takes it to every other block that its floor does not rule out: the best values of a block's lists bound all
scores in it. Blocks follow the dimension in which a vector is largest, so like vectors share one, and a heavy cell is
split by hash. Each group's k best are ranked together at the end.

Components are turned into floor(scale * x), x as double, so scores are integers and ties are exact.

Defined results: vectors that are null, or hold null or non-finite components, take no part, neither as query nor as
candidate; vectors of another length than a query count as no candidate of it; a query with fewer than k candidates
gets all; ties go to the smaller identifier; repeated identifiers are separate candidates, except for the query's own;
of queries that share an identifier the least vector is asked; components that floor(scale * x) takes beyond the doubles count as
the greatest double; a score beyond 64 bits counts as the nearest 64-bit integer; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import store

#: Shares (of sixteenths) of each list that are read when bounds are compared.
READS = 16
STOPS = (1, 2, 4, 8, 10, 12, 14, 16)
#: Blocks whose ends of lists a task compares with a part of the queries.
GROUP = 4096
LEAST, MOST = -(2**63), 2**63 - 1


class SortedLists:
    """A block of vectors of whole numbers with one list for each dimension: identifiers' places sorted by component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids = ids
        self.rows = np.nan_to_num(rows.astype(np.float64))
        places = np.argsort(self.rows, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(self.rows, places, 0).T)
        self.places = np.ascontiguousarray(places.T)
        self.cells = self.places * rows.shape[1] + np.arange(rows.shape[1])[:, None]  # of a table of rows by dimensions
        self.read = 0  # entries of each list that the last query read
        self.unseen = np.empty(rows.shape)  # 1 where a row's entry in a list is not read yet; made anew for each query

    def _resolve(self, some: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        """Final scores; whole numbers that doubles may not hold are multiplied as such."""
        if exact:
            return (self.rows[some] @ query).astype(np.int64)
        whole = [int(c) for c in query]
        sums = (sum(int(x) * c for x, c in zip(row, whole, strict=True)) for row in self.rows[some].tolist())
        return np.array([min(max(s, LEAST), MOST) for s in sums], np.int64)

    def top(self, query: np.ndarray, own: int, k: int, floor: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers, scores) of the k best rows but those with the query's own identifier.

        Rows under `floor` are left out.
        """
        m, n = self.rows.shape
        query = np.nan_to_num(np.asarray(query, np.float64))
        alive = np.flatnonzero(self.ids != own)
        with np.errstate(over="ignore"):
            most = float(np.sum(np.abs(query) * np.maximum(np.abs(self.values[:, 0]), np.abs(self.values[:, -1]))))
        self.read = 0
        exact = most < 2**53
        alive = self._alive(query, alive, k, floor, 0.0 if exact else most * 2.0**-40)
        scores = self._resolve(alive, query, exact)
        if len(alive) > 4 * k:  # rank only what can be among the k best, ties included
            near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            alive, scores = alive[near], scores[near]
        reached = scores >= floor
        alive, scores = alive[reached], scores[reached]
        order = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive][order], scores[order]

    def _alive(self, query: np.ndarray, alive: np.ndarray, k: int, floor: int, margin: float) -> np.ndarray:
        """Places of rows that can still qualify when reading stops; bounds may be off by `margin` (0: exact)."""
        m, n = self.rows.shape
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        worst = np.zeros(n)
        worst[up], worst[down] = self.values[up, 0] * query[up], self.values[down, -1] * query[down]
        low = np.full(m, worst.sum())
        unseen = self.unseen
        unseen.fill(1.0)  # lists of a zero weight are never read, but add nothing
        edge = np.zeros(n)
        for stop in STOPS:
            a, z = self.read, max(1, math.ceil(m * stop / READS))
            if len(alive) <= k or z == a:
                continue
            for lists, part, last in ((up, slice(m - z, m - a), m - z), (down, slice(a, z), z - 1)):
                cells = self.cells[lists, part]
                gain = self.values[lists, part] * query[lists, None] - worst[lists, None]
                low += np.bincount(self.places[lists, part].ravel(), gain.ravel(), m)
                unseen.reshape(-1)[cells.ravel()] = 0.0
                edge[lists] = self.values[lists, last] * query[lists]
            self.read = z
            mine = low[alive]
            more = edge - worst
            high = mine + ((unseen @ more)[alive] if 4 * len(alive) > m else unseen[alive] @ more)
            bar = float(floor) if len(alive) < k else max(float(floor), np.partition(mine, len(mine) - k)[len(mine) - k])
            bar = min(bar, float(MOST)) - margin if bar > LEAST + margin else -np.inf  # scores beyond 64 bits count as equal
            alive = alive[~(high < bar)]  # what is no number stays
        return alive


def usable(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component as a double, or null for a vector that takes no part."""
    whole = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Doubles of 2^53 and more are whole already; floor() gives 64-bit integers and would cut them.
    floored = F.transform(whole, lambda x: F.when(F.abs(x * scale) < float(2**53), F.floor(x * scale).cast("double")).otherwise(x * scale))
    return F.when(sound & (F.size(vector) > 0), floored)


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """`rows` with the block of each: by length, the dimension of the largest component and its sign, then hash.

    There are at most twice as many cells as dimensions (for each length), whatever the number of rows.
    """
    biggest = F.array_max(F.transform("x", F.abs))
    cell = F.struct(F.size("x").alias("n"), F.array_position(F.transform("x", F.abs), biggest).alias("d"), (F.element_at("x", F.array_position(F.transform("x", F.abs), biggest).cast("int")) < 0).alias("s"))
    marked = rows.withColumn("cell", cell)
    counts = marked.groupBy("cell").agg(F.count("*").alias("rows"))
    start = F.coalesce(F.sum("rows").over(Window.partitionBy(F.col("cell.n")).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = marked.join(counts.withColumn("start", start), "cell")
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
    block = F.floor((F.col("start") + share * F.col("rows")) / block_rows)
    return placed.select("id", "x", "q", F.struct(F.col("cell.n").alias("n"), block.alias("b")).alias("block"))


def _other_blocks(queries: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """`queries` (id, x, home, floor) with every other block whose lists' best values reach the floor.

    The ends of the lists stand for a block: blocks are dealt into groups of GROUP, and queries into `parts`.
    """
    ends = rows.select("block", F.posexplode("x").alias("d", "v")).groupBy("block", "d").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lists = ends.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("d", "lo", "hi"))).alias("ends"))
    blocks = lists.select(
        F.struct(F.col("block.n").alias("n"), F.floor(F.col("block.b") / GROUP).alias("g")).alias("group"),
        F.col("block.b").alias("b"), F.transform("ends", lambda e: e["lo"]).alias("lo"), F.transform("ends", lambda e: e["hi"]).alias("hi"),
    )
    groups = blocks.groupBy("group.n").agg(F.max("group.g").alias("last"))
    asked = queries.withColumns({"n": F.size("x"), "part": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts))}).join(F.broadcast(groups), "n")  # one row for each length of vectors
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("g"), "n", "part", "id", "x", "floor", F.col("home.b").alias("home")).withColumn("group", F.struct("n", "g"))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def reach(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The (query, block) pairs that may hold a score of the floor or more."""
        out = [pd.DataFrame({"id": [], "n": [], "b": []}, dtype="int64")]
        if len(found) and len(asked):
            lo, hi, b = (np.stack(found[c].to_numpy()) for c in ("lo", "hi", "b"))
            for own, x, floor, home in zip(asked["id"], asked["x"], asked["floor"], asked["home"], strict=True):
                with np.errstate(over="ignore", invalid="ignore"):
                    bound = np.maximum(lo * x, hi * x).sum(1)
                # Sums of doubles beyond 2^53 are rounded, and beyond the range no number: those blocks stay.
                near = b[~(bound * (1 + 1e-9) + 1 < floor) & (b != home) if np.abs(bound).max() < 2**53 else b != home]
                out.append(pd.DataFrame({"id": own, "n": len(x), "b": near}))
        return pd.concat(out)

    pairs = blocks.groupBy("group", "part").cogroup(asked.groupBy("group", "part")).applyInPandas(reach, "id bigint, n int, b bigint")
    return pairs.select("id", F.struct("n", "b").alias("block")).join(queries.drop("home"), "id")


def _search(pairs: DataFrame, rows: DataFrame, k: int, query_rows: int) -> DataFrame:
    """query_id, vec_id and score of the k best of each (query, block) of `pairs` (id, x, floor, block)."""
    parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / query_rows).alias("parts"))
    asked = pairs.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), "parts"))
    block = rows.join(parts, "block").select(F.col("block").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("id").alias("vec_id"), F.col("x").alias("v"))

    def best(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        if len(found) and len(asked):
            lists = SortedLists(found["vec_id"].to_numpy(), np.stack(found["v"].to_numpy()))
            for own, x, floor in zip(asked["id"], asked["x"], asked["floor"], strict=True):
                ids, scores = lists.top(x, own, k, floor)
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(out)

    asked = asked.select(*[F.col(c).alias(c) for c in ("block", "part", "id", "x", "floor")])
    return block.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(best, "query_id bigint, vec_id bigint, score bigint")


def exact_top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024,
    block_rows: int = 8192, query_rows: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of every query."""
    read = vectors.select(F.col(id_col).cast("bigint").alias("id"), usable(vector_col, scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and x is not null")
    rows = store(_blocks(read, block_rows), "vectors").df
    queries = rows.where("q").groupBy("id").agg(F.min(F.struct("x", "block")).alias("least")).select("id", "least.x", F.col("least.block").alias("home"))
    near = store(_search(queries.select("id", "x", F.lit(LEAST).alias("floor"), F.col("home").alias("block")), rows, k, query_rows), "near").df
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = near.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    known = store(queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST))), "asked").df
    parts = max(1, math.ceil(known.count() / query_rows))
    far = _search(_other_blocks(known, rows, parts), rows, k, query_rows)
    # A block gives at most k rows of a query, and far blocks only those that reach its floor.
    best = near.union(far).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
