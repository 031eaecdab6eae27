"""Shards of near-equal bytes by a k-d tree over metadata dimensions.

Starting from all rows, a node is split at the weighted median of its widest dimension (the range inside the node over
the range of all rows) until each leaf holds one shard's share of the bytes. A node that stands for s shards gives
s // 2 of them to its left child, with that share of its bytes.

The weighted median is distributed: bytes are summed by cells of the dimension (at most 2^16 a node), a running sum
over the cells finds the one in which the share ends, and while that cell is heavier than the tolerance it is cut
again, by 16 bits at a time of the text's hash and then of the identifier's. So rows of equal texts stay together
unless their group is too heavy for a near-equal split. Only one row for each node reaches the driver.

Slots number the rows of a shard without gaps: rows are numbered inside (shard, bucket) groups of bounded size, and
each bucket starts where the counts of those before it end.

Defined results: a null text weighs 1 byte and has a null checksum; null dimensions count as 0; repeated rows are
separate rows with slots of their own; an empty table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import crc32_text, store

CELLS = 1 << 16


@dataclass
class Node:
    """A node of the tree: its shards, and the cut that its search has found so far."""

    first: int
    shards: int
    dim: int = 0
    low: float = 0.0
    width: float = 0.0
    share: float = 0.0  # bytes that belong to the left child
    done: float = 0.0  # bytes of the cells before the cut
    cells: list[int] = field(default_factory=list)
    include: bool = False  # whether the last cell goes left
    open: bool = True


def text_dimensions(text: Column) -> list[Column]:
    """Metadata that equal texts share: logarithm of the size, bytes per character, characters per space, logarithm of
    the lines."""
    size, n = F.octet_length(text), F.length(text)
    spaces, lines = (n - F.length(F.replace(text, F.lit(c))) + 1 for c in (" ", "\n"))
    return [F.log2(size + 1), size / F.greatest(n, F.lit(1)), F.log2(n / spaces + 1), F.log2(lines)]


def kd_shards(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", dimensions: list[Column] | None = None,
    tolerance: float = 0.002, bucket_rows: int = 5000,
) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.col(text_col).cast("string")
    dims = dimensions or text_dimensions(text)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        crc32_text(text).alias("text_crc32"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"),
        *[F.coalesce(d.cast("double"), F.lit(0.0)).alias(f"d{k}") for k, d in enumerate(dims)],
    )
    table = store(rows.withColumn("node", F.lit(0)), "metadata")
    spans = [F.max(f"d{k}") - F.min(f"d{k}") for k in range(len(dims))]
    total, count, *ranges = table.df.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), *spans).first()
    most = max(1.0, tolerance * total / shards)
    nodes = {0: Node(0, shards)}
    while count and any(n.shards > 1 for n in nodes.values()):
        splitting = {k: n for k, n in nodes.items() if n.shards > 1}
        _choose_dimensions(table.df, splitting, ranges)
        coordinates = _coordinates(table.df, splitting, len(dims))
        stage = 0
        while any(n.open for n in splitting.values()):  # the fifth stage closes what is left
            _narrow(coordinates, splitting, stage, most, last=stage == 4)
            stage += 1
        moved = coordinates.withColumn("node", _side(splitting)).select("id", "size", "text_crc32", "h", "node", *[f"d{k}" for k in range(len(dims))])
        after = store(moved, "metadata")
        table.drop()
        table = after
        nodes = {c.first: c for n in nodes.values() for c in ([n] if n.shards == 1 else [Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)])}
    return _with_slots(table.df, count, shards, bucket_rows).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("node").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _by_node(nodes: dict[int, Node], value) -> Column:
    """The value of each row's node: a literal map, of one entry for each node of the level."""
    pairs = [x for k, n in nodes.items() for x in (F.lit(k), F.lit(value(n)))]
    return F.create_map(*pairs)[F.col("node")]


def _choose_dimensions(df: DataFrame, nodes: dict[int, Node], ranges: list[float]) -> None:
    n_dims = len(ranges)
    stats = df.where(F.col("node").isin(list(nodes))).groupBy("node").agg(F.sum("size").alias("size"), *[F.min(f"d{k}").alias(f"lo{k}") for k in range(n_dims)], *[F.max(f"d{k}").alias(f"hi{k}") for k in range(n_dims)])
    found = stats.collect()  # one row for each node that has rows
    for k in set(nodes) - {r.node for r in found}:
        nodes[k].open = False
    for r in found:
        n = nodes[r.node]
        widths = [r[f"hi{k}"] - r[f"lo{k}"] for k in range(n_dims)]
        n.dim = max(range(n_dims), key=lambda k: widths[k] / ranges[k] if ranges[k] else 0.0)
        n.low, n.width, n.share = r[f"lo{n.dim}"], widths[n.dim], r["size"] * (n.shards // 2) / n.shards


def _coordinates(df: DataFrame, nodes: dict[int, Node], n_dims: int) -> DataFrame:
    """Five coordinates of 16 bits that order the rows of a node: dimension, text hash twice, identifier hash twice."""
    value = F.array(*[F.col(f"d{k}") for k in range(n_dims)])[_by_node(nodes, lambda n: n.dim)]
    width = _by_node(nodes, lambda n: float(n.width))
    place = F.when(width > 0, F.floor((value - _by_node(nodes, lambda n: float(n.low))) / width * (CELLS - 1))).otherwise(0)
    own = F.xxhash64("id", "h")
    bits = [F.shiftrightunsigned("h", 48), F.shiftrightunsigned("h", 32).bitwiseAND(CELLS - 1), F.shiftrightunsigned(own, 48), F.shiftrightunsigned(own, 32).bitwiseAND(CELLS - 1)]
    return df.withColumns({"c0": F.coalesce(place, F.lit(0)).cast("int")} | {f"c{k}": b.cast("int") for k, b in enumerate(bits, 1)})


def _narrow(df: DataFrame, nodes: dict[int, Node], stage: int, most: float, last: bool) -> None:
    """Find, in each open node, the cell of this stage in which the left child's share ends."""
    now = {k: n for k, n in nodes.items() if n.open}
    inside = df.where(F.col("node").isin(list(now)))
    for s in range(stage):
        inside = inside.where(F.col(f"c{s}") == _by_node(now, lambda n, s=s: n.cells[s]))
    cell = F.col(f"c{stage}")
    order = Window.partitionBy("node").orderBy("cell")
    sums = inside.groupBy("node", cell.alias("cell")).agg(F.sum("size").alias("size"))
    running = sums.withColumn("upto", F.sum("size").over(order) + _by_node(now, lambda n: int(n.done)))
    crossing = running.where(F.col("upto") >= _by_node(now, lambda n: float(n.share))).groupBy("node").agg(F.min_by(F.struct("cell", "size", "upto"), "cell").alias("x"))
    for r in crossing.collect():  # one row for each node
        n = now[r.node]
        n.cells.append(r.x.cell)
        n.done = r.x.upto - r.x.size
        if r.x.size <= most or last:
            n.include = n.share - n.done >= r.x.size / 2
            n.open = False


def _side(nodes: dict[int, Node]) -> Column:
    """The child of each row: left if its coordinates come before the cut."""
    column = F.col("node")
    for k, n in nodes.items():
        left: Column = F.lit(n.include)
        for s in range(len(n.cells) - 1, -1, -1):
            c = F.col(f"c{s}")
            left = (c < n.cells[s]) | ((c == n.cells[s]) & left)
        column = F.when(F.col("node") == k, F.when(left, F.lit(n.first)).otherwise(F.lit(n.first + n.shards // 2))).otherwise(column)
    return column


def _with_slots(df: DataFrame, count: int, shards: int, bucket_rows: int) -> DataFrame:
    buckets = max(16, -(-count // (shards * bucket_rows)))
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64("id", "h", F.lit(1)), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("node", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("start", F.coalesce(before, F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("node", "bucket").orderBy("id", "h")) - 1
    return dealt.withColumn("_slot", inside).join(starts, ["node", "bucket"]).withColumn("slot", (F.col("start") + F.col("_slot")).cast("bigint"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows of `docs` by shard folder; identifiers must be unique."""
    places = assigned.select(F.col(id_col).alias("_id"), F.col("shard").alias("_shard"))
    docs.join(places, docs[id_col].eqNullSafe(places["_id"])).drop("_id").write.partitionBy("_shard").parquet(path)
