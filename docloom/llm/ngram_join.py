"""Jaccard self-join of texts on word n-grams with rare-first prefix filtering.

A text's set holds its distinct n-grams of words as 64-bit hashes. Two texts link when their sets' intersection is at
least `percent` % of the union. The order that prefixes follow is rare first: n-grams are ranked by a frequency
sketch over all texts (a count per hash bucket; the number of buckets is fixed, so the sketch has one size whatever
the input), ties by hash. Any total order finds every link; frequencies only make prefixes selective.

Equal sets are one node from the start, so exact copies cost one prefix per task. A node's prefix n-grams are
gathered by n-gram; an n-gram that the sketch knows to be frequent is dealt over several groups, so no group
outgrows `group_rows` much. Then links are found in two steps:

1. In each group the node that ranks the group's n-gram first is the pivot; every node is verified against the two
   pivots it shares most n-grams with. The links give components. This is repeated with pivots from each n-gram's
   largest component, for the nodes outside it, while a round finds much.
2. Only pairs of nodes of different components are left to compare, since a link inside a component changes nothing.
   Those of one n-gram that pass the length and positional filters, and whose signatures (parities of element counts,
   a bound on the sets' difference as the suffix filter's) do not rule a link out, are verified once each, with the
   suffix filter before the intersection.

So a group of thousands of near copies costs thousands of comparisons, not their square, and no link between
different texts is lost.

Defined results: null texts and texts without words have the empty set, no link and themselves as component; a text of
fewer than n words has its whole sequence as one n-gram; repeated rows link like copies; other columns are ignored.
Node keys are 64-bit digests of sets: two different sets share one with odds of 2^-64 a pair.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import Stored, bounded_batches, drop_shuffles, sliced, store
from docloom.llm.components import connected_components
from docloom.llm.words import Splitter, mix, windows

#: The sketch counts n-grams by the top bits of their hash: 26 at most, in blocks of 2^16 buckets.
BUCKET_BITS = 26
BLOCK_BITS = 16
#: Least counts of the sixteen levels that a bucket's count is kept as, in four bits.
LEVELS = np.array([1, 2, 4, 8, 16, 32, 64, 128, 256, 1 << 10, 1 << 12, 1 << 14, 1 << 18, 1 << 22, 1 << 26, 1 << 30], np.uint64)
FLUSH = 2_000_000
#: Prefix rows that a task holds at once: before it packs them, and of one range of groups.
PLACE_ROWS = 300_000
FILTER_BITS = 26


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text's word hashes."""
    if not len(h):
        return np.zeros(0, np.uint64)
    k = min(n, len(h))
    return np.unique(windows(h, tuple(range(k))) ^ np.uint64(0xC2B2AE3D27D4EB4F * (k if k < n else 0) % 2**64))


def set_key(s: np.ndarray) -> int:
    """Digest of a set as a signed 64-bit integer."""
    total = mix(s).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(s) * 0x9FB21C651E98DF25 % 2**64)
    return int(mix(total).view(np.int64)[0])


#: Words of a text: A-Z lower-cased, split at ASCII white space.
split = Splitter(b"\x20\x09\x0a\x0b\x0c\x0d")


def set_of(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text."""
    return shingles(split((text or "").encode("utf-8")), n)


def required(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def suffix_may_link(x: np.ndarray, y: np.ndarray, need: int, depth: int = 2) -> bool:
    """Suffix filter: split both sorted sets at the middle of one; unequal parts bound the intersection from above."""
    if min(len(x), len(y)) < need:
        return False
    if not depth or not len(y):
        return True
    middle = y[len(y) // 2]
    i, j = int(np.searchsorted(x, middle)), len(y) // 2
    left, right = min(i, j), min(len(x) - i, len(y) - j)
    if left + right < need:
        return False
    return suffix_may_link(x[:i], y[:j], need - right, depth - 1) and suffix_may_link(x[i:], y[j:], need - left, depth - 1)


def signature(s: np.ndarray) -> np.ndarray:
    """Parities of a set's counts by hash bucket, as four 64-bit integers.

    Each element of the symmetric difference of two sets changes one parity, so two signatures differ in at most as
    many bits as the sets differ in elements.
    """
    odd = np.bincount((s & np.uint64(255)).astype(np.intp), minlength=256).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    need = required(len(x), len(y), percent)
    if not suffix_may_link(x, y, need):
        return False
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum()) >= need


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))


def measure(rows: DataFrame, n: int) -> DataFrame:
    """One pass over all texts: rows (kind 0) with id, set size and key; rows (kind 1) with blocks of n-gram counts."""
    names = ["kind", "id", "size", "key", "counts"]

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        """Blocks of (low bits, count) of the buckets held, packed."""
        buckets, counts = np.unique(np.concatenate(held), return_counts=True)
        blocks = buckets >> BLOCK_BITS
        starts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        low, counts = (buckets & (1 << BLOCK_BITS) - 1).astype(np.uint16), counts.astype(np.uint32)
        packed = [zlib.compress(low[a:z].tobytes() + counts[a:z].tobytes(), 1) for a, z in zip(starts, [*starts[1:], len(blocks)], strict=True)]
        m = len(packed)
        return pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.array(blocks[starts].astype(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(packed, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in sliced(batches):
            sets = [set_of(t.as_py(), n) for t in b.column(1)]
            held += [(s >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32) for s in sets if len(s)]
            keys = [set_key(s) if len(s) else None for s in sets]
            k = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.nulls(k, pa.binary())], names)
            if sum(map(len, held)) > FLUSH:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    return rows.mapInArrow(run, "kind int, id bigint, size bigint, key bigint, counts binary")


class Frequencies:
    """Levels of bucket counts, two to a byte."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def level(self, s: np.ndarray) -> np.ndarray:
        bucket = s >> np.uint64(64 - self.bits)
        return self.packed[bucket >> np.uint64(1)] >> ((bucket & np.uint64(1)) << np.uint64(2)).astype(np.uint8) & 15


def frequencies(measured: DataFrame, grams: int) -> Frequencies:
    """The sketch: as many buckets as there are n-grams, but 2^BUCKET_BITS (32 MB of levels) at most."""
    bits = min(BUCKET_BITS, max(BUCKET_BITS - BLOCK_BITS + 1, (max(1, grams) - 1).bit_length()))
    fold = 1 << BUCKET_BITS - bits  # so many buckets count as one

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = zlib.decompress(packed)
                m = len(part) // 6
                low, counts = np.frombuffer(part, np.uint16, m), np.frombuffer(part, np.uint32, m, 2 * m)
                if k not in sums:
                    sums[k] = np.zeros((1 << BLOCK_BITS) // fold, np.uint64)
                np.add.at(sums[k], low // fold, counts.astype(np.uint64))
        levels = [(np.searchsorted(LEVELS, np.maximum(x, 1), side="right") - 1).astype(np.uint8) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([(x[0::2] | x[1::2] << 4).tobytes() for x in levels], pa.binary())], ["id", "levels"])

    blocks = measured.where("kind = 1").select("id", "counts")
    got = blocks.repartition("id").mapInArrow(total, "id bigint, levels binary").toArrow()
    width = (1 << BLOCK_BITS) // fold // 2
    out = np.zeros((1 << BUCKET_BITS - BLOCK_BITS, width), np.uint8)
    for k, levels in zip(got.column("id"), got.column("levels"), strict=True):
        out[k.as_py()] = np.frombuffer(levels.as_buffer(), np.uint8)
    return Frequencies(bits, out.reshape(-1))


#: A prefix row's size and position share one integer; no text that Spark holds has 2^31 n-grams.
POS_BITS = 32
#: Times a part, what turns a frequent n-gram into the group key of that part.
PART_STEP = 0x2545F4914F6D
#: Bits of a hash that prefix rows keep, and the bit below them, which tells n-grams that are dealt over parts.
GRAM = np.uint64(-(1 << 17) % 2**64)
DEALT = 1 << 16


def grams_of(s: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """N-grams as prefix rows tell them apart: 47 bits of the hash, and whether they are dealt over parts.

    What a row writes is mostly its hash. Two n-grams that share these bits only give pairs to verify that share none;
    those that do are met under their own n-gram, and the bit keeps n-grams that are dealt out from others.
    """
    return s & GRAM | (parts > 1).astype(np.uint64) * np.uint64(DEALT)


def group_step(part: np.ndarray) -> np.ndarray:
    """What an n-gram and the group key of one of its parts differ by."""
    return (part * PART_STEP).view(np.uint64) & GRAM


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes by significance, so that those that are all alike pack to nothing."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplaned(data: bytes, at: int, m: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, m * width, at).reshape(width, m).T).view(kind).reshape(m)


def pack_rows(group: np.ndarray, key: np.ndarray, part: np.ndarray, where: np.ndarray) -> bytes:
    """Prefix rows in order of group, as differences of groups and places among the distinct keys."""
    order = np.argsort(group)
    keys, place = np.unique(key[order], return_inverse=True)
    steps = np.diff(group[order], prepend=np.uint64(0))
    columns = (_planes(steps), _planes(place.astype(np.uint32)), _planes(where[order]), _planes(part[order].astype(np.uint32)), keys.tobytes())
    return np.array([len(group)], np.uint32).tobytes() + zlib.compress(b"".join(columns), 1)


def unpack_rows(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """group, key, part, and size and position of the rows."""
    m = int(np.frombuffer(blob, np.uint32, 1)[0])
    data = zlib.decompress(blob[4:])
    group = np.cumsum(_unplaned(data, 0, m, np.uint64), dtype=np.uint64)
    place, where, part = _unplaned(data, 8 * m, m, np.uint32), _unplaned(data, 12 * m, m, np.int64), _unplaned(data, 20 * m, m, np.uint32)
    return group, np.frombuffer(data, np.int64, -1, 24 * m)[place], part.astype(np.int64), where


def prefixes(rows: DataFrame, known: Frequencies, grams: int, n: int, percent: int, group_rows: int) -> DataFrame:
    """Prefix rows of all sets by range of group, many to a blob: there are a quarter as many as the corpus has n-grams.

    A row has a group (the n-gram, or one of the parts that a frequent one is dealt over), a key, a part, and size and
    position.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(known)
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), grams * (100 - percent) // 100 // PLACE_ROWS)
    shift = np.uint64(64 - max(1, (ranges - 1).bit_length()))

    def flush(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
        group, key, part, where = (np.concatenate(x) for x in columns)
        place = (group >> shift).astype(np.int64)
        order = np.argsort(place, kind="stable")
        edges = np.flatnonzero(np.diff(place[order], prepend=-1))
        cuts = [order[a:z] for a, z in zip(edges, [*edges[1:], len(order)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(place[order[edges]]), pa.array([pack_rows(group[c], key[c], part[c], where[c]) for c in cuts], pa.binary())], ["place", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, known = set(), shared.value
        columns: list[list[np.ndarray]] = [[], [], [], []]
        held = 0
        for b in sliced(batches):
            for t in b.column(1):
                s = set_of(t.as_py(), n)
                if not len(s) or (key := set_key(s)) in met:
                    continue
                if len(met) > 1_000_000:
                    met.clear()
                met.add(key)
                length = len(s) - -(-percent * len(s) // 100) + 1
                level = known.level(s)
                first = np.argsort(level, kind="stable")[:length]  # s is sorted, so ties go by hash
                parts = np.maximum(1, 4 * LEVELS[level[first]] // np.uint64(group_rows)).astype(np.int64)
                part = np.where(parts > 1, 1 + (key & 0x7FFFFFFF) % parts, 0)
                columns[0].append(grams_of(s[first], parts) ^ group_step(part))
                columns[1].append(np.full(length, key))
                columns[2].append(part)
                columns[3].append(len(s) << POS_BITS | np.arange(length))
                held += length
                if held > PLACE_ROWS:
                    yield flush(columns)
                    columns, held = [[], [], [], []], 0
        if held:
            yield flush(columns)

    return rows.mapInArrow(run, "place bigint, blob binary")


def shared_rows(blobs: DataFrame, percent: int) -> DataFrame:
    """Rows of groups that several sets share (gram, part, key, size, pos), with the group's pivot.

    Blobs meet by range of group, and a task holds one range at a time: PLACE_ROWS rows or so, since n-grams are spread
    by their hash and a frequent one is dealt over several groups. The pivot has the least of its n-grams ranked before
    this one. Two rows alone that no link can join are left out; rows of an n-gram that is dealt out stay, since they may
    meet in another part.
    """

    def shared(group: np.ndarray, key: np.ndarray, part: np.ndarray, where: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(starts, append=len(group))
        size, pos = where >> POS_BITS, where & (1 << POS_BITS) - 1
        keep, dealt = np.minimum.reduceat(key, starts) != np.maximum.reduceat(key, starts), np.maximum.reduceat(part, starts) > 0
        two = starts[(sizes == 2) & keep & ~dealt]
        a, b = size[two], size[two + 1]
        may = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & ((100 + percent) * np.minimum(a - pos[two], b - pos[two + 1]) >= percent * (a + b))
        keep[np.searchsorted(starts, two[~may])] = False
        rows = np.flatnonzero(np.repeat(keep | dealt, sizes))
        group, key, part, size, pos = (x[rows] for x in (group, key, part, size, pos))
        order = np.lexsort((key, size, pos, group))
        leads = np.flatnonzero(np.diff(group[order], prepend=~group[order[:1]]))
        pivot = np.empty(len(group), np.int64)
        pivot[order] = np.repeat(order[leads], np.diff(leads, append=len(group)))
        arrays = [group ^ group_step(part).view(np.int64), part.astype(np.int32), key, size.astype(np.int32), pos.astype(np.int32), key[pivot], size[pivot].astype(np.int32), pos[pivot].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["gram", "part", "key", "size", "pos", "p_key", "p_size", "p_pos"])

    def of_place(blobs: list[bytes]) -> pa.RecordBatch:
        group, key, part, where = (np.concatenate(x) for x in zip(*map(unpack_rows, blobs), strict=True))
        order = np.argsort(group)
        return shared(group[order].view(np.int64), key[order], part[order], where[order])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None
        for b in batches:
            for place, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if place != last and held:
                    yield of_place(held)
                    held = []
                last = place
                held.append(blob.as_py())
        if held:
            yield of_place(held)

    rows = blobs.repartition("place").sortWithinPartitions("place")
    found = rows.mapInArrow(read, "gram bigint, part int, key bigint, size int, pos int, p_key bigint, p_size int, p_pos int")
    return found.select("gram", "part", "key", "size", "pos", F.struct(F.col("p_key").alias("key"), F.col("p_size").alias("size"), F.col("p_pos").alias("pos")).alias("least"))


def _may_link(percent: int, a: str, b: str) -> str:
    """SQL of the length and positional filters for the n-gram that rows a and b share."""
    return (
        f"100 * least({a}.size, {b}.size) >= {percent} * greatest({a}.size, {b}.size) and "
        f"{100 + percent} * (least({a}.size - {a}.pos, {b}.size - {b}.pos)) >= {percent} * ({a}.size + {b}.size)"
    )


def _signs_may_link(percent: int, a: str, b: str) -> str:
    """SQL of a bound like the suffix filter's: signatures that differ in more bits than linked sets do in elements."""
    bits = " + ".join(f"bit_count({a}.s{k} ^ {b}.s{k})" for k in range(4))
    return f"{100 + percent} * ({bits}) <= {100 - percent} * ({a}.size + {b}.size)"


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link; `texts` holds key and the packed text once for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        total = 0  # n-grams kept

        def sets(key: int, packed: bytes) -> np.ndarray:
            nonlocal total
            if key not in kept:
                if total > 1_000_000:
                    kept.clear()
                    total = 0
                kept[key] = shingles(split(zlib.decompress(packed)), n)
                total += len(kept[key])
            return kept[key]

        for b in sliced(batches):
            x, y = b.column(0).to_pylist(), b.column(1).to_pylist()
            ok = [links(sets(i, p), sets(j, q), percent) for i, j, p, q in zip(x, y, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])

    left = texts.select(F.col("key").alias("a"), F.col("packed").alias("pa"))
    right = texts.select(F.col("key").alias("b"), F.col("packed").alias("pb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(run, "a bigint, b bigint")


def pack_texts(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Key, packed text and signature (s0 to s3) of the documents in `wanted` (id, key).

    They are found by a bit filter of fixed size and then by join.
    """
    slots = 1 << FILTER_BITS
    slot = F.xxhash64(F.col("id"), F.lit(FILTER_BITS)).bitwiseAND(slots - 1)
    bits = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("bits")).toArrow()
    table = np.zeros(slots >> 5, np.uint32)
    table[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().astype(np.uint32)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in sliced(batches):
            s = b.column(2).to_numpy()
            some = b.filter(pa.array((table[s >> 5] >> (s & 31).astype(np.uint32)) & 1 > 0))
            texts = [(t.as_py() or "").encode("utf-8") for t in some.column(1)]
            packed = pa.array([zlib.compress(t, 3) for t in texts], pa.binary())
            sets = [shingles(split(t), n) for t in texts]
            keys = pa.array([set_key(x) if len(x) else None for x in sets], pa.int64())
            signs = np.array([signature(x) for x in sets], np.int64).reshape(len(sets), 4)
            yield pa.RecordBatch.from_arrays([some.column(0), keys, packed, *(pa.array(signs[:, k]) for k in range(4))], ["id", "key", "packed", "s0", "s1", "s2", "s3"])

    found = rows.where("id is not null").select("id", "text", slot.alias("slot")).mapInArrow(run, "id bigint, key bigint, packed binary, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    return found.join(wanted, ["id", "key"], "left_semi").drop("id").dropDuplicates(["key"])


def _best_pivots(pairs: DataFrame, most: int = 2) -> DataFrame:
    """For each node b, the pivots a that it shares most n-grams with."""
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    order = Window.partitionBy("b").orderBy(F.desc("n"), "a")  # a node has at most one pivot for each n-gram of its own
    return counted.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("a", "b")


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` that `tried` holds in neither order."""
    known = tried.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    return pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(known, ["lo", "hi"], "left_anti").select("a", "b")


def _sided(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of n-grams that nodes of more than one component hold, with their root and, of their n-gram, the
    component that holds most of its rows, two pivots of that, and the last of the parts it is dealt over.

    What is known of an n-gram meets its rows part by part, so no task holds all rows of a frequent one.
    """
    marked = rows.select("gram", "part", "key", "size", "pos").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    own = F.struct("key", "size", "pos")
    by_root = marked.groupBy("gram", "root").agg(F.count("*").alias("n"), F.max("part").alias("last"), F.min_by(own, F.struct("pos", "key")).alias("p"), F.min_by(own, F.xxhash64("key", "gram")).alias("q"))
    of_gram = by_root.groupBy("gram").agg(F.count("*").alias("roots"), F.max("last").alias("last"), F.max_by(F.struct(F.col("root").alias("largest"), "p", "q"), F.struct("n", "root")).alias("top")).where("roots > 1")
    dealt = of_gram.select("gram", F.explode(F.sequence(F.when(F.col("last") > 0, 1).otherwise(0), "last")).alias("part"), "last", "top.largest", "top.p", "top.q")
    return marked.join(dealt, ["gram", "part"])


def _rest(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share an n-gram and may link: rows outside its largest one against all.

    Rows of either side go to every part of their n-gram, so a block of pairs has two parts and no task holds all rows
    of an n-gram. Sizes that differ by a step of more than one in a
    scale of 100 / percent never meet.
    """
    step = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("size").cast("int")
    fields = F.struct("key", "size", "pos", "root", "s0", "s1", "s2", "s3")
    every = F.explode(F.sequence(F.when(F.col("last") > 0, 1).otherwise(0), "last"))
    x = rows.where("root != largest").select("gram", F.col("part").alias("px"), every.alias("py"), F.array(step - 1, step, step + 1).alias("steps"), fields.alias("x")).withColumn("step", F.explode("steps")).drop("steps")
    y = rows.select("gram", every.alias("px"), F.col("part").alias("py"), step.alias("step"), fields.alias("y"))
    met = x.join(y, ["gram", "px", "py", "step"]).where(f"x.root != y.root and {_may_link(percent, 'x', 'y')} and {_signs_may_link(percent, 'x', 'y')}")
    return met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, group_rows: int = 2_000
) -> DataFrame:
    """id, n_shingles and component_id (the least id reachable by links) of every row of `docs`."""
    rows = _read(docs, id_col, text_col)
    spark = docs.sparkSession
    bounded_batches(spark)

    kept: list[Stored] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        """A table in the shared folder, after which the shuffles that made it can go."""
        kept.append(store(df, name))
        drop_shuffles(spark)
        return kept[-1].df

    def forget(*tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for table in [t for t in kept if any(t.df is x for x in tables)]:
            table.drop()
            kept.remove(table)

    def merged(known: Stored, more: DataFrame) -> Stored:
        """Components of the links that gave the known ones, and more: a node's link with its root stands for the former."""
        after = connected_components(known.df.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        known.drop()
        return after

    measured = keep(measure(rows, n), "measured")
    sizes = keep(measured.where("kind = 0").select("id", "size", "key"), "sizes")
    grams = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    known = frequencies(measured, grams)
    forget(measured)
    nodes = keep(sizes.where("key is not null").groupBy("key").agg(F.min("id").alias("id")), "nodes")
    shared = keep(shared_rows(prefixes(rows, known, grams, n, percent, group_rows), percent), "shared")
    texts = keep(pack_texts(rows, nodes.join(shared.select("key").distinct(), "key"), n), "texts")

    near = shared.alias("x").where(f"x.key != x.least.key and {_may_link(percent, 'x', 'x.least')}").select(F.col("least.key").alias("a"), F.col("key").alias("b"))
    tried = keep(_best_pivots(near), "tried")
    found = keep(verified(tried, texts, n, percent), "found")
    rounds, joined = shared, connected_components(found)
    while True:
        sided = keep(_sided(rounds, joined.df), "sided")  # components only merge, so what is left shrinks
        forget(rounds)
        rounds = sided
        # Another pivot for each n-gram, from its largest component; rounds go on while they find much.
        asked = rounds.where("root != largest").withColumn("pivot", F.explode(F.array("p", "q"))).alias("x").where(_may_link(percent, "x", "x.pivot"))
        again = keep(_best_pivots(_untried(asked.select(F.col("pivot.key").alias("a"), F.col("key").alias("b")), tried)), "tried")
        more = keep(verified(again, texts, n, percent), "found")
        links_found, links_asked = more.count(), again.count()
        tried = tried.union(again)
        joined = merged(joined, more)
        if links_found * 10 < links_asked or not links_asked:
            break
    if links_found:
        sided = keep(_sided(rounds, joined.df), "sided")
        forget(rounds)
        rounds = sided

    # What is left: pairs of different components, those outside an n-gram's largest component against all others.
    signed = rounds.drop("p", "q").join(texts.select("key", "s0", "s1", "s2", "s3"), "key")
    rest = keep(_untried(_rest(keep(signed, "signed"), percent), tried), "rest")
    final = merged(joined, verified(rest, texts, n, percent))

    rooted = nodes.join(final.df.withColumnRenamed("node", "key"), "key", "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "root").select("key", "component_id")
    linked = sizes.where("key is not null").join(named, "key").select("id", "size", "component_id")
    alone = sizes.where("key is null").select("id", "size", F.col("id").alias("component_id"))
    result = store(linked.union(alone), "components").df
    final.drop()
    forget(*[t.df for t in kept])
    drop_shuffles(spark)
    return result.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` whose identifier is the least of its component, with their own columns.

    Rows that share an identifier are one document: they stay or go together.
    """
    classes = ngram_components(docs, id_col, text_col, **how).groupBy(id_col).agg(F.min("component_id").alias("least"))
    gone = store(classes.where(F.col(id_col) > F.col("least")).select(F.col(id_col).alias("_gone")), "gone").df
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")  # broadcast where the table's size allows
