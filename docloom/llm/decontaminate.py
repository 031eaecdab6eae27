"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask: of a window of words it keeps some positions and ignores the rest, so a window whose words
were replaced only at ignored positions still has the same hash. Hashes of every window of every mask are joined
between test items and training texts; around each hit the item is laid on the text along the hit's diagonal and the
best stretch is verified word by word, with a limited share of substituted words.

Only windows that pass a Bloom filter of the items' seeds leave a task. The filter has a fixed size (`bloom_bits`),
whatever the number of items; with more items than it separates well, more windows reach the join and the result is
the same. Words are runs of characters without white space and ASCII punctuation, in lower case.

An overlap counts when some stretch of a diagonal has at least min(`min_words`, words of the item) words, of which at
least the share `identity` agree. Of 13 words and 80 % the masks miss no placement of substitutions in items of ten or
more words: each such stretch holds one of 13 to 25 words, and tests go through all of them. Items of fewer words get
seeds of their own length, one for each choice of words that may be replaced. Defined results: null and empty texts or
items have no overlap; items of fewer words than the shortest mask are sought whole and exactly; repeated rows of an
identifier count once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, sliced, store
from docloom.llm.words import Splitter, windows

#: Masks of six kept positions; each pair of them ignores different neighbours.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 7, 8), (0, 1, 4, 6, 8, 9), (0, 1, 2, 5, 6, 7), (0, 1, 3, 5, 7, 8))
SHORTEST = 1 + min(m[-1] for m in MASKS)
LONGEST = 1 + max(m[-1] for m in MASKS)
BLOOM_BITS = 26
split = Splitter(bytes(c for c in range(128) if not chr(c).isalnum()))
AROUND = 64


def word_hashes(text: str | None) -> np.ndarray:
    return split((text or "").lower().encode("utf-8"))


def own_masks(n: int, share: Fraction) -> tuple[tuple[int, ...], ...]:
    """Masks for items of n words, fewer than LONGEST: all n, or from SHORTEST words on every choice of the share."""
    return tuple(combinations(range(n), n if n < SHORTEST else max(1, -int(-share * n // 1))))


def seeds(h: np.ndarray, own: tuple[tuple[int, ...], ...]) -> list[tuple[np.ndarray, int]]:
    """(hashes by start, words covered) for every mask, then for the short items' own masks."""
    out = []
    for k, offsets in enumerate([*MASKS, *own]):
        got = windows(h, offsets)
        out.append((got ^ np.uint64(0x5851F42D4C957F2D * (k + 1 if k < len(MASKS) else 100 + sum(1 << o for o in offsets)) % 2**64), offsets[-1] + 1))
    return out


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return [h & low, (h >> np.uint64(20)) & low, (h >> np.uint64(38)) & low]


def best_stretch(agree: np.ndarray) -> tuple[int, int]:
    """[from, to) of the stretch with the greatest sum of +1 for each word that agrees and -3 for each that doesn't."""
    sums = np.concatenate([[0], np.cumsum(np.where(agree, 1, -3))])
    least = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - least))
    return int(np.argmin(sums[: end + 1])), end


def stretch(agree: np.ndarray, least: int, share: Fraction) -> tuple[int, int] | None:
    """[from, to) of a stretch of at least `least` words with at least the share of words that agree, if there is one.

    It is the best stretch where that one qualifies, else the one with the most agreeing words above the share.
    """
    sums = np.concatenate([[0], np.cumsum(np.where(agree, share.denominator - share.numerator, -share.numerator))])
    x, y = best_stretch(agree)
    if y - x >= least and sums[y] >= sums[x]:
        return x, y
    if len(agree) < least:
        return None
    above = sums[least:] - np.minimum.accumulate(sums[: len(sums) - least])
    k = int(np.argmax(above))
    return (int(np.argmin(sums[: k + 1])), k + least) if above[k] >= 0 else None


def overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_words: int = 13, identity: float = 0.8, bloom_bits: int = BLOOM_BITS,
) -> DataFrame:
    """One row for each text and item that overlap: identifiers, doc_start, item_start, n_words, n_same (word counts)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    share = Fraction(str(identity))
    around = max(AROUND, 2 * min_words)  # a stretch that qualifies holds one of fewer than twice the words

    def read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            words = [word_hashes(t.as_py()).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int64()))], ["item", "words"])

    source = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    known = store(source.where(F.col("item").isNotNull()).mapInArrow(read_items, "item bigint, words array<bigint>").where(F.size("words") > 0), "items")
    short = known.df.where(F.size("words") < LONGEST).select(F.size("words").alias("n")).distinct()
    own = tuple(m for r in sorted(short.collect()) for m in own_masks(r.n, share))  # at most LONGEST - 1 lengths

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            item, seed, at = [], [], []
            for i, words in zip(b.column(0), b.column(1), strict=True):
                h = words.values.to_numpy().view(np.uint64)
                for got, _ in seeds(h, own_masks(len(h), share) if len(h) < LONGEST else ()):
                    item.append(np.full(len(got), i.as_py(), np.int64))
                    seed.append(got.view(np.int64))
                    at.append(np.arange(len(got), dtype=np.int32))
            if item:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (item, seed, at)], ["item", "seed", "at"])

    item_rows = known.df.mapInArrow(item_seeds, "item bigint, seed bigint, at int")
    slots = 1 << bloom_bits
    found = item_rows.select(F.explode(F.array(
        F.col("seed").bitwiseAND(slots - 1),
        F.shiftrightunsigned("seed", 20).bitwiseAND(slots - 1),
        F.shiftrightunsigned("seed", 38).bitwiseAND(slots - 1),
    )).alias("slot"))
    # Set bits by word of 32: at most slots / 32 rows whatever the number of items.
    bits = found.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("bits")).toArrow()
    bloom = np.zeros(slots >> 5, np.uint32)
    bloom[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().astype(np.uint32)
    packed = spark.sparkContext.broadcast(bloom)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = packed.value

        def known_seed(h: np.ndarray) -> np.ndarray:
            """Starts whose seed is in the filter."""
            alive = np.arange(len(h))
            for k in range(3):
                slot = probes(h[alive], bloom_bits)[k]
                alive = alive[(table[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1 > 0]
                if not len(alive):
                    break
            return alive

        for b in sliced(batches):
            ids, starts, words, hit_seed, hit_at = [], [], [], [], []
            for i, text in zip(b.column(0), b.column(1), strict=True):
                h = word_hashes(text.as_py())
                at, seed, ends = [], [], []
                for got, covered in seeds(h, own):
                    here = known_seed(got)
                    at.append(here)
                    seed.append(got[here])
                    ends.append(here + covered)
                at, seed, ends = map(np.concatenate, (at, seed, ends))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, seed, ends = at[order], seed[order], np.maximum.accumulate(ends[order])
                # Hits whose surroundings touch share a segment of the text.
                new = np.flatnonzero(np.concatenate([[True], at[1:] > ends[:-1] + 2 * around]))
                for a, z in zip(new, [*new[1:], len(at)], strict=True):
                    first = max(0, int(at[a]) - around)
                    ids.append(i.as_py())
                    starts.append(first)
                    words.append(h[first : int(ends[z - 1]) + around].view(np.int64))
                    hit_seed.append(seed[a:z].view(np.int64))
                    hit_at.append((at[a:z] - first).astype(np.int32))
            lists = [pa.array(words, pa.list_(pa.int64())), pa.array(hit_seed, pa.list_(pa.int64())), pa.array(hit_at, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), *lists], ["id", "start", "words", "seed", "at"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    segments = store(rows.mapInArrow(find, "id bigint, start bigint, words array<bigint>, seed array<bigint>, at array<int>").dropDuplicates(["id", "start", "words"]).withColumn("segment", F.monotonically_increasing_id()), "segments").df
    hits = segments.select("segment", F.explode(F.arrays_zip("seed", "at")).alias("hit")).select("segment", "hit.seed", F.col("hit.at").alias("doc_at"))
    diagonals = hits.join(item_rows, "seed").select("segment", "item", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
    laid = diagonals.join(segments.select("segment", "id", "start", F.col("words").alias("doc_words")), "segment").join(known.df.withColumnRenamed("words", "item_words"), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for i, start, shift, doc, item_id, words in zip(*(b.column(n) for n in ("id", "start", "shift", "doc_words", "item", "item_words")), strict=True):
                d, w, s = doc.values.to_numpy(), words.values.to_numpy(), shift.as_py()
                a, z = max(0, -s), min(len(w), len(d) - s)
                agree = w[a:z] == d[a + s : z + s]
                if (found := stretch(agree, min(min_words, len(w)), share)) is not None:
                    x, y = found
                    out.append((i.as_py(), item_id.as_py(), start.as_py() + a + s + x, a + x, y - x, int(agree[x:y].sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(6)], ["id", "item", "doc_start", "item_start", "n_words", "n_same"])

    fields = ("doc_start", "item_start", "n_words", "n_same")
    checked = laid.mapInArrow(verify, "id bigint, item bigint, " + ", ".join(f"{f} bigint" for f in fields))
    best = checked.groupBy("id", "item").agg(F.max(F.struct("n_same", "n_words", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), (-F.col("m.d")).alias("doc_start"), (-F.col("m.i")).alias("item_start"), F.col("m.n_words").alias("n_words"), F.col("m.n_same").alias("n_same"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` that overlap no item, with their own columns."""
    bad = store(overlaps(docs, items, id_col, text_col, **how).select(F.col(id_col).alias("_bad")).distinct(), "overlapping").df
    return docs.join(bad, docs[id_col] == bad["_bad"], "left_anti")  # broadcast where the table's size allows
