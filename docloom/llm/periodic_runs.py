"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on the segments that survive.

A run is a stretch of words with smallest period q, of at least max(min_length, min_exponent * q) words, that no
neighbouring word extends keeping period q.

Masking. A run of n words with period q holds every window of n - q words of it twice, q apart, and those windows cover
it (n >= 2q). So all its words lie in k-grams that occur twice in the document, where k is the least overlap n - q that
any run can have with its own shift (16 for 24 words and exponent 3). Words outside repeated k-grams can be in no run;
what is left falls into segments, and each run lies in one segment. Most texts have none.

Main-Lorentz. A segment is halved again and again; at a cut m, for each period q, a run across m has at least half its
words on one side, which one comparison of hashed stretches tests for all periods and all cuts of a level at once. For
what passes, the common extensions forwards and backwards of the stretches q apart, found by bisection over running
hashes, give the run's ends. Each run is verified word by word afterwards, and a hash collision costs
direct comparisons, not a wrong run. Periods that are multiples of a shorter one have the same ends, and the shortest stays.

Each document is one row and no row meets another, so there is no shuffle. Memory of a text is linear in its length:
words are numbers (64-bit hashes of their bytes, case kept, which stand for the words), cuts are compared in bounded
parts, and the kept words are put together in pieces.

Defined results: null and empty texts, and texts of white space, have no words, no runs and an empty collapsed text;
repeated rows and repeated or null identifiers are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, sliced
from docloom.llm.words import Splitter, mix

SPACES = b" \t\n\v\f\r"
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: (cut, period) pairs that are compared at once.
PAIRS = 1 << 18
#: Words that are put together at once.
PIECE_WORDS = 1 << 16

Runs = list[tuple[int, int, int]]


class Words:
    """The words of a text: their places in its bytes and a number for each."""

    def __init__(self):
        self._split = Splitter(SPACES)
        self._split.value = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)  # case counts

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends and numbers."""
        if not data:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64)
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = self._split.is_space[np.frombuffer(data, np.uint8)]
        edges = np.flatnonzero(space[1:] != space[:-1])
        return edges[0::2], edges[1::2], self._split(data)


def least_overlap(min_length: int, min_exponent: int) -> int:
    """The fewest words that a run has in common with itself shifted by its period."""
    q = min_length // min_exponent  # the longest period for which min_length alone counts
    return min(min_length - q, (min_exponent - 1) * (q + 1)) if q else min_exponent - 1


class Stretches:
    """Comparison of stretches of numbers by running hashes."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x = x
        self.power = np.full(n + 1, BASE, np.uint64)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(x) * self.power[:n], out=self.sums[1:])

    def repeated(self, k: int) -> np.ndarray:
        """Which words lie in a k-gram that occurs more than once."""
        n = len(self.x)
        mask = np.zeros(n, bool)
        if n <= k:
            return mask
        grams = self.sums[k:] - self.sums[:-k]
        grams *= np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - k, INVERSE, np.uint64)]))
        order = np.sort(grams)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            steps = np.zeros(n + 1, np.int64)
            found = np.flatnonzero(np.isin(grams, twice))
            steps[found] += 1
            steps[found + k] -= 1
            mask = np.cumsum(steps[:-1]) > 0
        return mask

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of `length` words from i and from j (not before i) have equal hashes."""
        return (self.sums[i + length] - self.sums[i]) * self.power[j - i] == self.sums[j + length] - self.sums[j]

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far the words from i and j on (or before them, backwards) are equal, `most` at most; never too short."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.equal(i - mid, j - mid, mid) if back else self.equal(i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def exact(self, i: int, q: int) -> tuple[int, int]:
        """Ends of the stretch around i and i + q with period q, word by word."""
        x, n = self.x, len(self.x)
        differ = np.flatnonzero(x[i : n - q] != x[i + q :])
        end = (i + int(differ[0]) if len(differ) else n - q) + q
        differ = np.flatnonzero(x[:i] != x[q : q + i])
        return (int(differ[-1]) + 1 if len(differ) else 0), end

    def has_run(self, s: int, e: int, q: int) -> bool:
        """Whether [s, e) has period q and no neighbour extends it."""
        x = self.x
        return (x[s : e - q] == x[s + q : e]).all() and (s == 0 or x[s - 1] != x[s - 1 + q]) and (e == len(x) or x[e] != x[e - q])


def segments(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of marked words of at least `least` words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return [(int(a), int(b)) for a, b in zip(edges[0::2], edges[1::2], strict=True) if b - a >= least]


def _cuts(parts: list[tuple[int, int]], least: int) -> Iterator[np.ndarray]:
    """Rows (cut, left end, right end, longest period tried) of all nodes, a level at a time."""
    nodes = np.array([(a, b, a, b) for a, b in parts], np.int64).reshape(-1, 4)  # node's ends, segment's ends
    while len(nodes := nodes[nodes[:, 1] - nodes[:, 0] >= least]):
        cut = (nodes[:, 0] + nodes[:, 1]) >> 1
        yield np.stack([cut, nodes[:, 2], nodes[:, 3], nodes[:, 1] - nodes[:, 0]], 1)
        nodes = np.concatenate([np.stack([nodes[:, 0], cut, nodes[:, 2], nodes[:, 3]], 1), np.stack([cut, nodes[:, 1], nodes[:, 2], nodes[:, 3]], 1)])


def _across(s: Stretches, cut: np.ndarray, left: np.ndarray, right: np.ndarray, q: np.ndarray, min_length: int, min_exponent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, end, period, place) of the stretches across cuts that are long enough, by hashes."""
    need = np.maximum(min_length, min_exponent * q)
    side = np.maximum((need + 1) // 2 - q, 0)
    for before in (False, True):
        i = cut - q if before else cut
        fits = np.flatnonzero((i - side >= left) if before else (i + q + side <= right))
        fits = fits[i[fits] >= left[fits]]
        at = i[fits] - side[fits] if before else i[fits]
        some = fits[s.equal(at, at + q[fits], side[fits])]
        if len(some):
            i, p = i[some], q[some]
            fore = s.extension(i, i + p, right[some] - i - p, False)
            back = s.extension(i, i + p, i - left[some], True)
            long = fore + back + p >= need[some]
            if long.any():
                yield (i - back)[long], (i + p + fore)[long], p[long], i[long]


def find_runs(x: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> Runs:
    """(start, length, period) of all runs of the numbers x, by start, then period."""
    if min_exponent < 2 or min_length < 1:
        raise ValueError("min_exponent must be 2 or more and min_length 1 or more")
    k, shortest = least_overlap(min_length, min_exponent), max(min_length, min_exponent)
    if len(x) < shortest:
        return []
    s = Stretches(x)
    parts = segments(s.repeated(k), shortest)
    for every in (False, True):
        found = _candidates(s, parts, min_length, min_exponent, every)
        runs = set()
        for (a, b), periods in found.items():
            for p in sorted(periods):
                if s.has_run(a, b, p):
                    runs.add((a, b, p))
                    break  # longer periods with these ends are multiples
                if not every:
                    break
                a2, b2 = s.exact(periods[p], p)
                if b2 - a2 >= max(min_length, min_exponent * p):
                    runs.add((a2, b2, p))
        if len(runs) == len(found):
            break  # else hashes met by chance somewhere: all periods of all cuts are looked at word by word
    least = {}
    for a, b, p in runs:
        least[a, b] = min(p, least.get((a, b), p))
    return sorted((a, b - a, p) for (a, b), p in least.items())


def _candidates(s: Stretches, parts: list[tuple[int, int]], min_length: int, min_exponent: int, every: bool) -> dict[tuple[int, int], dict[int, int]]:
    """Ends of all stretches that are runs by hashes, with the least period (or every one) and a place for each."""
    found: dict[tuple[int, int], dict[int, int]] = {}
    for level in _cuts(parts, max(min_length, min_exponent)):
        longest = level[:, 3] // min_exponent
        starts = np.cumsum(longest) - longest
        total = int(longest.sum())
        for at in range(0, total, PAIRS):
            pair = np.arange(at, min(at + PAIRS, total))
            node = np.searchsorted(starts, pair, "right") - 1
            q = pair - starts[node] + 1
            for start, end, period, place in _across(s, level[node, 0], level[node, 1], level[node, 2], q, min_length, min_exponent):
                order = np.lexsort((period, end, start))
                first = np.ones(len(order), bool)
                if not every:
                    first[1:] = (np.diff(start[order]) != 0) | (np.diff(end[order]) != 0)
                for a, b, p, i in zip(*(c[order][first].tolist() for c in (start, end, period, place)), strict=True):
                    found.setdefault((a, b), {}).setdefault(p, i)
    return found


def kept_words(n: int, runs: Runs) -> np.ndarray:
    """Which words stay: all but those that a run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def _join(data: bytes, starts: np.ndarray, ends: np.ndarray, which: np.ndarray | None) -> str:
    """The words at `which` (None: all) joined by one space."""
    n = len(starts) if which is None else len(which)
    pieces = []
    for at in range(0, n, PIECE_WORDS):
        last = min(at + PIECE_WORDS, n)
        if which is None:
            words = data[starts[at] : ends[last - 1]].split()
        else:
            some = which[at:last]
            words = [data[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
        pieces.append(b" ".join(words))
    return b" ".join(pieces).decode()


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exponent: int = 3,
    reading: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """id, n_words, runs (start, length, period; by start, then period) and collapsed text of every row.

    `reading` gives the places of the words to read instead of 0..n-1, from the identifier and n (None: as they stand).
    """
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in sliced(batches):
            counts, all_runs, texts = [], [], []
            for own, text in zip(b.column(0), b.column(1), strict=True):
                data = (text.as_py() or "").encode()
                starts, ends, x = words(data)
                places = reading(own.as_py(), len(x)) if reading and len(x) else None
                runs = find_runs(x if places is None else x[places], min_length, min_exponent)
                which = places
                if runs:
                    kept = np.flatnonzero(kept_words(len(x), runs))
                    which = kept if places is None else places[kept]
                counts.append(len(x))
                all_runs.append([{"start": r[0], "length": r[1], "period": r[2]} for r in runs])
                texts.append(_join(data, starts, ends, which))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(all_runs, kind), pa.array(texts, pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    found = rows.mapInArrow(scan, "id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def planted_cycles(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the identifiers, a reading of n words that turns in a circle from some word on."""
    if doc_id is None or not n:
        return None
    h = crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + np.arange(n - a) % p
    return places


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of runs, the one of greatest exponent, and digests of all runs and of the collapsed text."""
    found = collapse_runs(docs, id_col, text_col, reading=planted_cycles)

    def before(a, b):
        longer = a["length"] * b["period"] - b["length"] * a["period"]
        return F.when(longer > 0, -1).when(longer < 0, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.signum(a["period"] - b["period"])).cast("int")

    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256)
    best = F.get(F.array_sort("runs", before), F.lit(0))
    return found.withColumn("best", best).select(
        id_col, F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest.alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
