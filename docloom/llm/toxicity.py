"""Toxicity scores by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a text, and the beginnings of each word (which stand for a stem where a
language glues suffixes on), hashed into a fixed number of slots. The machine's score is

    b + sum_i w_i + sum_{i<j} <v_i, v_j>

so a pair of terms, such as an insult and a group, can weigh more than its parts. It is trained by AdaGrad on a
bounded sample of labelled rows: those with the least hash of the identifier, `max_train` at most and only as many as
hold `max_slots` terms together. Terms that fewer than `min_docs` sampled texts hold are left out, frequent ones are not.
Linear weights have an L1 penalty; the factors of a term without a linear weight have one on their length (a group
lasso), so such a term takes part in pairs where these tell enough: it may be as frequent in clean texts as in toxic
ones. Both penalties were chosen among five settings by cross-validation within the four fifths that may be learnt from.
Scoring covers every whole text and needs no shuffle.

Defined results: null and empty texts have no terms and get the machine's bias; a row whose label is null is not
trained on; of labels that contradict each other for one identifier the 1 counts; repeated rows are scored each by
itself; without a labelled row of either class every score is 0; a row with a null identifier has no label and is not
held out; other columns are ignored by `score_toxicity` and stay, whatever their names, in `drop_toxic`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import bounded_batches, sliced, store

WORD = re.compile(r"[^\W_]+")
SLOTS = 1 << 18
STEMS = (3, 5)
MEMO_WORDS = 300_000


class Terms:
    """Hashed terms of texts, with a bounded memo of words."""

    def __init__(self, slots: int = SLOTS):
        self.slots, self.memo = slots, {}

    def _of_word(self, word: str) -> tuple[int, ...]:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        keys = [word] + [f"{word[:n]}*" for n in STEMS if len(word) > n]
        got = self.memo[word] = tuple(crc32(k.encode()) % self.slots for k in keys)
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        memo, found = self.memo, set()
        for word in set(WORD.findall((text or "").lower())):
            found.update(memo.get(word) or self._of_word(word))
        return np.fromiter(found, np.int64, len(found))


@dataclass
class Machine:
    """Bias, linear weights and factors of each slot; its size is fixed by slots and factors."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias, np.float64)
        sizes = np.array([len(r) for r in rows])
        full = np.flatnonzero(sizes)
        if len(full):
            index = np.concatenate([rows[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            v = self.v[index]
            total, squares = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
            out[full] += np.add.reduceat(self.w[index], starts) + 0.5 * (total**2 - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(
    rows: list[np.ndarray], labels: np.ndarray, slots: int = SLOTS, factors: int = 4, epochs: int = 8, rate: float = 0.3,
    l1: float = 15.0, l1_pairs: float = 10.0, min_docs: int = 3, batch: int = 64, seed: int = 7,
) -> Machine:
    """Fit the machine to rows of slots and 0/1 labels."""
    if not len(labels) or labels.min() == labels.max():
        return Machine(-30.0, np.zeros(slots, np.float32), np.zeros((slots, factors), np.float32))
    seen = np.zeros(slots, np.int64)
    for r in rows:
        seen[r] += 1  # a row's slots are distinct
    use = seen >= min_docs
    local = (np.cumsum(use) - 1).astype(np.int32)
    rows = [local[r[use[r]]] for r in rows]
    n = int(use.sum())
    rng = np.random.default_rng(seed)
    w, v = np.zeros(n), rng.normal(0, 0.01, (n, factors))
    zw, gw, gv, gb = np.zeros(n), np.zeros(n), np.full((n, factors), 1e-2), 1e-2
    share = labels.mean()
    bias = float(np.log(share / (1 - share)))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = [k for k in order[at : at + batch] if len(rows[k])]
            if not some:
                continue
            sizes = np.array([len(rows[k]) for k in some])
            index = np.concatenate([rows[k] for k in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vi = v[index]
            total = np.add.reduceat(vi, starts)
            z = bias + np.add.reduceat(w[index], starts) + 0.5 * (total**2 - np.add.reduceat(vi * vi, starts)).sum(1)
            slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]
            gb += (slope**2).sum()
            bias -= rate * slope.sum() / np.sqrt(gb) / 10
            each = np.repeat(slope, sizes)
            here, inverse = np.unique(index, return_inverse=True)
            dw = np.bincount(inverse, each, len(here))
            more = gw[here] + dw**2
            zw[here] += dw - (np.sqrt(more) - np.sqrt(gw[here])) / rate * w[here]
            gw[here] = more
            w[here] = np.where(np.abs(zw[here]) <= l1, 0.0, -(zw[here] - np.sign(zw[here]) * l1) / ((1 + np.sqrt(more)) / rate))
            pull = each[:, None] * (np.repeat(total, sizes, 0) - vi)
            dv = np.stack([np.bincount(inverse, pull[:, f], len(here)) for f in range(factors)], 1)
            gv[here] += dv**2
            step = 0.2 * rate / np.sqrt(gv[here])
            moved = v[here] - step * dv
            length = np.maximum(np.sqrt((moved**2).sum(1)), 1e-12)
            less = np.where(w[here] != 0, 0.0, l1_pairs) * step.mean(1) / length
            v[here] = moved * np.maximum(0.0, 1 - less)[:, None]
    full_w, full_v = np.zeros(slots, np.float32), np.zeros((slots, factors), np.float32)
    full_w[use], full_v[use] = w, v
    return Machine(bias, full_w, full_v)


def hold_out(id_col: str) -> Column:
    """True for rows that no label is learnt from: crc32 of the identifier as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int, max_slots: int = 1 << 25) -> Machine:
    """Train on at most `max_train` labelled rows outside the held-out part; their slots, not texts, reach the driver.

    `max_slots` bounds what reaches it (four bytes a slot), however long the texts are.
    """
    bounded_batches(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(
        F.col("_y").isin(0, 1) & ~hold_out("_id")
    )
    chosen = marked.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = texts.join(F.broadcast(chosen), "_id").select("_y", "_text", F.xxhash64("_id").alias("_h"))  # max_train rows at most

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in sliced(batches):
            slots = pa.array([np.sort(terms(t.as_py())).astype(np.int32) for t in b.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), slots, b.column(2)], ["y", "slots", "h"])

    terms = store(found.mapInArrow(hashed, "y int, slots array<int>, h bigint"), "terms")
    so_far = F.sum(F.size("slots").cast("bigint") + 1).over(Window.orderBy("h", "y", "n", "d").rowsBetween(Window.unboundedPreceding, 0))
    sizes = terms.df.select("h", "y", F.size("slots").alias("n"), F.xxhash64("slots").alias("d"), "slots")
    last = sizes.select("h", so_far.alias("held")).where(F.col("held") > max_slots).agg(F.min("h")).first()[0]  # max_train rows of numbers
    got = (terms.df if last is None else terms.df.where(F.col("h") < last)).select("y", "slots").toArrow()
    terms.drop()
    # Rows come in no fixed order: sort them, so that the same rows give the same machine.
    y = got.column("y").to_numpy()
    rows = [s.values.to_numpy() for s in got.column("slots")]  # views of the table
    order = sorted(range(len(rows)), key=lambda k: (len(rows[k]), int(rows[k].sum(dtype=np.int64)), int(y[k])))
    machine = train([rows[k] for k in order], y[order].astype(float))
    del rows, got
    pa.default_memory_pool().release_unused()
    return machine


def with_score(docs: DataFrame, machine: Machine, text_col: str, out_col: str) -> DataFrame:
    """`docs` with the score of each whole text in `out_col`; all other columns stay."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        for texts in parts:
            yield pd.Series(model.value.score([terms(t) for t in texts]))

    return docs.withColumn(out_col, score(F.col(text_col)))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_train: int = 12_000, threshold: float = 0.5,
) -> DataFrame:
    """id, held_out, score and predicted of every row of `docs`."""
    machine = fit(docs, labels, id_col, text_col, label_col, max_train)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    scored = with_score(rows, machine, "_text", "score")
    return scored.select(id_col, F.coalesce(hold_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that the machine does not reject, with their own columns."""
    name = "_toxic_score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, machine, text_col, name).where(F.col(name) < threshold).drop(name)
