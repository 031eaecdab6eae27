"""Language identification by bit-sliced Bloom filters over character n-grams.

Each language has a Bloom filter of the n-grams (of `sizes` characters, within words, word ends marked) that at least a
share `min_share` of its training texts hold. The filters have one size and the same hash functions and lie side by side:
row r of the table holds bit r of every filter, so the AND of an n-gram's few rows is the set of all languages that
contain it. For a text, the bits of these masks are counted language by language. A filter of fill f takes a foreign
n-gram for its own with probability p = f^hashes, so of n n-grams with c hits (c - n p) / (1 - p) are taken to be real;
the language with most of them is the answer.

Training counts, for each language and n-gram, the texts that hold it (an aggregate that combines before its shuffle),
keeps what reaches the share, and ORs the kept n-grams' bits together row by row. Only the table comes to the driver and
goes out to tasks: 2^`bits` rows of one byte for each eight languages, whatever the input. Of each language about
`max_train` texts are used, chosen by a hash of the identifier (all, where it has no more). Scoring reads every whole
text once, in bounded pieces, without a shuffle.

Defined results: `und` and score 0 for a text that is null or has no letter (a character of Unicode's L categories); a
text with letters but no known n-gram gets the language with most training rows and score 0, as do all texts with letters
if counts tie; rows without a language or a text are not trained on, and rows with a null identifier are, as they are not
held out; repeated rows count each; ties go to the language with more training rows, then to the lesser name; without any
training row every answer is `und`. The score is best / (best + second), 1 with a single language. Other columns stay as
they are in `with_language`, and are ignored in `identify`.

`SIZES` and `min_share` were chosen among six settings on one of the four fifths that may be learnt from, with filters
from the other three.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, sliced, store
from docloom.llm.words import mix

UND = "und"
SIZES = (3, 4, 5)
HASHES = 3
#: Characters of a text that are looked at together; pieces end between words.
PIECE = 1 << 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


@cache
def _kinds() -> np.ndarray:
    """1 for letters and 2 for marks, which belong to the word they stand in, by code point."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text with each gap between words as one 0, and a 0 at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()
    at = 0
    while at < len(codes):
        end = min(at + PIECE, len(codes))
        while end < len(codes):  # go on to the next gap
            gap = np.flatnonzero(kinds[codes[end : end + 4096]] == 0)
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + 4096, len(codes))
        part = codes[at:end]
        inside = kinds[part] > 0
        some = np.concatenate([[0], np.where(inside, part, 0), [0]]).astype(np.uint64)
        keep = np.ones(len(some), bool)
        keep[1:] = (some[1:] > 0) | (some[:-1] > 0)
        yield some[keep]
        at = end


def has_letter(text: str) -> bool:
    return any((_kinds()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)] == 1).any() for at in range(0, len(text), PIECE))


def ngrams(text: str, sizes: tuple[int, ...] = SIZES) -> Iterator[np.ndarray]:
    """64-bit hashes of the text's n-grams, with repeats, piece by piece."""
    for codes in _pieces(text):
        for n in sizes:
            count = len(codes) - n + 1
            if count <= 0:
                continue
            h = np.full(count, n, np.uint64)
            inner = np.ones(count, bool)
            for k in range(n):
                part = codes[k : k + count]
                h = h * np.uint64(0x9FB21C651E98DF25) + part
                if 0 < k < n - 1:
                    inner &= part > 0
            if n == 2:
                inner &= (codes[:-1] > 0) | (codes[1:] > 0)
            yield mix(h[inner])


def rows_of(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of the table that belong to each n-gram, one for each hash function."""
    return [(grams >> np.uint64(21 * k)) & np.uint64((1 << bits) - 1) for k in range(HASHES)]


@dataclass
class Filters:
    """Names of languages, most training rows first, and the bit-sliced filters: 2^bits rows of a byte for eight of them."""

    names: list[str]
    table: np.ndarray
    sizes: tuple[int, ...] = SIZES

    def __post_init__(self):
        self.bits = (len(self.table) - 1).bit_length()
        fill = np.concatenate([np.bincount(c, minlength=256) @ _BITS for c in self.table.T])[: len(self.names)] / len(self.table)
        #: Probability that a filter takes an n-gram for its own that it was not given.
        self.false = np.minimum(fill**HASHES, 0.999999)

    def languages(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the mask of all languages that contain it, as bytes."""
        first, *rest = rows_of(grams, self.bits)
        mask = self.table[first]
        for rows in rest:
            mask &= self.table[rows]
        return mask

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Hits of each language, and the number of n-grams."""
        hits, n = np.zeros(8 * self.table.shape[1], np.int64), 0
        for grams in ngrams(text, self.sizes):
            hits += np.concatenate([np.bincount(c, minlength=256) @ _BITS for c in self.languages(grams).T])
            n += len(grams)
        return hits[: len(self.names)], n

    def real(self, text: str) -> np.ndarray:
        """Hits of each language without those that are due to false positives."""
        hits, n = self.counts(text)
        return np.maximum((hits - n * self.false) / (1 - self.false), 0.0)

    def identify(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not has_letter(text):
            return UND, 0.0
        real = self.real(text)
        best = int(real.argmax())
        if real[best] <= 0:
            return self.names[0], 0.0
        second = float(np.delete(real, best).max(initial=0.0))
        return self.names[best], float(real[best] / (real[best] + second))


def hold_out(id_col: str) -> Column:
    """True for rows that nothing is learnt from: crc32 of the identifier as text, mod 5, is 0; a null identifier isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = 20_000, min_share: float = 0.03, bits: int = 20,
    sizes: tuple[int, ...] = SIZES,
) -> Filters:
    """Filters of the languages of the rows that `use` allows."""
    if not 1 <= bits <= 21:
        raise ValueError("bits must be 1 to 21: three rows come from one 64-bit hash")
    bounded_batches(docs.sparkSession)
    rows = docs.where(use & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    totals = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()  # one row a language
    totals.sort(key=lambda r: (-r["n"], r["lang"]))
    names = [r["lang"] for r in totals]
    if not names:
        return Filters([], np.zeros((1 << bits, 1), np.uint8), sizes)
    place = {name: k for k, name in enumerate(names)}
    share = F.pmod(F.xxhash64(id_col, F.lit(12)), F.lit(1 << 30)) / (1 << 30)
    wanted = F.element_at(F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], min(1.0, max_train / r["n"]))]), F.col(lang_col).cast("string"))
    sample = rows.where(share < wanted).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that hold an n-gram, and (n-gram -1) all texts, of each language."""
        for b in sliced(batches):
            parts: dict[int, list[np.ndarray]] = {}
            texts: dict[int, int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                k = place[lang]
                texts[k] = texts.get(k, 0) + 1
                if found := list(ngrams(text.as_py(), sizes)):
                    parts.setdefault(k, []).append(np.unique(np.concatenate(found)))
            for k, some in parts.items():
                grams, n = np.unique(np.concatenate(some), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), k), pa.int32()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int32()), pa.array([None] * len(texts), pa.int64()), pa.array(list(texts.values()), pa.int64())], ["lang", "gram", "n"])

    counts = store(sample.mapInArrow(count, "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngrams")
    least = {r["lang"]: min_share * r["n"] for r in counts.df.where("gram is null").collect()}  # one row a language
    if not least:
        counts.drop()
        return Filters(names, np.zeros((1 << bits, (len(names) + 7) // 8), np.uint8), sizes)
    enough = F.element_at(F.create_map(*[F.lit(x) for k, v in least.items() for x in (k, v)]), F.col("lang"))
    kept = counts.df.where(F.col("gram").isNotNull() & (F.col("n") >= enough))
    row = F.explode(F.array(*[F.shiftrightunsigned("gram", 21 * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(HASHES)]))
    slices = kept.select(row.alias("row"), F.expr("lang div 8").cast("int").alias("byte"), F.expr("shiftleft(1, lang % 8)").alias("mask")).groupBy("row", "byte").agg(F.bit_or("mask").alias("mask"))
    got = slices.toArrow()  # at most 2^bits rows for each eight languages
    table = np.zeros((1 << bits, (len(names) + 7) // 8), np.uint8)
    table[got.column("row").to_numpy(), got.column("byte").to_numpy()] = got.column("mask").to_numpy()
    counts.drop()
    return Filters(names, table, sizes)


def with_language(docs: DataFrame, filters: Filters, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`docs` with the language of each whole text and its score; all other columns stay."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang string, score double")
    def identify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([shared.value.identify(t) for t in texts], columns=["lang", "score"])

    found = identify(F.col(text_col).cast("string"))
    given = [F.col(f"`{c}`") for c in docs.columns if c not in (lang_col, score_col)]
    return docs.select(*given, found.alias("__found")).select(*given, F.col("__found.lang").alias(lang_col), F.col("__found.score").alias(score_col))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """id, held_out, lang_pred and score of every row; the filters come from rows that are not held out."""
    filters = fit(docs, ~hold_out(id_col), id_col, text_col, lang_col, **settings)
    rows = docs.select(F.col(id_col), hold_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    return with_language(rows, filters, "_text").select(id_col, "held_out", "lang_pred", "score")
