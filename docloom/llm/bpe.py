"""Byte-level BPE encoding and decoding.

Each piece of a text (a match of the split pattern) is merged on a segment tree over its byte positions. A leaf
holds the rank of the pair that starts at its position, a node the smaller of its two children, and equal ranks go
to the left child, so the root names the leftmost pair of the lowest rank. A merge joins that pair, takes the
absorbed position out and renews the ranks of the pairs at the merged position and at its live left neighbour:
three point updates of logarithmic cost, so a piece of n bytes takes O(n log n) whatever its content.

Texts are unbounded and pieces repeat, so every worker keeps the tokens of the pieces it has met in a memo of
bounded size. Nothing is shuffled.

Defined results: a null or empty text has no tokens (ids_sha256 is the digest of the empty string); repeated rows
give repeated rows; other columns of the input are ignored; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, sliced

MEMO_PIECES = 400_000
NO_PAIR = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece by rank-ordered merges on a segment tree."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    size = 1 << (n - 1).bit_length()
    rank_of = ranks.get
    # A key is rank * size + position: the least key is the lowest rank, and among equals the leftmost position.
    tree = [NO_PAIR] * (2 * size)
    for i in range(n - 1):
        r = rank_of(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # end[i]: where the live segment that starts at i ends, also the next start
    before = list(range(-1, n - 1))  # start of the live segment on the left

    def update(at: int, key: int) -> None:
        k = size + at
        tree[k] = key
        while k > 1:
            other = tree[k ^ 1]
            if other < key:
                key = other
            k >>= 1
            if tree[k] == key:
                return
            tree[k] = key

    while (least := tree[1]) != NO_PAIR:
        i = least % size
        j = end[i]
        e = end[j]
        end[i] = e
        update(j, NO_PAIR)
        if e < n:
            before[e] = i
            r = rank_of(piece[i : end[e]])
            update(i, NO_PAIR if r is None else r * size + i)
        else:
            update(i, NO_PAIR)
        p = before[i]
        if p >= 0:
            r = rank_of(piece[p:e])
            update(p, NO_PAIR if r is None else r * size + p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder for one vocabulary and split pattern, with a bounded memo of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO_PIECES):
        self.ranks, self.split, self.memo_size = ranks, regex.compile(pattern).findall, memo
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}  # the generation before: what is met again moves back into memo
        self.bytes_of = {str(i): b for b, i in ranks.items()}

    def _meet(self, piece: str) -> str:
        got = self.older.get(piece)
        if got is None:
            got = " ".join(map(str, merge_piece(piece.encode("utf-8"), self.ranks)))
        if len(self.memo) >= self.memo_size:
            self.older = self.memo.copy()
            self.memo.clear()
        self.memo[piece] = got
        return got

    def encode(self, text: str) -> list[str]:
        """Token ids as decimal strings."""
        memo, miss = self.memo, self._meet
        joined = " ".join([memo[p] if p in memo else miss(p) for p in self.split(text)])
        return joined.split(" ") if joined else []

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_decode(
    docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Encode each text and decode the ids: id, n_tokens, ids_sha256, decoded_sha256, and `ids` where keep_ids is set.

    `vocab_path` is read once by the driver and the table (fixed by the vocabulary, not by the data) is broadcast.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(vocab_path))
    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for batch in sliced(batches):
            count, digest, back, lists = [], [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                count.append(len(ids))
                digest.append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    lists.append([int(x) for x in ids])
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            if keep_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


