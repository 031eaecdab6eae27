"""The join of similar words against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions.fuzzy import indel_ratio
from docloom.operators import fuzzy_join


def edited(rng, word, n):
    letters = list(word)
    for _ in range(n):
        k = rng.randrange(len(letters) + 1)
        if rng.random() < 0.5 or not letters:
            letters.insert(k, rng.choice("abcdeé"))
        else:
            letters.pop(min(k, len(letters) - 1))
    return "".join(letters)


def frames(spark, a, b):
    return spark.createDataFrame([(x, 1) for x in a], "a string, n int").repartition(3), spark.createDataFrame([(x, "c") for x in b], "b string, ratio string")


@pytest.mark.parametrize("threshold", [100.0, 90.0, 82.0, 66.7, 50.0])
def test_no_pair_is_lost(spark, threshold):
    rng = random.Random(int(threshold))
    a = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(14))) for _ in range(120)] + ["abcdefghijklmnopqrst" * 2]
    b = [edited(rng, w, rng.randrange(4)) for w in a] + ["x", ""]
    got = {(r["a"], r["b"]): r["ratio"] for r in fuzzy_join.similar_words(*frames(spark, [*a, None], [*b, None, b[0]]), threshold).collect()}
    want = {(x, y): indel_ratio(x, y) for x in a for y in b if x and y and indel_ratio(x, y) >= threshold}
    assert got == want


def test_the_letter_bound_is_never_under_the_common_subsequence(spark):
    from docloom.functions.fuzzy import common_subsequence

    rng = random.Random(2)
    pairs = [("".join(rng.choice("abc.é") for _ in range(rng.randrange(9))), "".join(rng.choice("abc.é") for _ in range(rng.randrange(9)))) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy_join.letter_bound(F.col("a"), F.col("b")).alias("most")).collect()
    assert all(common_subsequence(r["a"], r["b"]) <= r["most"] <= min(len(r["a"]), len(r["b"])) for r in rows)


def test_hits_of_rows(spark):
    rng = random.Random(5)
    vocabulary = ["settle", "settles", "settled", "account", "accounts", "report", "reports", "client", "clientele", "fee"]
    rows = [(k, [rng.choice(vocabulary) for _ in range(rng.randrange(5))], [rng.choice(vocabulary) for _ in range(rng.randrange(5))]) for k in range(120)] + [(500, None, ["fee"]), (501, ["fee", "fee"], ["fee"]), (502, ["fee"], None)]
    df = spark.createDataFrame(rows, "key int, needles array<string>, words array<string>")
    got = {r["key"]: r["hits"] for r in fuzzy_join.fuzzy_hits(df, "key", "needles", "words", 82.0).collect()}
    assert got == {k: sum(any(indel_ratio(x, y) >= 82.0 for y in w or []) for x in n or []) for k, n, w in rows}
    assert fuzzy_join.fuzzy_hits(df.where("false"), "key", "needles", "words", 82.0).collect() == []
    with pytest.raises(ValueError, match="threshold"):
        fuzzy_join.similar_words(df, df, 0)
