"""Similar words as a join: pairs with an indel ratio of at least a threshold, found by keys and scored once each.

The ratio of words of lengths m and n is 200 * LCS / (m + n), so a threshold t allows at most D = (m + n) * (1 - t / 100)
insertions and deletions between them, and lengths that differ by D at most. Cut the word of length n into D + 1
segments: each edit spoils one, so one segment at least stands unchanged in the other word, at most D places away. Words
therefore meet by (m, n, number of the segment, its text), and no pair is lost. A pair that meets is bounded once more
by its letters: the LCS is at most the sum of the smaller counts of each letter. Only what passes is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.fuzzy import ratio
from docloom.sources.scratch import Scratch


def edits(m: Column, n: Column, threshold: float) -> Column:
    """The most insertions and deletions between words of lengths m and n that reach the threshold.

    Computed in whole thousandths of the threshold, so rounding can't take a pair away.
    """
    return F.floor((m + n) * (100_000 - int(threshold * 1000)) / 100_000.0 + 1e-9).cast("int")


def compatible(n: Column, threshold: float) -> Column:
    """Lengths m that words of length n can be similar to."""
    share = (200.0 - threshold) / threshold
    span = F.sequence(F.greatest(F.lit(1), F.ceil(n / share - 1e-9).cast("int")), F.floor(n * share + 1e-9).cast("int"))
    return F.filter(span, lambda m: F.abs(m - n) <= edits(m, n, threshold))


def _segments(word: Column, m: Column, n: Column, threshold: float) -> Column:
    """(number, text) of the segments of a word of length n that face words of length m: nearly equal, the first ones shorter."""
    k = edits(m, n, threshold) + 1
    begin = lambda i: F.floor(i * n / k).cast("int")
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(i.alias("i"), F.substring(word, begin(i) + 1, begin(i + 1) - begin(i)).alias("s")))


def _places(word: Column, m: Column, n: Column, threshold: float) -> Column:
    """(number, text) of what stands in a word of length m where segments of words of length n may have moved to."""
    d = edits(m, n, threshold)
    k = d + 1
    begin = lambda i: F.floor(i * n / k).cast("int")

    def of(i: Column) -> Column:
        size = begin(i + 1) - begin(i)
        starts = F.filter(F.sequence(begin(i) - d, begin(i) + d), lambda p: (p >= 0) & (p + size <= m))
        return F.transform(starts, lambda p: F.struct(i.alias("i"), F.substring(word, p + 1, size).alias("s")))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), k - 1), of)))


def letter_bound(a: Column, b: Column) -> Column:
    """An upper bound of the LCS: letters that both words have, as often as the one that has them less often."""
    once = F.array_distinct(F.split(a, ""))
    count = lambda word, c: F.length(word) - F.length(F.replace(word, c, F.lit("")))
    return F.aggregate(F.filter(once, lambda c: c != ""), F.lit(0), lambda total, c: total + F.least(count(a, c), count(b, c)))


def similar_words(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b, ratio) of words `a` of `left` and `b` of `right` whose ratio reaches the threshold (over 0).

    Null and empty words are similar to nothing. Segments of one character are shared by very many words; a threshold
    that leaves them (about under 70 for words of 7 letters) makes this join large, though never wrong.
    """
    if not 0 < threshold <= 100:
        raise ValueError("the threshold must be over 0 and at most 100")
    a = left.select("a").where("a != ''").distinct().withColumn("m", F.length("a")).withColumn("n", F.explode(compatible(F.col("m"), threshold)))
    b = right.select("b").where("b != ''").distinct().withColumn("n", F.length("b")).withColumn("m", F.explode(compatible(F.col("n"), threshold)))
    a = a.withColumn("k", F.explode(_places(F.col("a"), F.col("m"), F.col("n"), threshold))).select("a", "m", "n", "k.*")
    b = b.withColumn("k", F.explode(_segments(F.col("b"), F.col("m"), F.col("n"), threshold))).select("b", "m", "n", "k.*")
    met = a.join(b, ["m", "n", "i", "s"]).where(200.0 * F.least("m", "n") >= threshold * (F.col("m") + F.col("n"))).select("a", "b", "m", "n").distinct()
    near = met.where(200.0 * letter_bound(F.col("a"), F.col("b")) >= threshold * (F.col("m") + F.col("n")) - 1e-9)
    return near.select("a", "b", F.when(F.col("a") == F.col("b"), 100.0).otherwise(ratio(F.col("a"), F.col("b"))).alias("ratio")).where(F.col("ratio") >= threshold)


def fuzzy_hits(rows: DataFrame, key: str, needles: str, words: str, threshold: float) -> DataFrame:
    """`rows` with hits: how many of the needles are similar to one of the row's own words.

    `key` names rows uniquely; `needles` and `words` are arrays of words. A needle counts as often as it stands there.

    Hits depend on the two lists only. Words are joined once for each distinct pair of lists, under a number that a table
    keeps, and rows meet the hits of their lists in one join; only lists that differ take part in the joins by word.
    """
    empty = F.array().cast("array<string>")
    own = {"_needles": F.coalesce(needles, empty), "_words": F.array_sort(F.array_distinct(F.coalesce(words, empty)))}
    scratch = Scratch(rows.sparkSession, "lists")
    lists = scratch.save(rows.select(*[v.alias(k) for k, v in own.items()]).distinct().withColumn("_pair", F.monotonically_increasing_id()), "lists")
    asked = lists.select("_pair", F.explode("_needles").alias("a")).groupBy("_pair", "a").agg(F.count("*").alias("_n"))
    held = lists.select("_pair", F.explode("_words").alias("b"))
    pairs = similar_words(asked, held, threshold)
    found = asked.join(pairs.select("a", "b"), "a").join(held, ["_pair", "b"], "left_semi").select("_pair", "a", "_n").distinct()
    counted = found.groupBy("_pair").agg(F.sum("_n").alias("hits"))
    hits = scratch.save(lists.join(counted, "_pair").select("_needles", "_words", "hits"), "hits")
    scratch.drop(keep=1)
    return rows.withColumns(own).join(hits, ["_needles", "_words"], "left").drop("_needles", "_words").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("bigint"))
