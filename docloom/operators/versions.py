"""Many versions of a circular: how long each obligation held, and whole chains of supersession."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.sources.scratch import Scratch


def obligation_history(versions: DataFrame, held: DataFrame) -> DataFrame:
    """Stretches of consecutive versions in which an obligation stands with the same terms.

    `versions` has family and version (ordered within a family); `held` has family, version, obligation_id and terms. A
    stretch runs from `since` to `until`; `began` tells how it came about (original: in the first version, added,
    modified: other terms in the version before, reappeared: absent in the version before, but held once) and `ended`
    what follows (in_force: nothing, modified, superseded: absent in the next version). `nth` numbers an obligation's
    stretches.

    All windows are over (family, obligation_id) and share one shuffle, so a family may be of any size. Rows of `held`
    whose version isn't listed take no part; repeated rows count once, and of contradicting terms in one version the
    least counts; null terms are terms of their own.
    """
    places = versions.select("family", "version").where("family is not null and version is not null").distinct()
    order = Window.partitionBy("family").orderBy("version")
    places = places.withColumns({"_at": F.row_number().over(order), "_last": F.count("*").over(Window.partitionBy("family"))})
    rows = held.join(places, ["family", "version"]).groupBy("family", "obligation_id", "_at", "version", "_last").agg(F.min(F.struct(F.col("terms").isNotNull(), "terms")).alias("_t"))
    own = Window.partitionBy("family", "obligation_id").orderBy("_at")
    goes_on = (F.lag("_at").over(own) == F.col("_at") - 1) & F.lag("_t").over(own).eqNullSafe(F.col("_t"))
    marked = rows.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("nth", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    runs = numbered.groupBy("family", "obligation_id", "nth").agg(
        F.first("_t.terms").alias("terms"), F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.min_by("version", "_at").alias("since"), F.max_by("version", "_at").alias("until"), F.first("_last").alias("_last")
    )
    near = Window.partitionBy("family", "obligation_id").orderBy("nth")
    before, after = F.lag("_to").over(near), F.lead("_from").over(near)
    began = F.when(before.isNull(), F.when(F.col("_from") == 1, "original").otherwise("added")).when(before == F.col("_from") - 1, "modified").otherwise("reappeared")
    ended = F.when(F.col("_to") == F.col("_last"), "in_force").when(after == F.col("_to") + 1, "modified").otherwise("superseded")
    return runs.select("family", "obligation_id", "nth", "terms", "since", "until", (F.col("_to") - F.col("_from") + 1).alias("versions"), began.alias("began"), ended.alias("ended"))


def supersession_chains(links: DataFrame) -> DataFrame:
    """root, depth, cyclic and latest of every version of `links` (version, supersedes, issued).

    A version that supersedes nothing, or something that isn't there, is a root of depth 0. `latest` is the version of
    the same root that was issued last (ties: the greater name). A version whose chain runs into a cycle has neither
    root nor depth nor latest and is cyclic.

    Pointer doubling: each version points at an ancestor and knows the distance; a round replaces the pointer by that of
    the ancestor, so chains halve, and after as many rounds as the binary logarithm of the number of versions only
    cycles have a pointer left. Each round is one join on the pointer, of the unfinished rows only, and a written table;
    where many versions point at one, the join is skewed on the side that Spark splits, as names are unique on the other.
    Joins are by sort and merge: a broadcast in each round would bring a share of the table to the driver again and again.
    Rows with a null name take no part; of rows that share a name the least counts.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "chains")
    named = links.where("version is not null").groupBy("version").agg(F.min(F.struct(F.col("supersedes").isNull(), "supersedes", "issued")).alias("_x")).select("version", "_x.supersedes", "_x.issued")
    known = named.select(F.col("version").alias("supersedes"), F.lit(True).alias("_known"))
    start = named.join(known.hint("merge"), "supersedes", "left").select("version", F.when(F.col("_known"), F.col("supersedes")).alias("at"), F.when(F.col("_known"), 1).otherwise(0).cast("bigint").alias("depth"), "issued")
    state = scratch.save(start.withColumn("root", F.when(F.col("at").isNull(), F.col("version")).otherwise(F.col("at"))), "start")
    rounds = max(1, state.count()).bit_length()
    for _ in range(rounds):
        if state.where("at is not null").isEmpty():
            break
        there = state.select(F.col("version").alias("at"), F.col("at").alias("_at"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        on = state.where("at is not null").join(there.hint("merge"), "at").select("version", F.col("_at").alias("at"), (F.col("depth") + F.col("_depth")).alias("depth"), "issued", F.col("_root").alias("root"))
        state = scratch.save(on.unionByName(state.where("at is null")), "round")
        scratch.drop(keep=1)
    cyclic = F.col("at").isNotNull()
    latest = state.where(~cyclic).groupBy("root").agg(F.max(F.struct("issued", "version")).alias("_latest"))
    return state.withColumn("root", F.when(~cyclic, F.col("root"))).join(latest.hint("merge"), "root", "left").select(
        "version", "root", F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("cyclic"), F.col("_latest.version").alias("latest")
    )
