"""Hosted models: which accept what, and what is wrong with a configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Artifact tokens, their media types and labels; known providers.
ARTIFACTS = {"png": ("image/png", "PNG"), "jpeg": ("image/jpeg", "JPEG"), "jpg": ("image/jpeg", "JPEG"), "webp": ("image/webp", "WebP"), "gif": ("image/gif", "GIF"), "pdf": ("application/pdf", "PDF")}
PROVIDERS = ("anthropic", "google", "openai")
DEFAULT_PROVIDER = "anthropic"


def accepted_types(models: DataFrame) -> DataFrame:
    """id, position, mime and label of what models accept; unknown tokens go, the first of equal types stays."""
    mime = F.create_map(*[x for t, (m, _) in ARTIFACTS.items() for x in (F.lit(t), F.lit(m))])
    label = F.create_map(*[x for t, (_, n) in ARTIFACTS.items() for x in (F.lit(t), F.lit(n))])
    tokens = models.select("id", "available", F.posexplode(F.split(F.coalesce("artifacts", F.lit("")), ",")).alias("position", "token")).withColumn("token", F.lower(F.trim("token")))
    known = tokens.where(F.col("token").isin(*ARTIFACTS)).select("id", "available", "position", mime[F.col("token")].alias("mime"), label[F.col("token")].alias("label"))
    return known.groupBy("id", "available", "mime", "label").agg(F.min("position").alias("position"))


def models_accepting(models: DataFrame) -> DataFrame:
    """For each media type the available models that accept it; a missing flag counts as available."""
    usable = accepted_types(models).where("available is distinct from false")
    return usable.groupBy("mime").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("models"))


def accept_attribute(models: DataFrame) -> DataFrame:
    """The file picker's accept value and label list of each model, in token order."""
    listed = accepted_types(models).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "mime", "label"))).alias("x"))
    return listed.select("id", F.array_join(F.transform("x", lambda r: r["mime"]), ",").alias("accept"), F.array_join(F.transform("x", lambda r: r["label"]), " · ").alias("labels"))


def provider_of(requests: DataFrame, models: DataFrame) -> DataFrame:
    """`requests` (with model) and their provider, by default the first one."""
    return requests.join(models.select(F.col("id").alias("model"), "provider"), "model", "left").fillna(DEFAULT_PROVIDER, ["provider"])


def refused(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Requests whose model is not on the list; an empty list allows all."""
    listed = allowed.groupBy().agg(F.count("*").alias("_n"))
    return requests.join(allowed.select(F.col("model")).distinct(), "model", "left_anti").crossJoin(F.broadcast(listed)).where("_n > 0").drop("_n")


def public_view(models: DataFrame) -> DataFrame:
    """Models without anything about providers' keys."""
    return models.drop("key", "providers")


def is_placeholder(key):
    return F.coalesce(F.trim(key), F.lit("")).eqNullSafe("") | F.regexp_like(F.coalesce(key, F.lit("")), F.lit("(?i)REPLACE-ME"))


def violations(models: DataFrame, providers: DataFrame, default_model: str) -> DataFrame:
    """One row for each problem of a configuration: subject and problem. `models` has position, its place in the list."""
    known = F.col("provider").isin(*PROVIDERS)
    held = models.join(providers.select(F.col("name").alias("provider"), "key", F.lit(True).alias("listed")), "provider", "left")
    nth = F.row_number().over(_place())
    rules = [
        (F.coalesce(F.col("id"), F.lit("")) == "", "missing id"), (F.coalesce(F.col("label"), F.lit("")) == "", "missing label"),
        (~F.coalesce(known, F.lit(False)), "unknown provider"), (F.coalesce(known, F.lit(False)) & F.col("listed").isNull(), "provider not listed"),
        (F.coalesce(F.col("artifacts"), F.lit("")) == "", "missing artifacts"), (F.col("nth") > 1, "duplicate id"),
        (F.col("available").eqNullSafe(F.lit(True)) & is_placeholder(F.col("key")), "available without key"),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(p)) for c, p in rules]), lambda x: x.isNotNull())
    of_models = held.withColumn("nth", nth).select(F.coalesce("id", F.lit("(no id)")).alias("subject"), F.explode(found).alias("problem"))
    of_providers = providers.where(~F.col("name").startswith("$") & ~F.col("name").isin(*PROVIDERS)).select(F.col("name").alias("subject"), F.lit("unknown provider section").alias("problem"))
    default = models.groupBy().agg(F.count(F.when(F.col("id") == default_model, 1)).alias("n")).where("n = 0").select(F.lit(default_model).alias("subject"), F.lit("default model not listed").alias("problem"))
    return of_models.unionByName(of_providers).unionByName(default)


def _place():
    from pyspark.sql.window import Window

    return Window.partitionBy("id").orderBy("position")


def upload_problems(uploads: DataFrame, max_total_mb: float) -> DataFrame:
    """Requests (request, size, description) that are too large together, or have neither a file nor a description."""
    total = uploads.groupBy("request").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.count("size").alias("files"), F.max(F.coalesce(F.trim("description"), F.lit(""))).alias("description"))
    problem = F.when(F.col("total") > max_total_mb * 1024 * 1024, "too_large").when((F.col("files") == 0) & (F.col("description") == ""), "nothing_to_review")
    return total.select("request", "total", problem.alias("problem")).where("problem is not null")
