"""Where documents, rulebooks and configurations come from.

PDF decoding is outside: a page source is any table or folder that gives page texts, and tables where there are some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schemas

FORM_FEED = "\f"


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Pages in the PAGES schema from Parquet, ORC, JSON lines or Avro-like sources that Spark reads by name."""
    return spark.read.schema(schemas.PAGES).format(kind).load(path)


def read_text_documents(spark: SparkSession, path: str, pattern: str = "*.txt", recursive: bool = True) -> DataFrame:
    """Pages of whole text files, cut at form feeds; the document's name is the file's stem."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    pages = files.select(stem.alias("doc_id"), F.posexplode(F.split("value", FORM_FEED, -1)).alias("k", "text"))
    return pages.select("doc_id", (F.col("k") + 1).cast("int").alias("page_no"), "text", F.lit(None).cast("array<array<array<string>>>").alias("tables"))


def list_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a corpus in order of path, with size and digest of their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def require_documents(documents: DataFrame) -> DataFrame:
    """The same table; an empty corpus is an error."""
    if documents.isEmpty():
        raise FileNotFoundError("the corpus holds no documents")
    return documents


def isolate_failures(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one): one document's failure does not stop the others."""
    return parsed.where("error is null"), parsed.where("error is not null")


def read_rulebooks(spark: SparkSession, folder: str, order: list[str]) -> DataFrame:
    """position, name and content of rule texts, in the order given; one that is not there is an error.

    Each name is a file under the folder, or a folder that holds one.
    """
    files = spark.read.text([f"{folder}/{name}" for name in order], wholetext=True)
    path, place = F.input_file_name(), F.lit(None).cast("int")
    for k, name in enumerate(order, 1):
        place = F.when(path.endswith(f"/{name}") | path.contains(f"/{name}/"), k).otherwise(place)
    told = F.element_at(F.array(*[F.lit(n.split("/")[-1]) for n in order]), place)
    return files.select(place.alias("position"), told.alias("name"), F.col("value").alias("content")).orderBy("position")


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Models of a JSON configuration, with their position."""
    config = spark.read.option("multiLine", "true").json(path)
    return config.select(F.posexplode("models").alias("position", "m")).select("position", "m.*")


def friendly_names(documents: DataFrame, names: dict[str, str]) -> DataFrame:
    """`documents` with slug: the name given for the stem, else the stem."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    known = F.create_map(*pairs)[F.col("doc_id")] if pairs else F.lit(None).cast("string")
    return documents.withColumn("slug", F.coalesce(known, F.col("doc_id")))
