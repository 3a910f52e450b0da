"""Company records: the schema, CSV in and out, and the adapter from web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions import normalize as N

# The columns of the source, in order; all are strings.
SOURCE_COLUMNS = ("handle", "name", "website", "industry", "size", "type", "founded", "city", "state", "country_code")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in SOURCE_COLUMNS])
COLUMNS = ("record_id", *SOURCE_COLUMNS)


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _with_header(spark: SparkSession, path: str, **options) -> DataFrame:
    header = spark.read.option("header", True).options(**options).csv(path).limit(0)
    require(header, SOURCE_COLUMNS)
    kept = COLUMNS if "record_id" in header.columns else SOURCE_COLUMNS
    return spark.read.schema(header.schema).option("header", True).options(**options).csv(path).select(*kept)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, no inference, the ten columns in order, after record_id if the file has one; a gzip file is one task, so
    repartition before heavy work."""
    return _with_header(spark, path)


def read_local_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoting with newlines inside; missing values are empty strings."""
    return _with_header(spark, path, multiLine=True, quote='"', escape='"').fillna("")


def with_record_ids(df: DataFrame, key: str = "handle") -> DataFrame:
    """Stable ids, from the hash of all columns and a count within equal rows: the same for any partitioning. A table that has
    ids keeps them."""
    if "record_id" in df.columns:
        return df
    columns = [F.coalesce(F.col(c), F.lit("\0")) for c in df.columns]
    digest = F.substring(F.sha2(F.concat_ws("\1", F.col(key), *columns), 256), 1, 24)
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    copies = counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
    return copies.select(F.concat(F.lit("r"), digest, F.when(F.col("_copy") > 1, F.concat(F.lit("-"), F.col("_copy"))).otherwise(F.lit(""))).alias("record_id"), *df.columns)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def company_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records derived from the table of web pages."""
    return records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Name from the title, host from the url, some values made null, some names cut or extended so that near names and name
    prefixes occur."""
    page = F.col("page_id")
    base = pages.select(
        page,
        "url",
        F.regexp_extract("html", r"(?i)<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1).alias("lang"),
        F.regexp_extract("url", r"^https?://[^/]*\.([a-z]+)/", 1).alias("sfx"),
    )
    cut = lambda k: F.when(F.length("title") > k, F.expr(f"substring(title, 1, length(title) - {k})")).otherwise(F.lit(""))
    name = F.when(page % 11 == 4, F.concat("title", F.lit(" group"))).when(page % 7 == 3, cut(1)).when(page % 7 == 5, cut(2)).otherwise(F.col("title"))
    none = F.lit(None).cast("string")
    return base.select(
        N.record_id(page).alias("record_id"),
        F.col("url").alias("handle"),
        name.alias("name"),
        F.when((page % 5 == 0) | (page % 11 == 4), none).otherwise(F.col("url")).alias("website"),
        none.alias("industry"),
        none.alias("size"),
        none.alias("type"),
        none.alias("founded"),
        F.when(page % 5 == 2, none).otherwise(F.col("sfx")).alias("city"),
        none.alias("state"),
        F.when(page % 6 == 1, none).otherwise(F.col("lang")).alias("country_code"),
    )
