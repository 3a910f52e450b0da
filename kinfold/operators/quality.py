"""Data quality: shares of missing values, duplicates, collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import normalize as N

# The columns whose missing values are profiled.
PROFILED = ("name", "website", "handle", "city", "state", "country_code")


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def null_rates(df: DataFrame, columns: tuple[str, ...] = PROFILED) -> DataFrame:
    """column_name, null_rate: all columns in one pass; those that df lacks are left out."""
    have = [c for c in columns if c in df.columns]
    if not have:
        return df.sparkSession.createDataFrame([], "column_name string, null_rate double")
    rates = df.agg(*(F.avg(blank(c).cast("double")).alias(c) for c in have))
    return rates.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.round(F.col(c), 6).alias("null_rate")) for c in have))).alias("x")).select("x.*")


def exact_duplicates(df: DataFrame, key: str = "record_id") -> DataFrame:
    """All members of groups of rows that are equal but for the key."""
    groups = df.groupBy(*(c for c in df.columns if c != key)).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("duplicate_rows"))


def collision_groups(df: DataFrame, *keys: Column, least: int = 2, most: int | None = None) -> DataFrame:
    """The keys k1.. and n of groups of `least` to `most` rows; null keys have none."""
    named = df.select(*(k.alias(f"k{i + 1}") for i, k in enumerate(keys))).na.drop()
    n = named.groupBy(*named.columns).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n if most is None else n.where(F.col("n") <= most)


def collision_stats(df: DataFrame, *keys: Column) -> DataFrame:
    return collision_groups(df, *keys).agg(F.count("*").alias("groups_ge_2"), F.coalesce(F.sum("n"), F.lit(0)).alias("records_in_groups_ge_2"))


def country_top(df: DataFrame, n: int = 20) -> DataFrame:
    """A report: the most frequent countries, as written."""
    key = F.trim(F.coalesce("country_code", F.lit("")))
    return df.groupBy(key.alias("country_code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country_code").limit(n)


def masked_example(df: DataFrame, *keys: Column) -> DataFrame:
    """The most frequent key with two rows or more, masked."""
    top = collision_groups(df, F.concat_ws("|", *keys) if len(keys) > 1 else keys[0]).orderBy(F.desc("n"), "k1").limit(1)
    return top.select(N.masked_hash(F.col("k1")).alias("example"), "n")


def local_keys() -> dict[str, Column]:
    return {"host": N.local_host(F.col("website")), "name": N.local_name(F.col("name")), "coarse": N.coarse_key(F.col("name"), F.col("country_code"))}


def summary(df: DataFrame, key: str = "record_id") -> DataFrame:
    """The whole profile as (metric, value), in one scan: each row gives a count for the table, one for each missing value, and
    its keys, of which rows with equal values but for `key` are one. Keys are counted where they are read and once more
    after one shuffle; the rest is sums over that. An empty table has no null rates."""
    have = [c for c in PROFILED if c in df.columns]
    rest = [c for c in df.columns if c != key]
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    # to_json leaves nulls out, so they differ from every text
    kinds = {"row": F.lit(""), "same": F.sha2(F.to_json(F.struct(*rest)), 256), **local_keys(), **{f"null_rate_{c}": F.when(blank(c), "") for c in have}}
    each = df.select(F.inline(F.array(*(entry(k, v) for k, v in kinds.items())))).where("value is not null")
    n = F.col("n")
    found = each.groupBy("kind", "value").agg(F.count("*").alias("n")).groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(n >= 2).alias("groups"), F.coalesce(F.sum(F.when(n >= 2, n)), F.lit(0)).alias("records"))
    # as many rows as there are kinds; every metric is told, those without rows too
    of = lambda kind, c: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).cast("double")
    metrics = {"row_count": of("row", "n"), **{f"null_rate_{c}": F.round(of(f"null_rate_{c}", "n") / F.nullif(of("row", "n"), F.lit(0.0)), 6) for c in have}, "exact_duplicate_rows": of("same", "records")}
    for name in local_keys():
        metrics |= {f"{name}_groups_ge_2": of(name, "groups"), f"{name}_records_in_groups_ge_2": of(name, "records")}
    wide = found.agg(*(v.alias(k) for k, v in metrics.items()))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics))))
