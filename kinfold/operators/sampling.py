"""Samples that are the same for any partitioning: rows are ordered by a hash of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.operators import quality
from kinfold.scratch import Scratch

GROUP_SIZE = 2.2


def hash_order(seed: int, *keys: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)), 256)


#: Samples of up to this many rows are taken by one sort of what each task has as its first rows; larger ones by a threshold.
SORTED_ROWS = 10_000
#: Hex digits by which hashes are counted at a time (16 ** 3 counts), and hashes that are looked at one by one.
DIGITS, FEW = 3, 2_000


def hash_sample(df: DataFrame, n: int, seed: int = 42, *keys: str) -> DataFrame:
    """n rows, each set of n as likely as any other. n is the feature."""
    if n <= 0:
        raise ValueError("n must be positive")
    keys = keys or ("record_id",)
    if n > SORTED_ROWS:
        return threshold_sample(df, n, seed, *keys)
    return df.orderBy(hash_order(seed, *keys), *keys).limit(n)


def threshold(df: DataFrame, n: int, order: Column) -> tuple[str, int, int] | None:
    """The n-th smallest value of `order` (hex digits of one length), how many rows have it, and how many of those are among the
    first n. None if there are fewer than n rows. Values are counted by their first digits, then those with the digits at
    which the n-th lies by their next ones: the driver sees 4,096 counts a pass, and two or three passes do."""
    values, prefix = df.select(order.alias("h")), ""
    while True:
        under = values.where(F.col("h").startswith(prefix)).groupBy(F.substring("h", 1, len(prefix) + DIGITS).alias("p"))
        for r in sorted(under.agg(F.count("*").alias("n"), F.min("h").alias("least"), F.max("h").alias("most")).collect()):
            if n <= r.n:
                break
            n -= r.n
        else:
            return None
        if r.least == r.most:
            return r.least, r.n, n
        if r.n <= FEW:
            for h, many in sorted(values.where(F.col("h").startswith(r.p)).groupBy("h").agg(F.count("*").alias("n")).collect()):
                if n <= many:
                    return h, many, n
                n -= many
        prefix = r.p


def threshold_sample(df: DataFrame, n: int | float, seed: int = 42, *keys: str) -> DataFrame:
    """The rows that hash_sample gives, in no order, by a filter: no task holds the sample. n below 1 is a share of the rows,
    rounded down. Only rows whose keys are all equal to the last one's are chosen among by a limit."""
    keys = keys or ("record_id",)
    order = hash_order(seed, *keys)
    n = int(df.count() * n) if 0 < n < 1 else int(n)
    if n <= 0:
        return df.limit(0)
    found = threshold(df, n, order)
    if found is None:
        return df
    last, many, taken = found
    if many == taken:
        return df.where(order <= last)
    return df.where(order < last).unionByName(df.where(order == last).limit(taken))


#: Ranges of the hash in which rows are numbered; a count of each is joined back.
RANGES = 4096


def numbered(df: DataFrame, seed: int, key: str, out: str) -> DataFrame:
    """Numbers from 0 in the order of a seeded hash of the key: within ranges of the hash, and the counts of the ranges before.
    Keys should be unique: equal ones share a range."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    ranged = df.withColumn("_h", h).withColumn("_range", F.shiftrightunsigned("_h", 52).cast("int"))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).selectExpr("_range", "sum(_n) OVER (ORDER BY _range) - _n AS _before")
    inner = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)))
    return inner.join(F.broadcast(counts), "_range").withColumn(out, F.col("_before") + F.col("_at") - 1).drop("_h", "_range", "_at", "_before")  # RANGES rows at most


def sample_pairs(df: DataFrame, max_pairs: int = 1_000_000, seed: int = 42, key: str = "record_id", scratch: Scratch | None = None) -> DataFrame:
    """Up to about max_pairs pairs of rows, each pair of the table as likely, none twice; all of them if there are no more. Columns
    have _l and _r. Rows stand in a random ring, and each meets those 1 to k places on; what lies beyond max_pairs rows is
    left out by a threshold on the hash. Keys should be unique and not null."""
    df = df.where(F.col(key).isNotNull())
    n = df.count()
    if n > max_pairs:
        df, n = threshold_sample(df, max_pairs, seed, key), max_pairs
    far = min(-(-max_pairs // max(n, 1)), n // 2)
    ring = (scratch or Scratch(df.sparkSession)).keep(numbered(df, seed, key, "_rank"))
    names = [c for c in ring.columns if c != "_rank"]
    left = ring.select(*(F.col(c).alias(f"{c}_l") for c in names), "_rank", F.explode(F.sequence(F.lit(1), F.lit(max(far, 1)))).alias("_on"))
    # half way round both meet from either side
    once = (F.col("_on") * 2 != n) | (F.col("_rank") < F.col("_on"))
    left = left.where(once & F.lit(far > 0)).withColumn("_at", (F.col("_rank") + F.col("_on")) % max(n, 1)).drop("_rank", "_on")
    return left.join(ring.select(*(F.col(c).alias(f"{c}_r") for c in names), F.col("_rank").alias("_at")), "_at").drop("_at")


def eligible_groups(df: DataFrame, least: int = 2, most: int = 10, denied: tuple[str, ...] = N.DENIED_HOSTS) -> tuple[DataFrame, DataFrame]:
    """Host groups and name-and-country groups with a size in the window."""
    host, name, country = N.host(F.col("website")), N.name_norm(F.col("name")), N.country_norm(F.col("country_code"))
    hosts = quality.collision_groups(df.where(N.eligible_host(host, denied)), host, least=least, most=most)
    return hosts.withColumnRenamed("k1", "host"), quality.collision_groups(df, name, country, least=least, most=most).withColumnsRenamed({"k1": "name_norm", "k2": "country_norm"})


def check_parameters(least: int, most: int, *targets: int) -> None:
    if not 2 <= least <= most <= 80:
        raise ValueError("2 <= least <= most <= 80 must hold")
    if any(not 0 <= t <= 100_000 for t in targets):
        raise ValueError("targets are 0 to 100,000")
    if sum(targets) > 100_000:
        raise ValueError("targets are at most 100,000 in all")


def enriched_sample(df: DataFrame, host_target: int = 18_000, name_target: int = 12_000, filler: int = 10_000, seed: int = 42, least: int = 2, most: int = 10, denied: tuple[str, ...] = N.DENIED_HOSTS, scratch: Scratch | None = None) -> DataFrame:
    """Records of picked host groups and name-and-country groups, and filler from the rest; each record once."""
    check_parameters(least, most, host_target, name_target, filler)
    keyed = df.withColumns({"_host": N.host(F.col("website")), "_name": N.name_norm(F.col("name")), "_country": N.country_norm(F.col("country_code"))})
    hosts, names = eligible_groups(df, least, most, denied)
    picks = lambda target: max(1, int(target / GROUP_SIZE))
    h = hash_sample(hosts, picks(host_target), seed, "host")
    n = hash_sample(names, picks(name_target), seed + 1, "name_norm", "country_norm")
    by_host = keyed.join(h, keyed["_host"] == h["host"], "left_semi")
    by_name = keyed.join(n, (keyed["_name"] == n["name_norm"]) & (keyed["_country"] == n["country_norm"]), "left_semi")
    picked = by_host.unionByName(by_name).select(*df.columns).dropDuplicates(["record_id"])
    if not filler:
        return picked
    picked = (scratch or Scratch(df.sparkSession)).keep(picked)  # read twice
    return picked.unionByName(filler_rows(df, picked, filler, seed))


def filler_rows(df: DataFrame, picked: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return hash_sample(df.join(picked.select("record_id"), "record_id", "left_anti").select(*df.columns), n, seed + 2)


def check_result(rows: int, least: int = 1000, most: int = 50_000) -> None:
    if not least <= rows <= most:
        raise ValueError(f"{rows} rows; {least} to {most} are expected")
