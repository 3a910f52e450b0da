"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records uniformly into buckets that fit in a task's memory, by a seeded hash, and writes them, whole
records. Buckets are sized by bytes and rows; with larger executors larger buckets make fewer tasks. Pass two shuffles each bucket (Spark's shuffle() is a Fisher-Yates shuffle with a seed) and lays the buckets end to end; the
shards are equal cuts of that line. Law `rows`: the counts of any two shards differ by one at most.

Cases: null texts have no bytes; null ids are hashed as any value. Repeated rows are told apart by their place in the
input, so a row that makes a third of the table is spread like any other. With fewer rows than shards the last shards are
empty; an empty table gives an empty result. Columns may be of any type, maps too: rows are ordered by their hash and place
alone. All columns of the input come along, whatever their names but for the names
in OUT, which are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch

#: Bytes and rows that a bucket holds on average at most, and so the size of what one task shuffles in memory.
BUCKET_BYTES = 16 << 20
BUCKET_ROWS = 8000
#: Buckets whose starts are broadcast at most, 16 bytes each; those of more are joined by a shuffle.
BROADCAST_BUCKETS = 2_000_000
#: Buckets whose counts one task adds up; sums of those are added in a second step.
SPAN = 4096
OUT = ("law", "shard", "slot", "grown_shard")


def _bytes(df: DataFrame, names: list[str]) -> Column:
    """About the bytes of a row: those of strings and binaries, 8 for a number, and nested columns as JSON."""
    sizes = [F.lit(16)]
    for f in df.select(*(F.col(f"`{c}`") for c in names)).schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("c")))), F.lit(0)))
        else:
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8))
    return reduce(Column.__add__, (x.cast("long") for x in sizes))


def bucket_count(df: DataFrame, names: list[str], bucket_rows: int, bucket_bytes: int) -> tuple[int, int]:
    """Rows, and how many buckets they take."""
    total, size = df.agg(F.count("*"), F.sum(_bytes(df, names))).first()
    return total, max(1, -(-total // bucket_rows), -(-(size or 0) // bucket_bytes))


def shards(df: DataFrame, key: str = "doc_id", n_shards: int = 40, seed: int = 17, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """df's columns and law, shard, slot (from 0 without gaps in each shard) and grown_shard (null under this law)."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    names = [c for c in df.columns if c not in OUT]
    # the place of a row in the input is the same whenever the scan is repeated
    placed = df.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("row"), F.col(f"`{key}`").alias("_key"), F.monotonically_increasing_id().alias("place"))
    total, buckets = bucket_count(df, names, bucket_rows, bucket_bytes)
    scattered = placed.select("row", F.xxhash64(F.lit(seed), "_key", "place").alias("at"), "place")
    scattered = scattered.withColumn("bucket", F.pmod(F.shiftright("at", 20), F.lit(buckets)).cast("int"))
    # a task gathers about one bucket, whatever the session's number of partitions
    first = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).when(a["place"] < b["place"], -1).otherwise(1)
    gathered = scattered.repartition(buckets, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("at", "place", "row")), first).alias("rows"))
    written = scratch.keep(gathered.select("bucket", F.size("rows").alias("n"), F.col("rows.row").alias("rows")))
    scratch.free()
    # running counts in two levels: no task sees more than SPAN buckets, and the last one a row for each SPAN of them
    counts = written.select("bucket", "n", F.floor(F.col("bucket") / SPAN).alias("span"))
    spans = counts.groupBy("span").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("span", before(Window.orderBy("span")).alias("ahead"))
    starts = counts.withColumn("start", before(Window.partitionBy("span").orderBy("bucket"))).join(spans, "span").select("bucket", (F.col("start") + F.col("ahead")).alias("start"))
    each, more = divmod(total, n_shards)
    cut = more * (each + 1)
    starts = F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts
    mixed = written.withColumn("rows", F.shuffle("rows", seed)).join(starts, "bucket").select("start", F.posexplode("rows").alias("i", "row")).withColumn("g", F.col("start") + F.col("i"))
    # `more` shards of each + 1 rows come first, then those of `each`
    late = F.col("g") >= cut
    shard = F.when(late, more + F.floor((F.col("g") - cut) / max(each, 1))).otherwise(F.floor(F.col("g") / (each + 1)))
    slot = F.when(late, (F.col("g") - cut) % max(each, 1)).otherwise(F.col("g") % (each + 1))
    return mixed.select(*(F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)), F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write(df: DataFrame, path: str, **options) -> None:
    """The shuffled records as Parquet, a folder for each shard, in slot order."""
    out = shards(df, **options)
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
