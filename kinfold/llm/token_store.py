"""Token ids as Parquet: documents in the order of their ids, list columns of tokens, and what readers need to skip most of it.

write() lays texts out by ranges of ids, sorts each range, encodes it in that order and writes it: one pass, one shuffle, one
file (a shard) for each task. Tokens are a list column with dictionary encoding (a vocabulary of 2 ** 16 takes two bytes a
token); ids, places and lengths have no dictionary, so that Parquet's second version writes their differences. Row groups and
pages are kept small enough for their minima and maxima to be of use: a reader that wants a few documents, or a stretch of
the whole stream of tokens, opens the pages that hold them; one that wants only lengths never touches the tokens. A row
knows its place in its shard; the manifest, one row a shard, says where each shard begins.

Cases: a null text is empty, and an empty one is the end token alone; very long texts are one row. Null ids come first. Rows
that share an id are ordered by a hash of their text; equal rows are laid out over tasks too, so one id may hold any share of
the table. An empty table gives an empty store. Other columns of the table may be of any name or type, and aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import TEXTS, WAITING, encoder
from .text import release

END_ID = 2
#: Bytes of a row group and of a page, and rows that a page holds at most.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
#: Shards that are broadcast at most, 40 bytes each: beyond that a reader joins them by a shuffle.
BROADCAST_SHARDS = 500_000


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, place = TaskContext.get().partitionId(), 0
        for batch in (whole.slice(i, TEXTS) for whole in batches for i in range(0, whole.num_rows, TEXTS)):
            found: list = [None] * batch.num_rows
            for row, ids in encoder(path).encode(batch.column(1).to_pylist()):
                found[row] = np.append(ids, np.uint32(end_id)).astype("<u4")
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            begin = 0
            while begin < len(found):  # texts may be long: what is handed over is bounded by tokens too
                end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(sizes[begin:]), WAITING, "right")))
                n = sizes[begin:end]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(found[begin:end]).view(np.int32)))
                starts = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(np.full(len(n), shard), pa.int32()), pa.array(starts), pa.array(n), ids], names=["k", "shard", "place", "n_tokens", "ids"])
                begin = end
        release()

    return run


def write(docs: DataFrame, out: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> None:
    """Writes the tokens of all documents to out/tokens and the manifest to out/manifest."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    order = ["_key", F.xxhash64("_text"), F.monotonically_increasing_id()]
    laid = rows.repartitionByRange(*order).sortWithinPartitions("_key", F.xxhash64("_text"))
    encoded = laid.mapInArrow(_encoded(tokenizer, end_id), f"k {rows.schema[0].dataType.simpleString()}, shard int, place long, n_tokens long, ids array<int>")
    writer = encoded.withColumnRenamed("k", key).write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0")
    for name in (key, "place", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{out}/tokens")
    ends = spark.read.parquet(f"{out}/tokens").groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    # the one order over all shards is over as many rows as one stage has tasks
    ends.selectExpr("*", "sum(n_tokens) OVER (ORDER BY shard) - n_tokens AS base").write.mode("overwrite").parquet(f"{out}/manifest")


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """shard, n_docs, n_tokens, first_id, last_id, base (tokens of all shards before)."""
    return spark.read.parquet(f"{out}/manifest")


def _placed(df: DataFrame, shards: DataFrame) -> DataFrame:
    bases = shards.select("shard", "base")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_SHARDS else bases
    return df.join(bases, "shard").withColumn("start", F.col("base") + F.col("place")).drop("base", "place", "shard")


def read(spark: SparkSession, out: str, where: Column | None = None, ids: bool = True) -> DataFrame:
    """key, n_tokens, ids, start of the documents that `where`, a condition on the key or n_tokens, picks: it reaches the
    pages. ids=False leaves the tokens unread."""
    rows = spark.read.parquet(f"{out}/tokens")
    rows = rows if where is None else rows.where(where)
    return _placed(rows if ids else rows.drop("ids"), manifest(spark, out))


def stretch(spark: SparkSession, out: str, first: int, last: int) -> DataFrame:
    """start, ids: the tokens first to last - 1 of the whole stream, by document and in no order of rows. Shards outside it are
    left out by the manifest, pages by their places."""
    shards = manifest(spark, out).where((F.col("base") < last) & (F.col("base") + F.col("n_tokens") > first))
    numbers = [(r.shard, r.base) for r in shards.select("shard", "base").collect()]  # those that the stretch touches
    rows = spark.read.parquet(f"{out}/tokens")
    inside = F.lit(False)
    for shard, base in numbers:
        inside = inside | ((F.col("shard") == shard) & (F.col("place") < last - base) & (F.col("place") + F.col("n_tokens") > first - base))
    begin = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    end = F.least(F.lit(last) - F.col("start"), F.col("n_tokens"))
    found = _placed(rows.where(inside), shards)
    return found.select((F.col("start") + begin).alias("start"), F.slice("ids", (begin + 1).cast("int"), (end - begin).cast("int")).alias("ids"))


def digests(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32, worked out from the tokens read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            flat, ends = ids.values.to_numpy(zero_copy_only=False).view("<u4"), ids.offsets.to_pylist()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            n = np.diff(np.array(ends, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(crc, pa.int64())], names=["k", "start", "n_tokens", "ids_crc32"])
        release()

    source = tokens.select(F.col(key).alias("k"), "start", "ids")
    return source.mapInArrow(run, f"k {source.schema[0].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("k", key)
