"""Matching of records as they come: each batch meets itself and all records before it, and golden ids are merged. Where the
model has graphs (links.py), a batch takes time by the records in the store, whatever blocks hold; else it makes pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.operators import blocking
from kinfold.operators import matching as M
from kinfold.operators.components import connected_components
from kinfold.operators.links import match_links
from kinfold.scratch import Scratch
from kinfold.sources.tables import stream_files


class Store:
    """Prepared records with the golden id that they had when they came, and merges of golden ids, by batch. A batch is written
    as a whole under its number, so doing one again replaces what it wrote and nothing else."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.root}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def records(self, before: int | None = None) -> DataFrame:
        return self._read("records", "record_id string, name_norm string, host string, country_norm string, city_norm string, name_prefix string, label string", before).drop("batch")

    def merges(self, before: int | None = None) -> DataFrame:
        """src, dst: labels that are one entity."""
        return self._read("merges", "src string, dst string", before).drop("batch")

    def write(self, name: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def golden(self, before: int | None = None) -> DataFrame:
        """record_id, golden_entity_id as of now: labels followed through all merges."""
        rows = self.records(before).select("record_id", "label")
        ends = connected_components(self.merges(before)).select(F.col("node").alias("label"), F.col("label").alias("end"))
        return rows.join(ends, "label", "left").select("record_id", F.concat(F.lit("g"), F.coalesce("end", "label")).alias("golden_entity_id"))


def candidates(new: DataFrame, stored: DataFrame, denied: tuple[str, ...] = N.DENIED_HOSTS, tile: int = blocking.TILE) -> DataFrame:
    """Candidate pairs with a new record: of two new ones, and of a new and a stored one, each once, smaller id on the left."""
    among = M.candidate_pairs(new, denied, tile).drop("match_key")
    side = lambda df, s, on: df.na.drop(subset=list(on)).select(*(F.col(c).alias(f"{c}_{s}") for c in M.PAIR_COLUMNS), *on)

    def across(a: DataFrame, b: DataFrame, on: tuple[str, ...]) -> DataFrame:
        return blocking.tiled_join(side(a, "n", on), side(b, "s", on), on, "record_id_n", "record_id_s", tile).drop(*on)

    met = F.coalesce((F.col("host_n") == F.col("host_s")) & N.eligible_host(F.col("host_n"), denied), F.lit(False))
    pairs = across(M.with_host(new, denied), M.with_host(stored, denied), ("host",)).unionByName(across(new, stored, ("name_prefix", "country_norm")).where(~met))
    turned = F.col("record_id_n") > F.col("record_id_s")
    pick = lambda c, first, second: F.when(turned, F.col(f"{c}_{second}")).otherwise(F.col(f"{c}_{first}"))
    return among.unionByName(pairs.select(*(pick(c, "n", "s").alias(f"{c}_l") for c in M.PAIR_COLUMNS), *(pick(c, "s", "n").alias(f"{c}_r") for c in M.PAIR_COLUMNS)))


def absorb(batch: DataFrame, number: int, store: Store, model: M.Model, threshold: float = M.MATCH, denied: tuple[str, ...] = N.DENIED_HOSTS, prefix: int = 3) -> None:
    """Adds the records of a batch. Records already stored, and repeats within the batch, are passed over; so is a null id. Done
    again with its number, a batch leaves the store as it was."""
    scratch = Scratch(batch.sparkSession)
    stored = store.records(number)
    fresh = M.prepare(batch, prefix).select(*M.PAIR_COLUMNS).where("record_id is not null").dropDuplicates(["record_id"])
    new = scratch.keep(fresh.join(stored.select("record_id"), "record_id", "left_anti"))
    # a new record is its own entity at first, a stored one is what its label has become
    ends = connected_components(store.merges(number)).select(F.col("node").alias("label"), F.col("label").alias("end"))
    label = stored.select("record_id", "label").join(ends, "label", "left").select("record_id", F.coalesce("end", "label").alias("of"))
    every = scratch.keep(new.unionByName(stored.select(*M.PAIR_COLUMNS)))
    found = match_links(every, model, threshold, denied, scratch=scratch)
    if found is None:
        scored = M.score(M.compare(candidates(new, stored, denied)), model)
        edges = scored.where(F.col("match_probability") >= threshold).select(F.col("record_id_l").alias("a"), F.col("record_id_r").alias("b"))
    else:
        # links among stored records are known, and go as soon as labels are put for them
        members, linked = found
        whole = linked.select(F.explode(F.array("src", "dst")).alias("class_id")).distinct()
        edges = linked.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(members.join(whole, "class_id").select(F.col("record_id").alias("a"), F.col("class_id").alias("b")))
    edges = scratch.keep(edges.where("a <> b"))
    for s in "ab":
        edges = edges.join(label.select(F.col("record_id").alias(s), F.col("of").alias(f"of_{s}")), s, "left")
    links = edges.select(F.coalesce("of_a", "a").alias("src"), F.coalesce("of_b", "b").alias("dst")).where("src <> dst").distinct()
    store.write("merges", scratch.keep(links), number)
    store.write("records", new.withColumn("label", F.col("record_id")), number)
    scratch.close()


def run(spark: SparkSession, path: str, to_records, model: M.Model, root: str | None = None, files: int = 1, denied: tuple[str, ...] = N.DENIED_HOSTS, threshold: float = M.MATCH) -> Store:
    """Absorbs a folder of Parquet files as a stream, so many files a batch; to_records makes company records of its rows. Started
    again with its folder `root`, it goes on with the files that are new."""
    store = Store(spark, root or f"{Scratch(spark).root}/store")
    each = lambda df, number: absorb(df, number, store, model, threshold, denied)
    to_records(stream_files(spark, path, files)).writeStream.foreachBatch(each).option("checkpointLocation", f"{store.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store
