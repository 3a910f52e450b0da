"""The corpus pipeline: each stage is one operator, and takes what the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import decontaminate, langid, line_dedup, packing, trie_join
from kinfold.scratch import Scratch

#: Contaminated texts that are broadcast at most, by hashes; more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000


OWN = ("doc_id", "text", "lang", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """docs with its other columns under names that no operator uses, whatever they were called."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in OWN else f"_c{i}") for i, c in enumerate(docs.columns)))


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*(F.col(c if c in OWN else f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (null, or without a letter) go. Repeated rows stay, or go, together; ids may be
    null; long texts are read whole; an empty table stays empty. Other columns may have any names."""
    rows = _plain(docs)
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0
    found = langid.predict(rows, langid.fit(rows, learn), out=("_lang_pred", "_score"))
    return _named(found.where("_lang_pred <> 'und'"), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are cut out; documents of which no word is left go. Texts without repeated lines stay as they are, null
    and empty ones too; a null n_chars is filled in. Long texts are cut line by line; an empty table stays empty. Other
    columns may have any names."""
    cut = line_dedup.dedup(_plain(docs)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    return _named(cut.withColumn("n_chars", F.length("text").cast("long")), docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with Jaccard 0.8 or more the one with the smallest id stays, and so does each
    without words. Rows with one id stay together, and so do all with null ids. Texts count whole; an empty table stays
    empty. Other columns may have any names: they aren't read."""
    stay = trie_join.groups(docs, count_links=False).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("stay")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay"]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. That hangs on the text alone, so rows are known by its hash; ids may be
    null or occur twice. Null and empty texts stay; long ones are searched whole; an empty table, or benchmark, changes
    nothing. Other columns may have any names."""
    rows = _plain(docs).withColumn("_hash", F.xxhash64("text"))
    found = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_hash")
    found = Scratch(spark).keep(found.select("_hash").distinct())
    found = F.broadcast(found) if found.count() <= BROADCAST_HASHES else found
    return _named(rows.join(found, "_hash", "left_anti"), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their tokens, their sequence and their place in it. A null or empty text is the end
    token alone; repeated rows are packed each; an empty table gives an empty result."""
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(cut)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else scratch.keep(out)
    return docs
