"""Queries by name: each applies one operator to the whole company records of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.operators import entities as E
from kinfold.operators import links
from kinfold.operators import matching as M
from kinfold.operators import quality as Q
from kinfold.operators import sampling as S
from kinfold.operators import temporal
from kinfold.scratch import Scratch
from kinfold.sources.companies import company_records, records_of_pages
from kinfold.streaming import incremental, sessions

#: The denied hosts, of which the pages have none, and one of the pages' hosts, so that there is something to deny.
DENIED = (*N.DENIED_HOSTS, "cheap-pills.example.com")
TARGETS = {"host_target": 40, "name_target": 20, "filler": 30}


def _prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prepare(company_records(spark, sf_dir))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared records as a written table: blocks are counted before they are joined."""
    return Scratch(spark).keep(_prep(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str, disposition: str | None = None) -> DataFrame:
    return M.score(M.compared_pairs(_kept(spark, sf_dir), DENIED, model=M.FIXED, disposition=disposition), M.FIXED, digits=6)


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From links of classes: no pair of records is made."""
    return E.golden_of_links(*links.match_links(_kept(spark, sf_dir), M.FIXED, denied=DENIED))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hierarchy(_golden(spark, sf_dir), _prep(spark, sf_dir), DENIED)


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_host_parent(E.representatives(_golden(spark, sf_dir), _prep(spark, sf_dir)), DENIED)


def _ids(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select("record_id_l", "record_id_r", *more)


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = company_records(spark, sf_dir)
    return r.select("record_id", N.local_host(F.col("website")).alias("local_host"), N.local_name(F.col("name")).alias("local_name"), N.coarse_key(F.col("name"), F.col("country_code")).alias("coarse_key"))


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep = _prep(spark, sf_dir)
    return prep.withColumns({"name_norm_ingest": N.name_norm_ingest(F.col("name")), "host_parent_id": N.host_parent_id(F.col("host"), DENIED)}).drop("name", "website", "city", "country_code")


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = company_records(spark, sf_dir)
    return r.select("record_id", N.masked_hash(F.col("name")).alias("name_hash"), N.masked_hash(F.col("website")).alias("website_hash"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, out = company_records(spark, sf_dir), None
    for name, key in Q.local_keys().items():
        one = Q.collision_stats(r, key).select(F.lit(name).alias("key_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, out = company_records(spark, sf_dir), None
    for name, key in Q.local_keys().items():
        one = Q.masked_example(r, key).select(F.lit(name).alias("key_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts, names = S.eligible_groups(company_records(spark, sf_dir), denied=DENIED)
    return hosts.select(F.lit("host").alias("rule"), F.col("host").alias("group_key"), "n").unionByName(names.select(F.lit("name_country").alias("rule"), F.concat_ws("|", "name_norm", "country_norm").alias("group_key"), "n"))


def _part_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return Q.collision_groups(part, F.col("p_name"), F.col("p_brand"), most=10)


def _filler(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = company_records(spark, sf_dir)
    picked = S.enriched_sample(r, **(TARGETS | {"filler": 0}), denied=DENIED)
    return S.filler_rows(r, picked, TARGETS["filler"])


def _parent_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden, prep = Scratch(spark).keep(_golden(spark, sf_dir)), _prep(spark, sf_dir)
    return E.parent_review(E.hierarchy(golden, prep, DENIED), E.representatives(golden, prep))


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pattern_counts(Scratch(spark).keep(M.classes(_prep(spark, sf_dir))), DENIED)


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = Scratch(spark).keep(_golden(spark, sf_dir))
    return E.verify(company_records(spark, sf_dir), golden, E.hierarchy(golden, _prep(spark, sf_dir), DENIED))


def _mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = company_records(spark, sf_dir)
    return E.id_set_mismatch(r.where(F.col("website").isNotNull()), r.where(F.col("country_code").isNotNull()))


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages arrive in three parts."""
    feed = f"{Scratch(spark).root}/feed"
    spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(3, "page_id").write.parquet(feed)
    return incremental.run(spark, feed, records_of_pages, M.FIXED, denied=DENIED).golden()


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view before it, and each event's last order of the customer with its user's number."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = temporal.asof_join(bought, views, "user_id", "ts", "view_ts", ("view_id",))
    return temporal.asof_join(seen, orders, "user_id", "ts", "o_orderdate", ("o_orderkey",)).select("event_id", "view_id", "o_orderkey")


def _after_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event within a day after an error of the same user, the error itself not counted."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    spans = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.expr("ts + interval 1 microsecond").alias("begins"), F.expr("ts + interval 1 day").alias("ends"))
    return temporal.interval_join(events.select("user_id", "event_id", "ts"), spans, "user_id", "ts", "begins", "ends").select("user_id", "error_id", "event_id")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.run(spark, f"{sf_dir}/events.parquet")
    return found.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "n_events", F.round("total_value", 6).alias("total_value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "company_records": company_records,
    "normalize_keys": _normalized,
    "normalize_local": _local,
    "masked_hash": _masked,
    "null_rates": lambda s, d: Q.null_rates(company_records(s, d)),
    "exact_duplicates": lambda s, d: Q.exact_duplicates(company_records(s, d).drop("handle", "website")),
    "country_top20": lambda s, d: Q.country_top(company_records(s, d)),
    "dq_summary": lambda s, d: Q.summary(company_records(s, d)),
    "host_collision_groups": lambda s, d: Q.collision_groups(company_records(s, d), N.host(F.col("website"))).withColumnRenamed("k1", "host"),
    "name_collision_groups": lambda s, d: Q.collision_groups(company_records(s, d), N.name_norm_ingest(F.col("name"))).withColumnRenamed("k1", "name_norm"),
    "coarse_key_collisions": lambda s, d: Q.collision_groups(company_records(s, d), N.coarse_key(F.col("name"), F.col("country_code"))).withColumnRenamed("k1", "coarse_key"),
    "collision_stats": _stats,
    "masked_examples": _examples,
    "eligible_groups": _eligible,
    "part_collision_window": _part_groups,
    "max_host_group": lambda s, d: M.max_host_group(_prep(s, d), DENIED),
    "hash_topk_sample": lambda s, d: S.hash_sample(company_records(s, d), 100).select("record_id", "name", "website"),
    "threshold_sample": lambda s, d: S.threshold_sample(company_records(s, d), 0.5).select("record_id", "name", "website"),
    "enriched_sample": lambda s, d: S.enriched_sample(company_records(s, d), **TARGETS, denied=DENIED).select("record_id", "name", "website", "country_code"),
    "filler_antijoin": lambda s, d: _filler(s, d).select("record_id", "name"),
    "block_host": lambda s, d: _ids(M.block_host(_kept(s, d), DENIED)),
    "block_prefix_country": lambda s, d: _ids(M.block_prefix_country(_kept(s, d))),
    "block_dedup_union": lambda s, d: _ids(M.candidate_pairs(_kept(s, d), DENIED), "match_key"),
    "pair_counts_by_rule": lambda s, d: M.pair_counts(_prep(s, d), DENIED),
    "deterministic_pairs": lambda s, d: M.deterministic_pairs(_kept(s, d), DENIED),
    "near_host_names": lambda s, d: M.near_host_names(_kept(s, d), DENIED),
    "distinct_pair_counts": lambda s, d: M.distinct_pair_counts(_prep(s, d), DENIED),
    "lambda_estimate": lambda s, d: M.lambda_estimate(_kept(s, d), denied=DENIED).withColumn("lam", F.round("lam", 9)),
    "u_exact": lambda s, d: M.u_exact(_prep(s, d)).withColumn("u", F.round("u", 9)),
    "u_name_levels": lambda s, d: M.u_name_levels(_kept(s, d)).withColumn("share", F.round("share", 9)),
    "comparison_vectors": lambda s, d: _ids(M.compared_pairs(_kept(s, d), DENIED), *M.GAMMAS),
    "gamma_patterns": _patterns,
    "class_patterns": _patterns,
    "score_pairs_fixed": lambda s, d: _ids(_scored(s, d), "match_weight", "match_probability", "disposition"),
    "disposition_histogram": lambda s, d: M.histogram(M.score(_patterns(s, d), M.FIXED), F.col("n")),
    "pattern_histogram": lambda s, d: M.histogram(M.score(_patterns(s, d), M.FIXED), F.col("n")),
    "review_queue": lambda s, d: _ids(_scored(s, d, "review"), "match_probability"),
    "em_parameters": lambda s, d: M.parameters(M.train(_kept(s, d), denied=DENIED), s),
    "golden_entities": _golden,
    "incremental_golden": _incremental,
    "cluster_stats": lambda s, d: E.cluster_stats(_golden(s, d)),
    "cluster_review": lambda s, d: E.cluster_review(_golden(s, d), _prep(s, d)),
    "representatives": lambda s, d: E.representatives(_golden(s, d), _prep(s, d)),
    "host_parent": lambda s, d: _reps(s, d).select("golden_entity_id", "host_parent_id"),
    "name_prefix_parent": lambda s, d: E.name_parents(_reps(s, d)),
    "hierarchy": _tree,
    "parent_review": lambda s, d: _parent_review(s, d),
    "funnel": lambda s, d: E.funnel(_tree(s, d)),
    "verify_hierarchy": _verified,
    "id_set_mismatch": _mismatch,
    "asof_join": _asof,
    "interval_join": _after_errors,
    "event_sessions": _sessions,
}
