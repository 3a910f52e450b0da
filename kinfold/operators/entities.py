"""Golden entities, their hierarchy, and the checks of both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.operators.components import connected_components
from kinfold.scratch import Scratch


def golden_entities(records: DataFrame, scored: DataFrame, threshold: float = 0.9, scratch: Scratch | None = None) -> DataFrame:
    """record_id, golden_entity_id for every record: 'g' and the least record of its component."""
    edges = scored.where(F.col("match_probability") >= threshold).select(F.col("record_id_l").alias("src"), F.col("record_id_r").alias("dst"))
    labels = connected_components(edges, scratch)
    joined = records.select("record_id").join(labels, F.col("record_id") == F.col("node"), "left")
    return joined.select("record_id", F.concat(F.lit("g"), F.coalesce("label", "record_id")).alias("golden_entity_id"))


def golden_of_links(members: DataFrame, links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """As golden_entities, from links.match_links: records of a class with a link, or a loop, are one entity; of others each is its own."""
    labels = connected_components(links, scratch)
    joined = members.join(labels, F.col("class_id") == F.col("node"), "left")
    return joined.select("record_id", F.concat(F.lit("g"), F.coalesce("label", "record_id")).alias("golden_entity_id"))


def cluster_stats(golden: DataFrame) -> DataFrame:
    sizes = golden.groupBy("golden_entity_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("cluster_n"), F.count_if(F.col("n") == 1).alias("singleton_n"), F.coalesce(F.max("n"), F.lit(0)).alias("max_size"))


def _shown(masked: bool) -> tuple[Column, Column]:
    if masked:
        return N.masked_hash(F.col("name_norm")).alias("name_hash"), N.masked_hash(F.col("host")).alias("host_hash")
    return F.col("name_norm"), F.col("host")


def cluster_review(golden: DataFrame, prep: DataFrame, masked: bool = True, limit: int = 100) -> DataFrame:
    """A report: members of clusters of two or more with what was matched, the largest first, at most `limit` rows. Masked,
    names and hosts are hashes."""
    sizes = golden.groupBy("golden_entity_id").agg(F.count("*").alias("cluster_size")).where("cluster_size >= 2")
    joined = golden.join(sizes, "golden_entity_id").join(prep.select("record_id", "name_norm", "host", "country_norm"), "record_id")
    top = joined.orderBy(F.desc("cluster_size"), "golden_entity_id", "record_id").limit(limit)
    return top.select("golden_entity_id", "cluster_size", "record_id", *_shown(masked), "country_norm")


def representatives(golden: DataFrame, prep: DataFrame) -> DataFrame:
    """Of each golden entity its least record, with the keys. An aggregate, so no sort."""
    joined = golden.join(prep.select("record_id", "name_norm", "host", "country_norm"), "record_id")
    best = joined.groupBy("golden_entity_id").agg(F.min("record_id").alias("record_id"), F.min_by(F.struct("name_norm", "host", "country_norm"), "record_id").alias("x"))
    return best.select("golden_entity_id", "record_id", "x.name_norm", "x.host", "x.country_norm")


def with_host_parent(reps: DataFrame, denied: tuple[str, ...] = N.DENIED_HOSTS) -> DataFrame:
    return reps.withColumn("host_parent_id", N.host_parent_id(F.col("host"), denied))


def name_parents(reps: DataFrame, least: int = 8) -> DataFrame:
    """golden_entity_id and name_parent_id: of entities without a host parent, the entity of the same country with the
    shortest name of `least` characters or more that the name begins with, followed by a space; of entities with one name the
    least id. A name asks for each of its beginnings that end before a space, by equality, and each name is there once for a
    country: as many rows as names have spaces, whatever names have in common."""
    parents = reps.where(F.length("name_norm") >= least).groupBy("country_norm", F.col("name_norm").alias("begin")).agg(F.min("golden_entity_id").alias("parent"))
    child = reps.where(F.col("host_parent_id").isNull() & F.col("country_norm").isNotNull()).select("golden_entity_id", "name_norm", "country_norm")
    spaces = F.expr(f"filter(sequence({least}, length(name_norm) - 1), i -> substring(name_norm, i + 1, 1) = ' ')")
    asked = child.where(F.length("name_norm") > least).select("golden_entity_id", "country_norm", "name_norm", F.explode(spaces).alias("n"))
    met = asked.withColumn("begin", F.expr("substring(name_norm, 1, n)")).drop("name_norm").join(parents, ["country_norm", "begin"])
    return met.groupBy("golden_entity_id").agg(F.min_by("parent", "n").alias("name_parent_id"))


def hierarchy(golden: DataFrame, prep: DataFrame, denied: tuple[str, ...] = N.DENIED_HOSTS, least: int = 8, resolve_parent: bool = False) -> DataFrame:
    """record_id, golden_entity_id, ultimate_parent_id. A name parent is one hop: it isn't followed to its own host parent
    unless resolve_parent is set."""
    reps = with_host_parent(representatives(golden, prep), denied)
    named = name_parents(reps, least)
    if resolve_parent:
        up = reps.select(F.col("golden_entity_id").alias("name_parent_id"), F.col("host_parent_id").alias("up"))
        named = named.join(up, "name_parent_id").select("golden_entity_id", F.coalesce("up", "name_parent_id").alias("name_parent_id"))
    top = reps.join(named, "golden_entity_id", "left").select("golden_entity_id", F.coalesce("host_parent_id", "name_parent_id", "golden_entity_id").alias("ultimate_parent_id"))
    return golden.join(top, "golden_entity_id", "left").select("record_id", "golden_entity_id", "ultimate_parent_id")


def parent_review(tree: DataFrame, reps: DataFrame, masked: bool = True, limit: int = 50) -> DataFrame:
    """A report: golden entities of parents with two or more, with their representatives' keys, the largest first, at most `limit`
    rows. Masked, names and hosts are hashes; ids are shown."""
    pairs = tree.select("golden_entity_id", "ultimate_parent_id").distinct()
    sizes = pairs.groupBy("ultimate_parent_id").agg(F.count("*").alias("parent_size")).where("parent_size >= 2")
    joined = pairs.join(sizes, "ultimate_parent_id").join(reps.select("golden_entity_id", "name_norm", "host", "country_norm"), "golden_entity_id")
    top = joined.orderBy(F.desc("parent_size"), "ultimate_parent_id", "golden_entity_id").limit(limit)
    return top.select("ultimate_parent_id", "parent_size", "golden_entity_id", "country_norm", *_shown(masked))


def funnel(tree: DataFrame) -> DataFrame:
    """Records, entities, parents and the reductions from one to the next."""
    counts = tree.agg(F.count("*").alias("records"), F.countDistinct("golden_entity_id").alias("goldens"), F.countDistinct("ultimate_parent_id").alias("parents"))
    cut = lambda a, b: F.round(N.pct_reduction(F.col(a), F.col(b)), 6)
    return counts.select("*", cut("goldens", "records").alias("record_to_golden"), cut("parents", "goldens").alias("golden_to_parent"), cut("parents", "records").alias("record_to_parent"))


def id_set_mismatch(a: DataFrame, b: DataFrame, key: str = "record_id") -> DataFrame:
    """Ids that only one side has."""
    one, other = a.select(key).distinct(), b.select(key).distinct()
    only = lambda x, y, side: x.join(y, key, "left_anti").select(key, F.lit(side).alias("only_in"))
    return only(one, other, "left").unionByName(only(other, one, "right"))


def verify(source: DataFrame, golden: DataFrame, tree: DataFrame, frozen: tuple[int, int, int] | None = None) -> DataFrame:
    """check, ok, detail: nothing is written or raised."""
    counts = lambda df, name: df.agg(F.lit(name).alias("t"), F.count("*").alias("n"), F.countDistinct("record_id").alias("d"), F.count_if(reduce(Column.__or__, [F.col(c).isNull() for c in df.columns])).alias("nulls"))
    tables = {"source": source.select("record_id"), "golden": golden.select("record_id", "golden_entity_id"), "hierarchy": tree.select("record_id", "golden_entity_id", "ultimate_parent_id")}
    rows = None
    for name, df in tables.items():
        one = counts(df, name)
        rows = one if rows is None else rows.unionByName(one)
    checks = rows.select(F.explode(F.array(
        F.struct(F.concat("t", F.lit("_not_empty")).alias("check"), (F.col("n") > 0).alias("ok"), F.col("n").alias("detail")),
        F.struct(F.concat("t", F.lit("_unique_ids")).alias("check"), (F.col("n") == F.col("d")).alias("ok"), (F.col("n") - F.col("d")).alias("detail")),
        F.struct(F.concat("t", F.lit("_no_nulls")).alias("check"), (F.col("nulls") == 0).alias("ok"), F.col("nulls").alias("detail")),
    )).alias("x")).select("x.*")
    for name, a, b in (("source_golden", "source", "golden"), ("golden_hierarchy", "golden", "hierarchy")):
        unlike = id_set_mismatch(tables[a], tables[b]).agg(F.count("*").alias("n"))
        checks = checks.unionByName(unlike.select(F.lit(f"{name}_same_ids").alias("check"), (F.col("n") == 0).alias("ok"), F.col("n").alias("detail")))
    if frozen:
        got = funnel(tree)
        for column, want in zip(("records", "goldens", "parents"), frozen, strict=True):
            checks = checks.unionByName(got.select(F.lit(f"frozen_{column}").alias("check"), (F.col(column) == want).alias("ok"), F.col(column).alias("detail")))
    return checks
