"""Pairs within blocks, where one block may hold any share of the rows.

An equi-join puts all pairs of a block into one task. Here a block with more rows than a tile holds is cut into tiles by a hash
of the row's id, and its tiles meet two by two: the join's key is the block and the two tiles, so no task's key makes more
pairs than two tiles have. A row is sent once for each tile of its block, that is n / tile times, while pairs grow with n * n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a tile at most. Tiles are half full on average, so that uneven hashes don't reach it.
TILE = 2048
#: Cut blocks that are broadcast at most: their keys and a number each; more are joined by a shuffle.
BROADCAST_BLOCKS = 10_000
#: Pairs that a task looks at on average, as far as MOST_TASKS allow.
PAIRS, MOST_TASKS = 4_000_000, 8_000


def _small_enough(df: DataFrame, limit: int = BROADCAST_BLOCKS) -> tuple[DataFrame, int]:
    n = df.limit(limit + 1).count()
    return (F.broadcast(df) if n <= limit else df), n


def block_counts(df: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """The block's key and n; rows with a null in the key are in no block."""
    return df.na.drop(subset=list(on)).groupBy(*on).agg(F.count("*").alias("n"))


def _numbered(df: DataFrame, cut: DataFrame, on: tuple[str, ...], tiles: str, key: str, out: str) -> DataFrame:
    """df with `tiles` of its block (1 if that isn't cut) and its own tile `out`."""
    have = df.join(cut, list(on), "left").withColumn(tiles, F.coalesce(tiles, F.lit(1)))
    return have.withColumn(out, F.pmod(F.xxhash64(key), F.col(tiles)).cast("int"))


def _tiles_of(n: Column, tile: int) -> Column:
    return F.ceil(2 * n / tile).cast("int")


def _dealt(df: DataFrame, pairs: float, *keys: str) -> DataFrame:
    """df dealt by the key so that tasks make PAIRS pairs each on average: pairs, unlike bytes, are what a task's time hangs on."""
    return df.repartition(min(math.ceil(pairs / PAIRS), MOST_TASKS), *keys) if pairs > PAIRS else df


def self_pairs(df: DataFrame, on: tuple[str, ...], columns: tuple[str, ...], key: str = "record_id", tile: int = TILE, needs: tuple[str, ...] = (), told: dict[str, Column] | None = None, only: Column | None = None, first: Column | None = None) -> DataFrame:
    """All pairs of rows that agree on `on`, each once: `columns` with _l and _r, the smaller key on the left. df is read more
    than once, so it should be a written table. Equal and null keys make no pair.

    told: more columns of a pair, and only: which pairs are made, both from `columns` and `needs` of its sides (_l and _r) in a
    way that doesn't hang on which is which, so they are known before the sides are put in order. first: only pairs with one
    row or both of this kind.

    Rows don't meet rows: a row meets a tile as one array, and pairs come of unpacking it, at half the cost of a join of rows."""
    rows = df.na.drop(subset=list(on)).where(F.col(key).isNotNull())
    rows = rows.select(*dict.fromkeys((*columns, *needs, *on, key)), (F.lit(True) if first is None else F.coalesce(first, F.lit(False))).alias("_first"))
    counts = rows.groupBy(*on).agg(F.count("*").alias("n"), F.count_if("_first").alias("_firsts")).where("n > 1 and _firsts > 0")
    seen = counts.agg(F.coalesce(F.sum(F.col("_firsts") * F.col("n").cast("double")), F.lit(0.0)).alias("pairs"), F.count_if(F.col("n") > tile).alias("cut")).first()
    cut = counts.where(F.col("n") > tile).select(*on, _tiles_of(F.col("n"), tile).alias("_tiles"), _tiles_of(F.col("_firsts"), tile).alias("_lefts"))
    have = rows.withColumns({"_tiles": F.lit(1), "_lefts": F.lit(1), "_own": F.lit(0)})
    if seen.cut:
        have = _numbered(rows, F.broadcast(cut) if seen.cut <= BROADCAST_BLOCKS else cut, on, "_tiles", key, "_own").withColumn("_lefts", F.coalesce("_lefts", F.lit(1)))
    side = lambda s: F.struct(*(F.col(c).alias(f"{c}_{s}") for c in dict.fromkeys((key, *columns, *needs))), F.col("_first").alias(f"_first_{s}"))
    # first rows have tiles of their own, which meet all tiles; without a kind each two tiles meet once
    own, least, most = (F.col("_own"), F.col("_own"), F.col("_j")) if first is None else (F.pmod(F.xxhash64(key), F.col("_lefts")).cast("int"), F.lit(0), F.col("_lefts") - 1)
    left = have.where("_first").select(*on, own.alias("_i"), F.explode(F.sequence(least, F.col("_tiles") - 1)).alias("_j"), side("l").alias("_l")).select(*on, "_i", "_j", "_l.*")
    tiles = have.groupBy(*on, F.col("_own").alias("_j")).agg(F.max("_lefts").alias("_lefts"), F.collect_list(side("r")).alias("_rows"))
    right = tiles.select(*on, "_j", F.explode(F.sequence(F.lit(0), most)).alias("_i"), "_rows")
    keys = (*on, "_i", "_j")
    met = _dealt(left, seen.pairs, *keys).join(_dealt(right, seen.pairs, *keys).hint("merge"), list(keys)).select(*(c for c in left.columns), F.inline("_rows"))
    a, b = F.col(f"{key}_l"), F.col(f"{key}_r")
    # equal keys are in one tile
    once = F.col("_i") < F.col("_j") if first is None else ~F.col("_first_r") & (a != b)
    met = met.where((once | (a < b)) & (F.lit(True) if only is None else only))
    # of two different tiles either side may have the smaller key
    turned = lambda c, s: F.when(a > b, F.col(f"{c}_{'r' if s == 'l' else 'l'}")).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}")
    return met.select(*(turned(c, s) for s in "lr" for c in columns), *(c.alias(name) for name, c in (told or {}).items()))


def tiled_join(left: DataFrame, right: DataFrame, on: tuple[str, ...], left_key: str, right_key: str, tile: int = TILE) -> DataFrame:
    """The equi-join of left and right, with keys whose rows would make more than a tile times a tile of pairs cut on both
    sides. Both are read more than once. Names besides `on` must differ. Sides are often made by explode(), which Spark takes to
    be as small as what it reads, so none is broadcast: every task would hold it whole."""
    # one table of counts for both sides
    counts = lambda df, m, n: df.na.drop(subset=list(on)).select(*on, F.lit(m).cast("long").alias("_m"), F.lit(n).cast("long").alias("n"))
    both = counts(left, 1, 0).unionByName(counts(right, 0, 1)).groupBy(*on).agg(F.sum("_m").alias("_m"), F.sum("n").alias("n"))
    cut, n_cut = _small_enough(both.where(F.col("_m").cast("double") * F.col("n") > tile * tile).select(*on, _tiles_of(F.col("_m"), tile).alias("_a"), _tiles_of(F.col("n"), tile).alias("_b")))
    if not n_cut:
        return left.join(right.hint("merge"), list(on))
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    one = _numbered(left, cut, on, "_a", left_key, "_i").withColumn("_j", numbers("_b")).drop("_a", "_b")
    other = _numbered(right, cut, on, "_b", right_key, "_j").withColumn("_i", numbers("_a")).drop("_a", "_b")
    return one.join(other.hint("merge"), [*on, "_i", "_j"]).drop("_i", "_j")
