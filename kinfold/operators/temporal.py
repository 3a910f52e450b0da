"""Joins by time, of keys that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slice of time in which rows of one key are ordered together.
SLICE = 86_400
#: A tree over time: each step up takes so many times the span of the step below, and so many steps are used.
FAN, STEPS = 16, 9
#: The step of the smallest nodes of a long range at most: 256 seconds.
LEAF = 2


def _slice(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: tuple[str, ...], seconds: int = SLICE) -> DataFrame:
    """left's columns and `values` of right's latest row of the same key that isn't later; nulls if there is none. Of right rows
    with one time the largest `values` count. Rows with a null key or time find nothing, and aren't found.

    Rows are ordered within slices of a key's time. What a slice hands on is its last right row, so the order over a whole key
    is over one row a slice, whatever the key's rows are."""
    named = [f"_v{i}" for i in range(len(values))]
    own = [c for c in left.columns]
    found = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull()).select(F.col(key).alias("_key"), F.col(right_ts).alias("_ts"), F.struct(*(F.col(v).alias(n) for v, n in zip(values, named, strict=True))).alias("_value"))
    found = found.withColumn("_slice", _slice(F.col("_ts"), seconds))
    asking = left.select(F.struct(*own).alias("_row"), F.col(key).alias("_key"), F.col(left_ts).alias("_ts")).withColumn("_slice", _slice(F.col("_ts"), seconds))
    # within a slice: right rows of one time stand before left ones, the largest of them last
    both = asking.select("_key", "_slice", "_ts", F.lit(1).alias("_side"), F.lit(None).cast(found.schema["_value"].dataType).alias("_value"), "_row").unionByName(found.select("_key", "_slice", "_ts", F.lit(0).alias("_side"), "_value", F.lit(None).cast(asking.schema["_row"].dataType).alias("_row")))
    inner = Window.partitionBy("_key", "_slice").orderBy("_ts", "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(inner)).where("_side = 1")
    # what each slice hears from the slices before
    last = found.groupBy("_key", "_slice").agg(F.max(F.struct("_ts", "_value"))["_value"].alias("_last"))
    slices = last.unionByName(asking.where(F.col("_key").isNotNull()).select("_key", "_slice").distinct().withColumn("_last", F.lit(None).cast(found.schema["_value"].dataType)))
    slices = slices.groupBy("_key", "_slice").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    heard = slices.select("_key", "_slice", F.last("_last", ignorenulls=True).over(before).alias("_heard")).where("_heard is not null")
    out = seen.join(heard, ["_key", "_slice"], "left").withColumn("_value", F.when(F.col("_ts").isNotNull() & F.col("_key").isNotNull(), F.coalesce("_seen", "_heard")))
    return out.select(*(F.col("_row")[c].alias(c) for c in own), *(F.col("_value")[n].alias(v) for n, v in zip(named, values, strict=True)))


def _up(x: Column, step: int) -> Column:
    return F.ceil(x / F.lit(FAN**step)) if step else x


def _down(x: Column, step: int) -> Column:
    return F.floor(x / F.lit(FAN**step)) if step else x


def nodes_of_range(start: Column, end: Column) -> Column:
    """The nodes (step, place) of the tree that make up [start, end) exactly, each second in one of them; whole numbers."""
    parts = []
    for step in range(STEPS):
        low, high = _up(start, step).cast("long"), _down(end, step).cast("long")
        above, under = (_up(start, step + 1) * FAN).cast("long"), (_down(end, step + 1) * FAN).cast("long")
        last = step == STEPS - 1
        run = lambda a, b, step=step: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda p: F.struct(F.lit(step).alias("step"), p.alias("place")))).otherwise(F.array().cast("array<struct<step:int,place:bigint>>"))
        whole = F.lit(last) | (above > under)
        parts += [F.when(whole, run(low, high)).otherwise(run(low, above)), F.when(whole, run(high, high)).otherwise(run(under, high))]
    return F.flatten(F.array(*parts))


def _seconds(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("long")


def laid(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """ranges by their nodes (step, place). Nodes at either end are of the leaf step, a 16th of the range or less and 256 seconds at
    most, and taken whole: what lies in them is still to be checked."""
    low, high = _seconds(F.col(start)), _seconds(F.col(end))
    length = high - low
    leaf = F.lit(0)
    for step in range(1, LEAF + 1):
        leaf = F.when(length >= FAN ** (step + 1), F.lit(step)).otherwise(leaf)
    unit = F.pow(F.lit(float(FAN)), leaf)
    place = lambda x: F.floor(x / unit).cast("long")
    nodes = F.transform(nodes_of_range(place(low), place(high) + 1), lambda x: F.struct((x["step"] + leaf).cast("int").alias("step"), x["place"].alias("place")))
    return ranges.select("*", F.inline(nodes))


def interval_join(points: DataFrame, ranges: DataFrame, key: str, ts: str, start: str, end: str) -> DataFrame:
    """Each point with each range of its key that holds it: start <= ts < end, to the microsecond. Columns besides the key must
    differ. Null keys and times, and ranges without length, meet nothing. ranges are read twice.

    A range is cut into the nodes of a tree over time (a few for each step, however long it is), and a point asks for the one
    node of each step that ranges have: equality of key and node, no comparison of all points with all ranges of a key."""
    held = ranges.where((F.col(start) < F.col(end)) & F.col(key).isNotNull())
    length = _seconds(F.col(end)) - _seconds(F.col(start))
    row = held.agg(F.coalesce(F.min(length), F.lit(0)).alias("least"), F.coalesce(F.max(length), F.lit(0)).alias("most")).first()
    first = max(k for k in range(LEAF + 1) if not k or row.least >= FAN ** (k + 1))
    # with the parts of leaves that stand out at either end
    steps = [k for k in range(first, STEPS + LEAF) if k <= LEAF or FAN**k <= row.most + 2 * FAN**LEAF]
    held = laid(held, start, end)
    asked = points.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("step", F.explode(F.array(*(F.lit(x) for x in steps))))
    asked = asked.withColumn("place", F.floor(_seconds(F.col(ts)) / F.pow(F.lit(float(FAN)), F.col("step"))).cast("long"))
    return asked.join(held, [key, "step", "place"]).where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("step", "place")
