"""What each order of a set of filters removes, from signed parity sums of the failures.

A document fails some of n filters: a mask of n bits. Instead of its mask each document adds a sign to 2 ** n sums, one for
each subset s of the filters: + if it fails an even number of s, - if odd (a Walsh-Hadamard transform, taken while
aggregating). Those sums, for each part and label, are all that leaves the documents, and the same transform divided by
2 ** n turns them back, exactly, into the number of documents with each mask. From those counts every order of the filters
is evaluated without the documents: what a step keeps, removes, finds removed already, and the labels it costs. A filter's
removals summed over all n! orders need no orders: a document with f failures is first removed by each of them in n! / f.

Copies: a text is a copy if a smaller id of the whole table has the same one. Texts are known by SHA-256. Rows are counted by
(id, text) before they meet labels, and by (text, part, label) before the texts' smallest ids are found, so that a hot id or
text arrives as a few rows.

Cases: a null text is empty, a null part is ''. An empty text has no words, so it is short and nothing else. A row with a
null id is no copy and makes none; it has no label. Repeated rows count each, and are no copies of each other. Of repeated
labels the highest counts. An empty table gives an empty result. Other columns of the table may be of any name or type.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters that an audit takes at most: the sums double with each, and the orders multiply.
MOST = 6


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text: A short, B repetitive, C upper case, D marks of code or tables."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def _sign(mask: Column, subset: int) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(F.lit(subset))) % 2)


def failures(docs: DataFrame, filters: Mapping[str, Column], copies: str | None = "E", text: str = "text", key: str = "doc_id", part: str = "lang", labels: DataFrame | None = None, marks: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """part, mask, one boolean for each label of `marks`, n: documents by what they fail. Bit i is the i-th filter, `copies`
    is the last one."""
    held = F.coalesce(F.col(text), F.lit(""))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = docs.select(F.col(key).alias("id"), F.unhex(F.sha2(held, 256)).alias("digest"), F.coalesce(F.col(part), F.lit("")).alias("part"), bits.alias("mask"))
    rows = rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    if labels is None:
        rows = rows.withColumns({m: F.lit(False) for m in marks})
    else:
        told = labels.groupBy(F.col(key).alias("id")).agg(*(F.max(F.coalesce(F.col(m) == 1, F.lit(False))).alias(m) for m in marks))
        rows = rows.join(told, "id", "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in marks})
    if copies is None:
        return rows.groupBy("part", "mask", *marks).agg(F.sum("n").alias("n"))
    known = F.col("id").isNotNull()
    alike = rows.groupBy("digest", "part", "mask", *marks).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unknown"), F.min(F.when(known, F.struct("id", "n"))).alias("first"))
    # a text has a row for each part and label here, whatever its copies
    least = F.min("first.id").over(Window.partitionBy("digest"))
    alike = alike.withColumn("own", F.col("unknown") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    return alike.select("part", *marks, F.inline(both)).where("n > 0").select("part", "mask", *marks, "n")


def parity_sums(failed: DataFrame, n_filters: int, marks: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """part, labels and the array `sums`: element s is the sum of the signs for the subset s."""
    signed = failed.groupBy("part", *marks).agg(*(F.sum(_sign(F.col("mask"), s) * F.col("n")).alias(f"s{s}") for s in range(1 << n_filters)))
    return signed.select("part", *marks, F.array(*(f"s{s}" for s in range(1 << n_filters))).alias("sums"))


def cells(sums: DataFrame, n_filters: int) -> DataFrame:
    """sums turned back: element m of the array `cells` is the number of documents with the mask m."""
    size = 1 << n_filters
    back = lambda m: F.expr(f"aggregate(transform(sums, (x, s) -> x * (1 - 2 * (bit_count({m} & s) % 2))), 0L, (a, x) -> a + x) div {size}")
    return sums.withColumn("cells", F.array(*(back(m) for m in range(size)))).drop("sums")


def orders(counted: DataFrame, names: tuple[str, ...], good: str = "quality", bad: str = "toxic") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order and step."""
    size = 1 << len(names)
    total = lambda where: F.array(*(F.sum(F.when(where, F.col("cells")[m]).otherwise(0)) for m in range(size)))
    parts = counted.groupBy("part").agg(total(F.lit(True)).alias("every"), total(F.col(good)).alias("good"), total(F.col(bad)).alias("bad"))
    all_orders = F.array(*(F.lit("\n".join(p)) for p in permutations(names)))
    rows = parts.select("*", F.explode(all_orders).alias("o")).select("part", "every", "good", "bad", F.split("o", "\n").alias("o"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    bits, at = F.array(*(F.lit(1 << i) for i in range(len(names)))), F.array(*map(F.lit, names))
    bit = lambda x: F.element_at(bits, F.array_position(at, x).cast("int"))
    rows = rows.withColumn("bit", bit(F.element_at("o", F.col("step")))).withColumn("before", F.aggregate(F.slice("o", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + bit(x)))
    pick = lambda cells, which: F.expr(f"aggregate(filter(transform({cells}, (x, m) -> IF({which}, x, 0L)), x -> x > 0), 0L, (a, x) -> a + x)")
    removed = "m & bit > 0 AND m & before = 0"
    n = factorial(len(names))
    share = f"aggregate(transform(every, (x, m) -> IF(m & bit > 0, x * ({n} div greatest(bit_count(m), 1)), 0L)), 0L, (a, x) -> a + x)"
    return rows.select(
        "part", F.array_join("o", "").alias("filter_order"), "step", pick("every", "m & (before | bit) = 0").alias("kept"), pick("every", removed).alias("removed"),
        pick("every", "m & bit > 0 AND m & before > 0").alias("redundant"), pick("every", "m = bit").alias("unique_fails"), pick("good", removed).alias("good_lost"), pick("bad", removed).alias("toxic_lost"), F.expr(share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, copies: str | None = "E", text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """All orders of the filters over docs; filters: name and failure condition, those of texts unless given."""
    filters = text_filters(F.coalesce(F.col(text), F.lit(""))) if filters is None else filters
    names = (*filters, *([copies] if copies else []))
    if not 1 <= len(names) <= MOST or len(set(names)) < len(names):
        raise ValueError(f"1 to {MOST} filters of different names are expected")
    failed = failures(docs, filters, copies, text, key, part, labels)
    return orders(cells(parity_sums(failed, len(names)), len(names)), names)
