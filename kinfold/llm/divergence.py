"""How the sources of each language differ in their use of terms, on term vectors with one element for each source.

Terms are counted by language and source, and those in enough documents of a language are kept: each becomes one row with an
array of its counts by the language's sources. Everything else is worked out within such a row: smoothed shares in parts of
10 ** 9, the differences of all pairs of sources, and the excess over the language as a whole. Only the pairs' sums, added up
in each task before they are sent, and the best terms of each source leave it.

Shares are whole numbers: 1 + floor(10 ** 9 * (count + 5) / (N + 5 * V)), with N the counts of all kept terms there and V the
number of kept terms. The division is done in two steps that stay within 64 bits for counts up to 2 * 10 ** 14.

Cases: null texts, languages and sources are ''. A source without kept terms has N = 0 and takes part; a language with one
source has no pairs, one without kept terms has pairs of 0. Repeated rows count each, ids aren't read. Equal values are
ranked by item. An empty table gives an empty result. Very long texts are one array of words at a time. Other columns of the
table may be of any name or type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: A term is kept with so many documents of its language; so many terms of a source are reported.
LEAST_DOCS, TOP = 30, 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 10 ** 9 = A * B, for a division in two steps.
A, B = 31_250, 32_000
#: Keys over which a language's arrays are laid for the join with its terms.
SALTS = 64


def terms(text: Column) -> Column:
    """Runs of ASCII letters and of all that isn't ASCII; only A to Z are lower-cased."""
    # lower() changes nothing but A to Z in an ASCII text, and is faster there
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"), "")


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), n_docs. One pass: each text gives all its words, then its distinct ones. A row with
    a null term stands for each group that occurs, with words or without."""
    none = F.lit(None).cast("string")
    held = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    words = held.select("lang", "source", terms(F.col("text")).alias("w"))
    each = words.select("lang", "source", F.size("w").alias("size"), F.posexplode(F.concat("w", F.array_distinct("w"), F.array(none))).alias("at", "term"))
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("at") < F.col("size")).alias("n"), F.count_if((F.col("at") >= F.col("size")) & F.col("term").isNotNull()).alias("n_docs"))


def kept_terms(counted: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, uses: the sources with their counts, of terms in `least_docs` documents of the language or more."""
    by_term = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.collect_list(F.struct("source", "n")).alias("uses"))
    return by_term.where(F.col("n_docs") >= least_docs).select("lang", "term", "uses")


def languages(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, v (kept terms), total and the array `sources` (source, n) in the order of names: as many elements as groups."""
    sums = kept.select("lang", F.inline("uses")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("sources"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    return by_lang.join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.expr("aggregate(sources, 0L, (a, x) -> a + x.n)").alias("total"), "sources")


def share(count: str, n: str) -> str:
    """SQL of a smoothed share; v is the number of kept terms."""
    part, whole = f"({count} + 5)", f"({n} + 5 * v)"
    return f"(1 + {B} * ({part} * {A} div {whole}) + {part} * {A} % {whole} * {B} div {whole})"


def vectors(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, term, counts and shares by source (in the order of `sources`), whole (the language's share), sources."""
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    laid = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    wide = kept.withColumn("salt", salt).join(laid, ["lang", "salt"]).withColumn("uses", F.map_from_entries("uses"))
    wide = wide.withColumn("counts", F.expr("transform(sources, x -> coalesce(uses[x.source], 0L))"))
    whole = "aggregate(counts, 0L, (a, x) -> a + x)"
    return wide.select("lang", "term", "counts", F.expr(f"transform(sources, (x, i) -> {share('counts[i]', 'x.n')})").alias("shares"), F.expr(share(whole, "total")).alias("whole"), "sources.source")


def pair_sums(wide: DataFrame) -> DataFrame:
    """lang, i, j (places of two sources, i < j), value: differences of shares, summed over terms, first within each task."""
    emitted = F.expr("flatten(transform(shares, (p, i) -> transform(slice(shares, i + 2, size(shares)), (q, k) -> named_struct('i', i, 'j', i + k + 1, 'f', abs(p - q)))))")
    return wide.select("lang", F.inline(emitted)).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))


def pairs(sums: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value: each source with each other one of its language."""
    every = langs.select("lang", F.posexplode("sources.source").alias("i", "a"), F.col("sources.source").alias("others")).select("lang", "i", "a", F.posexplode("others").alias("j", "b")).where("i < j")
    valued = every.join(sums, ["lang", "i", "j"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return valued.select("lang", F.inline(both), "value")


def excesses(wide: DataFrame) -> DataFrame:
    """lang, source, item (a term that the source uses more than the language does), value."""
    found = F.expr("filter(transform(shares, (p, i) -> named_struct('source', source[i], 'used', counts[i] > 0, 'value', p - whole)), x -> x.used AND x.value > 0)")
    return wide.select("lang", F.col("term").alias("item"), F.inline(found)).drop("used")


def _ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank. Counts and vectors are written once and read from there."""
    scratch = scratch or Scratch(docs.sparkSession)
    counted = scratch.keep(counts(docs, text, lang, source))
    kept = scratch.keep(kept_terms(counted, least_docs))
    langs = scratch.keep(languages(counted.where("term is null").select("lang", "source"), kept))
    wide = vectors(kept, langs)
    best = _ranked(excesses(wide), "term").where(F.col("rank") <= top)
    return _ranked(pairs(pair_sums(wide), langs), "pair").unionByName(best)
