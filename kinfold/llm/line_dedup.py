r"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line's set holds the hashes of its distinct words (between spaces). Words are ordered by rarity, from the corpus counts
of buckets of word hashes (as many as the corpus may have words), ties by hash: one order for all lines. Lines of equal
sets are one class, which stands at its first place (id, text, line number); classes are numbered in the order of
these places, so of a pair the larger number is the later one, and no pair is joined with places to find that out.

Classes meet at the words of their prefixes (n - ceil(t n) + 1 words of n), and a pair goes on if its lengths, its positions
in the order and the parities of its hashes in 64 bits allow the overlap that is needed. Two similar sets share l words
among their first n - ceil(t n) + l, so where more than DIRECT classes meet at a word they meet at pairs of words instead,
with the next word that both have (LEVELS words at most). Where that is still too many, mostly at copies of one line, each
class is tested against the first one of like length, and those still unsettled against all earlier ones. What meets is
made from the classes each time: of the rows only those of one meeting are on disk, in its shuffle, and no others.

The pairs left are compared exactly. A line is removed if a line at an earlier place has Jaccard >= num / den with it,
whether or not that one is removed itself. Sets so small that no other set is similar (of one to three words at 4 / 5)
make no pairs: their classes settle them.

Cases: null texts stay null, empty ones empty. Lines without words stay; with min_words more than 1 so do all of fewer
distinct words, compared with nothing. A carriage return at the end of a line is no part of its words. Null ids come
first. Of rows with one id and different texts, each has its own lines. Repeated rows (equal ids and texts) have lines at
equal places, of which none is earlier, so they stay alike. A very long line is a set as any other. An empty table gives
an empty result. All other columns stay as they are, whatever their names but for those in OUT, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Buckets of words that are counted, for SKETCH_BYTES of text and at most (a byte each in every executor): the words of a
#: corpus grow with some 0.6th power of it. And the classes of rarity for each doubling of a count (127 at most, in a byte).
SKETCH, SKETCH_BYTES, SKETCH_MOST, SKETCH_POWER, STEPS = 1 << 22, 1 << 29, 1 << 25, 0.7, 3
RARITY_SHIFT = 56
#: Classes that meet at a key at most, else the key gets one more word, up to LEVELS.
DIRECT, LEVELS = 256, 2
MIN_WORDS = 1
#: Documents whose numbers are broadcast at most, removed lines and crowded keys; beyond that they are joined by a shuffle.
BROADCAST_DOCS, BROADCAST_LINES, BROADCAST_KEYS = 500_000, 1_000_000, 1_000_000
OUT = ("n_lines", "n_removed", "removed_share")


def _lines(df: DataFrame) -> DataFrame:
    return df.select("id", "doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _words(line: Column) -> Column:
    """With empty ones, where blanks follow each other."""
    return F.split(F.rtrim(line, F.lit("\r")), " ")


def _hashes(line: Column) -> Column:
    return F.transform(_words(line), lambda w: F.xxhash64(w))


def _set(line: Column) -> Column:
    return F.array_remove(F.array_distinct(_hashes(line)), F.xxhash64(F.lit("")))


def _rarity(count: Column) -> Column:
    return F.least(F.lit(127), F.floor(F.log2(count + 1) * STEPS))


def _beyond(count: int) -> int:
    """The least place in the order of words whose bucket's class is above that of this count."""
    return (math.floor(math.log2(count + 1) * STEPS) + 1) << RARITY_SHIFT


def _buckets(size: int) -> int:
    """How many for so many bytes of text: a power of 2. Too few, and every word shares one with frequent words."""
    more = math.ceil(SKETCH_POWER * math.log2(max(1.0, size / SKETCH_BYTES)))
    return min(SKETCH_MOST, SKETCH << more)


def _sketch(df: DataFrame, buckets: int) -> DataFrame:
    """One row: the class of rarity of each bucket of words, a byte each.

    A bucket's count is that of its words or more, so _beyond() tells for sure that a word is in few lines."""
    words = df.select(F.explode(F.split("text", "\n")).alias("line")).select(F.explode(_words(F.col("line"))).alias("w"))
    every = df.sparkSession.range(buckets).select(F.col("id").alias("b"), F.lit(0).alias("n"))
    counts = words.select(F.xxhash64("w").bitwiseAND(F.lit(buckets - 1)).alias("b"), F.lit(1).alias("n")).union(every)
    counts = counts.groupBy("b").agg(_rarity(F.sum("n")).cast("tinyint").alias("r"))
    joined = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["r"])
    blocks = counts.groupBy(F.shiftright("b", 12).alias("b_")).agg(joined(F.struct("b", "r")).alias("r"))
    return blocks.agg(F.flatten(joined(F.struct("b_", "r"))).alias("rarity"))


def _prefix(n: Column, num: int, den: int) -> Column:
    return (n - F.floor((n.cast("long") * num + (den - 1)) / den) + 1).cast("int")


def _sized(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast if it has up to `limit` rows."""
    return F.broadcast(df) if df.count() <= limit else df


class _Pairs:
    """What two rows (key, c, nr, bits) of classes must fulfil; nr holds the length and the position in the order."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def like(self, a: str, b: str) -> Column:
        num, den = self.num, self.den
        n, m = (F.shiftright(f"{x}.nr", 32) for x in (a, b))
        left, right = (F.shiftright(f"{x}.nr", 32) - F.col(f"{x}.nr").bitwiseAND(F.lit(0xFFFFFFFF)) for x in (a, b))
        # each word in one set only flips a bit at most, so the overlap is at most (n + m - bits that differ) / 2; the
        # cheapest and sharpest test, so it comes first
        bits = (num + den) * F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits"))) <= (den - num) * (n + m)
        length = (den * n >= num * m) & (den * m >= num * n)
        # at the first word that two lines share all of the overlap is still to come; pairs are met there or nowhere
        position = (num + den) * F.least(left, right) >= num * (n + m)
        return bits & length & position

    def all_of(self, rows: DataFrame) -> DataFrame:
        """c, c_ (the earlier one) and differ of all pairs within a key."""
        rows = rows.select("key", "c", "nr", "bits")
        both = rows.alias("a").join(rows.alias("b"), "key").where((F.col("a.c") > F.col("b.c")) & self.like("a", "b"))
        return self.pair(both)

    @staticmethod
    def pair(both: DataFrame) -> DataFrame:
        return both.select(F.col("a.c").alias("c"), F.col("b.c").alias("c_"), F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))).alias("differ"))


def _longer(rows: DataFrame, level: int) -> DataFrame:
    """Keys of one more word: each that may be the next one shared. A tail begins after a key's last word."""
    reach = F.greatest(F.lit(0), F.size("tail") - (LEVELS - level))  # the words that count on this level
    rows = rows.select("key", "c", "nr", "bits", "tail", F.posexplode(F.slice("tail", F.lit(1), reach)).alias("at", "w"))
    return rows.select(F.xxhash64("key", "w").alias("key"), "c", "nr", "bits", F.slice("tail", F.col("at") + 2, F.size("tail")).alias("tail"))


def removed_lines(df: DataFrame, num: int = 4, den: int = 5, min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """Of a table of id, doc (a hash of the text) and text: id, doc, pos (from 0) of the lines that are removed."""
    scratch, spark = scratch or Scratch(df.sparkSession), df.sparkSession
    met = _Pairs(num, den)
    buckets = _buckets(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    sketch = scratch.keep(_sketch(df, buckets))
    # the optimiser puts the subquery's value, one array held by each executor, where `rarity` is used
    ordered = F.expr(f"transform(s, h -> shiftleft(cast(rarity[cast(h & {buckets - 1}L as int)] as bigint), {RARITY_SHIFT}) | shiftrightunsigned(h, {64 - RARITY_SHIFT}))")
    sets = _lines(df).select("id", "doc", "pos", F.explode(F.array(_set(F.col("line")))).alias("s")).withColumn("n", F.size("s"))
    # explode() of the one array keeps what follows from computing it twice
    sets = sets.where(F.col("n") >= max(1, min_words)).withColumn("rarity", sketch.scalar()).select("id", "doc", "pos", "n", F.sort_array(ordered).alias("all"))
    sets = sets.select("id", "doc", "pos", "n", F.explode(F.array("all")).alias("s"))
    parity = F.expr("aggregate(s, 0L, (a, h) -> a ^ shiftleft(1L, cast(h & 63L as int)))")
    wide = scratch.keep(sets.select("id", "doc", "pos", "n", F.xxhash64("s").alias("h"), F.slice("s", F.lit(1), _prefix(F.col("n"), num, den) + (LEVELS - 1)).alias("prefix"), parity.alias("bits")), hashes=True)
    scratch.drop(sketch)
    scratch.free()
    # a class's number takes less room than its hash, and grows with its first place
    classes = wide.groupBy("h").agg(F.min(F.struct("id", "doc", "pos")).alias("first"), F.count("*").alias("many")).orderBy("first")
    classes = scratch.keep(classes.withColumn("c", F.monotonically_increasing_id()), hashes=True)
    scratch.free()
    # the rest all lines of a class have alike
    reps = wide.groupBy("h").agg(*(F.first(x).alias(x) for x in ("n", "prefix", "bits")))
    reps = scratch.keep(reps.join(classes.select("h", "c"), "h").drop("h"), hashes=True)
    lines = scratch.keep(wide.select("id", "doc", "pos", "h"))
    scratch.drop(wide)
    scratch.free()

    # a set of n words can be similar to another one only if it is to one of n + 1 words that holds it
    paired = reps.where(F.col("n").cast("long") * den >= (F.col("n") + 1).cast("long") * num)
    in_prefix = _prefix(F.col("n"), num, den)

    def beyond(count: int) -> DataFrame:
        """Rows of the words that are in more lines than that by the sketch."""
        meet = paired.select("c", "n", "bits", "prefix", F.posexplode("prefix").alias("r", "key")).where((F.col("r") < in_prefix) & (F.col("key") >= _beyond(count)))
        nr = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("r").cast("long")).alias("nr")
        return meet.select("key", "c", nr, "bits", F.slice("prefix", F.col("r") + 2, F.size("prefix")).alias("tail"))

    # a word that the corpus has once brings no lines together, and only those beyond DIRECT can be in more lines than that
    rows, counted, pairs = beyond(1), beyond(DIRECT), []
    for level in range(1, LEVELS + 1):
        crowded = scratch.keep(counted.groupBy("key").agg(F.count("*").alias("f")).where(F.col("f") > DIRECT).select("key"), hashes=True)
        scratch.free()
        keys = _sized(crowded, BROADCAST_KEYS)
        # before the next meeting: this one's shuffle is free then
        pairs.append(scratch.keep(met.all_of(rows.join(keys, "key", "left_anti")).distinct()))
        scratch.free()
        rows = counted.join(keys, "key", "left_semi")
        if level < LEVELS and not crowded.isEmpty():
            rows = counted = _longer(rows, level + 1)
        else:
            break
    band = F.floor(F.log(F.shiftright("nr", 32).cast("double")) / F.lit(math.log(den / num))).alias("band")
    hot = scratch.keep(rows.select("key", "c", "nr", "bits", band))
    hubs = hot.groupBy("key", "band").agg(F.min(F.struct("c", "nr", "bits")).alias("hub")).select("key", "band", "hub.*")
    earlier = (F.col("a.c") > F.col("b.c")) & met.like("a", "b")
    star = met.pair(hot.alias("a").join(hubs.alias("b"), ["key", "band"]).where(earlier))
    # of a class's hubs the likeliest
    star = star.groupBy("c").agg(F.min(F.struct("differ", "c_")).alias("x")).select("c", "x.c_", "x.differ")
    found = star
    for more in pairs:
        found = found.union(more)
    tested = scratch.keep(found.distinct())
    # the prefixes aren't needed any more
    scratch.drop(reps, *pairs)
    del pairs, found, star
    scratch.free()
    sets = _Sets(df, classes, num, den, scratch)
    settled = sets.later(tested)
    left = met.pair(hot.join(settled, "c", "left_anti").alias("a").join(hot.alias("b"), "key").where(earlier)).distinct()
    left = scratch.keep(left.join(tested, ["c", "c_"], "left_anti"))
    if not left.isEmpty():
        settled = scratch.keep(settled.union(sets.later(left)).distinct())
    # classes of one line that nothing earlier is like don't matter
    marked = classes.join(settled.withColumn("all_of", F.lit(True)), "c", "left").where("all_of or many > 1").drop("many")
    out = lines.join(marked, "h").where(F.coalesce("all_of", F.lit(False)) | (F.struct("id", "doc", "pos") > F.col("first"))).select("id", "doc", "pos")
    out = scratch.keep(out.distinct())
    scratch.drop(lines, classes, hot, crowded, tested, settled, left)
    scratch.free()
    return out


class _Sets:
    """The exact comparison of pairs of classes; words come from the texts again."""

    def __init__(self, df: DataFrame, classes: DataFrame, num: int, den: int, scratch: Scratch):
        self.df, self.num, self.den, self.scratch = df, num, den, scratch
        self.classes = classes.select("c", "first")

    def later(self, pairs: DataFrame) -> DataFrame:
        """c of those that are similar to c_ in a pair (c, c_, differ) of theirs."""
        wanted = self.scratch.keep(pairs.select(F.explode(F.array("c", "c_")).alias("c")).distinct().join(self.classes, "c"))
        sets = self.scratch.keep(self._sets(wanted), hashes=True)
        if sets.count() > wanted.count():  # rows are repeated; without such ones no set is shuffled for this
            sets, more = self.scratch.keep(sets.groupBy("c").agg(F.first("s").alias("s")), hashes=True), sets
            self.scratch.drop(more)
        self.scratch.free()
        # one similar earlier class is enough: first the likeliest of each, then all the others of those still unsettled
        likeliest = pairs.groupBy("c").agg(F.min(F.struct("differ", "c_")).alias("x")).select("c", "x.c_")
        settled = self.scratch.keep(self._similar(sets, likeliest))
        self.scratch.free()
        others = pairs.join(settled, "c", "left_anti").select("c", "c_").join(likeliest, ["c", "c_"], "left_anti")
        others = self.scratch.keep(others)
        needed = others.select(F.explode(F.array("c", "c_")).alias("c")).distinct()
        out = self.scratch.keep(settled.union(self._similar(sets.join(needed, "c", "left_semi"), others)))
        self.scratch.drop(wanted, sets, settled, others)
        self.scratch.free()
        return out

    def _sets(self, wanted: DataFrame) -> DataFrame:
        docs = self.scratch.keep(wanted.groupBy("first.id", "first.doc").agg(F.collect_list(F.struct("first.pos", "c")).alias("at")))
        texts = self.df.alias("t").join(_sized(docs, BROADCAST_DOCS).alias("d"), F.col("t.id").eqNullSafe(F.col("d.id")) & (F.col("t.doc") == F.col("d.doc")))
        lines = texts.select("at", F.split("text", "\n").alias("lines")).select("lines", F.explode("at").alias("x"))
        return lines.select("x.c", _set(F.get("lines", F.col("x.pos"))).alias("s"))

    def _similar(self, sets: DataFrame, pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets, "c").join(sets.select(F.col("c").alias("c_"), F.col("s").alias("s_")), "c_")
        return both.where((self.num + self.den) * F.size(F.array_intersect("s", "s_")).cast("long") >= self.num * (F.size("s") + F.size("s_")).cast("long")).select("c").distinct()


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None, **options) -> DataFrame:
    """df with the removed lines cut out of the text, and n_lines, n_removed, removed_share (of the text's characters)."""
    scratch = scratch or Scratch(df.sparkSession)
    names = [c for c in df.columns if c not in OUT]
    # the row as one column, so no name can clash
    rows = df.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("row"), F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("doc"), F.col(f"`{text}`").alias("text"))
    lost = removed_lines(rows.select("id", "doc", "text"), scratch=scratch, **options)
    gone = lost.groupBy("id", "doc").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = F.broadcast(gone) if lost.count() <= BROADCAST_LINES else gone
    joined = rows.alias("r").join(gone.alias("g"), F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.doc") == F.col("g.doc")), "left").select("row", "text", "gone")
    lines = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    joined = joined.withColumn("kept", kept)
    share = F.when(F.col("gone").isNull(), F.lit(0.0)).otherwise(1 - F.length("kept") / F.greatest(F.length("text"), F.lit(1)))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    counts = (n_lines.cast("long"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"), share)
    return joined.select(*((F.col("kept") if c == text else F.col("row")[f"c{i}"]).alias(c) for i, c in enumerate(names)), *(x.alias(c) for x, c in zip(counts, OUT, strict=True)))
