"""Names within an edit distance of 2, found by equality of parts instead of by comparing all pairs.

A name is cut into three parts. Two edits leave one of them as it was, and move it by a place or two. So of two names the
shorter one offers its three parts, with their places, as keys, and the longer one asks for what it has at those places and
beside them: 24 keys at most, however many names there are. What meets is compared by Levenshtein distance. Names are taken
once each with their number of records, so copies cost nothing.

What meets are numbers of names at hashes of keys: three numbers a row, however long keys and names are. Two edits change the
parity of four letters at most, which is seen from the rows; the few pairs left get their names by their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators import blocking
from kinfold.scratch import Scratch

#: Fixed: the distance for which the parts and shifts below hold.
DISTANCE = 2
PARTS = DISTANCE + 1
#: By how many letters one name is longer: the places by which an untouched part can have moved.
SHIFTS = {0: (-1, 0, 1), 1: (0, 1), 2: (0, 1, 2)}
#: Bits of the parities that an edit changes at most: another letter instead of one.
EDIT_BITS = 2
#: The same of couples of letters: another letter is in two couples, instead of two others.
COUPLE_BITS = 4


def _key(name: Column, length: Column, part: int, start: Column, size: Column) -> Column:
    return F.struct(length.alias("length"), F.lit(part).alias("part"), name.substr(start + 1, size).alias("piece"))


def _cut(length: Column, part: int) -> tuple[Column, Column]:
    begin = lambda k: F.floor(length * k / PARTS).cast("int")
    return begin(part), begin(part + 1) - begin(part)


def offered(name: Column) -> Column:
    """The keys of a name as the shorter one."""
    n = F.length(name)
    return F.array(*(_key(name, n, k, *_cut(n, k)) for k in range(PARTS)))


def asked(name: Column, least: int) -> Column:
    """The keys that a name asks for as the longer one, or one of equal length."""
    keys = []
    for more, shifts in SHIFTS.items():
        length = F.length(name) - more
        for k in range(PARTS):
            begin, size = _cut(length, k)
            keys += [F.when((length >= least) & (begin + s >= 0) & (begin + s + size <= F.length(name)), _key(name, length, k, begin + s, size)) for s in shifts]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def letter_bits(name: Column) -> Column:
    """How often each letter occurs, as parities of 64 hashes of letters."""
    letter = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(x).bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(F.split(name, ""), F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(letter(x)))


def couple_bits(name: Column) -> Column:
    """How often each letter with the next one occurs (the last with none), as parities of 64 hashes."""
    couple = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(name.substr(i, F.lit(2))).bitwiseAND(F.lit(63)).cast("int"))
    return F.when(F.length(name) > 0, F.aggregate(F.sequence(F.lit(1), F.length(name)), F.lit(0).cast("long"), lambda bits, i: bits.bitwiseXOR(couple(i))))


def candidates(names: DataFrame, within: tuple[str, ...], name: str = "name_norm", least: int = 6, tile: int = blocking.TILE) -> DataFrame:
    """within, name_l, name_r, n_l, n_r: what meets at a key, not yet compared. names: within, name and n, each name once."""
    scratch = Scratch(names.sparkSession)
    rows = names.na.drop(subset=list(within)).where(F.length(name) >= max(least, PARTS)).select(*within, F.col(name).alias("name"), "n")
    rows = scratch.keep(rows.withColumn("i", F.monotonically_increasing_id()).withColumn("bits", letter_bits(F.col("name"))))
    side = lambda keys, s: rows.select(F.explode(F.transform(keys, lambda k: F.xxhash64(*within, k))).alias("key"), F.col("i").alias(f"i_{s}"), F.col("bits").alias(f"bits_{s}"))
    index, probe = side(offered(F.col("name")), "l"), side(asked(F.col("name"), max(least, PARTS)), "r")
    # a name is at a key once on either side, so a few names can't crowd one
    met = index.join(probe, "key") if rows.count() <= tile else blocking.tiled_join(index, probe, ("key",), "i_l", "i_r", tile)
    met = met.where((F.col("i_l") != F.col("i_r")) & (F.bit_count(F.col("bits_l").bitwiseXOR(F.col("bits_r"))) <= EDIT_BITS * DISTANCE)).select("i_l", "i_r").distinct()
    # `within` once more: two keys may have one hash
    named = lambda s: rows.select(*within, *(F.col(c).alias(f"{c}_{s}") for c in ("i", "name", "n")))
    return met.join(named("l"), "i_l").join(named("r"), ["i_r", *within]).select(*within, "name_l", "name_r", "n_l", "n_r")


def near_names(names: DataFrame, within: tuple[str, ...], name: str = "name_norm", least: int = 6, tile: int = blocking.TILE) -> DataFrame:
    """within, name_l, name_r (name_l < name_r), n_l, n_r, distance (1 or 2): each pair of different names of `least` letters or
    more once. Null names and names with a null in `within` take no part."""
    a, b = F.col("name_l"), F.col("name_r")
    compared = candidates(names, within, name, least, tile).withColumn("distance", F.levenshtein(a, b, DISTANCE)).where(F.col("distance") >= 0)
    ordered = compared.select(*within, F.least(a, b).alias("name_l"), F.greatest(a, b).alias("name_r"), F.when(a < b, F.col("n_l")).otherwise(F.col("n_r")).alias("n_l"), F.when(a < b, F.col("n_r")).otherwise(F.col("n_l")).alias("n_r"), "distance")
    return ordered.distinct()
