"""Benchmark decontamination by spaced-seed hashing.

A mask looks at some of the words of a window and ignores the others, so a window hashes alike when only ignored words
were replaced. Windows of the benchmark and of the texts are joined on mask and hash; around each hit, words are compared
one by one along the hit's diagonal. Of the stretches there in which at least 80 of 100 words are equal (sum 0 or more
with 1 for an equal word and -4 for another) the one with the most equal words counts. A text is contaminated by an item
if that has min_words equal words, or the share `part` of the item's words if that is less.

No stretch that meets this rule is without a hit: with m words replaced it has 4 m equal ones or more, and both MASKS
together hit every such stretch of SEEDED equal words or more (those of 16, 20, 25 and 30 words with 3, 4, 5 and 6
replaced are the hardest; longer ones contain one). Items that need fewer are looked for by the longest run of equal words
that all stretches of theirs have.

Words are runs of letters and digits; case of A-Z and marks don't count. The benchmark's windows are held in memory by
each task, as long as they are few: of a larger benchmark a block of items of bounded size at a time, each with a pass
over the texts.

Cases: null and empty texts and items match nothing, and so do items of fewer than LEAST words, which any text may hold.
Repeated rows each give their rows; of repeated items with one id too. A text that holds an item many times gives one row,
its best stretch, the first of equal ones. Empty tables give an empty result. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .text import ALNUM, U64, Words, chunks, mix, release

#: Fixed masks: the places of a window that are looked at.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 4))
#: Equal words from which on the masks hit every stretch.
SEEDED = 13
LEAST, MIN_WORDS, PART = 5, 13, 0.8
MATCH, MISS = 1, -4
#: Words of the benchmark that tasks hold at once; with windows some 100 bytes each.
BLOCK_WORDS = 1_000_000
#: Bytes that count as a word when blocks are sized, whatever stands between words.
WORD_BYTES = 6
BITS = 22
#: Words that are compared at once.
COMPARED = 1 << 20


def seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the window that begins at each word but the last ones."""
    n = len(hashes) - mask[-1]
    out = np.full(max(n, 0), U64(sum((o + 1) * 1000003**i for i, o in enumerate(mask)) % (1 << 64)))
    for i, offset in enumerate(mask):
        out += hashes[offset : offset + len(out)] * U64((0xD6E8FEB86659FD93 * (2 * i + 1)) % (1 << 64))
    return mix(out)


def needed(n: int, min_words: int, part: float) -> int:
    """Equal words that an overlap with an item of n words needs."""
    return max(1, min(min_words, math.ceil(part * n - 1e-9)))


def sure_run(n: int, need: int) -> int:
    """The run of equal words that every stretch has in which `need` of at most n words and 80 of 100 are equal."""
    equal = [(max(need, -MISS * m), m) for m in range(n) if max(need, -MISS * m) + m <= n]
    return min((-(-e // (m + 1)) for e, m in equal), default=n)


class Benchmark:
    """Items' words and the sorted hashes of their windows."""

    def __init__(self, ids: list, words: list[np.ndarray], min_words: int = MIN_WORDS, part: float = PART):
        self.ids, self.words = ids, words
        self.need = np.array([needed(len(w), min_words, part) for w in words], np.int64)
        self.flat = np.concatenate([*words, np.zeros(0, U64)])
        self.size = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        runs = {(n, e): sure_run(n, e) for n, e in set(zip(self.size.tolist(), self.need.tolist(), strict=True)) if n >= LEAST and e < SEEDED}
        run = [runs.get(x, 0) for x in zip(self.size.tolist(), self.need.tolist(), strict=True)]
        self.masks = [*MASKS, *(tuple(range(n)) for n in sorted(set(runs.values())))]
        found = []
        for k, mask in enumerate(self.masks):
            for i, w in enumerate(words):
                if len(w) >= LEAST and (run[i] == 0 if k < len(MASKS) else run[i] == len(mask)):
                    s = seeds(w, mask)
                    found.append(np.stack([s, np.full(len(s), i, U64), np.arange(len(s), dtype=U64)]))
        table = np.concatenate(found, axis=1) if found else np.zeros((3, 0), U64)
        table = table[:, np.argsort(table[0], kind="stable")]
        self.hash, self.item, self.place = table[0].copy(), table[1].astype(np.int64), table[2].astype(np.int64)
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[(self.hash >> U64(64 - BITS)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word of the text, item and word of the item where windows agree."""
        s = seeds(hashes, mask)
        at = np.flatnonzero(self.maybe[(s >> U64(64 - BITS)).astype(np.int64)])
        first, last = np.searchsorted(self.hash, s[at], "left"), np.searchsorted(self.hash, s[at], "right")
        n = last - first
        where = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[where], self.place[where]


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and equal words of the stretch with the most equal words of those whose sum is 0 or more, the first of
    equal ones; it begins and ends with an equal word."""
    total = np.concatenate([[0], np.cumsum(np.where(same, MATCH, MISS))])
    equal = np.concatenate([[0], np.cumsum(same)])
    # for each end the earliest start from which the sum isn't negative
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    end = int((equal - equal[start]).argmax())
    at = np.flatnonzero(same[start[end] : end]) + start[end]
    return (int(at[0]), int(at[-1]) + 1, len(at)) if len(at) else (0, 0, 0)


def overlaps(words: Words, bench: Benchmark) -> list[tuple[int, int, int, int, int]]:
    """Row, item, start, end (words of the text) and equal words: the best stretch for each row and item that counts."""
    found = []
    for mask in bench.masks:
        at, item, place = bench.hits(words.hash, mask)
        inside = words.row[at] == words.row[at + mask[-1]] if len(at) else np.zeros(0, bool)
        found.append(np.stack([words.row[at[inside]], item[inside], at[inside] - place[inside]]))
    row, item, diagonal = np.unique(np.concatenate(found, axis=1), axis=1)
    low, high = np.maximum(words.first[row], diagonal), np.minimum(words.first[row + 1], diagonal + bench.size[item])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    block = np.cumsum(high - low) // COMPARED
    for first, last in zip(*(np.searchsorted(block, np.unique(block), side) for side in ("left", "right")), strict=True):
        n = (high - low)[first:last]
        ends = np.cumsum(n)
        at = np.repeat(low[first:last] - (ends - n), n) + np.arange(n.sum())
        same = words.hash[at] == bench.flat[at + np.repeat((bench.first[item] - diagonal)[first:last], n)]
        # most hits are chance: all of their diagonal has too few equal words
        for j in np.flatnonzero(np.add.reduceat(same, ends - n, dtype=np.int64) >= bench.need[item[first:last]]).tolist():
            r, i, begin = int(row[first + j]), int(item[first + j]), int(low[first + j] - words.first[row[first + j]])
            start, end, equal = best_stretch(same[ends[j] - n[j] : ends[j]])
            if equal >= bench.need[i] and equal > best.get((r, i), (0, 0, 0))[2]:
                best[r, i] = (begin + start, begin + end, equal)
    return [(*k, *v) for k, v in sorted(best.items())]


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int, min_words: int, part: float) -> Iterator[Benchmark]:
    """The benchmark in blocks of about block_words words, by the bytes of its texts: one, if it's no larger. Items are dealt
    by id and text, so that items of one id are split too."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-size // (block_words * WORD_BYTES))
    for k in range(n):
        block = benchmark.select(F.col(item).alias("item"), F.coalesce(text, F.lit("")).alias("text"))
        block = block.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else block
        rows = sorted(block.collect(), key=lambda r: (str(r.item), r.text))
        words = []
        for _, _, data, offsets in chunks(pa.array([r.text for r in rows], pa.string())):
            w = Words(data, offsets, ALNUM)
            words += np.split(w.hash, w.first[1:-1])
        yield Benchmark([r.item for r in rows], words, min_words, part)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, part: float = PART, block_words: int = BLOCK_WORDS) -> DataFrame:
    """key, item, start_word, end_word, equal_words for each text and item that overlap. One narrow stage for each block."""
    spark = docs.sparkSession
    key_type, item_type = docs.select(key).schema[0].dataType.simpleString(), benchmark.select(item).schema[0].dataType.simpleString()
    schema = f"k {key_type}, i {item_type}, start_word int, end_word int, equal_words int"
    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())

    def look(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for batch in batches:
                rows = []
                for first, _, data, offsets in chunks(batch.column(1)):
                    rows += [(first + r, *x) for r, *x in overlaps(Words(data, offsets, ALNUM), bench)]
                at, items, *rest = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([bench.ids[i] for i in items], item_arrow), *(pa.array(x, pa.int32()) for x in rest)]
                yield pa.RecordBatch.from_arrays(arrays, names=["k", "i", "start_word", "end_word", "equal_words"])
            release()

        return run

    item_arrow = to_arrow_type(benchmark.select(item).schema[0].dataType)
    parts = [source.mapInArrow(look(spark.sparkContext.broadcast(b)), schema) for b in _blocks(benchmark, item, item_text, block_words, min_words, part)]
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return out.toDF(key, item if item != key else f"{item}_", "start_word", "end_word", "equal_words")
