"""Best-fit packing, planned on a histogram of lengths.

Texts are tokenised, cut into pieces of at most `size` tokens (only what is longer is cut, and the first piece takes the
odd rest), and the pieces are counted by length. Best-fit decreasing runs over those at most `size` counts: of the open
sequences with room, those with the least room are filled first, many alike at a time. The plan says which ranks within a
length go to which sequences, and where; pieces get theirs by a join on length and rank. Ranks need no tokens: those are
joined to their places once, by the number a piece has in the written table. sequences() lays the tokens end to end.

Cases: a null text is empty, and an empty one is the end token alone. Repeated rows and ids are packed each; an empty
table gives an empty result. Extra columns aren't read. The order of ranks within a length is by id, piece and content.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .pretokens import Known, groups, in_letters, split
from .text import release

SIZE, END_ID = 2048, 0
#: Distinct pre-tokens whose ids a Python worker remembers, at about 30 bytes; beyond that it forgets and starts anew.
REMEMBER = 500_000
#: Tokens that a Python worker hands over at once.
WAITING = 1 << 18
#: Texts that are Python strings at a time.
TEXTS = 512
#: Pieces of one length that a task ranks, on average; more are spread by salts.
RANKED = 50_000


class Encoder:
    """Ids of texts: the tokenizer's merges run once for each distinct pre-token that is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known, self.size, self.flat = Known(), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def numbers(self, joined: str, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """For sorted distinct hashes of the pre-tokens at start to end: their numbers in size and flat."""
        out = self.known.find(hashes)
        new = np.flatnonzero(out < 0)
        if len(new):
            tokens = [self.merges(in_letters(joined[a:b])) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            self.size = np.concatenate([self.size, np.fromiter(map(len, tokens), np.int64, len(tokens))])
            self.flat = np.concatenate([self.flat, np.array([t.id for word in tokens for t in word], "<u4")])
            out[new] = self.known.add(hashes[new])
        return out

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """Row and ids of each text, in any order."""
        for rows, held in groups(texts, self.added):
            if rows[0] < 0:
                yield -1 - rows[0], np.array(self.tokenizer.encode(held[0], add_special_tokens=False).ids, "<u4")
                continue
            if self.known.n >= REMEMBER:
                self.forget()
            joined, start, end, hashes, first = split(held, True)
            distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
            number = self.numbers(joined, start[at], end[at], distinct)[which]
            n = self.size[number]
            ends = np.cumsum(n)
            begin = np.cumsum(self.size) - self.size
            ids = self.flat[np.repeat(begin[number] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            cut = np.concatenate([[0], ends])[first]
            for row, a, b in zip(rows, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield row, ids[a:b]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(path)


def pieces(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """key, piece, start, length, ids_crc32 and ids (array<int>) of every piece. One narrow stage."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, TEXTS) for whole in batches for i in range(0, whole.num_rows, TEXTS)):
            rows, tokens = [], []

            def flush(batch=batch, rows=rows, tokens=tokens) -> pa.RecordBatch:
                at, piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
                flat = pa.array(np.concatenate([*tokens, np.zeros(0, "<u4")]).view(np.int32))
                held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), flat)
                rows.clear(), tokens.clear()
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), held], names=["k", "piece", "start", "length", "ids_crc32", "ids"])

            waiting = 0
            for row, ids in encoder(path).encode(batch.column(1).to_pylist()):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                n, done, k = len(ids), 0, 0
                while done < n:
                    take = (n - done - 1) % size + 1 if not k else size
                    part = ids[done : done + take]
                    rows.append((row, k, done, take, zlib.crc32(part))), tokens.append(part)
                    done, k, waiting = done + take, k + 1, waiting + take
                    if waiting >= WAITING:
                        yield flush()
                        waiting = 0
            yield flush()
        release()

    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return source.mapInArrow(run, f"k {source.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, ids array<int>").withColumnRenamed("k", key)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram. Rows: length, first rank, how many ranks, first sequence, offset."""
    rooms: dict[int, list[tuple[int, int]]] = {}  # by free tokens: runs of sequences (first, how many)
    free = 0  # bit r: rooms has runs with r free tokens
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = (fit & -fit).bit_length() - 1 + length if (fit := free >> length) else size
            first, many = rooms[room].pop() if room < size else (opened, left)
            # the fullest one takes more until nothing fits: `full` sequences take as many as fit, one more takes the rest
            fits = room // length
            full, rest = divmod(left, fits)
            full, rest = (many, 0) if full >= many else (full, rest)
            for begin, used, items in ((first, full, fits), (first + full, min(rest, 1), rest)):
                if used:
                    out += [(length, rank + i * used, used, begin, size - room + i * length) for i in range(items)]
                    rank, left = rank + used * items, left - used * items
                    if room > items * length:
                        rooms.setdefault(room - items * length, []).append((begin, used))
                        free |= 1 << room - items * length
            used = full + min(rest, 1)
            if room == size:
                opened += used
            elif used < many:
                rooms[room].append((first + used, many - used))
            elif not rooms[room]:
                free ^= 1 << room
    return out


def ranked(df: DataFrame, by: str, order: list[str], rank: str, salts: int) -> DataFrame:
    """Rank from 0 within `by`, without all rows of a value in one task: ranks within salts, and the salts' totals."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(by, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(by, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = salted.withColumn("_at", F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order)))
    return inner.join(counts, [by, "_salt"]).withColumn(rank, F.col("_before") + F.col("_at") - 1).drop("_salt", "_before", "_at")


def pack(parts: DataFrame, key: str = "doc_id", size: int = SIZE, scratch: Scratch | None = None) -> DataFrame:
    """parts (with the ids) and sequence_id, offset. parts is written once and read from there."""
    spark = parts.sparkSession
    parts = (scratch or Scratch(spark)).keep(parts.withColumn("_place", F.monotonically_increasing_id()))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    salts = -(-max(counts.values(), default=1) // RANKED)
    step = 100_000  # ranks of a plan row that one task lays out
    rows = [(a, b + i, min(step, n - i), s + i, o) for a, b, n, s, o in plan(counts, size) for i in range(0, n, step)]
    slots = spark.createDataFrame(rows, "length long, first long, n long, sequence long, offset long").repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))
    slots = slots.select("length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_i"), "first", "sequence", "offset")
    slots = slots.select("length", (F.col("first") + F.col("_i")).alias("_rank"), (F.col("sequence") + F.col("_i")).alias("sequence_id"), "offset")
    order = [key, "piece", "start", "ids_crc32"]
    placed = ranked(parts.select("length", *order, "_place"), "length", order, "_rank", salts).join(slots, ["length", "_rank"])
    # the places are hashed, so the tokens need no sort
    return parts.join(placed.select("_place", "sequence_id", "offset").hint("shuffle_hash"), "_place").drop("_place")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (the tokens of its pieces end to end) and n_pieces of each sequence."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.size("parts").alias("n_pieces"))


def digests(packed: DataFrame) -> DataFrame:
    """packed without ids; ids_crc32 is computed anew from the ids delivered."""
    names = [c for c in packed.columns if c not in ("ids", "ids_crc32")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(names))
            flat, ends = ids.values.to_numpy(zero_copy_only=False).view("<u4"), ids.offsets.to_pylist()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], names=[*(f"c{i}" for i in range(len(names))), "crc"])
        release()

    source = packed.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), "ids")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "ids") + ", crc long"
    out = source.mapInArrow(run, schema).toDF(*names, "ids_crc32")
    return out.select(*(F.col(f"`{c}`") for c in packed.columns if c != "ids"))
