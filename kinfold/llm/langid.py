"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound from the vectors of its letters, each permuted
by its place; a text is the bundle (sum) of its trigrams; a language is the bundle of the unit vectors of texts known to
be in it. A text gets the language whose prototype has the largest cosine with it.

Cases: a null text, or one without a letter, is `und` with score 0. Ties go to the language that sorts first. Repeated
rows and ids give repeated rows; of an id's texts in one language the least is learned from. Very long texts are bundled
whole, on their own. An empty table gives an empty one. Without any language learned all is `und`. Only the
named id, text and language columns are read; columns of other names may be there.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import release

DIM, LETTERS, SEED = 1024, 256, 20
#: Texts of one language that a prototype is made of, at most: the fit is on a bounded sample.
FIT_TEXTS = 400
#: Parts of a language in which the lowest hashes are looked for before they meet.
SALTS = 32
#: Texts that are bundled together, and their code points at most.
GROUP, GROUP_CHARS = 64, 200_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point 0 if it's no letter, else a number below LETTERS: a to z have their own, all others share the
    rest, so that those of one script mostly have their own too."""
    table = np.zeros(0x110000, np.uint16)
    for point in range(0x32400):
        c = chr(point)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 4294967296 % (LETTERS - 27)
    return table


@lru_cache(maxsize=1)
def _letters() -> list[np.ndarray]:
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (LETTERS, DIM))
    return [np.roll(base, shift, axis=1) for shift in (2, 1, 0)]


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code and text of each trigram; one blank stands for what lies between words, and none is in the middle."""
    sizes = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    # a blank before each text and one after the last
    at = np.arange(len(points)) + np.repeat(np.arange(1, len(texts) + 1), sizes)
    kinds = np.zeros(len(points) + len(texts) + 1, np.uint16)
    kinds[at] = _classes()[points]
    owner = np.zeros(len(kinds), np.int32)
    owner[at] = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    keep = kinds > 0
    keep[1:] |= kinds[:-1] > 0
    keep[0] = True
    kinds, owner = kinds[keep].astype(np.int64), owner[keep]
    middle = np.flatnonzero(kinds[1:-1]) + 1
    return kinds[middle - 1] << 16 | kinds[middle] << 8 | kinds[middle + 1], owner[middle]


def bundle(texts: list[str]) -> np.ndarray:
    """A vector for each text, not yet of unit length."""
    out = np.zeros((len(texts), DIM), np.float32)
    codes, owner = _trigrams(texts)
    if len(codes):
        pairs, counts = np.unique(owner.astype(np.int64) << 24 | codes, return_counts=True)
        kinds, column = np.unique(pairs & 0xFFFFFF, return_inverse=True)
        a, b, c = _letters()
        table = np.zeros((len(texts), len(kinds)), np.float32)
        table[pairs >> 24, column] = counts
        for i in range(0, len(kinds), 1024):
            k = kinds[i : i + 1024]
            out += table[:, i : i + 1024] @ (a[k >> 16] * b[k >> 8 & 255] * c[k & 255])
    return out


def _groups(column: pa.Array):
    """First row and texts of each group; no more than GROUP texts are Python strings at a time."""
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    first, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if i + 1 - first == GROUP or size > GROUP_CHARS or i + 1 == len(sizes):
            yield first, [x or "" for x in column.slice(first, i + 1 - first).to_pylist()]
            first, size = i + 1, 0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)


def fit(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = FIT_TEXTS) -> dict[str, np.ndarray]:
    """Prototypes of the languages of at most per_lang texts each, those whose key hashes lowest. To the driver comes a
    vector for each language and task, never a text."""
    known = df.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    lowest = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_at", "_id"))).where(F.col("_n") <= per_lang)
    chosen = known.select(F.col(lang).cast("string").alias("_lang"), F.xxhash64(F.col(key)).alias("_at"), F.col(key).alias("_id")).distinct()
    # of a language no more than SALTS * per_lang rows meet, however many there are
    chosen = lowest(lowest(chosen, "_lang", F.pmod("_at", F.lit(SALTS))), "_lang").select("_lang", "_id")
    texts = known.select(F.col(lang).cast("string").alias("_lang"), F.col(key).alias("_id"), F.col(text).alias("_text"))
    # per_lang ids for each language: bounded, so they're broadcast
    texts = texts.join(F.broadcast(chosen), ["_lang", "_id"]).groupBy("_lang", "_id").agg(F.min("_text").alias("_text")).select("_lang", "_text")

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, group in _groups(batch.column(1)):
                for name, vector in zip(langs[first : first + len(group)], _unit(bundle(group)), strict=True):
                    sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])
        release()

    out: dict[str, np.ndarray] = {}
    for row in texts.mapInArrow(add, "lang string, vector array<double>").collect():
        out[row.lang] = out.get(row.lang, 0) + np.array(row.vector)
    return {k: _unit(out[k]).astype(np.float32) for k in sorted(out)}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", out: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all of df's, by default) and out: the language and the cosine, from 0 to 1. Columns of df with
    the names in out are replaced. One narrow stage, no shuffle."""
    names, table = [*prototypes, "und"], np.array(list(prototypes.values()), np.float32).reshape(-1, DIM).T
    rest = [c for c in (df.columns if keep is None else keep) if c not in out]
    read = [*rest, *([text] if text not in rest else [])]
    at, width = read.index(text), len(rest)

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for _, group in _groups(batch.column(at)):
                vectors = bundle(group)
                blank = ~vectors.any(axis=1) & np.array([not any(map(str.isalpha, t)) for t in group]) if table.size else np.ones(len(group), bool)
                cosines = _unit(vectors) @ table if table.size else np.zeros((len(group), 1), np.float32)
                best = cosines.argmax(axis=1)
                langs += [names[-1] if x else names[i] for i, x in zip(best, blank, strict=True)]
                scores.append(np.where(blank, 0.0, np.clip(cosines[np.arange(len(group)), best].astype(np.float64), 0, 1)))
            arrays = [*batch.columns[:width], pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])
        release()

    source = df.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(read)))
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[:width])), f"c{width} string", f"c{width + 1} double"])
    return source.mapInArrow(run, schema).toDF(*rest, *out)
