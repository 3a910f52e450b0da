"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + pairs), where pairs = sum over i < j of <v_i, v_j> x_i x_j is computed in linear time
as half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2. Features: each distinct word (hashed, weighed by log count, unit length
in a text) and, one-hot by quantile bins, statistics of the text's structure and the metadata columns named.

Cases: a null or empty text has no words and zero statistics and gets a score as any other. Null metadata counts as 0.
Labels other than 0 and 1, and null ones, teach nothing; of contradicting labels of one id the majority counts, and a tie
teaches nothing. Without usable labels the score is 0.5; with those of one kind only it is near 1 or near 0. Of several
rows of one id the one with the least text teaches. Repeated rows give repeated results, an empty table none. Very long
texts are scored whole. A column with the name of the score is replaced; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words, chunks

BUCKETS, BINS, RANK = 1 << 16, 8, 8
#: Labelled rows that the fit sees at most, those whose id hashes lowest.
FIT_ROWS = 6000
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.05, 1e-5, 7
STATS = ("bytes", "words", "word_bytes", "upper", "digits", "marks", "high", "lines", "line_words", "distinct", "top_word", "line_copies", "line_marks", "long_words")

_UPPER, _DIGIT, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK[33:127] = True
_MARK &= ~(_LETTER | _DIGIT)
_LINE = np.ones(256, bool)
_LINE[10] = False


@dataclass(frozen=True)
class Model:
    edges: np.ndarray
    bias: float
    weight: np.ndarray
    factors: np.ndarray


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(data: np.ndarray, offsets: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a chunk: row, bucket and weight of each distinct word; statistics, a line for each text."""
    n, words = len(offsets) - 1, Words(data, offsets)
    size, count = np.diff(offsets).astype(float), np.diff(words.first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))

    def having(table: np.ndarray) -> np.ndarray:
        return np.bincount(owner[table[data]], minlength=n).astype(float)

    keys, times = np.unique(words.row << 16 | (words.hash >> np.uint64(48)).astype(np.int64), return_counts=True)
    row, bucket, weight = keys >> 16, keys & (BUCKETS - 1), np.log1p(times)
    weight /= np.sqrt(np.bincount(row, weight**2, n))[row] if len(row) else 1
    top = np.zeros(n)
    np.maximum.at(top, row, times)
    lines = Words(data, offsets, _LINE)
    line_rows = np.diff(lines.first).astype(float)
    seen = np.lexsort((lines.hash, lines.row))
    again = np.zeros(len(seen), bool)
    again[1:] = (lines.hash[seen][1:] == lines.hash[seen][:-1]) & (lines.row[seen][1:] == lines.row[seen][:-1])
    letters, marks, word_bytes = having(_LETTER), having(_MARK), words.end - words.start
    ends_in_mark = _MARK[data[lines.end - 1]] if len(lines.end) else np.zeros(0, bool)
    stats = np.stack(
        [
            np.log1p(size),
            np.log1p(count),
            _share(np.bincount(words.row, word_bytes, n), count),
            _share(having(_UPPER), letters),
            _share(having(_DIGIT), size),
            _share(marks, size),
            _share(having(np.arange(256) >= 128), size),
            np.log1p(line_rows),
            _share(count, line_rows),
            _share(np.bincount(row, minlength=n), count),
            _share(top, count),
            _share(np.bincount(lines.row[seen][again], minlength=n), line_rows),
            _share(np.bincount(lines.row[ends_in_mark], minlength=n), line_rows),
            _share(np.bincount(words.row[word_bytes > 20], minlength=n), count),
            *np.log1p(np.maximum(np.nan_to_num(meta, nan=0.0, posinf=0.0, neginf=0.0), 0)).T,
        ],
        axis=1,
    )
    return row, bucket, weight, stats


def _columns(edges: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Feature numbers of the bins of each statistic."""
    bins = np.stack([np.searchsorted(e, s, "right") for e, s in zip(edges, stats.T, strict=True)], axis=1)
    return BUCKETS + np.arange(stats.shape[1]) * BINS + bins


def _joined(row, bucket, weight, stats, edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of all features, sorted by row."""
    n, m = stats.shape
    rows = np.concatenate([row, np.repeat(np.arange(n), m)])
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate([bucket, _columns(edges, stats).ravel()])[order], np.concatenate([weight, np.full(n * m, m**-0.5)])[order]


def _margins(model: Model, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The model's sum for each row, and sum v_i x_i. Every row has features."""
    begin = np.searchsorted(rows, np.arange(n))
    vx = model.factors[cols] * x[:, None]
    total = np.add.reduceat(vx, begin)
    pairs = (total**2).sum(1) - np.add.reduceat((vx**2).sum(1), begin)
    return model.bias + np.add.reduceat(model.weight[cols] * x, begin) + 0.5 * pairs, total


def train(parts: list[tuple], stats: np.ndarray, labels: np.ndarray) -> Model:
    """Logistic loss, Adagrad on small batches. parts: buckets and weights of each labelled text."""
    m = stats.shape[1]
    size = BUCKETS + m * BINS
    rng = np.random.default_rng(SEED)
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(stats) else np.zeros((m, BINS - 1))
    share = labels.mean() if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        margin = 0.0 if not len(labels) else 5.0 if share else -5.0
        return Model(edges, margin, np.zeros(size), np.zeros((size, RANK)))
    bias, weight, factors = np.array([np.log(share / (1 - share))]), np.zeros(size), rng.normal(0, 0.02, (size, RANK))
    slopes = [np.full(x.shape, 1e-6) for x in (bias, weight, factors)]
    bins = _columns(edges, stats)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        rate = RATE / (1 + epoch / 4)
        for i in range(0, len(order), BATCH):
            ids = order[i : i + BATCH]
            cols = np.concatenate([np.concatenate([parts[k][0], bins[k]]) for k in ids])
            x = np.concatenate([np.concatenate([parts[k][1], np.full(m, m**-0.5)]) for k in ids])
            rows = np.repeat(np.arange(len(ids)), [len(parts[k][0]) + m for k in ids])
            margin, total = _margins(Model(edges, bias[0], weight, factors), rows, cols, x, len(ids))
            loss = (1 / (1 + np.exp(-margin)) - labels[ids])[rows]
            used, place = np.unique(cols, return_inverse=True)
            grow = loss * x
            gw = np.bincount(place, grow, len(used)) + DECAY * weight[used]
            gv = np.zeros((len(used), RANK))
            np.add.at(gv, place, grow[:, None] * (total[rows] - factors[cols] * x[:, None]))
            gv += DECAY * factors[used]
            gb = np.array([(1 / (1 + np.exp(-margin)) - labels[ids]).sum()])
            for value, slope, at, g in ((bias, slopes[0], slice(None), gb), (weight, slopes[1], used, gw), (factors, slopes[2], used, gv)):
                slope[at] += g**2
                value[at] -= rate * g / np.sqrt(slope[at])
    return Model(edges, float(bias[0]), weight, factors)


def _source(df: DataFrame, text: str, meta: tuple[str, ...], first: list[str]) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(first)), F.col(text).alias("_text"), F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in meta)).cast("array<double>").alias("_meta"))


def _meta(batch: pa.RecordBatch, m: int) -> np.ndarray:
    return np.array(batch.column(batch.num_columns - 1).to_pylist(), float).reshape(-1, m)


def fit(df: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "quality", meta: tuple[str, ...] = ("n_chars",), fit_rows: int = FIT_ROWS) -> Model:
    """The model, from at most fit_rows labelled ids where learn (of the key) holds. To the driver come features, no texts."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & learn).groupBy(F.col(key).alias("_id")).agg(F.avg(F.col(label)).alias("_share"))
    usable = usable.where("_share <> 0.5").select("_id", (F.col("_share") > 0.5).cast("int").alias("_label"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    # fit_rows rows of two numbers: bounded, so they're broadcast
    source = _source(df.withColumn("_key", F.col(key)), text, meta, ["_key"]).withColumnRenamed("_0", "_id").join(F.broadcast(chosen), "_id")
    # an id may have many rows: one of them, chosen within tasks first
    source = source.groupBy("_id", "_label").agg(F.min(F.struct("_text", "_meta")).alias("x")).select("_id", "_label", "x._text", "x._meta")

    def extract(batches):
        for batch in batches:
            meta_values, out = _meta(batch, len(meta)), []
            for first, end, data, offsets in chunks(batch.column(2)):
                row, bucket, weight, stats = features(data, offsets, meta_values[first:end])
                cut = np.searchsorted(row, np.arange(1, end - first))
                out += zip(np.split(bucket, cut), np.split(weight, cut), stats, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array([x[0].astype(np.int32) for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.float64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))], names=["id", "label", "bucket", "weight", "stats"])

    rows = source.mapInArrow(extract, "id string, label int, bucket array<int>, weight array<double>, stats array<double>").toArrow()
    order = np.argsort(rows.column("id").to_numpy(zero_copy_only=False).astype(str), kind="stable")
    lists = [rows.column(c).combine_chunks() for c in ("bucket", "weight", "stats")]
    parts = [(lists[0][int(i)].values.to_numpy().astype(np.int64), lists[1][int(i)].values.to_numpy()) for i in order]
    stats = np.array([lists[2][int(i)].values.to_numpy() for i in order]).reshape(-1, len(STATS) + len(meta))
    return train(parts, stats, rows.column("label").to_numpy(zero_copy_only=False)[order].astype(float))


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, meta: tuple[str, ...] = ("n_chars",), out: str = "score") -> DataFrame:
    """The columns in keep (all but the text, by default) and the probability of label 1. One narrow stage, no shuffle."""
    rest = [c for c in (df.columns if keep is None else keep) if c != out and (c != text or keep is not None)]
    spark = df.sparkSession
    # of fixed size, whatever the input: (BUCKETS + bins) * (RANK + 1) numbers
    shared = spark.sparkContext.broadcast(Model(model.edges, model.bias, model.weight.astype(np.float32), model.factors.astype(np.float32)))

    def run(batches):
        m = shared.value
        for batch in batches:
            values, out = _meta(batch, len(meta)), [np.zeros(0)]
            for first, end, data, offsets in chunks(batch.column(batch.num_columns - 2)):
                rows, cols, x = _joined(*features(data, offsets, values[first:end]), m.edges)
                margin, _ = _margins(m, rows, cols, x.astype(np.float32), end - first)
                out.append(1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30))))
            arrays = [*batch.columns[:-2], pa.array(np.concatenate(out), pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

    source = _source(df, text, meta, rest)
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[:-2])), f"c{len(rest)} double"])
    return source.mapInArrow(run, schema).toDF(*rest, out)
