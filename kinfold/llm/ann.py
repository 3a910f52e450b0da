"""Nearest neighbours by inner product with an adaptive dimension scan.

Vectors get one more component, so that the largest inner product is the least distance, and are turned by a random
rotation. An inverted file of k-means cells, fitted on a bounded sample, says which lists a query probes. There are about
as many lists as the square root of the vectors: of more than COARSE each cell is cut by a second level of centres, fitted
on the sample's residuals, so the sample needn't grow.

Two scans. The first takes a query's nearest lists in full, as many as hold FIRST (k + 1) vectors, and so gives k + 1
candidates and a bound: the distance of the last of them. The second goes through the other probed lists, in which the
components are added in blocks, and after each block a hypothesis test on the partial distances gives up candidates that are
unlikely to be within the bound. What is left has its inner product computed on the original vectors.

Lists lie together in shelves of about SHELF vectors, and a query is sent to a shelf once, with the lists it probes there; a
larger list is spread over several shelves, and the queries that meet in one are cut into chunks of bounded size. Equal
vectors are searched once: a class of them stands for all, with its k + 1 smallest ids, which is all that k neighbours can
need.

Cases: vectors that are null, empty, all zero, or hold null or non-finite components take no part, as queries or
candidates; nor do those of another length than the most frequent (of equally frequent ones, the longest). Rows with null
ids take no part. Repeated rows count once. Ties go to the smaller id. A query gets k neighbours, or all other rows if there
are fewer. Empty tables and no queries give an empty result. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Vectors that the index is fitted on at most, those whose hash is lowest; of them, those that bound distances.
FIT_VECTORS, BOUND_VECTORS = 16_384, 4096
#: Centres of the first level at most, lists at most, and rounds of k-means.
COARSE, MAX_LISTS, ROUNDS = 2048, 65_536, 8
#: The share of true neighbours that the probes chosen on the sample must reach there.
AIM = 0.985
#: Components of a block, the slack of the test, and the share of pairs left from which on they are compared one by one.
BLOCK, SLACK, SPARSE = 16, 2.1, 0.1
FIRST = 8
#: Vectors of a shelf, queries that meet one at once in a task, and of these the ones compared together.
SHELF, CHUNK, TOGETHER = 16_384, 4096, 256


@dataclass(frozen=True)
class Index:
    largest: float  # squared norm
    rotation: np.ndarray
    coarse: np.ndarray
    fine: np.ndarray  # added to each coarse centre
    probes: int
    bound: np.ndarray

    def turned(self, x: np.ndarray, is_query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(self.largest - (x**2).sum(1), 0))
        return np.column_stack([x, more]) @ self.rotation

    @property
    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    def own(self, turned: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        cell = _closest(turned, self.coarse)
        return cell * len(self.fine) + _closest(turned - self.coarse[cell], self.fine)

    def order(self, turned: np.ndarray) -> np.ndarray:
        """All lists, nearest first."""
        centers = (self.coarse[:, None] + self.fine).reshape(-1, turned.shape[1])
        return np.argsort((centers**2).sum(1) - 2 * turned @ centers.T, axis=1, kind="stable")


def _closest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1) if len(centers) > 1 else np.zeros(len(x), np.int64)


def _means(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), n, replace=False)]
    for _ in range(ROUNDS):
        own = _closest(x, centers)
        count = np.bincount(own, minlength=n)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def fit(sample: np.ndarray, largest: float, total: int, k: int, seed: int = 5) -> Index:
    """Cells by k-means, and as many probes as find AIM of the neighbours of sample vectors in the sample."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    index = Index(largest, rotation, np.zeros((1, dim)), np.zeros((1, dim)), 1, np.zeros((0, dim)))
    x = index.turned(sample, False)
    lists = min(int(np.ceil(np.sqrt(total))), MAX_LISTS)
    coarse = _means(x, int(np.clip(min(lists, len(x) // 8), 1, COARSE)), rng)
    split = -(-lists // COARSE) if lists > COARSE else 1
    fine = _means(x - coarse[_closest(x, coarse)], min(split, len(x)), rng) if split > 1 else np.zeros((1, dim))
    index = Index(largest, rotation, coarse, fine, 1, x[:BOUND_VECTORS])
    own = index.own(x)
    asked = rng.choice(len(x), min(len(x), 512), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    order = index.order(index.turned(sample[asked], True))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(index.lists)[None, :].repeat(len(asked), 0), 1)
    needed = np.sort(np.take_along_axis(place, own[true], 1).ravel()) if true.size else np.zeros(1, int)
    return replace(index, probes=int(needed[min(len(needed) - 1, int(AIM * len(needed)))]) + 1)


def scan(queries: np.ndarray, table: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of the pairs that no test gave up. bound: a squared distance for each query."""
    dim, partial, pairs = table.shape[1], np.zeros((len(queries), len(table))), None
    for d in range(0, dim, BLOCK):
        q, t, seen = queries[:, d : d + BLOCK], table[:, d : d + BLOCK], min(d + BLOCK, dim)
        if pairs is None:
            partial += (q**2).sum(1)[:, None] + (t**2).sum(1) - 2 * q @ t.T
        else:
            step = q[pairs[0]] - t[pairs[1]]
            partial = partial + np.einsum("ij,ij->i", step, step)
        most = bound * ((1 + SLACK / np.sqrt(seen)) ** 2 if seen < dim else 1 + 1e-9) * (seen / dim)
        if pairs is not None:
            keep = partial <= most[pairs[0]]
            pairs, partial = (pairs[0][keep], pairs[1][keep]), partial[keep]
        else:
            keep = partial <= most[:, None] + 1e-9 * abs(most[:, None])
            if seen == dim or keep.sum() <= SPARSE * keep.size:
                pairs = np.nonzero(keep)
                partial = partial[pairs]
            else:  # given up for good
                partial[~keep] = np.inf
    return pairs


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vec, as doubles, of the vectors that take part."""
    v = F.col("vec")
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & v.isNotNull())
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("vec", F.transform(v, lambda x: x + F.lit(0.0)))


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query; queries: a condition on the column id."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    rows = usable(df, key, vector)
    id_type = rows.schema["id"].dataType.simpleString()
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if not sizes:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    dim = sizes.n
    rows = rows.where(F.size("vec") == dim)
    # the k + 1 smallest ids of each vector: limited within tasks before they're sent
    place = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("_at", place).where(F.col("_at") <= k + 1).select("vec", "id")
    classes = scratch.keep(few.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("class"), "ids", "vec"))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    total, largest = classes.agg(F.count("*"), F.max(norm)).first()
    picked = classes.select("vec").orderBy(F.xxhash64("vec")).limit(FIT_VECTORS).toArrow().column("vec")
    index = spark.sparkContext.broadcast(fit(_matrix(picked, dim), largest * (1 + 1e-12), total, k))

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            own = index.value.own(index.value.turned(x, False)) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["class", "ids", "vec", "list"])

    asked = rows.where(queries).select("id", "vec").distinct().join(classes.select("class", "vec"), "vec").select("id", "class")
    asked = scratch.keep(asked)
    placed = scratch.keep(classes.mapInArrow(assign, f"class {id_type}, ids array<{id_type}>, vec array<double>, list int"))
    wanted = asked.select("class").distinct().join(classes, "class").select("class", "vec")
    sizes = np.zeros(index.value.lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # MAX_LISTS rows at most
        sizes[r["list"]] = r["count"]
    # a list has `parts` shelves from `base` on; small ones share theirs
    parts = np.maximum(1, -(-sizes // SHELF))
    begin = np.cumsum(np.where(parts > 1, 0, sizes)) // SHELF
    base = np.where(parts > 1, begin.max(initial=0) + 1 + np.cumsum(np.where(parts > 1, parts, 0)) - parts, begin)
    shelves = spark.sparkContext.broadcast((sizes, base, parts))

    def probe(is_first: bool):
        def run(batches):
            m, (sizes, base, parts) = index.value, shelves.value
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    q = m.turned(_matrix(part.column(1), dim), True)
                    order = m.order(q)
                    held = np.cumsum(sizes[order], axis=1)
                    first = (held < FIRST * (k + 1)).sum(1) + 1  # so many lists are taken in full
                    far = (q**2).sum(1)[:, None] + (m.bound**2).sum(1) - 2 * q @ m.bound.T
                    # 2 k, so that with the query itself and lists not probed there are still k within it
                    bound = np.partition(far, 2 * k, axis=1)[:, 2 * k] if far.shape[1] > 2 * k else np.full(len(q), np.inf)
                    at, shelf, lists = [], [], []
                    for r in range(len(q)):
                        mine = order[r, : first[r]] if is_first else order[r, first[r] : max(m.probes, first[r])]
                        mine = mine[sizes[mine] > 0]
                        own = np.repeat(np.arange(len(mine)), parts[mine])
                        on = base[mine][own] + np.arange(len(own)) - np.searchsorted(own, own)
                        for s in np.unique(on):
                            at.append(r), shelf.append(s), lists.append(np.sort(mine[own[on == s]]).astype(np.int32))
                    at = np.array(at, np.int64)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(shelf, pa.int32()), pa.array(lists, pa.list_(pa.int32())), pa.array(np.full(len(at), np.inf) if is_first else bound[at], pa.float64())], names=["query", "qvec", "shelf", "lists", "bound"])

        return run

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            m, x, asked_for, ids = index.value, _matrix(a.column("vec"), dim), _matrix(b.column("qvec"), dim), a.column("class").to_numpy()
            table, q, limit = m.turned(x, False), m.turned(asked_for, True), b.column("bound").to_numpy()
            list_of, probed = a.column("list").to_numpy(), b.column("lists").to_pylist()
            by_list = np.argsort(list_of, kind="stable")
            where = {int(n): by_list[s : s + c] for n, s, c in zip(*np.unique(list_of[by_list], return_index=True, return_counts=True), strict=True)}
            for start in range(0, len(q), TOGETHER):
                askers: dict[int, list[int]] = {}
                for r in range(start, min(start + TOGETHER, len(q))):
                    for n in probed[r]:
                        askers.setdefault(n, []).append(r)
                found = [np.zeros((2, 0), np.int64)]
                for n, who in askers.items():
                    if n in where:
                        i, j = scan(q[who], table[where[n]], limit[who])
                        found.append(np.stack([np.array(who)[i], where[n][j]]))
                i, j = np.concatenate(found, axis=1)
                score = np.einsum("ij,ij->i", asked_for[i], x[j])
                # no more than k + 1 of a query can count
                best = np.lexsort((ids[j], -score, i))
                place = np.arange(len(best)) - np.searchsorted(i[best], i[best])
                best = best[place <= k]
                out.append((i[best], j[best], score[best]))
        i, j, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": b.column("query").take(pa.array(i)), "ids": a.column("ids").take(pa.array(j)), "score": pa.array(score)})

    shelved = placed.select("class", "ids", "vec", "list", _shelf(base, parts, spark).alias("shelf"))
    probe_type = f"query {id_type}, qvec array<double>, shelf int, lists array<int>, bound double"
    until = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def scanned(probed: DataFrame) -> DataFrame:
        probed = scratch.keep(probed)
        # a row for each shelf
        chunks = probed.groupBy("shelf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("qs"))
        left = shelved.join(chunks, "shelf").select("shelf", until("qs").alias("q"), "class", "ids", "vec", "list")
        right = probed.join(chunks, "shelf").select("shelf", F.pmod(F.xxhash64("query"), F.col("qs")).cast("int").alias("q"), "query", "qvec", "lists", "bound")
        return scratch.keep(left.groupBy("shelf", "q").cogroup(right.groupBy("shelf", "q")).applyInArrow(near, f"query {id_type}, ids array<{id_type}>, score double"))

    first = scanned(wanted.mapInArrow(probe(True), probe_type))
    last = first.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("at") == k + 1).select("query", F.col("score").alias("least"))
    others = wanted.mapInArrow(probe(False), probe_type).join(last, "query", "left")
    far = F.aggregate("qvec", F.lit(0.0), lambda a, x: a + x * x) + F.lit(index.value.largest) - 2 * F.col("least")
    second = scanned(others.select("query", "qvec", "shelf", "lists", F.least("bound", far * (1 + 1e-9)).alias("bound")))
    best = first.union(second).select("query", F.explode("ids").alias("vec_id"), "score")
    best = best.withColumn("_in", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_in") <= k + 1).drop("_in")
    each = asked.join(best, asked["class"] == best["query"]).where(F.col("vec_id") != F.col("id"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")).cast("int")).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def _shelf(base: np.ndarray, parts: np.ndarray, spark: SparkSession) -> Column:
    """The shelf of a row with list and class; base and parts have MAX_LISTS numbers at most."""
    table = spark.createDataFrame([(base.tolist(), parts.tolist())], "base array<int>, parts array<int>")
    many = table.select("parts").scalar()
    return F.get(table.select("base").scalar(), F.col("list")) + F.pmod(F.xxhash64("class"), F.get(many, F.col("list"))).cast("int")
