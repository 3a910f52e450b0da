"""N-gram Jaccard join by prefix trees, and the groups its links make.

A text's set holds the 64-bit hashes of its distinct n-grams of words. Equal sets are one class. All n-grams have one
global order: first those of a fixed sample of hash values (the same for all texts), the rare before the frequent by the
number of classes they're in, then the others by hash. Two sets that are similar enough share an element among the first
few of each in this order (the prefix filter), so classes meet at the elements of their prefixes that others have too.

Where classes meet, pairs are tested against length and position bounds, and then exactly, many at once: the sets of one
side are put in one tree, ordered so that what many of them hold comes first and like sets share a long path. All sets of
the other side are carried down it together, each with the overlap so far, so a shared path is compared once for all sets
below it and all sets above; a set leaves a subtree whose remaining length, or its own, can't bring the overlap needed.

At a meeting point only classes of different groups are tested: first, in two turns, each with one class of like length, then
what is left in full, where a pair goes on only if the parities of the sets' elements in 64 * PARITY buckets allow it: the
buckets of unlike parity are no more than the elements that only one of the two has. So the groups are found without all
pairs of near copies, and no link between groups is missed.

The number of links is counted afterwards by the same trees: every link is within a group, so a group's classes go into
trees of BLOCK sets and all of its sets are carried down each of them. Groups of up to BLOCK classes go many to a task. No
table of pairs is made.

Cases: null texts and texts without words have empty sets, no links, and their own id as component. A text of fewer words
than an n-gram has its whole sequence as the one n-gram. Repeated rows and ids are rows of their own. A row with a null id is
linked like any other; the component of rows that all have none is null. Ties of order go by hash. An empty table gives an empty result. Columns other than the id and text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..scratch import Scratch
from .text import U64, Words, as_signed, chunks, mix, release, windows

#: Elements of all sets in one tree, on average.
TREE_ITEMS = 1 << 19
#: Longs that hold the parities of a set's elements, by bucket.
PARITY = 8
#: Sets in a tree that counts links, and of those that are carried down it together.
BLOCK = 256
#: Turns of hubs: the place of the bands of like length, None for one band of all; "all" tests what they leave.
TURNS = (0.0, None, "all")
#: Elements of a path after which bounds are tested, at first; doubled from then on.
STEP = 32


class PrefixTree:
    """Sets of uint64 in one order: what more of them hold comes first, ties by value. Those with a common beginning share
    the nodes of it."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.root = self._node(np.zeros(0, np.int64))
        flat = np.concatenate(sets) if sets else np.zeros(0, U64)
        self.values, at, many = np.unique(flat, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(many), np.int64)
        self.rank[np.argsort(-many, kind="stable")] = np.arange(len(many))
        ranks = self.rank[at]
        end = np.cumsum([len(x) for x in sets], dtype=np.int64)
        for name, x in enumerate(sets):
            self._insert(np.sort(ranks[end[name] - len(x) : end[name]]), name)

    @staticmethod
    def _node(run: np.ndarray) -> dict:
        return {"run": run, "next": {}, "ids": [], "low": 1 << 62, "high": 0}

    def _insert(self, items: np.ndarray, name: int) -> None:
        node, at, n = self.root, 0, len(items)
        while True:
            node["low"], node["high"] = min(node["low"], n), max(node["high"], n)
            if at == n:
                node["ids"].append(name)
                return
            child = node["next"].get(items[at])
            if child is None:
                child = node["next"][items[at]] = self._node(items[at:])
                child["low"] = child["high"] = n
                child["ids"].append(name)
                return
            run = child["run"]
            m = min(len(run), n - at)
            unlike = np.flatnonzero(run[:m] != items[at : at + m])
            same = int(unlike[0]) if len(unlike) else m
            if same < len(run):
                upper = self._node(run[:same])
                upper["next"][run[same]] = child
                upper["low"], upper["high"] = child["low"], child["high"]
                child["run"] = run[same:]
                node["next"][items[at]] = upper
                child = upper
            node, at = child, at + same

    def similar(self, probes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The places of probes and of the tree's sets whose Jaccard similarity is num / den or more."""
        num, den, width = self.num, self.den, max(1, len(self.values))
        n = np.array([len(x) for x in probes], np.int64)
        flat, who = np.concatenate(probes) if probes else np.zeros(0, U64), np.repeat(np.arange(len(n)), n)
        at = np.minimum(np.searchsorted(self.values, flat), width - 1)
        known = np.flatnonzero(self.values[at] == flat) if len(self.values) else np.zeros(0, np.int64)
        who, rank = who[known], self.rank[at[known]]
        # who holds an element, by element; and the elements of each, in order
        by = np.argsort(rank, kind="stable")
        holders, first = who[by], np.searchsorted(rank[by], np.arange(width + 1))
        own = np.sort(who * width + rank)
        ends = np.searchsorted(own, np.arange(1, len(n) + 1) * width)
        found: list[tuple[np.ndarray, int]] = []
        stack = [(self.root, 0, np.arange(len(n)), np.zeros(len(n), np.int64))]
        while stack:
            node, depth, alive, overlap = stack.pop()
            low, high, run = node["low"], node["high"], node["run"]
            fit = (den * high >= num * n[alive]) & (den * n[alive] >= num * low)
            alive, overlap = alive[fit], overlap[fit]
            at, step = 0, STEP
            while len(alive) and at < len(run):
                part = run[at : at + step]
                at, step, depth = at + len(part), 2 * step, depth + len(part)
                lo = first[part]
                many = first[part + 1] - lo
                holding = holders[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
                overlap = overlap + np.bincount(holding, minlength=len(n))[alive]
                left = ends[alive] - np.searchsorted(own, alive * width + part[-1], "right")
                need = -(-num * (n[alive] + np.maximum(low, -(-num * n[alive] // den))) // (num + den))
                fit = overlap + np.minimum(high - depth, left) >= need
                alive, overlap = alive[fit], overlap[fit]
            if not len(alive):
                continue
            if node["ids"]:
                hit = alive[(num + den) * overlap >= num * (n[alive] + depth)]
                found += [(hit, name) for name in node["ids"]]
            stack += [(child, depth, alive, overlap) for child in node["next"].values()]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(hit for hit, _ in found)]), np.repeat(np.array([name for _, name in found], np.int64), [len(hit) for hit, _ in found])


def _unpacked(t: pa.Table, column: str) -> list[np.ndarray]:
    items = t.column(column).combine_chunks()
    items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
    flat, at = items.values.to_numpy().view(U64), items.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _sets(docs: DataFrame, key: str, text: str, k: int, num: int, den: int, sample: int | None) -> DataFrame:
    """id, t (the hash of the text of a row without id, else null), n, c (the hash of the set) and: with sample, the set's
    elements in the sample (of 65536 hash values), those of the prefix beyond it and the parities; without, the whole set.
    Elements are ordered by their hash."""
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.when(F.col(key).isNull(), F.xxhash64(text)).alias("t"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, c, first, more, bits = [], [], [], [], []
            for _, _, data, offsets in chunks(batch.column(1)):
                hashes, row = windows(Words(data, offsets), k)
                for own in np.split(hashes, np.searchsorted(row, np.arange(1, len(offsets) - 1))):
                    own = np.unique(own)
                    n.append(len(own))
                    c.append(mix(own.sum(dtype=U64, keepdims=True) ^ mix(np.bitwise_xor.reduce(own, keepdims=True) + U64(len(own))))[0] if len(own) else U64(0))
                    if sample is None:
                        first.append(as_signed(own))
                        continue
                    inside = (own >> U64(17) & U64(0xFFFF)) < U64(sample)
                    first.append(as_signed(own[inside]))
                    prefix = len(own) - -(-num * len(own) // den) + 1 if len(own) else 0
                    more.append(as_signed(own[~inside][: max(0, prefix - len(first[-1]))]))
                    odd = np.bincount((own >> U64(33)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
                    bits.append(np.packbits(odd.astype(bool)).view(np.int64))
            lists = lambda x: pa.array(x, pa.list_(pa.int64()))
            arrays = [batch.column(0), batch.column(2), pa.array(n, pa.int32()), pa.array(as_signed(np.array(c, U64))), lists(first), *([lists(more), lists(bits)] if sample is not None else [])]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "t", "n", "c", "items", "more", "bits"][: len(arrays)])
        release()

    return source.mapInArrow(run, f"id {kind}, t long, n int, c long, items array<long>" + ", more array<long>, bits array<long>" * (sample is not None))


def _spanning(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the least of each component and each other member, from the links (x, y) of classes."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = ends[: len(x)], ends[len(x) :]
    label = np.arange(len(nodes))
    while len(i) and (label[i] != label[j]).any():
        low = np.minimum(label[i], label[j])
        # also the roots, so what was joined stays joined
        for at in (label[i], label[j]):
            np.minimum.at(label, at, low)
        while (label != label[label]).any():
            label = label[label]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of the sets (c, size, items) with the same components as all links of the given pairs, and others that the
    same trees show: of each tree a star for each group, as a tree shows a link for each two of many near copies."""
    sized = pairs.join(sets.select(F.col("c").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("size"))
    sized = scratch.keep(sized.withColumn("trees", F.ceil(F.col("size") / TREE_ITEMS).cast("int")))
    # the partners of most fit in a part of a tree: those of several share one
    small = max(1, -(-(sized.where("trees = 1").agg(F.sum("size")).first()[0] or 0) // TREE_ITEMS))
    placed = sized.select("a", "trees", F.when(F.col("trees") == 1, F.pmod(F.xxhash64("a"), F.lit(small))).otherwise(F.col("a")).alias("g"), (F.col("trees") == 1).alias("shared"))
    by = ["shared", "g", "tree"]
    split = pairs.join(placed, "a").select("shared", "g", F.pmod(F.xxhash64("b"), F.col("trees")).cast("int").alias("tree"), "b").distinct()
    stored = split.join(sets.select(F.col("c").alias("b"), "items"), "b").select(*(F.col(x).alias(f"{x}_") for x in by), "b", F.col("items").alias("items_"))
    probes = placed.select("a", "shared", "g", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree")).join(sets.select(F.col("c").alias("a"), "items"), "a").select(*by, "a", "items")

    def test(partner: pa.Table, probe: pa.Table) -> pa.Table:
        x = y = np.zeros(0, np.int64)
        if partner.num_rows and probe.num_rows:
            i, j = PrefixTree(_unpacked(partner, "items_"), num, den).similar(_unpacked(probe, "items"))
            x, y = _spanning(probe.column("a").to_numpy()[i], partner.column("b").to_numpy()[j])
        return pa.table({"a": pa.array(x), "b": pa.array(y)})

    # names of its own for each side: both come from the same tables
    return stored.groupBy(*(f"{x}_" for x in by)).cogroup(probes.groupBy(*by)).applyInArrow(test, "a long, b long")


def _merged(fresh: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """c, label (the least c of its group) of all classes with links, after these links; components are found of groups."""
    ends = fresh.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    if labels is None:
        roots = connected_components(fresh, scratch, "a", "b")
        return roots.select(F.col("node").alias("c"), "label")
    base = scratch.keep(labels.unionByName(ends.join(labels, "c", "left_anti").withColumn("label", F.col("c"))))
    lifted = fresh.join(base.select(F.col("c").alias("a"), F.col("label").alias("x")), "a").join(base.select(F.col("c").alias("b"), F.col("label").alias("y")), "b")
    roots = connected_components(lifted.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), scratch, "x", "y")
    return base.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("c", F.coalesce("root", "label").alias("label"))


def _degrees(labels: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """c, n_links of all classes with links: how many other classes each is similar to."""
    many = labels.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))
    members = scratch.keep(labels.join(many, "label").join(sets.drop("size"), "c"), hashes=True)
    small = max(1, -(-members.where("m = 1").count() // BLOCK))
    alone = F.col("m") == 1
    chunk = F.when(alone, F.lit(0)).otherwise(F.pmod(F.xxhash64("c"), F.col("m")).cast("int"))
    placed = members.select(F.when(alone, F.pmod(F.xxhash64("label"), F.lit(small))).otherwise(F.col("label")).alias("g"), alone.alias("alone"), chunk.alias("own"), "m", "label", "c", "items")
    left = placed.select("g", "alone", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("m") - 1)).alias("j"), "label", "c", "items")
    right = placed.where("own > 0").select("g", "alone", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), F.col("own").alias("j"), "label", "c", "items")

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        names, n = [], []
        if a.num_rows and a.column("i")[0].as_py() == a.column("j")[0].as_py():
            own, c, label = _unpacked(a, "items"), a.column("c").to_numpy(), a.column("label").to_numpy()
            order = np.argsort(label, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                group = [own[x] for x in at]
                which, _ = PrefixTree(group, num, den).similar(group)
                names.append(c[at]), n.append(np.bincount(which, minlength=len(at)) - 1)
        elif a.num_rows and b.num_rows:
            right, left = PrefixTree(_unpacked(a, "items"), num, den).similar(_unpacked(b, "items"))
            names += [a.column("c").to_numpy(), b.column("c").to_numpy()]
            n += [np.bincount(left, minlength=a.num_rows), np.bincount(right, minlength=b.num_rows)]
        none = np.zeros(0, np.int64)
        return pa.table({"c": pa.array(np.concatenate([none, *names])), "n": pa.array(np.concatenate([none, *n]).astype(np.int64))})

    by = ["g", "alone", "i", "j"]
    counted = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(count, "c long, n long")
    out = scratch.keep(counted.groupBy("c").agg(F.sum("n").alias("n_links")))
    scratch.drop(members)
    scratch.free()
    return out


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 4, den: int = 5, count_links: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """key, n_shingles, component_id (the smallest id reachable by links), n_links (all links of the row's class to other
    classes) for every row; n_links only with count_links. Similar: Jaccard >= num / den."""
    scratch = scratch or Scratch(docs.sparkSession)
    # the sample holds the whole prefix of all but short sets, with room to put the frequent last
    sample = min(65536, int(65536 * 2.2 * (1 - num / den)))
    sets = scratch.keep(_sets(docs, key, text, k, num, den, sample), hashes=True)
    rows = scratch.keep(sets.select("id", "n", "c"))
    classes = scratch.keep(sets.where("n > 0").groupBy("c").agg(F.min("id").alias("id"), F.min("t").alias("t")))
    # one row of each class: that of its least id, or of one of the texts if no row of it has an id
    least = classes.select("c", F.col("id").alias("least"), F.col("t").alias("least_t"))
    named = sets.where("n > 0 and id is not null").join(least, "c").where("id = least")
    unnamed = sets.where("n > 0 and id is null").join(least.where("least is null"), "c").where("t = least_t").dropDuplicates(["c"])
    reps = scratch.keep(named.unionByName(unnamed).drop("least", "least_t", "t"), hashes=True)
    scratch.drop(sets)
    scratch.free()

    prefix = (F.col("n") - F.expr(f"(n * {num}L + {den - 1}L) div {den}L") + 1).cast("int")
    each = reps.select("c", F.explode("items").alias("h"))
    counts = scratch.keep(each.groupBy("h").agg(F.count("*").alias("f")).where("f > 1"))
    scratch.free()
    # of a class the elements that others have: by rarity they follow those that none has
    shared = each.join(counts, "h").groupBy("c").agg(F.sort_array(F.collect_set(F.struct("f", "h"))).alias("shared"))
    sizes = reps.select("c", "n", prefix.alias("p"), F.size("items").alias("u"), "more").dropDuplicates(["c"])
    placed = sizes.join(shared, "c", "left").withColumn("alone", F.col("u") - F.coalesce(F.size("shared"), F.lit(0)))
    first = F.transform(F.slice(F.coalesce("shared", F.array().cast("array<struct<f:bigint,h:bigint>>")), F.lit(1), F.greatest(F.lit(0), F.col("p") - F.col("alone"))), lambda x, i: F.struct(x["h"].alias("h"), (F.col("alone") + i).alias("r")))
    rest = F.transform("more", lambda x, i: F.struct(x.alias("h"), (F.col("u") + i).alias("r")))
    meet = placed.select("c", "n", F.explode(F.concat(first, rest)).alias("x")).select("x.h", "c", "n", "x.r")
    meet = scratch.keep(meet, hashes=True)
    scratch.drop(counts)
    scratch.free()
    several = meet.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h")
    meet, all_of = scratch.keep(meet.join(several, "h"), hashes=True), meet
    scratch.drop(all_of)
    wanted = meet.select("c").distinct().join(classes, "c").select("id", "t")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    known = texts.join(wanted.where("id is not null").select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    others = texts.where("id is null").withColumn("t", F.xxhash64("text")).join(wanted.where("id is null").select("t").distinct(), "t", "left_semi").dropDuplicates(["t"])
    full = _sets(known.unionByName(others.select("id", "text")), "id", "text", k, num, den, None)
    full = scratch.keep(full.join(meet.select("c").distinct(), "c", "left_semi").dropDuplicates(["c"]).select("c", F.size("items").cast("long").alias("size"), "items"), hashes=True)
    scratch.free()

    # at the first element that two sets share all of the overlap is still to come; pairs are met there or nowhere
    near = F.expr(f"{den}L * least(n, hub.n) >= {num}L * greatest(n, hub.n) and {num + den}L * least(n - r, hub.n - hub.r) >= {num}L * (n + hub.n)")
    parities = reps.select("c", "bits").dropDuplicates(["c"])
    tested = docs.sparkSession.createDataFrame([], "a long, b long")
    labels, spent = None, [reps, meet]
    width = np.log(den / num)
    for turn, shift in enumerate(TURNS):
        now = meet.withColumn("label", F.col("c")) if labels is None else meet.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
        mixed = now.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h")
        now = scratch.keep(now.join(mixed, "h"))
        spent += [now]
        if now.isEmpty():
            break
        if shift == "all":
            now = now.join(parities, "c")
            other = now.select("h", F.col("label").alias("label_"), F.struct("c", "n", "r", "bits").alias("hub"))
            unlike = sum(F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("hub.bits", F.lit(i)))) for i in range(PARITY))
            likely = (num + den) * unlike.cast("long") <= (den - num) * (F.col("n") + F.col("hub.n"))
            pairs = now.join(other, "h").where((F.col("label") < F.col("label_")) & near & likely)
            pairs = pairs.select(F.least("c", "hub.c").alias("a"), F.greatest("c", "hub.c").alias("b"))
        else:
            band = F.lit(0) if shift is None else F.floor(F.log(F.col("n").cast("double")) / width + shift)
            # one class of each group and band at a meeting point, and the least of them as the hub, in an order of each turn
            one = now.groupBy("h", band.alias("band"), "label").agg(F.min(F.struct(F.xxhash64("c", F.lit(turn)).alias("o"), "c", "n", "r")).alias("x"))
            hub = one.groupBy("h", "band").agg(F.min("x").alias("hub"), F.count("*").alias("many")).where("many > 1")
            pairs = one.join(hub, ["h", "band"]).select("hub", "x.*").where((F.col("c") != F.col("hub.c")) & near)
            pairs = pairs.select(F.col("hub.c").alias("a"), F.col("c").alias("b"))
        pairs = scratch.keep(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        spent += [pairs]
        if pairs.isEmpty():
            continue
        fresh = scratch.keep(_verified(pairs, full, num, den, scratch).distinct())
        scratch.free()
        tested = tested.unionByName(pairs)
        if not fresh.isEmpty():
            labels, before = scratch.keep(_merged(fresh, labels, scratch)), labels
            spent += [fresh, before]
            scratch.free()
    scratch.drop(*spent)
    if labels is None:
        return rows.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), "c").join(classes.withColumnRenamed("id", "least"), "c", "left").select(key, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col(key)).alias("component_id"), *([F.lit(0).cast("long").alias("n_links")] if count_links else []))
    named = classes.join(labels, "c", "left").select("c", "id", F.coalesce("label", "c").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.join(least, "label").select("c", "component_id")
    if count_links:
        named = named.join(_degrees(labels, full, num, den, scratch), "c", "left")
    scratch.drop(full)
    out = rows.join(named, "c", "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []))
