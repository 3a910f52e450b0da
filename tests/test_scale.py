"""Hot blocks, names, chains and stars: results against brute force, and how much work they take."""

import itertools
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.operators import blocking, entities, matching, near_names, patterns, quality, sampling
from kinfold.operators.components import connected_components
from kinfold.plans import registry
from kinfold.scratch import Scratch
from kinfold.sources.companies import company_records


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


#: One host has a third of all records, one name too; values are null or occur twice.
NAMES = ["acme global", "acme globel", "acme  globl", "acme", "bolt", "acme global", None, "straße nord", "strasse nord", "acme global inc"]
RECORDS = [(f"r{i:03d}", NAMES[i % 10] if i % 3 else "acme global", "hot.com" if i % 3 == 0 else (f"h{i % 5}.com" if i % 7 else None), None if i % 4 else "rome", None if i % 11 == 0 else ("us", "de")[i % 2]) for i in range(90)]


@pytest.fixture(scope="module")
def prep(spark):
    return Scratch(spark).keep(matching.prepare(spark.createDataFrame(RECORDS, "record_id string, name string, website string, city string, country_code string").repartition(3)))


def ids(df):
    return Counter((r.record_id_l, r.record_id_r) for r in df.select("record_id_l", "record_id_r").collect())


def plain(prep, meet):
    rows = sorted(prep.collect(), key=lambda r: r.record_id)
    return Counter((a.record_id, b.record_id) for a, b in itertools.combinations(rows, 2) if meet(a, b))


same_host = lambda a, b: a.host is not None and a.host == b.host
same_prefix = lambda a, b: None not in (a.name_prefix, a.country_norm) and (a.name_prefix, a.country_norm) == (b.name_prefix, b.country_norm)
same_name = lambda a, b: None not in (a.name_norm, a.country_norm) and (a.name_norm, a.country_norm) == (b.name_norm, b.country_norm)
near = lambda a, b: None not in (a.name_norm, b.name_norm) and min(len(a.name_norm), len(b.name_norm)) >= 6 and levenshtein(a.name_norm, b.name_norm) <= 2


@pytest.mark.parametrize("tile", [4, 16, blocking.TILE])
def test_tiled_blocks_have_the_pairs_of_whole_blocks(prep, tile):
    assert ids(matching.block_host(prep, tile=tile)) == plain(prep, same_host)
    assert ids(matching.candidate_pairs(prep, tile=tile)) == plain(prep, lambda a, b: same_host(a, b) or same_prefix(a, b))
    pairs = matching.candidate_pairs(prep, tile=tile).collect()
    assert all(r.host_l == r.host_r if r.match_key == "host" else r.name_prefix_l == r.name_prefix_r for r in pairs)


@pytest.mark.parametrize("tile", [4, blocking.TILE])
def test_levels_known_before_sides_are_in_order(prep, tile):
    """The levels of all candidate pairs, and those of one disposition without the others."""
    rows = lambda df: Counter(map(tuple, df.collect()))
    plain = matching.compare(matching.candidate_pairs(prep, tile=tile)).select("record_id_l", "record_id_r", *matching.GAMMAS)
    assert rows(matching.compared_pairs(prep, tile=tile)) == rows(plain)
    of_kind = {k: matching.compared_pairs(prep, tile=tile, model=matching.FIXED, disposition=k) for k in ("match", "review")}
    scored = matching.score(plain, matching.FIXED)
    assert all(rows(df) == rows(scored.where(F.col("disposition") == k).select(*df.columns)) for k, df in of_kind.items())


def test_review_queue_compares_names_once_a_pair(spark, sf_dir):
    """A filter of dispositions was planned with a comparison of names for each of its thresholds and levels."""
    plan = registry.QUERIES["review_queue"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("levenshtein(") <= 8


def test_no_two_tiles_make_more_pairs_than_they_should(spark):
    df = spark.range(3000).select(F.format_string("r%05d", "id").alias("record_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 97)).alias("block"))
    cut, n = blocking._small_enough(blocking.block_counts(df, ("block",)).where("n > 64").select("block", blocking._tiles_of(F.col("n"), 64).alias("_tiles")))
    sizes = blocking._numbered(df, cut, ("block",), "_tiles", "record_id", "_own").groupBy("block", "_own").count()
    assert n == 1 and sizes.agg(F.max("count")).first()[0] <= 64
    got = blocking.self_pairs(df, ("block",), ("record_id",), tile=64)
    assert got.count() == got.distinct().count() == 1000 * 999 // 2 + sum(k * (k - 1) // 2 for k in Counter(i % 97 for i in range(3000) if i % 3).values())
    assert got.where("record_id_l >= record_id_r").count() == 0
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_odd_rows(spark):
    rows = [("a", "x"), ("b", "x"), ("b", "x"), (None, "x"), (None, "x"), ("c", None), ("d", None), ("e", "y")]
    df = spark.createDataFrame(rows, "record_id string, block string")
    for tile in (2, 100):
        assert ids(blocking.self_pairs(df, ("block",), ("record_id",), tile=tile)) == {("a", "b"): 2}
        assert blocking.self_pairs(df.limit(0), ("block",), ("record_id",), tile=tile).count() == 0


def test_tiled_join(spark):
    left = spark.createDataFrame([(i, "hot" if i < 50 else f"k{i}") for i in range(70)] + [(99, None)], "a long, k string")
    right = spark.createDataFrame([(i, "hot" if i < 40 else f"k{i + 10}") for i in range(70)] + [(99, None)], "b long, k string")
    want = Counter(map(tuple, left.join(right, "k").collect()))
    for tile in (3, 10, 1000):
        assert Counter(map(tuple, blocking.tiled_join(left, right, ("k",), "a", "b", tile).select("k", "a", "b").collect())) == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names=st.lists(st.text("abé𝒳 ", min_size=0, max_size=11), min_size=2, max_size=40, unique=True))
def test_near_names_against_all_pairs(spark, names):
    df = spark.createDataFrame([("h", n, 1) for n in names] + [(None, "abcdefg", 1), ("g", None, 1)], "host string, name_norm string, n long")
    got = {(r.name_l, r.name_r): r.distance for r in near_names.near_names(df, ("host",), tile=8).collect()}
    pairs = [(min(a, b, key=str.encode), max(a, b, key=str.encode)) for a, b in itertools.combinations(names, 2) if min(len(a), len(b)) >= 6]
    assert got == {p: d for p in pairs if (d := levenshtein(*p)) <= 2}


def test_near_names_of_a_large_host_compare_few(spark):
    rng = random.Random(7)
    names = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(8, 20))) for _ in range(3000)}
    names |= {n[:3] + "#" + n[4:] for n in sorted(names)[:300]}
    df = Scratch(spark).keep(spark.createDataFrame([("h", n, 1) for n in sorted(names)], "host string, name_norm string, n long"))
    met = near_names.candidates(df, ("host",)).count()
    assert near_names.near_names(df, ("host",)).count() >= 300 and met < len(names) * (len(names) - 1) // 2 // 100


def test_near_names_meet_as_numbers(spark, monkeypatch):
    """Rows that meet are as narrow for long names and hosts, and names that only share a part are told apart by their letters."""
    names = [f"{'long ' * 20}{a}{'name ' * 20}" for a in ("abcdefgh", "abcdefgi", "zyxwvuts")] + ["x", None]
    df = spark.createDataFrame([(h, n, 1) for h in ("h" * 100, "g", None) for n in names], "host string, name_norm string, n long")
    met, join = [], blocking.tiled_join

    def seen(left, right, *args):
        met.extend((left, right))
        return join(left, right, *args)

    monkeypatch.setattr(blocking, "tiled_join", seen)
    got = near_names.near_names(df, ("host",), tile=2).collect()
    assert sorted((r.host, r.name_l, r.name_r, r.distance) for r in got) == [(h, names[0], names[1], 1) for h in ("g", "h" * 100)]
    assert len(met) == 2 and all({t for _, t in side.dtypes} == {"bigint"} for side in met)
    assert near_names.candidates(df, ("host",), tile=2).select("name_l", "name_r").distinct().count() == 2


@pytest.mark.parametrize("tile", [4, blocking.TILE])
def test_deterministic_pairs_and_their_number(prep, tile):
    want = plain(prep, lambda a, b: (same_host(a, b) and near(a, b)) or same_name(a, b))
    assert ids(matching.deterministic_pairs(prep, tile=tile)) == want
    assert matching.deterministic_count(prep, tile=tile).first()[0] == sum(want.values())
    assert matching.deterministic_count(prep.limit(0)).first()[0] == 0


def test_counts_of_pairs_without_pairs(prep):
    got = {r.rule: (r.n_pairs, r.n_new) for r in matching.distinct_pair_counts(prep).collect()}
    pairs = Counter(r.match_key for r in matching.candidate_pairs(prep).collect())
    assert {k: v[1] for k, v in got.items()} == pairs
    assert got["prefix_country"][0] == matching.block_prefix_country(prep).count() > got["prefix_country"][1]
    total = sum(pairs.values())
    matching.check_blocks(prep, 1000, total, distinct=True)
    for n, distinct in ((total, False), (total - 1, True)):
        with pytest.raises(ValueError, match="pairs"):
            matching.check_blocks(prep, 1000, n, distinct=distinct)
    assert {tuple(r) for r in matching.distinct_pair_counts(prep.limit(0)).collect()} == {("host", 0, 0), ("prefix_country", 0, 0)}


def test_patterns_from_classes(spark, prep):
    distinct = Scratch(spark).keep(matching.classes(prep))
    assert distinct.count() < prep.count() and matching.pattern_counts(distinct.limit(0)).count() == 0
    assert patterns.block_patterns(distinct, ("name_norm", "country_norm")) == {tuple(r[:4]): r.n for r in matching.gamma_patterns(matching.compare(matching.block_name_country(prep))).collect()}
    want = {tuple(r[:4]): r.n for r in matching.gamma_patterns(matching.compare(matching.candidate_pairs(prep))).collect()}
    denied = {tuple(r[:4]): r.n for r in matching.gamma_patterns(matching.compare(matching.candidate_pairs(prep, ("hot.com",)))).collect()}
    assert {tuple(r[:4]): r.n for r in matching.pattern_counts(distinct, ("hot.com",)).collect()} == denied != want
    for tile in (3, blocking.TILE):
        assert {tuple(r[:4]): r.n for r in matching.pattern_counts(distinct, tile=tile).collect()} == want


def test_training_against_em_over_pairs(spark, sf_dir):
    """The whole training again: every pair by itself, in numpy, levels that no pair shows at their priors."""
    import numpy as np

    prep = Scratch(spark).keep(matching.prepare(company_records(spark, sf_dir)))
    model = matching.train(prep)
    names, found = list(matching.COMPARISONS), {c: [] for c in matching.COMPARISONS}
    assert model.mode == "em"
    for pairs, held in ((matching.block_host(prep), ("host",)), (matching.block_name_country(prep), ("name", "country"))):
        g = np.array([tuple(r) for r in matching.compare(pairs).select(*matching.GAMMAS).collect()])
        lam = min(model.lam * np.prod([matching.PRIORS.m[c][-1] / model.u[c][-1] for c in held]), 0.5)
        m = {c: np.array(matching.PRIORS.m[c]) for c in names if c not in held}
        shown = {c: np.array([(g[:, names.index(c)] == k).any() for k in matching.COMPARISONS[c]]) for c in m}
        for _ in range(25):
            yes, no = np.full(len(g), lam), np.full(len(g), 1 - lam)
            for c in m:
                x, known = g[:, names.index(c)], g[:, names.index(c)] >= 0
                yes[known] *= m[c][x[known]]
                no[known] *= np.array(model.u[c])[x[known]]
            p, before = yes / (yes + no), m
            lam, m = min(max(p.mean(), 1e-6), 1 - 1e-6), {}
            for c in before:
                mass = np.array([p[g[:, names.index(c)] == k].sum() for k in matching.COMPARISONS[c]])
                room = 1 - np.array(matching.PRIORS.m[c])[~shown[c]].sum()
                m[c] = np.where(shown[c], np.clip(room * mass / mass.sum(), 1e-6, 1 - 1e-6), matching.PRIORS.m[c]) if mass.sum() else before[c]
            if max(np.abs(m[c] - before[c]).max() for c in m) < 0.01:
                break
        for c in m:
            found[c].append((m[c], shown[c]))
    for c in names:
        assert np.allclose(model.m[c], np.mean([x for x, _ in found[c]], axis=0), atol=1e-9)
        hidden = ~np.any([s for _, s in found[c]], axis=0)
        assert {f"{c}:{k}" for k in np.flatnonzero(hidden)} == {x for x in model.unseen if x.startswith(f"{c}:")}
    table = {(r.comparison, r.level): r.trained for r in matching.parameters(model, spark).collect()}
    assert {f"{c}:{k}" for (c, k), ok in table.items() if not ok} == set(model.unseen)


@pytest.mark.parametrize("kind", ["chain", "star", "both"])
def test_components_shrink(spark, kind):
    """A chain and a star of 10 ** 5 nodes: no round has more than the one before, and all of them a few times the first."""
    n = 100_000
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    star = spark.range(1, n).select(F.lit(n // 2 + n if kind == "both" else n // 2).cast("long").alias("src"), (F.col("id") + (n if kind == "both" else 0)).alias("dst"))
    edges = {"chain": chain, "star": star, "both": chain.union(star)}[kind]
    report = []
    got = connected_components(edges, report=report)
    labels = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert labels == {"chain": {0: n}, "star": {1: n - 1}, "both": {0: n, n + 1: n - 1}}[kind]
    assert len(report) <= 30 and all(b[0] < a[0] and b[1] < a[1] for a, b in itertools.pairwise(report))
    assert sum(n for n, _ in report) <= 5 * report[0][0] and sum(e for _, e in report) <= 5 * report[0][1]


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((40, 30), (300, 280)):
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [("loop", "loop"), (None, "x"), ("y", None)]
        of = {}

        def find(x, of=of):
            while of.setdefault(x, x) != x:
                x = of[x]
            return x

        for a, b in edges:
            if a and b:
                a, b = find(a), find(b)
                of[max(a, b)] = min(a, b)
        got = connected_components(spark.createDataFrame(edges, "src string, dst string"))
        assert {r.node: r.label for r in got.collect()} == {x: find(x) for x in of}


def test_word_prefix_parents(spark):
    """Names that share their first letters, several of a name, spaces at the ends, nulls: against all pairs."""
    rng = random.Random(5)
    words = ["north", "northern", "south", "a", "trade"]
    names = ["northern " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(150)] + ["northern", " northern trade ", "northern trade  x", None, "a b", "x" * 9, "x" * 9 + " " + "y " * 500]
    rows = [(f"g{i:03d}", n, rng.choice(["us", "de", None]), None if i % 3 else "p1") for i, n in enumerate(names)]
    reps = spark.createDataFrame(rows, "golden_entity_id string, name_norm string, country_norm string, host_parent_id string")
    want = {}
    for g, n, c, host in rows:
        fits = [(len(p), q) for q, p, d, _ in rows if None not in (n, c, p) and c == d and g != q and len(p) >= 8 and n.startswith(p + " ")]
        if fits and host is None:
            want[g] = min(fits)[1]
    assert {r.golden_entity_id: r.name_parent_id for r in entities.name_parents(reps).collect()} == want and len(want) > 50
    assert entities.name_parents(reps.limit(0)).count() == 0


def test_threshold_sample(spark):
    df = spark.range(9000).select(F.format_string("r%d", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("record_id"), F.col("id").alias("n")).repartition(5)
    order = sampling.hash_order(42, "record_id")
    ranked = [r.record_id for r in df.orderBy(order).select("record_id").collect()]
    for n in (1, 500, 2500, 4500, 8999, 9000, 20_000):
        got = [r.record_id for r in sampling.threshold_sample(df, n).collect()]
        assert Counter(got) == Counter(ranked[:n])
    assert sampling.threshold_sample(df, 0.5).count() == 4500 and sampling.threshold_sample(df.limit(0), 5).count() == sampling.threshold_sample(df.limit(0), 0.5).count() == 0
    unique = spark.range(30_000).select(F.col("id").cast("string").alias("record_id"))
    a, b = (Counter(r.record_id for r in x.collect()) for x in (sampling.hash_sample(unique, 12_000), unique.orderBy(order, "record_id").limit(12_000)))
    assert a == b


def test_pairs_of_a_sample(spark):
    df = spark.range(60).select(F.format_string("r%02d", "id").alias("record_id"), F.lit("x").alias("name_norm"))
    pair = lambda r: tuple(sorted((r.record_id_l, r.record_id_r)))
    for n in (0, 1, 2, 3, 4, 7, 8, 60):
        got = Counter(map(pair, sampling.sample_pairs(df.limit(n)).collect()))
        assert len(got) == n * (n - 1) // 2 and set(got.values()) <= {1}
    for most in (10, 59, 60, 200):
        got = Counter(map(pair, sampling.sample_pairs(df, most).collect()))
        assert most <= sum(got.values()) <= max(most + 60, most) and set(got.values()) == {1} and all(a != b for a, b in got)
    drawn = Counter(x for p in (pair(r) for s in range(20) for r in sampling.sample_pairs(df, 30, s).collect()) for x in p)
    assert len(drawn) == 60 and max(drawn.values()) <= 45  # 20 on average


def test_levels_of_sampled_names_are_near_the_exact_ones(spark):
    prep = Scratch(spark).keep(matching.prepare(company_records(spark, "/root/testdata/sf0.01")))
    exact = {r.g_name: r.share for r in matching.u_name_levels(prep).collect()}
    some = {r.g_name: r.share for r in matching.u_name_levels(prep, 5000).collect()}
    assert abs(sum(exact.values()) - 1) < 1e-12 and all(abs(exact[g] - some.get(g, 0)) <= 4 * (exact[g] / 5000) ** 0.5 + 1e-9 for g in exact)
    assert matching.u_name(prep.limit(0)) == (1e-6,) * 4


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan parquet"), plan


def test_the_profile_is_one_scan(spark, sf_dir):
    n, plan = scans(registry.QUERIES["dq_summary"](spark, sf_dir))
    assert n == 1 and "Join" not in plan
    n, plan = scans(registry.QUERIES["normalize_keys"](spark, sf_dir))
    assert n == 1 and "Exchange" not in plan


def test_profile_of_odd_tables(spark):
    rows = [("r1", "Acme Inc", None, 1), ("r2", "acme", " ", 1), ("r3", "acme", " ", 1), ("r4", None, "a.com", None), ("r5", None, "a.com", None), ("r6", "", "b.com", 2)]
    df = spark.createDataFrame(rows, "record_id string, name string, website string, value int").withColumn("country_code", F.lit(None).cast("string"))
    got = {r.metric: r.value for r in quality.summary(df).collect()}
    rates = {f"null_rate_{r.column_name}": r.null_rate for r in quality.null_rates(df).collect()}
    assert got["row_count"] == 6 and got["exact_duplicate_rows"] == quality.exact_duplicates(df).first()[0] == 4 and rates.items() <= got.items()
    for name, key in quality.local_keys().items():
        assert (got[f"{name}_groups_ge_2"], got[f"{name}_records_in_groups_ge_2"]) == tuple(quality.collision_stats(df, key).first())
    empty = {r.metric: r.value for r in quality.summary(df.limit(0)).collect()}
    assert empty["row_count"] == empty["host_groups_ge_2"] == 0 and empty["null_rate_name"] is None and set(empty) == set(got)
    assert quality.null_rates(df.select("value")).count() == 0


def test_reviews_show_what_was_matched(spark, prep):
    golden = prep.select("record_id", F.lit("g1").alias("golden_entity_id"))
    shown = entities.cluster_review(golden, prep, masked=False, limit=5).collect()
    assert len(shown) == 5 and set(shown[0].asDict()) == {"golden_entity_id", "cluster_size", "record_id", "name_norm", "host", "country_norm"} and shown[0].cluster_size == 90
    masked = entities.cluster_review(golden, prep, limit=5).collect()
    assert all(r.name_hash is None or r.name_hash.startswith("hash:") for r in masked)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"verify_hierarchy"}))
def test_plans_are_native(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "Python", "Pandas", "MapInArrow"))
