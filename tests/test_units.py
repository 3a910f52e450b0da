"""Normalisers on hand-written values, guards, components, training and plans."""

import pytest
from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.operators import entities, matching, quality, sampling
from kinfold.operators.components import connected_components
from kinfold.plans import registry
from kinfold.sources import companies, tables


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"))).first()[0]


def many(spark, make, cases):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, x string").select("i", make(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in rows] == list(cases.values())


def test_names(spark):
    many(spark, N.name_norm, {None: None, "": None, "  ": None, " Acme  Co ": "acme co", "\tAcme  Co\t": " acme co ", "Acmé": "acmé"})
    many(spark, N.name_norm_ingest, {"\tAcme  Co\t": "acme co", " ": None})
    many(spark, N.local_name, {"Acme, Inc.": "acme,", "inc": None, "Acme GmbH LLC": "acme", "Zinc": "zinc", None: None})


def test_hosts(spark):
    many(spark, N.host, {"http://www.acme.com/x": "acme.com", "acme.com?x=1": "acme.com?x=1", "ftp://acme.com/": "ftp:", "acme.com:80/y": "acme.com:80", "HTTPS://u@Acme.com": "u@acme.com", "/foo": None, "www.": None, "https://": None, " ": None, None: None})
    many(spark, N.local_host, {"ftp://acme.com/": "acme.com", "acme.com?x=1": "acme.com", "www.acme.com/a": "acme.com", None: None})
    many(spark, lambda c: N.eligible_host(c), {"linkedin.com": False, "x.wixsite.com": True, None: False})


def test_record_id_is_never_cut(spark):
    many(spark, lambda c: N.record_id(c.cast("long")), {"7": "r000000000007", "1234567890123": "r1234567890123"})


def test_name_levels(spark):
    rows = [("acme", "acme", 3), ("abcdef", "abcdeg", 2), ("abcde", "abcdx", 0), ("abcdefgh", "abcdefxy", 1), ("abcdefg", "abcdexy", 0), (None, "a", -1), ("éabcde", "eabcde", 2), ("abcdefgh", "zzzzzzzz", 0)]
    df = spark.createDataFrame([(a, b, g, None, None) for a, b, g in rows], "name_norm_l string, name_norm_r string, want int, h string, c string")
    for c in ("host", "country_norm", "city_norm"):
        df = df.withColumns({f"{c}_l": F.col("h"), f"{c}_r": F.col("c")})
    out = matching.compare(df).collect()
    assert all(r.g_name == r.want and r.g_host == r.g_country == r.g_city == -1 for r in out)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)]
    edges = [*chain, (1000, 1001), (1001, 1000), (1000, 1001), (2000, 2000), *((3000, 3001 + i) for i in range(50)), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    for parts in (1, 5):
        got = connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(parts))
        assert {r.node: r.label for r in got.collect()} == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id string, name string, website string, city string, country_code string")


def test_guards(spark):
    df = matching.prepare(records(spark, [(f"r{i}", f"acme {i}", "acme.com", None, "us") for i in range(5)]))
    matching.check_blocks(df, max_group=5, max_pairs=20)
    with pytest.raises(ValueError, match="a host with 5"):
        matching.check_blocks(df, max_group=4)
    with pytest.raises(ValueError, match="20 pairs"):
        matching.check_blocks(df, max_pairs=19)
    matching.check_source(df, 5)
    for bad, limit, text in ((df, 4, "5 rows"), (df.union(df), 0, "unique"), (df.withColumn("record_id", F.lit(None).cast("string")), 0, "null")):
        with pytest.raises(ValueError, match=text):
            matching.check_source(bad, limit)
    tables.check_table_names(["a.b.c", "c"])
    for names in (["a-b"], ["a.b.c.d"], ["a", "a"], [""]):
        with pytest.raises(ValueError):
            tables.check_table_names(names)
    for bad in ((1, 10), (2, 81), (5, 4), (2, 10, -1)):
        with pytest.raises(ValueError):
            sampling.check_parameters(*bad)
    with pytest.raises(ValueError):
        sampling.check_result(999)


def test_hierarchy(spark):
    rows = [("r1", "acme global", "http://acme.com", None, "us"), ("r2", "acme global group", None, None, "us"), ("r3", "acme global group east", "linkedin.com", None, "us"), ("r4", "short", None, None, "us"), ("r5", "short one", None, None, "us"), ("r6", "acme global", None, None, "de")]
    golden = spark.createDataFrame([(r[0], f"g{r[0]}") for r in rows], "record_id string, golden_entity_id string")
    prep = matching.prepare(records(spark, rows))
    got = {r.record_id: r.ultimate_parent_id for r in entities.hierarchy(golden, prep).collect()}
    assert got["r1"].startswith("p") and got["r2"] == got["r3"] == "gr1" and got["r4"] == "gr4" and got["r5"] == "gr5" and got["r6"] == "gr6"
    up = {r.record_id: r.ultimate_parent_id for r in entities.hierarchy(golden, prep, resolve_parent=True).collect()}
    assert up["r2"] == up["r1"] == got["r1"]


def test_em_finds_the_parameters_of_a_known_mixture():
    import itertools

    m, u, lam = ((0.1, 0.9), (0.2, 0.8), (0.3, 0.7)), ((0.9, 0.1), (0.8, 0.2), (0.95, 0.05)), 0.3
    base = matching.Model(lam, matching.PRIORS.m, {"name": matching.PRIORS.u["name"], **dict(zip(("host", "country", "city"), u, strict=True))})
    patterns = []
    for levels in itertools.product((0, 1), repeat=3):
        p = lam * m[0][levels[0]] * m[1][levels[1]] * m[2][levels[2]] + (1 - lam) * u[0][levels[0]] * u[1][levels[1]] * u[2][levels[2]]
        patterns.append(((0, *levels), p * 1e6))
    got, share = matching.em(patterns, base, ("name",), 0.1, 1e-9, 2000)
    assert abs(share - lam) < 1e-3 and all(abs(got[c][1] - x[1]) < 1e-3 for c, x in zip(("host", "country", "city"), m, strict=True))


def test_training_without_signal_gives_the_priors(spark):
    prep = matching.prepare(records(spark, [("r1", "a", None, None, None), ("r2", "b", None, None, None)]))
    assert matching.train(prep) == matching.PRIORS


def test_quality_of_odd_tables(spark):
    df = spark.createDataFrame([("r1", "a", None), ("r2", "a", None), ("r3", "a", None), ("r4", " ", "x")], "record_id string, name string, website string")
    assert quality.exact_duplicates(df).first()[0] == 3
    assert {r.column_name: r.null_rate for r in quality.null_rates(df).collect()} == {"name": 0.25, "website": 0.75}
    assert quality.exact_duplicates(df.limit(0)).first()[0] == 0


def test_samples_do_not_depend_on_partitions(spark, sf_dir):
    df = companies.company_records(spark, sf_dir)
    a, b = (sorted(r.record_id for r in sampling.hash_sample(df.repartition(n), 20).collect()) for n in (1, 7))
    assert a == b and len(set(a)) == 20
    with pytest.raises(ValueError):
        sampling.hash_sample(df, 0)


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([tuple(f"{c}{i}" for c in companies.SOURCE_COLUMNS) for i in range(3)], companies.SCHEMA)
    companies.write_csv(df.coalesce(1), str(tmp_path / "c"))
    assert sorted(map(tuple, companies.read_csv(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, df.collect()))
    assert companies.with_record_ids(df.union(df)).select("record_id").distinct().count() == 6
    df.select("name").write.option("header", True).csv(str(tmp_path / "d"))
    with pytest.raises(ValueError, match="missing columns"):
        companies.read_csv(spark, str(tmp_path / "d"))


@pytest.mark.parametrize("name", ["block_dedup_union", "comparison_vectors", "masked_hash", "normalize_local"])
def test_plans_stay_in_the_jvm_without_cartesian_products(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan
