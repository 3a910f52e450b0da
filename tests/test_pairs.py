"""Pairs from rows that meet arrays, and pairs of one disposition that don't begin with whole blocks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinfold.operators import blocking, matching, near_names
from kinfold.plans import registry
from kinfold.scratch import Scratch


@pytest.mark.parametrize("name", ["comparison_vectors", "score_pairs_fixed"])
def test_pairs_come_of_unpacked_arrays(spark, sf_dir, name):
    """Each pair was a row of a join; joins make a row for each record and tile now. A name is compared by distance once."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline(_rows") == 2 and "name_couples" in plan


def test_couples_of_letters_within_two_edits(spark):
    rng, rows = random.Random(7), []
    for _ in range(400):
        a = "".join(rng.choice("abcé𝒳 ") for _ in range(rng.randint(1, 14)))
        b = list(a)
        for _ in range(2):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        rows.append((a, "".join(b)))
    bits = lambda c: near_names.couple_bits(F.col(c))
    df = spark.createDataFrame(rows, "a string, b string").where("b <> ''").select(F.bit_count(bits("a").bitwiseXOR(bits("b"))).alias("d"))
    assert df.agg(F.max("d")).first()[0] <= 2 * near_names.COUPLE_BITS


def test_pairs_with_a_first_row(spark):
    df = Scratch(spark).keep(spark.createDataFrame([(f"r{i:02d}", "hot" if i < 40 else f"b{i % 3}", i % 7 == 0) for i in range(60)], "record_id string, block string, odd boolean"))
    rows = df.collect()
    want = Counter((a.record_id, b.record_id) for a in rows for b in rows if a.record_id < b.record_id and a.block == b.block and (a.odd or b.odd))
    for tile in (4, 100):
        got = blocking.self_pairs(df, ("block",), ("record_id",), tile=tile, first=F.col("odd")).collect()
        assert Counter((r.record_id_l, r.record_id_r) for r in got) == want


def test_review_makes_no_pairs_of_whole_hosts(spark, sf_dir, monkeypatch):
    """Unlike names are for review only where host, country and city agree; of a whole host only rows without a name meet all."""
    seen, plain = [], matching.self_pairs
    monkeypatch.setattr(matching, "self_pairs", lambda df, on, *a, **k: seen.append((on, k.get("first"))) or plain(df, on, *a, **k))
    registry.QUERIES["review_queue"](spark, sf_dir)
    assert ("host", "country_norm", "city_norm") in [on for on, _ in seen]
    assert all(first is not None for on, first in seen if on == ("host",))


@pytest.mark.parametrize("tile", [3, blocking.TILE])
@pytest.mark.parametrize("kind", ["match", "review", "possible", "non_match"])
def test_each_disposition_alone(spark, tile, kind):
    """With hosts that are denied, names that are missing and near ones."""
    names = ["acme global", "acme globel", "acme", None, "acme globe", "bolt"]
    data = [(f"r{i:02d}", names[i % 6], ("hot.com", "x.com", None)[i % 3 % 2 if i < 20 else i % 3], (None, "rome", "oslo")[i % 5 % 3], ("us", None)[i % 4 == 3]) for i in range(48)]
    prep = Scratch(spark).keep(matching.prepare(spark.createDataFrame(data, "record_id string, name string, website string, city string, country_code string")))
    every = matching.score(matching.compare(matching.candidate_pairs(prep)).select("record_id_l", "record_id_r", *matching.GAMMAS), matching.FIXED)
    got = matching.compared_pairs(prep, tile=tile, model=matching.FIXED, disposition=kind)
    want = every.where(F.col("disposition") == kind).select(*got.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
