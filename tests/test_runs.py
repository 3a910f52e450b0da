"""The commands, and the runs with their guards."""

import json

import pytest
from pyspark.sql import functions as F

from kinfold.__main__ import main
from kinfold.operators import matching as M
from kinfold.plans import runs
from kinfold.sources import companies, tables
from kinfold.sources.companies import company_records

HEAD = ",".join(companies.SOURCE_COLUMNS)


def csv_file(path, rows):
    cells = lambda i: ",".join({"handle": f"h{i}", "name": f'"Acme, {i % 3}\n Inc"', "website": f"https://a{i % 4}.example.org", "country_code": "us"}.get(c, "") for c in companies.SOURCE_COLUMNS)
    path.write_text("\n".join([HEAD, *map(cells, range(rows))]) + "\n")
    return path


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    source = csv_file(tmp_path / "in.csv", 12)
    size, digest = source.stat().st_size, tables.sha256_file(source)
    assert main(["smoke"]) == 0 and "rows=10" in capsys.readouterr().out
    assert main(["obtain", "--input", "in.csv", "--size", str(size), "--sha256", digest]) == 0
    assert main(["obtain", "--input", "in.csv", "--size", "1", "--sha256", digest]) == 1
    assert main(["sample", "--input", "in.csv", "--output", "out", "--meta", "meta.json", "--n", "5"]) == 0
    meta = json.loads((tmp_path / "meta.json").read_text())
    assert (meta["n_requested"], meta["n_written"], meta["rows_total"], meta["source_sha256"]) == (5, 5, 12, digest) and meta["columns"] == list(companies.COLUMNS)
    written = companies.read_local_csv(spark, str(tmp_path / "out"))
    assert written.columns == list(companies.COLUMNS) and written.select("record_id").distinct().count() == 5
    assert companies.with_record_ids(written) is written
    assert main(["obtain", "--input", "in.csv", "--size", str(size), "--sha256", digest, "--output", "copy/in.csv"]) == 0
    copied = (tmp_path / "copy" / "in.csv").stat().st_mtime_ns
    assert main(["obtain", "--input", "gone.csv", "--size", str(size), "--sha256", digest, "--output", "copy/in.csv"]) == 0
    assert (tmp_path / "copy" / "in.csv").stat().st_mtime_ns == copied
    assert main(["obtain", "--input", "gone.csv", "--size", str(size), "--sha256", digest, "--output", "copy/in.csv", "--force"]) == 1
    capsys.readouterr()
    assert main(["sample", "--input", "in.csv", "--output", "out", "--n", "0"]) == 1 and "positive" in capsys.readouterr().err
    assert main(["profile", "--input", "in.csv", "--output", "profile.json"]) == 0
    found = json.loads((tmp_path / "profile.json").read_text())
    assert found["columns"] == list(companies.SOURCE_COLUMNS) and found["metrics"]["row_count"] == 12 and found["countries"] == [["us", 12]]


def test_table_commands(spark, sf_dir, tmp_path, capsys, monkeypatch):
    """Sample, match, roll up and verify by tables, each in its role."""
    monkeypatch.chdir(tmp_path)
    db = "kin_commands"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{tmp_path / 'db'}'")
    raw, picked, golden, tree = (f"{db}.companies_{x}" for x in ("raw", "match_sample", "golden", "hierarchy"))
    try:
        assert tables.write_table(company_records(spark, sf_dir), raw).rows == company_records(spark, sf_dir).count()
        assert main(["match-sample", "--source", picked, "--output", raw]) == 1
        assert main(["match-sample", "--source", raw, "--output", picked, "--host-target", "40", "--name-target", "20", "--filler", "30", "--least-rows", "10"]) == 0
        assert main(["match", "--source", raw, "--golden", golden]) == 1 and "must not be used" in capsys.readouterr().err
        assert main(["match", "--source", picked, "--golden", golden, "--threshold", "0.5", "--prefix", "name_first4"]) == 0
        said = capsys.readouterr().out
        assert "hash:" in said or "max_size=1" in said
        assert main(["rollup", "--source", picked, "--golden", golden, "--hierarchy", tree]) == 0 and "parents=" in capsys.readouterr().out
        three = ["--source", picked, "--golden", golden, "--hierarchy", tree]
        assert main(["verify", *three, "--versions", "versions.json"]) == 0 and (tmp_path / "versions.json").is_file()
        assert main(["verify", *three, "--versions", "versions.json"]) == 0
        assert main(["verify", *three, "--frozen", "1,1,1"]) == 1 and "frozen_records" in capsys.readouterr().err
        assert main(["verify", "--source", raw, "--golden", golden, "--hierarchy", tree]) == 1
        tables.write_table(spark.createDataFrame([(r.record_id, r.golden_entity_id, "p") for r in spark.table(tree).collect()], spark.table(tree).schema), tree)
        assert main(["verify", *three, "--versions", "versions.json"]) == 1 and "hierarchy_unchanged" in capsys.readouterr().err
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_tables(spark, tmp_path):
    db = "kin_tables"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{tmp_path / 'db'}'")
    try:
        df = spark.createDataFrame([(1, "a"), (2, None)], "n long, x string")
        assert tables.write_table(df, f"{db}.one", ("n",)) == tables.Written(2, {"n": 0})
        with pytest.raises(ValueError, match="nulls in x"):
            tables.write_table(df, f"{db}.two", ("n", "x"))
        assert tables.write_table(df.select(F.col("n").alias("other")).limit(0), f"{db}.one").rows == 0
        assert tables.read_table(spark, f"{db}.one").columns == ["other"]
        assert tables.list_tables(spark, db) == ["one", "two"]
        assert tables.drop_prefixed(spark, "", db) == [] and tables.drop_prefixed(spark, "tw", db) == ["two"] and tables.list_tables(spark, db) == ["one"]
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_roles():
    tables.check_table_names(["main.my_companies_raw"], {"companies_raw"})
    tables.check_roles(("match_source", "a.b.companies_match_sample"), ("golden", "a.b.companies_golden"))
    for bad in ([("match_source", "a.companies_raw")], [("raw", "a.my_companies_raw")], [("golden", "x"), ("hierarchy", "x")], [("evaluated", "other")], [("golden", "tabl\u00e9")], [("golden", "a\n")], [("hierarchy", "companies_golden")]):
        with pytest.raises(ValueError):
            tables.check_roles(*bad)


def test_runs(spark, sf_dir):
    records = company_records(spark, sf_dir)
    wide = runs.Settings(max_group=1000)
    with pytest.raises(ValueError, match="a host with"):
        runs.match(records, runs.Settings(max_group=1))
    with pytest.raises(ValueError, match="pairs"):
        runs.match(records, runs.Settings(max_group=1000, max_pairs=1))
    with pytest.raises(ValueError, match="rows"):
        runs.match(records, runs.Settings(max_rows=3))
    with pytest.raises(ValueError, match="not unique"):
        runs.match(records.union(records), wide)
    with pytest.raises(ValueError, match="letters"):
        runs.Settings(prefix="name_last2").letters()
    scored, golden = runs.match(records, runs.Settings(max_group=1000, prefix="name_first4"), M.FIXED)
    tree = runs.rollup(records, golden, wide)
    with pytest.raises(ValueError, match="golden rows"):
        runs.rollup(records.limit(2), golden, wide)
    versions = {"golden": tables.fingerprint(golden)}
    assert all(r.ok for r in runs.verify(records, golden, tree, versions=versions).collect())
    changed = runs.verify(records, golden.withColumn("golden_entity_id", F.lit("x")), tree, versions=versions).collect()
    assert {r.check for r in changed if not r.ok} >= {"golden_unchanged"}
    assert [r.check for r in runs.verify(records, golden.drop("golden_entity_id"), tree).collect() if not r.ok] == ["golden_columns"]
    with pytest.raises(ValueError, match="expected"):
        runs.match_sample(records, host_target=4, name_target=4, filler=4)
    assert runs.match_sample(records, host_target=4, name_target=4, filler=4, least_rows=1).count() >= 4
