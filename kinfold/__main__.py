"""python -m kinfold obtain | sample | profile | smoke | match-sample | match | rollup | verify: the commands. Only options that
are given are handed on."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import entities, matching, quality, sampling
from kinfold.plans import runs
from kinfold.sources import companies, tables


def session(master: str = "local[*]") -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def home() -> Path:
    """The nearest folder above that holds pyproject.toml and the package, else the present one."""
    here = Path.cwd()
    return next((p for p in (here, *here.parents) if (p / "pyproject.toml").is_file() and (p / "kinfold").is_dir()), here)


def obtain(input: str, size: int, sha256: str, output: str | None = None, force: bool = False) -> str:
    """Verifies the file, and copies it to output unless that is verified already; nothing is fetched, as this library has no
    network access."""
    return tables.exit_line(file=tables.obtain(home() / input, size, sha256, home() / output if output else None, force))


def sample(input: str, output: str, meta: str | None = None, n: int = 30_000, seed: int = 42, size: int | None = None, sha256: str | None = None) -> str:
    """n rows of a CSV file as CSV with record ids, and what they are as JSON. With size and sha256 the file is verified before.
    Rows are counted on their way."""
    if sha256:
        tables.obtain(home() / input, size, sha256)
    total, rows = Observation(), Observation()
    read = companies.read_local_csv(session(), str(home() / input)).observe(total, F.count(F.lit(1)).alias("n"))
    picked = runs.ingest(read, n, seed)[1].observe(rows, F.count(F.lit(1)).alias("n"))
    companies.write_csv(picked.select(*companies.COLUMNS), str(home() / output))
    if meta:
        tables.write_metadata(home() / meta, n_requested=n, n_written=rows.get["n"], rows_total=total.get["n"], seed=seed, source_path=input, source_sha256=tables.sha256_file(home() / input), output=output, columns=list(companies.COLUMNS))
    return tables.exit_line(rows=rows.get["n"], total=total.get["n"])


def profile(input: str, output: str) -> str:
    """The profile of a CSV file as JSON: columns, metrics, most frequent countries, masked examples."""
    df = companies.read_local_csv(session(), str(home() / input))
    found = {r.metric: r.value for r in quality.summary(companies.with_record_ids(df)).collect()}
    top = [[r.country_code, r.n] for r in quality.country_top(df).collect()]
    examples = {k: r.example if (r := quality.masked_example(df, key).first()) else None for k, key in quality.local_keys().items()}
    tables.write_metadata(home() / output, columns=df.columns, metrics=found, countries=top, examples=examples)
    return tables.exit_line(rows=int(found["row_count"]))


def smoke() -> str:
    """A session that counts ten rows and picks one."""
    spark = session("local[1]")
    return tables.exit_line(spark=spark.version, rows=spark.range(10).count(), picked=sampling.hash_sample(spark.range(10), 1, 42, "id").count())


def _settings(prefix: str | None, threshold: float | None, **limits: int | None) -> runs.Settings:
    given = {"prefix": prefix, "threshold": threshold, **limits}
    return runs.Settings(**{k: v for k, v in given.items() if v is not None})


def _shown(review: DataFrame) -> None:
    for row in review.collect():  # a report of 100 rows at most
        print("\t".join("" if x is None else str(x) for x in row))


def match_sample(source: str, output: str, host_target: int = 18_000, name_target: int = 12_000, filler: int = 10_000, seed: int = 42, least: int = 2, most: int = 10, least_rows: int = 1000, most_rows: int = 50_000) -> str:
    """The enriched sample of a table of raw companies as a table."""
    tables.check_roles(("raw", source), ("match_sample", output))
    sampling.check_parameters(least, most, host_target, name_target, filler)
    records = companies.with_record_ids(companies.require(session().table(source), companies.SOURCE_COLUMNS))
    picked = runs.match_sample(records, host_target=host_target, name_target=name_target, filler=filler, seed=seed, least=least, most=most, least_rows=least_rows, most_rows=most_rows)
    return tables.exit_line(rows=tables.write_table(picked, output, ("record_id",)).rows, output=output)


def match(source: str, golden: str, prefix: str | None = None, threshold: float | None = None, max_rows: int | None = None, max_group: int | None = None, max_pairs: int | None = None, unmask: bool = False) -> str:
    """Golden entities of a table of companies as a table, after the guards; shows the clusters, masked unless unmask is given."""
    tables.check_roles(("match_source", source), ("golden", golden))
    settings = _settings(prefix, threshold, max_rows=max_rows, max_group=max_group, max_pairs=max_pairs)
    records = companies.require(session().table(source), companies.COLUMNS)
    scored, found = runs.match(records, settings)
    _shown(entities.cluster_review(found, matching.prepare(records, settings.letters()), not unmask))
    rows = tables.write_table(found, golden, ("record_id", "golden_entity_id")).rows
    return tables.exit_line(rows=rows, **entities.cluster_stats(found).first().asDict(), **matching.histogram(scored).first().asDict(), golden=golden)


def rollup(source: str, golden: str, hierarchy: str, unmask: bool = False) -> str:
    """Ultimate parents of golden entities as a table; shows those of parents with several, masked unless unmask is given."""
    tables.check_roles(("match_source", source), ("golden", golden), ("hierarchy", hierarchy))
    spark = session()
    records, found = spark.table(source), spark.table(golden)
    tree = runs.rollup(records, found)
    _shown(entities.parent_review(tree, entities.representatives(found, matching.prepare(records)), not unmask))
    tables.write_table(tree, hierarchy, ("record_id", "golden_entity_id", "ultimate_parent_id"))
    return tables.exit_line(**entities.funnel(tree).first().asDict(), hierarchy=hierarchy)


def verify(source: str, golden: str, hierarchy: str, frozen: str | None = None, versions: str | None = None) -> str:
    """Checks of three tables; fails if one fails, or if a table changes meanwhile. frozen: three totals with commas between.
    versions: a JSON file of fingerprints by role; what it has must still hold, and if there is no such file it is written."""
    names = {"source": source, "golden": golden, "hierarchy": hierarchy}
    tables.check_roles(*(("evaluated", t) for t in names.values()))
    spark = session()
    prints = lambda: {role: list(tables.fingerprint(spark.table(t))) for role, t in names.items()}
    before, file = prints(), home() / versions if versions else None
    told = json.loads(file.read_text(encoding="utf-8")) if file and file.is_file() else before
    rows = runs.verify(*(spark.table(t) for t in names.values()), frozen=tuple(map(int, frozen.split(","))) if frozen else None, versions=told).collect()
    bad = [r.check for r in rows if not r.ok] + [f"{role}_moved" for role, now in prints().items() if now != before[role]]
    if bad:
        raise ValueError("failed: " + ", ".join(bad))
    if file and not file.is_file():
        tables.write_metadata(file, **before)
    return tables.exit_line(checks=len(rows))


_TABLES = {"--source": str, "--golden": str, "--hierarchy": str}
OPTIONS = {
    obtain: {"--input": str, "--size": int, "--sha256": str, "--output": str, "--force": None},
    sample: {"--input": str, "--output": str, "--meta": str, "--n": int, "--seed": int, "--size": int, "--sha256": str},
    profile: {"--input": str, "--output": str},
    smoke: {},
    match_sample: {"--source": str, "--output": str, **{f"--{x}": int for x in ("host-target", "name-target", "filler", "seed", "least", "most", "least-rows", "most-rows")}},
    match: {"--source": str, "--golden": str, "--prefix": str, "--threshold": float, "--max-rows": int, "--max-group": int, "--max-pairs": int, "--unmask": None},
    rollup: {**_TABLES, "--unmask": None},
    verify: {**_TABLES, "--frozen": str, "--versions": str},
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinfold", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for run, options in OPTIONS.items():
        sub = commands.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        for name, kind in options.items():
            sub.add_argument(name, **({"type": kind} if kind else {"action": "store_const", "const": True}))
    given = {k: v for k, v in vars(parser.parse_args(argv)).items() if v is not None}
    command = given.pop("command").replace("-", "_")
    run = next(f for f in OPTIONS if f.__name__ == command)
    try:
        print(run(**given))
    except (ValueError, TypeError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
