"""Tables, files, guards of names, and metadata."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# What a table's name may be, and the last parts of names that a role refuses or is confined to.
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}$")
ROLES: dict[str, tuple[set[str], set[str]]] = {  # role: refused, allowed (empty: any other)
    "raw": (set(), {"companies_raw"}),
    "match_sample": ({"companies_raw", "companies_sample", "companies_golden", "companies_hierarchy"}, set()),
    "match_source": ({"companies_raw", "companies_golden", "companies_hierarchy"}, set()),
    "golden": ({"companies_raw", "companies_sample", "companies_match_sample"}, set()),
    "hierarchy": ({"companies_raw", "companies_sample", "companies_match_sample", "companies_golden"}, set()),
    "evaluated": ({"companies_raw", "companies_sample"}, {"companies_match_sample", "companies_golden", "companies_hierarchy"}),
}


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_is_complete(path: str | Path, size: int, sha256: str) -> bool:
    p = Path(path)
    return p.is_file() and p.stat().st_size == size and sha256_file(p) == sha256


def obtain(path: str | Path, size: int, sha256: str, output: str | Path | None = None, force: bool = False) -> Path:
    """The verified file, copied to `output` unless that is verified already (force copies it again). Fetching it is left to the
    caller: this library has no network access."""
    if output and not force and file_is_complete(output, size, sha256):
        return Path(output)
    if not file_is_complete(path, size, sha256):
        raise ValueError(f"{path} is missing or not the file expected")
    if not output or Path(output).resolve() == Path(path).resolve():
        return Path(path)
    Path(output).parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(path, output)
    if not file_is_complete(output, size, sha256):
        raise ValueError(f"{output} was not copied whole")
    return Path(output)


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum over row hashes, in which equal rows don't cancel: stands for a version where tables have no history."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 61)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("x")).first()
    return row.n, row.x


def check_table_names(names: list[str], forbidden_suffixes: set[str] | tuple[str, ...] = (), allowed_suffixes: set[str] | tuple[str, ...] = ()) -> None:
    """Identifiers of one to three parts, all different as texts, whose last part, as a whole, is allowed."""
    for name in names:
        if not _NAME.fullmatch(name or ""):
            raise ValueError(f"not a table name: {name!r}")
        last = name.rpartition(".")[2]
        if last in forbidden_suffixes:
            raise ValueError(f"a table that must not be used: {name}")
        if allowed_suffixes and last not in allowed_suffixes:
            raise ValueError(f"not an expected table: {name}")
    if len(set(names)) != len(names):
        raise ValueError("table names must differ")


def check_roles(*names: tuple[str, str]) -> None:
    """(role, table name) of all tables of a run: each may have its role, and all differ."""
    for role, name in names:
        check_table_names([name], *ROLES[role])
    check_table_names([name for _, name in names])


def read_table(spark: SparkSession, name: str) -> DataFrame:
    check_table_names([name])
    return spark.table(name)


@dataclass(frozen=True)
class Written:
    """What was written: rows, and the nulls of the columns that were to have none."""

    rows: int
    nulls: dict[str, int]


def write_table(df: DataFrame, name: str, required: tuple[str, ...] = ()) -> Written:
    """Overwrites the table, its schema too, and fails loudly. Rows and the nulls of `required` columns are counted while writing:
    nothing is read back. A null in one of them is an error, raised after the write."""
    check_table_names([name])
    spark = df.sparkSession
    if "." in name:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name.rpartition('.')[0]}")
    seen = Observation()
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{i}") for i, c in enumerate(required)]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls).write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(name)
    found = seen.get
    out = Written(found.get("rows", 0), {c: found.get(f"nulls_{i}", 0) for i, c in enumerate(required)})
    if bad := [c for c, n in out.nulls.items() if n]:
        raise ValueError(f"nulls in {', '.join(bad)} of {name}")
    return out


def stream_files(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, so many at a time; of a single file too, which Spark streams by its folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    return reader.parquet(path) if status.isDirectory() else reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def list_tables(spark: SparkSession, schema: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(schema))


def drop_prefixed(spark: SparkSession, prefix: str, schema: str | None = None) -> list[str]:
    gone = [t for t in list_tables(spark, schema) if prefix and t.startswith(prefix)]
    for t in gone:
        spark.sql(f"DROP TABLE IF EXISTS {f'{schema}.' if schema else ''}{t}")
    return gone


def write_metadata(path: str | Path, **values) -> None:
    Path(path).write_text(json.dumps(values, indent=2, default=str) + "\n", encoding="utf-8")


def exit_line(**metrics) -> str:
    return "ok " + " ".join(f"{k}={v}" for k, v in metrics.items())
