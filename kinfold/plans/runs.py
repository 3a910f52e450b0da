"""The five runs in order, with their guards on the path: ingestion, match sample, matching, rollup, verification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.operators import entities as E
from kinfold.operators import matching as M
from kinfold.operators import sampling as S
from kinfold.scratch import Scratch
from kinfold.sources.companies import with_record_ids
from kinfold.sources.tables import fingerprint


@dataclass(frozen=True)
class Settings:
    """What matching depends on."""

    threshold: float = M.MATCH
    prefix: int | str = 3  # letters of the name, or the name of such a column: name_first<k>
    max_rows: int = 50_000
    max_group: int = 80
    max_pairs: int = 2_000_000
    denied: tuple[str, ...] = N.DENIED_HOSTS
    distinct_pairs: bool = False  # max_pairs counts a pair of both rules once, not for each

    def letters(self) -> int:
        text = str(self.prefix).removeprefix("name_first")
        if not text.isdigit() or not 1 <= int(text) <= 20:
            raise ValueError(f"a number of letters or name_first<k> is expected, not {self.prefix!r}")
        return int(text)


def ingest(raw: DataFrame, n: int = 30_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The records with ids, and a random sample of n."""
    records = with_record_ids(raw)
    return records, S.hash_sample(records, n, seed)


def id_sum(key: str = "record_id") -> Column:
    """A sum over hashes of ids, in which equal ids don't cancel: two tables with equal rows, sums and no null have the same ids,
    each as often."""
    return F.coalesce(F.sum(F.pmod(F.xxhash64(key), F.lit(1 << 61)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def _rows() -> Column:
    return F.count(F.lit(1))


def match_sample(records: DataFrame, **options) -> DataFrame:
    """The enriched sample: ids are checked before, the number of rows after, which is counted while writing."""
    M.check_source(records, limit=0)
    limits = {k: options.pop(k) for k in ("least_rows", "most_rows") if k in options}
    out, seen = Scratch(records.sparkSession).keep_counted(S.enriched_sample(records, **options), rows=_rows())
    S.check_result(seen["rows"], limits.get("least_rows", 1000), limits.get("most_rows", 50_000))
    return out


def match(records: DataFrame, settings: Settings = Settings(), model: M.Model | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored pairs and golden entities. Rows, ids, host groups and pairs are checked before any pair is made; that the golden
    rows have the records' ids, each once, is seen while they are written."""
    scratch = Scratch(records.sparkSession)
    M.check_source(records, settings.max_rows)
    prep, had = scratch.keep_counted(M.prepare(records, settings.letters()), rows=_rows(), ids=id_sum())
    M.check_blocks(prep, settings.max_group, settings.max_pairs, settings.denied, settings.distinct_pairs)
    scored = scratch.keep(M.score(M.compare(M.candidate_pairs(prep, settings.denied)), model or M.train(prep, denied=settings.denied)))
    golden, got = scratch.keep_counted(E.golden_entities(prep, scored, settings.threshold), rows=_rows(), ids=id_sum())
    if got != had:
        raise ValueError(f"{got['rows']} golden rows for {had['rows']} records, or other ids")
    return scored, golden


def rollup(records: DataFrame, golden: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Records with golden entity and ultimate parent. Every golden row must be a record's, and get a parent: its rows with
    and without one are counted while writing."""
    prep = M.prepare(records, settings.letters())
    known = records.select(F.col("record_id").alias("_id")).distinct()
    row = golden.join(known, golden["record_id"] == known["_id"], "left").agg(_rows().alias("rows"), F.count("_id").alias("known")).first()
    if row.rows != row.known:
        raise ValueError(f"{row.rows} golden rows, of which {row.known} have a record")
    tree, seen = Scratch(records.sparkSession).keep_counted(E.hierarchy(golden, prep, settings.denied), rows=_rows(), lost=F.count_if(F.col("ultimate_parent_id").isNull()))
    if seen["lost"] or seen["rows"] != row.rows:
        raise ValueError(f"{seen['lost']} records without a parent, {seen['rows']} of {row.rows} rows")
    return tree


EXPECTED = {"source": ("record_id",), "golden": ("record_id", "golden_entity_id"), "hierarchy": ("record_id", "golden_entity_id", "ultimate_parent_id")}


def verify(source: DataFrame, golden: DataFrame, tree: DataFrame, frozen: tuple[int, int, int] | None = None, versions: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """check, ok, detail. Columns come first; with versions, the fingerprints from before, so does that nothing changed."""
    tables = dict(zip(EXPECTED, (source, golden, tree), strict=True))
    spark = source.sparkSession
    missing = {name: [c for c in EXPECTED[name] if c not in df.columns] for name, df in tables.items()}
    rows = [(f"{name}_columns", not cols, len(cols)) for name, cols in missing.items()]
    now = {name: fingerprint(df) for name, df in tables.items() if versions and name in versions}
    rows += [(f"{name}_unchanged", now[name] == tuple(versions[name]), now[name][0]) for name in now]
    first = spark.createDataFrame(rows, "check string, ok boolean, detail long")
    return first if any(missing.values()) else first.unionByName(E.verify(source, golden, tree, frozen))


