"""Divergence of sources, the store of tokens and the audit of filters, on small odd tables against brute force."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import divergence, filter_audit, queries, token_store

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = [f"{'abcdefgh'[i % 8]}{'xyz' * (i % 3)}{chr(97 + i)}" for i in range(20)]
LONG = " ".join(WORDS * 12)
#: doc_id, text, lang, source, and columns whose names the operators use themselves.
ROWS = [
    (0, LONG, "en", "a", 1, "x"), (1, LONG, "en", "b", 1, "x"), (2, LONG, "de", "a", 1, "x"), (2, LONG, "de", "a", 1, "x"), (3, None, None, None, None, None), (4, "", "en", "c", 0, "x"),
    (5, LONG.upper(), "en", "a", 1, "y"), (6, "Straße ÉCOLE école x1y straße\x00tab\tend", "de", "b", 1, "y"), (7, "## " + LONG, "en", "a", 1, "y"), (8, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), "en", "b", 1, "y"),
    (None, LONG, "en", "a", 1, "y"), (9, "a " * 40_000, "en", "b", 1, "y"), (10, "", "", "", 1, "y"), (11, "## " + LONG, "fr", "", 1, "y"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def plain_divergence(rows, least, top):
    low = {c: c + 32 for c in range(65, 91)}
    rows = [((r[2] or ""), (r[3] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(low))) for r in rows]
    out = Counter()
    for lang in {r[0] for r in rows}:
        df, uses = Counter(), defaultdict(Counter)
        for _, source, words in (r for r in rows if r[0] == lang):
            df.update(set(words))
            uses[source].update(words)
        kept = [t for t, n in df.items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        whole, p = share(sum(uses.values(), Counter())), {s: share(c) for s, c in uses.items()}
        for s in uses:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in uses if o != s]
            term = [(whole[t] - p[s][t], t.encode(), t) for t in kept if uses[s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out.update((lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found))
    return out


@pytest.mark.parametrize(("least", "top"), [(1, 50), (2, 3), (99, 50)])
def test_divergence(docs, least, top):
    got = Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(docs, least, top).collect())
    assert got == plain_divergence(ROWS, least, top)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (7, 9, 3), (10**13 + 7, 2 * 10**13 + 1, 123_457), (2 * 10**13, 2 * 10**13, 1), (5, 10**14, 9)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    assert [r[0] for r in df.selectExpr(divergence.share("c", "n")).collect()] == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]


def plain_audit(rows, labels):
    good, bad = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    failed = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        failed.append((lang or "", f, i in good, i in bad))
    out = Counter()
    for part in {p for p, *_ in failed}:
        own, total, steps = [x[1:] for x in failed if x[0] == part], Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, c in enumerate(order):
                hit = [x for x in left if x[0][c]]
                gone = sum(x[0][c] for x in own) - len(hit)
                left = [x for x in left if not x[0][c]]
                total[c] += len(hit)
                steps.append((c, "".join(order), k + 1, len(left), len(hit), gone, sum(x[0][c] and sum(x[0].values()) == 1 for x in own), sum(x[1] for x in hit), sum(x[2] for x in hit)))
        out.update((part, *x, total[c]) for c, *x in steps)
    return out


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit(spark, docs):
    labels = [(0, 1, 0), (1, 1, 1), (2, None, 1), (2, 1, None), (2, 1, 0), (4, 0, 1), (5, 1, 0), (77, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Counter(tuple(r[c] for c in COLUMNS) for r in filter_audit.audit(docs, table).collect())
    assert got == plain_audit(ROWS, [x for x in labels if x[0] is not None])
    assert filter_audit.audit(docs.limit(0), table).count() == 0
    none = filter_audit.audit(docs, table.limit(0))
    assert none.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0 and none.count() == 4 * 120 * 5


def test_filter_audit_of_other_filters(spark, docs):
    """The sums turn back into counts for any number of filters, and the shares of an order add up."""
    filters = {"short": F.length("text") < 10, "other": F.col("source") != "a", "null": F.col("text").isNull()}
    got = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), filters, copies=None)
    rows = got.collect()
    assert len(rows) == 4 * 6 * 3
    for part in {r.part for r in rows}:
        n = sum((r[2] or "") == part for r in ROWS)
        for order in {r.filter_order for r in rows}:
            own = sorted((r for r in rows if (r.part, r.filter_order) == (part, order)), key=lambda r: r.step)
            assert n == own[0].kept + own[0].removed and own[-1].kept + sum(r.removed for r in own) == n and sum(r.shapley for r in own) == 6 * (n - own[-1].kept)
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit(docs, None, {}, copies=None)


def test_token_store(spark, docs, tmp_path):
    tokenizer, out = Tokenizer.from_file(BYTE), str(tmp_path / "store")
    token_store.write(docs, out, BYTE)
    rows = sorted(token_store.read(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 2)) for i, t, *_ in ROWS)
    stream = [x for r in rows for x in r.ids]
    assert [r.start for r in rows] == list(itertools.accumulate([0, *(r.n_tokens for r in rows)]))[:-1] and all(r.n_tokens == len(r.ids) for r in rows)
    some = token_store.read(spark, out, F.col("doc_id").between(5, 7), ids=False)
    assert some.columns == ["doc_id", "n_tokens", "start"] and {r.doc_id for r in some.collect()} == {5, 6, 7}
    for first, last in ((0, 1), (3, 777), (len(stream) - 5, len(stream) + 9), (len(stream), len(stream) + 1)):
        parts = sorted((r.start, r.ids) for r in token_store.stretch(spark, out, first, last).collect())
        assert [x for _, ids in parts for x in ids] == stream[first:last]
    digests = {r.start: (r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.digests(token_store.read(spark, out)).collect()}
    assert digests == {r.start: (r.doc_id, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows}
    token_store.write(docs.limit(0), out, BYTE)
    assert token_store.read(spark, out).count() == 0


def test_token_store_skips_what_readers_do_not_want(spark, docs, tmp_path):
    """Encodings, row groups and page indexes as described; the reader's filter and columns reach the scan."""
    import pyarrow.parquet as pq

    out = str(tmp_path / "store")
    token_store.write(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100)), out, BYTE)
    found = set()
    for path in (tmp_path / "store" / "tokens").glob("*.parquet"):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                x = meta.row_group(g).column(c)
                found.add((x.path_in_schema, any("DICTIONARY" in e for e in x.encodings), "DELTA_BINARY_PACKED" in x.encodings, x.has_column_index and x.has_offset_index))
    assert ("ids.list.element", True, False, True) in found
    assert {x for x in found if x[0] in ("doc_id", "place", "n_tokens")} == {(c, False, True, True) for c in ("doc_id", "place", "n_tokens")}
    plan = token_store.read(spark, out, F.col("doc_id") == 7, ids=False)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PushedFilters" in line and "doc_id" in line)
    assert "EqualTo(doc_id,7)" in scan and "ids" not in scan.split("ReadSchema")[1]


def test_token_store_query(spark, sf_dir):
    tokenizer, at, want = Tokenizer.from_file(BYTE), 0, {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op12_token_store(spark, sf_dir).collect()} == want
