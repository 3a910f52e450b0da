"""The registered queries and the pipeline over whole tables, against SQL and brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kinfold.llm import decontaminate, queries
from tests.llm.test_operators import jaccard_groups
from tests.oracle import differs

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert differs(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def plain_lines(texts):
    """Texts without the lines that are like one at an earlier place."""
    seen, out = [], {}
    for i, t in sorted(texts.items()):
        kept = []
        for line in (t or "").split("\n"):
            w = {x for x in line.rstrip("\r").split(" ") if x}
            again = w and any(9 * len(w & s) >= 4 * (len(w) + len(s)) for s in seen if 4 * len(w) <= 5 * len(s) and 4 * len(s) <= 5 * len(w))
            kept += [] if again else [line]
            seen += [w] if w and w not in seen else []
        out[i] = None if t is None else "\n".join(kept)
    return out


def holds(text, item, need):
    """Whether a diagonal has a stretch with `need` equal words, 80 of 100 of its words equal."""
    n, m = len(text), len(item)
    same = np.zeros((n + 2 * m, m), bool)
    same[m : m + n] = text[:, None] == item
    at = np.arange(n + m)
    diagonals = np.stack([same[at + j, j] for j in range(m)], 1)
    for row in diagonals[diagonals.sum(1) >= need]:
        for a in range(m):
            for b in range(a + 1, m + 1):
                equal = int(row[a:b].sum())
                if equal >= need and 5 * equal >= 4 * (b - a):
                    return True
    return False


def contaminated(texts, items):
    codes = defaultdict(lambda: len(codes))
    low = {c: c + 32 for c in range(65, 91)}
    words = lambda t: np.array([codes[w.translate(low)] for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")], np.int64)
    items = [w for w in map(words, items) if len(w) >= decontaminate.LEAST]
    return {i for i, t in texts.items() for w in [words(t)] if any(holds(w, x, decontaminate.needed(len(x), 13, 0.8)) for x in items)}


def check_packing(rows, texts, size=2048):
    """Every token of every text once, in as few sequences as best fit gives or the tokens allow."""
    tokenizer, pieces, held = Tokenizer.from_file(BYTE), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        held[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    total = 0
    for i, t in texts.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = (len(ids) - 1) % size + 1
        starts = [0, *range(first, len(ids), size)]
        want = [(k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, a in enumerate(starts) for n in [size if k else first]]
        assert sorted(pieces[i]) == want
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= size
    bins = []
    for n in sorted((n for x in pieces.values() for _, _, n, _ in x), reverse=True):
        fits = [k for k, b in enumerate(bins) if b + n <= size]
        if fits:
            bins[max(fits, key=lambda k: bins[k])] += n
        else:
            bins.append(n)
    assert len(held) <= len(bins) and len(held) >= -(-total // size)


def test_token_counts(spark, sf_dir, texts):
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.no_truncation(), tokenizer.no_padding()
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    got = queries.op9_token_counts(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((i, len((texts[i] or "").encode()), n, n > 2048) for i, n in want.items())


def test_packing(spark, sf_dir, texts):
    check_packing(queries.op10_best_fit_packing(spark, sf_dir).collect(), texts)


def test_shards(spark, sf_dir, texts):
    got = queries.op7_shuffle_shards(spark, sf_dir).collect()
    size = lambda t: len((t or "").encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t) + 16, zlib.crc32((t or "").encode())) for i, t in texts.items())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None} and set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(40)]
    assert max(counts) - min(counts) <= 1


def test_decontaminate(spark, sf_dir, texts):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {r.doc_id for r in queries.op8_decontaminate(spark, sf_dir).collect()} == contaminated(texts, items) != set()


def test_pipeline(spark, sf_dir, texts):
    """All five stages in turn by brute force; what stays is packed."""
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {i: t for i, t in texts.items() if any(map(str.isalpha, t or ""))}
    lines = plain_lines(kept)
    kept = {i: t for i, t in lines.items() if t == kept[i] or re.search(r"[^ \t-\r]", t)}
    groups = jaccard_groups(sorted(kept.items()), 5, 4, 5)
    kept = {i: kept[i] for i, _, least in groups if i == least}
    gone = contaminated(kept, items)
    kept = {i: t for i, t in kept.items() if i not in gone}
    assert gone and len(texts) > len(kept) > 0.5 * len(texts)
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), kept)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, an empty table; each stage keeps the columns, also those it doesn't know."""
    item = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = "quite some words that nobody else has ever written anywhere"
    rows = [(None, own, None, None, None, "x"), (1, None, "en", "s", None, "x"), (2, "", "en", "s", 0, None), (3, "12 34", "en", "s", 5, "x"), (4, item, "en", "s", 9, "x"), (5, "another text of its own kind", None, None, 9, "x"), (5, "another text of its own kind", None, None, 9, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash string"
    clash = {"a.b": F.lit(1.5), "_score": F.lit("kept"), "n_removed": F.col("doc_id"), "_lang_pred": F.lit(2), "removed_share": F.lit("x"), "_c1": F.lit(True), "id": F.lit("z")}
    got = docs = spark.createDataFrame(rows, schema).withColumns(clash)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{k}")
        stage(spark, got, str(tmp_path)).write.parquet(path)
        got = spark.read.parquet(path)
        assert k == len(corpus_pipeline.STAGES) - 1 or got.columns == docs.columns
        if "a.b" in got.columns:
            assert {(r["a.b"], r["_score"], r["n_removed"] == r.doc_id, r["_lang_pred"], r["removed_share"], r["_c1"], r["id"]) for r in got.collect()} == {(1.5, "kept", True, 2, "x", True, "z")}
    assert Counter(r.doc_id for r in got.collect()) == Counter({None: 1, 5: 2})
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
