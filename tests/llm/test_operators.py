"""Each operator on small tables with nulls, empty and odd texts, ties, repeated rows and clashing names, against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import ann, chat, decontaminate, langid, line_dedup, packing, quality_fm, queries, shuffle_shards, token_counts, trie_join

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
BASE = [f"w{i} und x{i % 7} the y{i % 13} of" for i in range(30)]
LONG = " ".join(BASE)
TEXTS = [LONG, LONG, LONG.replace("w3 ", "zz ", 1), LONG.upper(), None, "", " \n\t ", "one", "one two", "é ß 漢字 <|endoftext|> it's 12", "\n".join(BASE[:9]), "\n".join([BASE[0], *BASE[10:14], BASE[0] + " more"]), "A" * 3000]
DOCS = [(i, t, "en" if i % 2 else None, -1, "clash", 7.5) for i, t in enumerate(TEXTS)] + [(0, LONG, "en", 3, "clash", 1.0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, n_chars long, n string, score double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def jaccard_groups(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])))
    of, before = list(range(len(sets))), None
    links = [(a, b) for a, (_, x) in enumerate(sets) for b, (_, y) in enumerate(sets[:a]) if x and y and den * len(x & y) >= num * len(x | y)]
    while of != before:
        before = [*of]
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    least = defaultdict(lambda: 1 << 60)
    for g, (i, _) in zip(of, sets, strict=True):
        least[g] = min(least[g], i)
    return Counter((i, len(s), least[g] if s else i) for g, (i, s) in zip(of, sets, strict=True))


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 4, 5)])
def test_trie_join(docs, none, k, num, den):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in trie_join.groups(docs, k=k, num=num, den=den).collect())
    assert got == jaccard_groups([(r[0], r[1]) for r in DOCS], k, num, den)
    assert trie_join.groups(none, k=k, num=num, den=den).count() == 0


def test_trie_join_links_rows_without_ids(spark):
    """Near copies of which one or all have no id; repeated rows without id; texts without words."""
    base = [f"w{i} und x{i % 7} the y{i % 13} of" for i in range(30)]
    near = lambda a, b: " ".join(base).replace(a, b, 1)
    other = " ".join(f"q{i} r{i}" for i in range(60))
    rows = [(None, near("w3 ", "zz ")), (3, " ".join(base)), (None, near("w4 ", "yy ")), (None, near("w4 ", "yy ")), (None, other), (None, other + " end"), (None, None), (None, " "), (None, "alone here"), (7, "quite alone here")]
    got = trie_join.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=3, num=80, den=100).collect()
    links = Counter((r.doc_id, r.component_id, r.n_links, r.n_shingles > 0) for r in got)
    assert links == {(3, 3, 2, True): 1, (None, 3, 2, True): 3, (None, None, 1, True): 2, (None, None, 0, False): 2, (None, None, 0, True): 1, (7, 7, 0, True): 1}


def test_trie_join_counts_all_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [[f"{g}v{i}" for i in range(40)] for g in range(4)]
    texts = []
    for i in range(90):
        words = list(base[0] if i < 60 else base[1 + i % 3])
        for at in rng.integers(0, 40, i % 4):
            words[at] = f"z{rng.integers(9)}"
        texts.append(" ".join(words))
    rows = list(enumerate([*texts, texts[0], None, "alone here"]))
    sets = {i: frozenset(zip(*(w[j:] for j in range(3)))) if len(w := (t or "").split()) >= 3 else frozenset(w) for i, t in rows}
    classes = {s for s in sets.values() if s}
    want = {i: sum(5 * len(s & o) >= 3 * len(s | o) for o in classes if o != s) if s else 0 for i, s in sets.items()}
    assert max(want.values()) > 10
    for block in (256, 7):
        monkeypatch.setattr(trie_join, "BLOCK", block)
        got = trie_join.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=3, num=3, den=5)
        assert {r.doc_id: r.n_links for r in got.collect()} == want


@given(st.lists(st.frozensets(st.integers(0, 30), min_size=1, max_size=25), max_size=12), st.lists(st.frozensets(st.integers(0, 30), min_size=1, max_size=25), max_size=12), st.sampled_from([(4, 5), (90, 100), (1, 2)]), st.sampled_from([1, 4, 32]))
@settings(max_examples=150, deadline=None)
def test_prefix_tree(sets, others, share, step):
    num, den = share
    others = [*others, *sets[:3]]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(trie_join, "STEP", step)
        rows = lambda x: [np.array(sorted(s), np.uint64) for s in x]
        probes, found = trie_join.PrefixTree(rows(sets), num, den).similar(rows(others))
    got = sorted(zip(probes.tolist(), found.tolist(), strict=True))
    assert got == [(i, j) for i, s in enumerate(others) for j, t in enumerate(sets) if den * len(s & t) >= num * len(s | t)]


def test_prefix_tree_shares_paths():
    """Near copies: the tree holds what all of them have once, and so do a walk's comparisons."""
    base = np.arange(1000, dtype=np.uint64)
    sets = [np.sort(np.append(np.delete(base, i), np.uint64(5000 + i))) for i in range(50)]
    tree, n, stack = trie_join.PrefixTree(sets, 4, 5), 0, []
    stack.append(tree.root)
    while stack:
        node = stack.pop()
        n += len(node["run"])
        stack += node["next"].values()
    assert n < 1000 + 50 * 60
    assert len(tree.similar(sets)[0]) == 50 * 50


def test_links_of_a_tree_as_stars():
    """Of n near copies a tree shows n * n links; n - 1 pairs have the same components."""
    x, y = (z.ravel() for z in np.meshgrid(np.arange(50), np.arange(50)))
    a, b = trie_join._spanning(x, y)
    assert set(a) == {0} and sorted(b) == list(range(1, 50))
    rng = np.random.default_rng(2)
    for n in (0, 1, 30, 90, 200):
        x, y = rng.integers(0, 120, n), rng.integers(0, 120, n)
        group = {i: {i} for i in range(120)}
        for i, j in zip(x, y, strict=True):
            both = group[i] | group[j]
            group |= dict.fromkeys(both, both)
        want = sorted((min(g), i) for i, g in group.items() if min(g) != i)
        assert sorted(zip(*trie_join._spanning(x, y), strict=True)) == want
    chain = np.random.default_rng(3).permutation(2000)
    a, b = trie_join._spanning(chain[:-1], chain[1:])
    assert set(a) == {0} and len(b) == 1999


def test_trie_join_in_small_trees(docs, monkeypatch):
    monkeypatch.setattr(trie_join, "TREE_ITEMS", 40)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in trie_join.groups(docs, k=3, num=90, den=100).collect())
    assert got == jaccard_groups([(r[0], r[1]) for r in DOCS], 3, 90, 100)


def test_line_dedup(docs, none):
    seen, want = [], {}
    rows = sorted({(r[0], r[1]) for r in DOCS if r[1] is not None})
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            w = {x for x in line.rstrip("\r").split(" ") if x}
            again = len(w) >= 5 and any(9 * len(w & s) >= 4 * (len(w) + len(s)) for s in seen)
            kept += [] if again else [line]
            seen += [w] if len(w) >= 5 else []
        want[i] = "\n".join(kept)
    out = line_dedup.dedup(docs)
    assert out.columns == [*docs.columns, *line_dedup.OUT]
    got = out.collect()
    assert len(got) == len(DOCS)
    assert all(r.text == want.get(r.doc_id) for r in got)
    assert line_dedup.dedup(none).count() == 0


def test_line_dedup_of_short_lines(spark):
    lines = ["a", "a b", "b a a", "a b c", "c b a", "a b d", "a b c d", "d c b a\r", "a b c d e", "a b c d f", "g h i j k", "j i h g", "", " ", "All rights reserved.", "x x x x x x x x", "x"]
    rows = [(i, "\n".join(lines[i % 5 :: 2] + lines[:i])) for i in range(6)]
    for num, den in ((4, 5), (1, 2), (1, 1)):
        seen, want = [], {}
        for i, text in rows:
            kept = []
            for line in text.split("\n"):
                w = {x for x in line.rstrip("\r").split(" ") if x}
                kept += [] if w and any(den * len(w & s) >= num * len(w | s) for s in seen) else [line]
                seen += [w] if w else []
            want[i] = "\n".join(kept)
        got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), num=num, den=den).collect()
        assert {r.doc_id: r.text for r in got} == want


def test_line_dedup_beyond_direct_meetings(spark, monkeypatch):
    """Crowded words go to keys of more words; ids are null or repeated, and columns have the names used inside."""
    rng = np.random.default_rng(4)
    lines = []
    for i in range(160):
        words = [f"k{j}" for j in range(20)] if i < 90 else ["k0", "k1", *(f"m{rng.integers(40)}" for _ in range(rng.integers(4, 14)))]
        for at in rng.integers(0, len(words), i % 5):
            words[at] = f"z{rng.integers(30)}"
        lines.append(" ".join(words))
    rows = [(None if i % 11 == 0 else i // 2, "\n".join(lines[i * 4 : i * 4 + 4] + ["only here %d %d" % (i, j) for j in range(i % 3)])) for i in range(40)]
    rows += [(rows[8][0], rows[8][1]), (3, "a text of its own"), (3, "another text of id three"), (90, None), (91, "")]
    df = spark.createDataFrame([(i, t, 7, "x", "y", 2.5) for i, t in rows], "doc_id long, text string, id long, _gone string, _kept string, n_lines double").repartition(3)
    docs = df.select("doc_id", F.xxhash64("text").alias("h"), "text").distinct().collect()
    seen, want = [], {}
    for r in sorted((r for r in docs if r.text is not None), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
        kept = []
        for line in r.text.split("\n"):
            w = set(line.split())
            kept += [] if w and any(5 * len(w & s) >= 4 * len(w | s) for s in seen) else [line]
            seen += [w] if w else []
        want[r.doc_id, r.text] = "\n".join(kept)
    want = Counter(want.get(r, r[1]) for r in rows)
    for direct in (2, 6, 1000):
        monkeypatch.setattr(line_dedup, "DIRECT", direct)
        got = line_dedup.dedup(df)
        assert got.columns == ["doc_id", "text", "id", "_gone", "_kept", *line_dedup.OUT]
        got = got.collect()
        assert Counter(r.text for r in got) == want and {(r.id, r._gone, r._kept) for r in got} == {(7, "x", "y")}
        assert all(r.n_lines == (0 if r.text is None else r.n_removed + r.text.count("\n") + (r.text != "" or r.n_removed == 0)) for r in got)


def test_line_dedup_writes_no_rows_of_meetings(spark, monkeypatch):
    """However many words share a bucket, what is written are classes and pairs, and the buckets grow with the text."""
    lines = [f"w{i} w{i + 1} w{i + 2} w{i % 3} a b c d e f" for i in range(60)]
    df = spark.createDataFrame([(i, "\n".join(lines[i * 6 : i * 6 + 6] + [f"{lines[i]} g"])) for i in range(10)], "doc_id long, text string")
    want = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    keep, kept = line_dedup.Scratch.keep, []

    def seen(self, frame, *args, **kwargs):
        kept.append(frame.columns)
        return keep(self, frame, *args, **kwargs)

    monkeypatch.setattr(line_dedup.Scratch, "keep", seen)
    monkeypatch.setattr(line_dedup, "SKETCH", 2)
    monkeypatch.setattr(line_dedup, "DIRECT", 2)
    assert {r.doc_id: r.text for r in line_dedup.dedup(df).collect()} == want
    assert want[9] != "\n".join(lines[54:60] + [f"{lines[9]} g"])
    assert kept and not any("tail" in columns for columns in kept)
    monkeypatch.undo()
    sizes = [line_dedup._buckets(x) for x in (0, 1 << 29, 6 << 30, 1 << 50)]
    assert sizes == sorted(sizes) and sizes[0] == sizes[1] == line_dedup.SKETCH and sizes[2] >= 4 * sizes[1] and sizes[3] == line_dedup.SKETCH_MOST


def test_line_dedup_numbers_classes_in_order_of_place(spark, monkeypatch):
    """A pair tells by its numbers which is the later one, so neither pairs nor rows of meetings are joined with places."""
    lines = [f"w{i // 4} x{i // 4} y{i // 4} a b c d e f g{i % 4}" for i in range(80)]
    df = spark.createDataFrame([(i, "\n".join(lines[i::10])) for i in range(10)], "doc_id long, text string").repartition(3)
    keep, kept = line_dedup.Scratch.keep, []

    def seen(self, frame, *args, **kwargs):
        kept.append((frame.columns, keep(self, frame, *args, **kwargs)))
        return kept[-1][1]

    monkeypatch.setattr(line_dedup.Scratch, "keep", seen)
    monkeypatch.setattr(line_dedup.Scratch, "drop", lambda self, *frames: None)
    for direct in (2, 1000):
        kept.clear()
        monkeypatch.setattr(line_dedup, "DIRECT", direct)
        assert sum(r.n_removed for r in line_dedup.dedup(df).collect()) == 60
        (classes,) = (frame.collect() for columns, frame in kept if {"h", "first", "c"} <= set(columns))
        assert [r.c for r in sorted(classes, key=lambda r: r.first)] == sorted(r.c for r in classes) and len(classes) == 80
        pairs = [frame for columns, frame in kept if columns == ["c", "c_", "differ"]]
        assert sum(frame.count() for frame in pairs) and not any(frame.where("c <= c_").count() for frame in pairs)
        assert not any({"key", "first"} <= set(columns) for columns, _ in kept)


def test_line_dedup_counts_the_words_of_all_prefixes(spark, monkeypatch):
    """The count of crowded words takes each prefix whole at any size, instead of those that a frequent word lets through."""
    df = spark.createDataFrame([(i, f"w{i} x{i} a b c d e f g") for i in range(20)], "doc_id long, text string")
    keep, plans = line_dedup.Scratch.keep, []

    def seen(self, frame, *args, **kwargs):
        if frame.columns == ["key"]:
            plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return keep(self, frame, *args, **kwargs)

    monkeypatch.setattr(line_dedup.Scratch, "keep", seen)
    assert sum(r.n_removed for r in line_dedup.dedup(df).collect()) == 0
    assert plans and all("posexplode(prefix" in plan and "prefix#" in plan and not re.search(r"prefix#\d+\[", plan) for plan in plans)


@pytest.mark.parametrize("repeated", [False, True])
def test_line_dedup_shuffles_sets_only_for_repeated_rows(spark, monkeypatch, repeated):
    """Each class has its set once for the exact comparison, and without repeated rows no shuffle sees to that."""
    rows = [(i, f"w{i // 2} x{i // 2} a b c d e f g{i % 2} h") for i in range(8)]
    df = spark.createDataFrame(rows + rows[:2] * repeated, "doc_id long, text string")
    keep, kept = line_dedup.Scratch.keep, []

    def seen(self, frame, *args, **kwargs):
        out = keep(self, frame, *args, **kwargs)
        if frame.columns == ["c", "s"]:
            kept.append((frame._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Aggregate"), out.count(), out.select("c").distinct().count()))
        return out

    monkeypatch.setattr(line_dedup.Scratch, "keep", seen)
    assert sum(r.n_removed for r in line_dedup.dedup(df).collect()) == 4 + repeated
    assert [x[0] for x in kept[:2]] == [False, True][: 1 + repeated] and kept[repeated][1] == kept[repeated][2] == 8


def test_pipeline_keeps_what_only_one_document_has(spark):
    line = "this line is in all of the documents"
    rows = [(1, line), (2, "\n".join([line] * 20 + ["some own words at the end"])), (3, f"{line}\n\t\n{line}"), (4, "")]
    got = corpus_pipeline.dedup_lines(spark, spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long"), "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, line), (2, "some own words at the end"), (4, "")]


def test_language_id(docs, none):
    fitted = langid.fit(docs, F.lit(True))
    got = langid.predict(docs, fitted)
    assert got.columns == ["doc_id", "text", "lang", "n_chars", "n", "lang_pred", "score"]
    for r in got.collect():
        blank = not any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == blank and 0 <= r.score <= 1 and (r.score == 0 or not blank)
    assert langid.fit(none, F.lit(True)) == {}
    many = docs.select("doc_id", "text", "lang").union(docs.sparkSession.createDataFrame([(1000 + i, f"нет да {i}" if i % 2 else f"όχι ναι {i}", "ru" if i % 2 else "el") for i in range(90)], "doc_id long, text string, lang string"))
    learned = langid.fit(many.union(many), F.lit(True), per_lang=20)
    assert sorted(learned) == ["el", "en", "ru"]
    again = langid.predict(many, learned).where("doc_id >= 1000").collect()
    assert len(again) == 90 and all(r.lang_pred == r.lang for r in again)
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.predict(none, fitted).count() == 0


def test_bundle_is_the_sum_of_its_trigrams():
    a, b, c = langid._letters()
    code = {"x": 24, "y": 25, " ": 0}
    want = sum(a[code[p]] * b[code[q]] * c[code[r]] for p, q, r in (" xy", "xy ", " x "))
    assert np.array_equal(langid.bundle(["Xy, x"])[0], want)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (7, 0), (8, 0), (12, 0), (3, None), (4, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    model = quality_fm.fit(docs, labels, F.lit(True))
    got = quality_fm.score(docs, model, keep=["doc_id"]).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert min(by[0], by[1], by[2]) > max(by[7], by[8])
    assert {r.score for r in quality_fm.score(docs, quality_fm.fit(docs, labels.limit(0), F.lit(True)), keep=["doc_id"]).collect()} == {0.5}
    assert quality_fm.score(none, model, keep=["doc_id"]).count() == 0


@pytest.fixture(scope="module")
def held_out(spark, sf_dir):
    return {"op1": queries.op1_quality_fm(spark, sf_dir).collect(), "op6": queries.op6_language_id(spark, sf_dir).collect()}


def test_queries_predict_held_out_documents(spark, sf_dir, held_out):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    lang, quality = {r.doc_id: r.lang for r in source}, {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None}
    for name, remainder, mod, truth, least in (("op1", 1, 3, quality, 0.9), ("op6", 0, 5, lang, 0.95)):
        rows = held_out[name]
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in source)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == remainder) and 0 <= r.score <= 1 for r in rows)
        said = [((r.predicted if name == "op1" else r.lang_pred) == truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
        assert len(said) > 20 and sum(said) / len(said) >= least
    assert all(r.predicted == (r.score >= 0.5) for r in held_out["op1"])
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, t or ""))) for r in held_out["op6"] for t in [next(s.text for s in source if s.doc_id == r.doc_id)])


def test_outputs_replace_columns_of_their_names(docs):
    named = docs.withColumn("n_tokens", F.lit("x"))
    assert token_counts.counts(named, WORD).columns == ["doc_id", "lang", "n_chars", "n", "score", *token_counts.OUT]
    model = quality_fm.Model(np.zeros((15, 7)), 0.0, np.zeros(quality_fm.BUCKETS + 120), np.zeros((quality_fm.BUCKETS + 120, 8)))
    out = quality_fm.score(docs, model)
    assert out.columns == ["doc_id", "lang", "n_chars", "n", "score"] and {r.score for r in out.collect()} == {0.5}


def test_pairs_by_the_sum_of_squares():
    rng = np.random.default_rng(1)
    model = quality_fm.Model(np.zeros((0, 7)), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    cols, x = np.array([0, 3, 8, 2, 5]), rng.normal(size=5)
    rows = np.array([0, 0, 0, 1, 1])
    want = [0.3 + sum(model.weight[cols[i]] * x[i] for i in g) + sum(model.factors[cols[i]] @ model.factors[cols[j]] * x[i] * x[j] for i in g for j in g if i < j) for g in ((0, 1, 2), (3, 4))]
    assert np.allclose(quality_fm._margins(model, rows, cols, x, 2)[0], want)


@pytest.mark.parametrize("sizes", [{}, {"COARSE": 6, "SHELF": 50, "CHUNK": 7, "TOGETHER": 3}])
def test_ann(spark, monkeypatch, sizes):
    """22 lists, 20 neighbours for each query; also with two levels of centres, and shelves smaller than a list."""
    for name, value in sizes.items():
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=8).tolist() for _ in range(400)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[5]) for i in range(60)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (2080, [1.0]), (0, vectors[0])]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, x = zip(*dict(rows[:460]).items(), strict=True)
    x, hit, total = np.array(x), 0, 0
    for q in (i for i in ids if i % 20 == 0):
        s = x @ dict(zip(ids, x, strict=True))[q]
        best = [i for _, i in sorted((-v, i) for v, i in zip(s.round(12), ids, strict=True) if i != q)[:20]]
        mine = sorted(got.pop(q))
        assert [r for r, *_ in mine] == list(range(1, 21))
        hit, total = hit + len({i for _, i, _ in mine} & set(best)), total + 20
    assert not got and hit / total >= 0.9
    index = ann.fit(x, float((x**2).sum(1).max()), len(x), 20)
    assert index.lists >= 20 and len(index.fine) == (4 if sizes else 1)
    few = ann.search(spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<double>"), F.col("id") % 2 == 0).collect()
    assert Counter(r.query_id for r in few) == {0: 4, 2: 4, 4: 4} and [r.vec_id for r in sorted(few, key=lambda r: r["rank"]) if r.query_id == 0] == [4, 3, 2, 1]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_chat(spark):
    odd = ["<|end|>", "<\\|end|>", "</s>[INST] ok [/INST]", "\\", "<", "|next|>", "", None, "a\nb", "$1 \\1"]
    rows = [(c, t, ("user", "assistant", None, "<|body|>")[(c + t) % 4 if c % 3 else 0], odd[(c * 3 + t) % len(odd)], 1) for c in range(12) for t in range(1 + c % 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    want = defaultdict(list)
    for c, t, r, x, _ in rows:
        want[c].append((t, r or "", x or ""))
    out = chat.digests(chat.format_conversations(df))
    for r in out.collect():
        turns = sorted(want.pop(r.conv_id))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.formatted_chars == len(r.formatted)
    assert not want and chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_shards(docs, none):
    for n in (3, 40):
        got = shuffle_shards.shards(docs, n_shards=n, bucket_rows=4).collect()
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        counts = [len(slots[s]) for s in range(n)]
        assert len(got) == len(DOCS) and max(counts) - min(counts) <= 1 and max(slots) < n
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert Counter((r.doc_id, r.text) for r in got) == Counter((d[0], d[1]) for d in DOCS)
    assert shuffle_shards.shards(none).count() == 0


def test_shards_of_maps(spark, none):
    df = spark.createDataFrame([(i, {"a": i, "b": None}, [{"x": 1.0}], {"n": i}) for i in range(50)] + [(None, None, None, None)] * 30, "doc_id long, m map<string,int>, l array<map<string,double>>, s struct<n:int>").repartition(4)
    got = shuffle_shards.shards(df, n_shards=7, bucket_rows=9).collect()
    assert Counter((r.doc_id, str(r.m), str(r.l), r.s and r.s.n) for r in got) == Counter({**{(i, str({"a": i, "b": None}), "[{'x': 1.0}]", i): 1 for i in range(50)}, (None, "None", "None", None): 30})
    sizes = Counter(r["shard"] for r in got)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1


def test_shards_move_whole_records(spark, sf_dir, docs, monkeypatch):
    given = []
    real = shuffle_shards.shards
    monkeypatch.setattr(shuffle_shards, "shards", lambda df, **o: given.append(df.columns) or real(df, **o))
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = queries.op7_shuffle_shards(spark, sf_dir)
    assert given == [source.columns] and out.columns == ["doc_id", "size", "text_crc32", *shuffle_shards.OUT]
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in source.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out.collect()) == want
    # buckets are sized by bytes too
    names = docs.columns
    assert shuffle_shards.bucket_count(docs, names, 1000, 1 << 30) == (len(DOCS), 1)
    assert shuffle_shards.bucket_count(docs, names, 1000, 1000)[1] >= sum(len((d[1] or "").encode()) for d in DOCS) // 1000
    assert Counter(tuple(r)[: len(names)] for r in real(docs, n_shards=3, bucket_bytes=1000).collect()) == Counter(DOCS)


def test_decontaminate(spark, docs, none):
    item = " ".join(LONG.split()[30:60])
    changed = " ".join("other" if i % 9 == 4 else w for i, w in enumerate(item.split()))
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, f"before {changed}, AFTER"), (51, " ".join(item.split()[:9])), (52, item.upper().replace(" ", ", "))], "doc_id long, text string"))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two"), (5, "quite another thing altogether here")], "item_id long, text string")
    for block in (1_000_000, 20):
        got = decontaminate.contaminated(more, bench, block_words=block).collect()
        assert Counter((r.doc_id, r.item_id) for r in got) == Counter({(i, 1): 2 if i == 0 else 1 for i in (0, 1, 2, 3, 10, 50, 52)})
    # a benchmark without spaces, and one whose items share an id, are cut into blocks too
    lines = spark.createDataFrame([(1, "\n".join(item.split())), (1, item.upper()), (1, "語" * 500), (None, item)], "item_id long, text string")
    assert len(list(decontaminate._blocks(lines, "item_id", "text", 20, 13, 0.8))) > 1
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(more, lines, block_words=20).collect()}
    assert got == {(i, x) for i in (0, 1, 2, 3, 10, 50, 52) for x in (1, None)}
    assert decontaminate.contaminated(none, bench).count() == decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontaminate_at_the_limit():
    """Random and periodic substitutions against all stretches of all diagonals."""
    rng, seen = np.random.default_rng(5), set()
    for n, misses in [(14, 1), (16, 2), (16, 3), (16, 4), (20, 3), (20, 4), (20, 5), (30, 6), (37, 7), (40, 8), (5, 1), (6, 1), (10, 2), (11, 2), (15, 3), (60, 12)] * 12:
        item = rng.integers(1, 1 << 60, n).astype(np.uint64)
        text = np.concatenate([rng.integers(1, 1 << 60, 7).astype(np.uint64), item, rng.integers(1, 1 << 60, 4).astype(np.uint64)])
        at = rng.permutation(n)[:misses] if rng.random() < 0.7 else (np.arange(misses) * max(1, n // misses) + rng.integers(n)) % n
        text[7 + at] = 0
        need, most = decontaminate.needed(n, 13, 0.8), 0
        same = text[7 : 7 + n] == item
        for i in range(n):
            for j in range(i + 1, n + 1):
                equal = int(same[i:j].sum())
                most = max(most, equal) if 5 * equal >= 4 * (j - i) else most
        words = decontaminate.Words(np.zeros(0, np.uint8), np.zeros(2, np.int64))
        words.hash, words.row, words.first = text, np.zeros(len(text), np.int64), np.array([0, len(text)])
        got = decontaminate.overlaps(words, decontaminate.Benchmark(["a"], [item]))
        assert [x[4] for x in got] == ([most] if most >= need else []), (n, at)
        assert all(5 * e >= 4 * (b - a) and same[a - 7] and same[b - 8] for *_, a, b, e in got)
        seen.add(most >= need)
    assert seen == {True, False}


def test_pipeline_decontaminates_rows_without_ids(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(None, f"a {item} b"), (None, "clean"), (7, item), (7, "clean too"), (8, None)], "doc_id long, text string")
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(None, "clean"), (7, "clean too"), (8, None)])


def test_masks_hit_every_stretch():
    for n, m in ((16, 3), (20, 4), (25, 5)):
        gaps = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), m)])
        hit = np.zeros(len(gaps), bool)
        for mask in decontaminate.MASKS:
            for i in range(n - mask[-1]):
                hit |= gaps & sum(1 << (i + o) for o in mask) == 0
        assert hit.all()


ALPHABET = "abz ABZ''st'll İıßéÉ12½²\t\n\r\x0b\x1c\x1f\x85\xa0|<>…—“”€ñ漢🙂Ως"


@given(st.lists(st.one_of(st.text(ALPHABET, max_size=30), st.sampled_from(["<|endoftext|>", "it's", "x" * 100])), max_size=6))
@settings(max_examples=150, deadline=None)
def test_tokens_are_the_librarys(texts):
    counter, encoder = token_counts.counter(WORD), packing.encoder(BYTE)
    assert counter.count(texts) == [len(counter.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert {i: x.tolist() for i, x in encoder.encode(texts)} == {i: encoder.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_token_counts(docs, none):
    counter = token_counts.counter(WORD)
    for r in token_counts.counts(docs, WORD, limit=5).collect():
        text = r.text if "text" in r else dict((d[0], d[1]) for d in DOCS)[r.doc_id]
        n = len(counter.tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 5)
    assert token_counts.counts(none, WORD).count() == 0


def test_packing(docs, none, tmp_path):
    packing.pieces(docs, BYTE, size=64).write.parquet(str(tmp_path / "p"))
    got = packing.pack(docs.sparkSession.read.parquet(str(tmp_path / "p")), size=64).collect()
    tokenizer, want = packing.encoder(BYTE).tokenizer, Counter()
    for i, t, *_ in DOCS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 64 + 1
        for k, a in enumerate([0, *range(first, len(ids), 64)]):
            part = ids[a : a + (64 if k else first)]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        assert all(o == sum(n for _, n in sorted(v)[:i]) for i, (o, _) in enumerate(sorted(v))) and sum(n for _, n in v) <= 64
    packing.pieces(none, BYTE).write.parquet(str(tmp_path / "e"))
    assert packing.pack(docs.sparkSession.read.parquet(str(tmp_path / "e"))).count() == 0


def test_packing_delivers_the_tokens(docs):
    packed = packing.pack(packing.pieces(docs, BYTE, size=64), size=64)
    tokenizer, got = packing.encoder(BYTE).tokenizer, packed.collect()
    tokens = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS)}
    assert all(r.ids == tokens[r.doc_id][r.start : r.start + r.length] for r in got)
    held = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert sum(r.n_pieces for r in held.values()) == len(got) and all(len(r.ids) <= 64 for r in held.values())
    assert all(held[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids for r in got)
    # the digests come from the tokens delivered
    wrong = packed.withColumn("ids_crc32", F.lit(-1).cast("long"))
    assert packing.digests(packed).columns == [c for c in packed.columns if c != "ids"]
    assert Counter(packing.digests(wrong).collect()) == Counter(packed.drop("ids").collect())


def test_scan_drops_only_the_far():
    rng = np.random.default_rng(8)
    table, queries = rng.normal(size=(700, 33)), rng.normal(size=(9, 33))
    far = ((queries[:, None] - table) ** 2).sum(2)
    for share in (0.01, 0.5, 1.0):
        bound = np.quantile(far, share, axis=1)
        i, j = ann.scan(queries, table, bound)
        assert (far[i, j] <= bound[i] * (1 + 1e-8)).all() and len(set(zip(i.tolist(), j.tolist()))) == len(i)
        assert len(i) >= 0.9 * (far <= bound[:, None]).sum()
    assert len(ann.scan(queries, table, np.full(9, np.inf))[0]) == far.size


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
@settings(max_examples=100, deadline=None)
def test_plan_is_best_fit_decreasing(counts):
    used, slots = defaultdict(int), Counter()
    for length, rank, n, first, offset in packing.plan(counts, 50):
        slots[length] += n
        for i in range(n):
            assert used[first + i] == offset
            used[first + i] += length
    assert dict(slots) == counts and all(v <= 50 for v in used.values())
    bins = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        fits = [i for i, b in enumerate(bins) if b + length <= 50]
        if fits:
            bins[max(fits, key=lambda i: bins[i])] += length
        else:
            bins.append(length)
    assert len(used) == len(bins)
