"""N-gram join, components and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tidelog.llm import components, language_id, ngram_join, packing, tables, toxicity
from tidelog.llm.tables import table

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset() if not words else frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def union(parents, a, b):
    a, b = find(parents, a), find(parents, b)
    parents[max(a, b)] = min(a, b)


def find(parents, x):
    while parents[x] != x:
        parents[x] = parents[parents[x]]
        x = parents[x]
    return x


def join_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parents = {i: i for i in sets}
    ids = [i for i, s in sets.items() if s]
    where = defaultdict(set)
    for i in ids:
        for g in sets[i]:
            where[g].add(i)
    for i in ids:
        for j, overlap in Counter(j for g in sets[i] for j in where[g] if j < i).items():
            if 100 * overlap >= 75 * (len(sets[i]) + len(sets[j]) - overlap):
                union(parents, i, j)
    return {i: (len(s), find(parents, i)) for i, s in sets.items()}


def families(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    for size in (1, 4, 40, 150):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 160]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.15:
                base = copy
            texts.append(" ".join(copy))
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))) + " " + line for _ in range(40)]
    texts += [None, "", " \t", "a b", "A\tB", "a b c", "x", "one two three four five", "One two  three four five", *texts[:6]]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "few", "direct", "members", "hot"), [(1, 50, 4, 1024, 500), (2, 10**9, 10**9, 1024, 3), (3, 0, -1, 7, 3), (4, 10**9, -1, 16, 10**6)])
def test_components_of_families(spark, monkeypatch, seed, few, direct, members, hot):
    """Whatever the pivot rounds leave over is settled exactly, in blocks of any size."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "DIRECT", direct)
    monkeypatch.setattr(tables, "HOT_SHARE", hot)
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    monkeypatch.setattr(ngram_join, "OUTSIDE", max(2, members // 4))
    rows = families(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = ngram_join.ngram_components(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == join_brute(rows) and len(found) == len(rows)


def test_small_batches_and_fragments(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BATCH_BYTES", 500)
    monkeypatch.setattr(ngram_join, "LEAST_FRAGMENTS", 61)
    rows = families(9)
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == join_brute(rows)


def test_join_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.ngram_components(frame([])).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_components(frame([(5, None)])).collect()] == [(5, 0, 5)]
    same = ngram_join.ngram_components(frame([(7, "a b"), (7, "a b"), (3, "A b"), (None, "q r")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in same) == [(0, 0), (3, 3), (7, 3), (7, 3)]


def test_drop_near_copies_keeps_columns(spark):
    rows = families(5)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, hit string, slot long")
    kept = ngram_join.drop_near_copies(docs)
    expected = {i for i, (_, c) in join_brute(rows).items() if i == c}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == expected


@pytest.mark.parametrize("seed", range(3))
def test_stars(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    parents = {x: x for e in edges for x in e}
    for a, b in edges:
        union(parents, a, b)
    found = {r["u"]: r["v"] for r in components.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(parents, x) for x in parents if find(parents, x) != x}


def test_no_edges(spark):
    assert components.stars(spark.createDataFrame([], "u long, v long")).count() == 0


def test_planes():
    import numpy as np

    for kind in (np.uint16, np.uint32, np.uint64):
        values = np.array([0, 1, 255, 256, 60000], dtype=kind)
        assert (ngram_join.unplanes(ngram_join.planes(values), kind) == values).all()


def test_pipeline_stages(spark, sf_dir, tmp_path):
    """Each stage's decisions against its operator or brute force, on all its predecessor kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "exact_dedup", "ngram_join", "packing"]
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{number}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{number}")
        kept.append((before, docs))
    assert all(after.columns == columns for _, after in kept[:4])
    ids = lambda frame: {r["doc_id"] for r in frame.select("doc_id").collect()}
    model = toxicity.fit(kept[0][0].select("doc_id", "text"), table(spark, sf_dir, "labels"))
    assert ids(kept[0][1]) == ids(toxicity.score(kept[0][0].select("doc_id", "text"), model).filter("predicted = 0"))
    names = language_id.identify(kept[1][0].select("doc_id", "text"), language_id.fit(kept[1][0]))
    assert ids(kept[1][1]) == ids(names.filter("lang_pred <> 'und' AND score >= 0.5"))
    groups = defaultdict(list)
    for r in kept[2][0].collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
    assert ids(kept[2][1]) == {min(g)[1] for g in groups.values()}
    rows = [(r["doc_id"], r["text"]) for r in kept[3][0].collect()]
    assert ids(kept[3][1]) == {i for i, (_, c) in join_brute(rows).items() if i == c}
    assert ids(kept[4][1]) == ids(kept[4][0]) and kept[4][1].agg({"length": "sum"}).first()[0] == packing.pieces(kept[4][0]).agg({"length": "sum"}).first()[0]


def test_pipeline_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_pipeline_with_clashing_columns(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents").selectExpr("*", "1 AS score", "'x' AS predicted", "2 AS kept", "'y' AS lang_pred", "0 AS keep_id", "3 AS label")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
    assert docs.count() and docs.select("score", "kept").distinct().count() == 1


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)] * 3])
def test_pipeline_on_nothing(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
    assert docs.count() == 0
