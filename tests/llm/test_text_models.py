"""Language identification and toxicity: the methods against brute force, held-out accuracy, edge cases."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import language_id as lid
from tidelog.llm import toxicity as tox
from tidelog.llm.tables import table

BIG = "/root/testdata/sf0.01"


def segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[last:i])
                last = i
        yield [*parts, word[last:]]


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "abc", "▁ab", "c"]
    weights = np.append(np.random.default_rng(1).dirichlet(np.ones(len(pieces))), 1e-3)[:, None]
    found = lid.Lattices(pieces).log_probability(["abcab", "a", "xb"], weights)[:, 0]
    for word, value in zip(["abcab", "a", "xb"], found, strict=True):
        p = lambda s: weights[pieces.index(s), 0] if s in pieces else 0.0
        total = sum(np.prod([p(s) + (1e-3 if len(s) == 1 else 0) for s in seg]) for seg in segmentations("▁" + word))
        assert value == pytest.approx(np.log(total))


def test_em_raises_the_likelihood():
    pieces = ["▁", "▁x", "a", "b", "ab", "ba", "x"]
    words, n = ["abab", "ab", "xab"], np.array([3.0, 5.0, 2.0])
    lattices, weights, last = lid.Lattices(pieces), np.append(np.full(len(pieces), 1 / len(pieces)), 1e-7), -np.inf
    for _ in range(5):
        now = float(n @ lattices.log_probability(words, weights[:, None])[:, 0])
        assert now >= last - 1e-9
        last, use = now, lattices.expected(words, n, weights) + 1e-9
        weights = np.append(use / use.sum(), 1e-7)


def test_held_out_accuracy(spark):
    rows = lid.op1_language_id(spark, BIG).toPandas()
    truth = table(spark, BIG, "documents").select("doc_id", "lang", "text").toPandas().set_index("doc_id")
    held = rows[rows.held_out]
    assert len(rows) == len(truth) and (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (held.lang_pred == held.doc_id.map(truth.lang)).mean() > 0.95 and rows.score.between(0, 1).all()


def test_language_edge_cases():
    model = lid.train({"aa": Counter({"the": 5, "and": 3}), "bb": Counter({"und": 5, "der": 4})}, lid.vocabulary(lid.vocabulary_path()))
    names, scores = lid.scorer(model)(pa.array([None, "", "12 !?", "the and", "und der", "x" * 500, "THE", "日本"]))
    assert names.to_pylist()[:5] == ["und", "und", "und", "aa", "bb"] and names.to_pylist()[6] == "aa" and scores.to_pylist()[:3] == [0.0, 0.0, 0.0]
    assert lid.scorer(lid.train({}, ["a"]))(pa.array(["text"]))[0].to_pylist() == ["und"]


def test_cache_bound_changes_nothing(monkeypatch):
    model = lid.train({"aa": Counter({"the": 5, "and": 3}), "bb": Counter({"und": 5, "der": 4})}, lid.vocabulary(lid.vocabulary_path()))
    texts = [pa.array([f"the word{chr(97 + i)} und der and"]) for i in range(20)]
    whole = lid.scorer(model)
    expected = [whole(t)[1].to_pylist() for t in texts]
    monkeypatch.setattr(lid, "CACHE_WORDS", 6)
    monkeypatch.setattr(lid, "LEAST_CACHE", 6)
    small = lid.scorer(model)
    assert [small(t)[1].to_pylist() for t in texts] == expected
    many = pa.array(["the " + " ".join(f"w{chr(97 + i)}" for i in range(20)), "und der", "the", None, "and und der the a b c d"])
    assert small(many)[0] == whole(many)[0] and small(many)[1].to_pylist() == pytest.approx(whole(many)[1].to_pylist())


def test_toxicity_held_out(spark):
    rows = tox.op8_toxicity(spark, BIG).toPandas().set_index("doc_id")
    labels = table(spark, BIG, "labels").toPandas()
    held = labels[labels.doc_id.map(rows.held_out)]
    score, y = held.doc_id.map(rows.score).to_numpy(), held.toxic.to_numpy()
    order = score.argsort().argsort()
    n = y.sum()
    assert n and (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n)) > 0.8
    assert (rows.predicted == (rows.score >= 0.5)).all() and rows.score.between(0, 1).all()


def corpus(spark, rows, more=()):
    """(docs, labels) of rows (id, text, toxic); ids of these are not held out."""
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows] + list(more), "doc_id long, toxic int")


def learnable(n):
    return [i for i in range(2 * n + 50) if zlib.crc32(str(i).encode()) % 5][:n]


def brute_force(rows):
    """Scores by a dense fit, written apart from the operator: a function from a text to its score."""

    def grams(text):
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        return {f"<{w}>"[i:j] for w in words for i in range(len(w) + 2) for j in range(i + 3, min(i + 5, len(w) + 2) + 1)}

    texts, y = [r[1] for r in rows], np.array([r[2] for r in rows], dtype=float)
    names = sorted(set().union(*map(grams, texts)))
    x = np.array([[float(g in grams(t)) for g in names] for t in texts])
    toxic, clean = x[y == 1].sum(0), x[y == 0].sum(0)
    ratio = np.log((toxic + 1) / (y.sum() + 2)) - np.log((clean + 1) / ((1 - y).sum() + 2))
    ratio[(toxic + clean < 4) | (np.abs(ratio) < 0.5)] = 0
    x, w, b = x * ratio, np.zeros(len(names)), np.log(y.mean() / (1 - y.mean()))
    m, v, mb, vb = 0 * w, 0 * w, 0.0, 0.0
    for step in range(1, 301):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        g, gb = x.T @ error + 2e-3 * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b = b - 0.02 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return lambda text: 1 / (1 + np.exp(-(b + sum(ratio[i] * w[i] for i in (names.index(g) for g in grams(text) if g in names)))))


TOXIC = ["you idiot fool", "what an idiot", "idiots all", "an idiotic thing"]
CLEAN = ["a fine day", "the cat sat", "on the mat", "rain again", "fine rain all day"]


def test_toxicity_against_brute_force(spark):
    rows = [(i, (TOXIC if k % 3 == 0 else CLEAN)[k % (4 if k % 3 == 0 else 5)], int(k % 3 == 0)) for k, i in enumerate(learnable(60))]
    model = tox.fit(*corpus(spark, rows))
    texts = [*TOXIC, *CLEAN, "IDIOT!", "the day", "", None, "x" * 1000]
    expected = brute_force(rows)
    scores, predicted = tox.scorer(model)(pa.array(texts))
    assert scores.to_pylist() == pytest.approx([expected(t) for t in texts], abs=1e-3)  # weights of under 1e-4 are left out
    assert predicted.to_pylist() == [int(s >= 0.5) for s in scores.to_pylist()] and predicted.to_pylist()[:4] == [1] * 4


def test_toxicity_one_class(spark):
    rows = [(i, "a", 0) for i in learnable(3)]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for model in (tox.fit(*corpus(spark, rows)), tox.fit(corpus(spark, rows)[0], none), tox.fit(*corpus(spark, rows[:0]))):
        scores, predicted = tox.scorer(model)(pa.array(["x", None]))
        assert predicted.to_pylist() == [0, 0] and scores[0] == scores[1]


def test_toxicity_rows_of_any_kind(spark):
    """Long labelled texts are learned from; repeated ids, repeated labels, strange labels and clashing columns don't matter."""
    ids = learnable(80)
    rows = [(i, "you idiot fool " * 2000 if k % 2 else "a fine day on the mat", k % 2) for k, i in enumerate(ids)]
    docs, labels = corpus(spark, rows, [(ids[0], 0), (ids[1], 1), (ids[2], 7), (ids[3], None), (None, 1), (10**9, 1)])
    many = docs.unionByName(docs.filter(F.col("doc_id") == ids[1]).crossJoin(spark.range(500)).drop("id")).withColumns({"score": F.lit("mine"), "times": F.lit(1), "toxic": F.lit(0)})
    sample, shares = tox.sampled(many, labels, 1500)
    assert sample.count() == 80 and shares == (41 / 82, 41 / 82)
    model = tox.fit(many, labels)
    found = tox.score(spark.createDataFrame([(1, "idiot", "a"), (1, "idiot", "b"), (None, None, "c"), (2, "the day", "d")], "doc_id long, text string, score string"), model)
    assert found.columns == ["doc_id", "text", "score", "predicted"] and {(r["text"], r["predicted"]) for r in found.collect() if r["text"]} == {("idiot", 1), ("the day", 0)} and found.count() == 4
    assert tox.score(docs.limit(0), model).count() == 0


def test_language_long_words():
    """A long word's probability is that of the lattice, whatever its length."""
    pieces = ["▁", "▁a", "a", "ab", "b", "abc", "▁ab", "c"]
    weights = np.random.default_rng(1).dirichlet(np.ones(len(pieces) + 1), 2).T
    lattices = lid.Lattices(pieces)
    for word in ("abcab", "x", "abcaaabbbcx" * 3):
        assert lattices.long_forward(word, weights) == pytest.approx(lattices.log_probability([word], weights)[0])
        assert lattices._expected_long(word, weights[:, 0]) == pytest.approx(lattices._expected([word], np.ones(1), weights[:, 0]))
    one, two = (lattices.long_forward("abc" * n, weights) for n in (40_000, 80_000))
    assert np.isfinite(two).all() and two == pytest.approx(2 * one, rel=1e-3)


def test_language_letters():
    assert lid.words_of("½ ²³ Ⅷ 12 _") == [] and lid.words_of("กัน it's ÀB") == ["กัน", "it", "s", "àb"]


def test_many_languages(spark):
    """No language is left out, however many there are."""
    rows = [(i, f"l{i % 300:03}", " ".join(chr(97 + (i % 300) // 26**k % 26) * 3 for k in range(3)) + " " + chr(97 + i % 26) * (2 + i % 7)) for i in learnable(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = lid.fit(docs)
    assert len(model.languages) == 300
    found = lid.identify(docs.withColumn("lang_pred", F.lit("mine")), model)
    assert found.columns == ["doc_id", "lang", "text", "lang_pred", "score"]
    pairs = [(r["lang"], r["lang_pred"]) for r in found.collect()]
    assert len(pairs) == len(rows) and sum(a == b for a, b in pairs) > 0.7 * len(pairs)


def test_language_tables_of_any_kind(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    model = lid.fit(empty)
    assert model.languages == [] and lid.identify(empty, model).count() == 0
    rows = [(1, "b", "same"), (1, "b", "same"), (2, "a", "same"), (None, "a", "same"), (3, None, None), (4, "a", ""), (6, "b", "same same")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = lid.identify(docs, lid.train({"b": Counter(same=3), "a": Counter(same=3)}, ["▁", "same", "s"])).collect()
    assert [r["lang_pred"] for r in found if r["text"]] == ["a"] * 5 and all(r["lang_pred"] == "und" for r in found if not r["text"]) and len(found) == len(rows)
