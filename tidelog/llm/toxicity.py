"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is a character n-gram of a word (with marks for the word's start and
end); its value in a document is 1 where any word has it. Each is scaled by its
log-count ratio between the two classes, and a logistic regression is fitted on
the scaled features (the ratios are thus the prior belief about their weights).

Training: at most ``SAMPLE_DOCS`` labelled documents of each class, chosen by a
hash of the id, whatever their length. The classes are weighted back to their
share of all labels. In how many sampled documents of each class an n-gram
occurs is counted by the executors; those of fewer than ``MIN_DOCS`` documents,
or with a ratio near 0, are left out there. The driver gets the others and, of
each sampled document, the numbers of those it has: no text and no other n-gram.
Scoring covers every word of every text.

Defined results: null text counts as empty; a text without words gets the
intercept's score. Where one class has no sampled row, every score is the share
of toxic labels (0 with no labels at all). Labels other than 0 and 1, null ids
and labels of no document don't count. Repeated labels of a document count as
often as they occur; of documents that share an id the text that sorts first is
learned from. Rows are never dropped or merged. Columns of the input may have
any names; an added column replaces one of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.arrow_columns import slices, with_python_columns
from tidelog.llm.language_id import held_out
from tidelog.llm.tables import cut, packed, table
from tidelog.llm.worker_cache import claim, trim

SAMPLE_DOCS = 1500
SHORTEST, LONGEST, MIN_DOCS, MIN_RATIO = 3, 5, 4, 0.5
STEPS, L2, ALPHA = 300, 2e-3, 1.0
#: Words whose features a worker keeps; longer words than ``CACHE_LETTERS`` are worked out anew.
CACHE_WORDS, CACHE_LETTERS = 300_000, 60
#: Features handled at once in a step of the fit; sampled documents a task.
CHUNK, DOCS_PER_TASK = 1 << 20, 400
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return WORDS.findall(text.lower())


def grams_of(word: str) -> set[str]:
    """Character n-grams of ``<word>``."""
    marked = f"<{word}>"
    return {marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)}


def grams_in(text: str) -> set[str]:
    """Character n-grams of all words of ``text``."""
    return set().union(*map(grams_of, set(words_of(text))))


@dataclass
class ToxicityModel:
    intercept: float
    weights: dict[str, float] = field(default_factory=dict)  # of n-grams, ratios included


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def log_count_ratio(in_toxic, in_all, n_toxic: float, n_clean: float):
    """Of an n-gram's documents: the log of the smoothed share among the toxic ones over that among the clean ones."""
    return np.log((in_toxic + ALPHA) / (n_toxic + 2 * ALPHA)) - np.log((in_all - in_toxic + ALPHA) / (n_clean + 2 * ALPHA))


def constant(shares: tuple[float, float]) -> ToxicityModel:
    """The model that gives every text the share of toxic labels."""
    share = min(max(shares[1], 1e-9), 1 - 1e-9)
    return ToxicityModel(float(np.log(share / (1 - share))))


def regression(docs: list[np.ndarray], y: np.ndarray, times: np.ndarray, scale: np.ndarray, shares: tuple[float, float]) -> tuple[float, np.ndarray]:
    """(intercept, weights) of the logistic regression.

    ``docs`` has the numbers of each document's features, ``times`` how often a
    document counts and ``scale`` the features' values where present.
    """
    sizes = np.array([len(d) for d in docs])
    columns = np.concatenate([np.zeros(0, np.int32), *docs])
    ends = np.cumsum(sizes)
    pieces, at = [], 0  # runs of whole documents of about CHUNK features
    while at < len(docs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        pieces.append(slice(at, to))
        at = to
    amount = np.where(y == 1, shares[1] / (times * y).sum(), shares[0] / (times * (1 - y)).sum()) * times
    w, b = np.zeros(len(scale)), float(np.log(max(shares[1], 1e-9) / max(shares[0], 1e-9)))
    # Adam with a fixed number of full-batch steps: the same data give the same model.
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        g, gb, scaled = np.zeros_like(w), 0.0, w * scale
        for piece in pieces:
            first = ends[piece.start] - sizes[piece.start]
            own = columns[first : ends[piece.stop - 1]]
            row = np.repeat(np.arange(piece.stop - piece.start), sizes[piece])
            p = _logistic(np.bincount(row, weights=scaled[own], minlength=piece.stop - piece.start) + b)
            error = (p - y[piece]) * amount[piece]
            g += np.bincount(own, weights=error[row], minlength=len(w))
            gb += float(error.sum())
        g = g * scale + L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w = w - 0.02 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.02 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return float(b), w * scale


def scorer(model: ToxicityModel) -> Callable[[pa.Array], list[pa.Array]]:
    """The function from texts to (score, predicted), with a bounded cache of words."""
    claim("toxicity")
    grams = list(model.weights)
    ids = {g: i for i, g in enumerate(grams)}
    weights = [model.weights[g] for g in grams]
    cache: dict[str, tuple[int, ...]] = {}

    def features(word: str) -> tuple[int, ...]:
        found = tuple({ids[g] for g in grams_of(word) if g in ids})
        if len(word) <= CACHE_LETTERS:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            cache[word] = found
        return found

    def score(texts: pa.Array) -> list[pa.Array]:
        sums = []
        for text in texts.to_pylist():
            present: set[int] = set()
            for word in set(words_of(text)) if text else ():
                found = cache.get(word)
                if found is None:
                    found = features(word)
                if found:
                    present.update(found)
            sums.append(model.intercept + sum(weights[i] for i in sorted(present)))
        scores = _logistic(np.array(sums, dtype=float))
        return [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]

    return score


def sampled(docs: DataFrame, labels: DataFrame, sample_docs: int) -> tuple[DataFrame | None, tuple[float, float]]:
    """(toxic, times, text) of the sample, and the classes' parts of all labels (clean, toxic)."""
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = cut(known.join(docs.select("doc_id"), "doc_id", "left_semi"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    if not total:
        return None, (1.0, 0.0)
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = Counter((r["doc_id"], r["toxic"]) for c in sorted(sizes) for r in known.filter(F.col("toxic") == c).orderBy(*order).limit(sample_docs).collect())
    # At most two times SAMPLE_DOCS ids: small enough to broadcast at any size of the input.
    schema = T.StructType([*known.schema.fields, T.StructField("times", T.LongType())])
    picked = docs.sparkSession.createDataFrame([(*k, n) for k, n in sorted(chosen.items())], schema)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    sample = cut(texts.groupBy("doc_id", "toxic", "times").agg(F.min("text").alias("text")).select("toxic", "times", "text"))
    return packed(sample, len(chosen), DOCS_PER_TASK), (sizes.get(0, 0) / total, sizes.get(1, 0) / total)


def gram_counts(sample: DataFrame) -> DataFrame:
    """(gram, in_all, in_toxic): in how many documents of ``sample`` each n-gram occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for batch in batches:
            for part in slices(batch, 2):
                every, toxic = Counter(), Counter()
                for label, times, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for gram in grams_in(text):
                        every[gram] += times
                        if label:
                            toxic[gram] += times
                grams = list(every)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams, pa.string()), pa.array(every.values(), pa.int64()), pa.array([toxic[g] for g in grams], pa.int64())], names=["gram", "in_all", "in_toxic"]
                )

    counted = sample.mapInArrow(count, "gram string, in_all long, in_toxic long")
    return counted.groupBy("gram").agg(F.sum("in_all").alias("in_all"), F.sum("in_toxic").alias("in_toxic"))


def encoded(sample: DataFrame, grams: list[str]) -> DataFrame:
    """(toxic, times, features): the places in ``grams`` of each sampled document's n-grams, as 32-bit numbers."""
    shared = sample.sparkSession.sparkContext.broadcast(grams)  # n-grams of the bounded sample

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {g: i for i, g in enumerate(shared.value)}
        for batch in batches:
            for part in slices(batch, 2):
                found = [np.array(sorted(ids[g] for g in grams_in(t) if g in ids), dtype=np.int32).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["toxic", "times", "features"])

    return sample.mapInArrow(encode, f"toxic {sample.schema['toxic'].dataType.simpleString()}, times long, features binary")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """Learn from the labelled documents that are not held out."""
    sample, shares = sampled(docs, labels, sample_docs)
    if sample is None:
        return constant(shares)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.sum("times").alias("n")).collect()}
    if len(n) < 2:
        return constant(shares)
    smooth = lambda c, of: F.log((F.col(c) + ALPHA) / (n[of] + 2 * ALPHA))
    ratio = smooth("in_toxic", 1) - smooth("in_clean", 0)
    telling = gram_counts(sample).filter(F.col("in_all") >= MIN_DOCS).withColumn("in_clean", F.col("in_all") - F.col("in_toxic")).filter(F.abs(ratio) >= MIN_RATIO)
    table_ = telling.select("gram", "in_all", "in_toxic").orderBy("gram").toArrow()
    grams = table_.column("gram").to_pylist()
    scale = log_count_ratio(table_.column("in_toxic").to_numpy(), table_.column("in_all").to_numpy(), n[1], n[0])
    rows = encoded(sample, grams).orderBy("toxic", "times", "features").toArrow()
    features = [np.frombuffer(f.as_buffer(), np.int32) for f in rows.column("features")]
    y, times = (rows.column(c).to_numpy().astype(float) for c in ("toxic", "times"))
    b, final = regression(features, y, times, scale, shares)
    model = ToxicityModel(b, {g: float(x) for g, x in zip(grams, final, strict=True) if abs(x) > 1e-4})
    del table_, rows, features, grams
    trim()
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` plus score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return with_python_columns(docs, [("text", fields, lambda: scorer(shared.value))])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
