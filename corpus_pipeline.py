"""Corpus pipeline: toxicity, language, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``, for the documents they keep.

Defined results, of every stage: a null text is an empty one; texts of any
length are read whole; rows that repeat an id or a text are rows like others (a
stage that keeps one of several says which); no documents give no rows; further
columns of ``docs``, of whatever names, are handed on as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import exact_dedup, language_id, ngram_join, packing, toxicity
from tidelog.llm.tables import ensure_checkpoint_dir, table

#: The least posterior of a language at which a document is kept.
LEAST_SCORE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def guarded(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with working names for all columns but those that are used, and the way back to their own names."""
    names = [c if c in used else f"_own{i}" for i, c in enumerate(docs.columns)]
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    return renamed, [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, doesn't find toxic.

    Empty texts get the intercept's score; with no labels nothing is toxic.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows, own = guarded(docs, "text")
    return toxicity.score(rows, model).filter(F.col("predicted") == 0).select(*own)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told, with a posterior of ``LEAST_SCORE`` at least.

    Texts without a letter are in none. Of languages that tie the first counts.
    """
    model = language_id.fit(docs.select("doc_id", "lang", "text"))
    rows, own = guarded(docs, "text")
    told = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return language_id.identify(rows, model).filter(told).select(*own)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, of equally long ones that of the smallest id, a null id last.

    Rows of equal text and id are one document, kept or dropped together.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of near copies.

    Texts without words are near to none and stay.
    """
    return ngram_join.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces and their places in sequences; an empty text is the closing id alone."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("packing", pack),
]

#: SQL can't express the trained stages; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
