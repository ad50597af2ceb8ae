"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Texts are read once, for a 64-bit hash, the SHA-256 and the length of the
normalised text. Pass 1 sets a bit a row in a filter of ``ROW_BITS`` bits a row
and more. The filter is made of blocks of ``WORDS`` words of 64 bits; a task ORs
its rows into its own words and counts the rows of each, and only these blocks
are exchanged and merged: at most one a block and task, no row. A word that
counts more rows than it has bits holds a collision, so at least two rows may be
equal there; every other row is certainly alone. Pass 2 probes the marks of such
words (one bit a word, at most ``MAX_BLOCKS`` blocks, broadcast) with every row.
Rows that miss pass straight through; only those that hit are grouped by
SHA-256, so false positives cost work and never change a result. Beyond some
``MAX_BLOCKS`` x ``WORDS`` x 2 rows the filter fills up and more and more rows
hit; what shuffles then are their hashes and ids.

Defined results: null text counts as empty, so all null, empty and white-space
texts are equal to each other. Of equal texts the one with the most code points
stays, then the smallest id, a null id last. Rows that repeat an id within a
group are one document: they are kept or dropped together. Texts of any length
are read whole. An empty table gives an empty result. Columns of the input may
have any names, also those that the operator adds; an added column replaces one
of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.tables import cut, cut_with, fresh, join_groups, packed, table

#: What the normal form deletes: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: Of pass 1: words a block, bits a row at least, bounds of the blocks, rows a task.
WORDS, ROW_BITS, MIN_BLOCKS, MAX_BLOCKS, TASK_ROWS = 32, 32, 64, 1 << 22, 250_000
#: Bounds of filters of known keys: 2**28 bits are 2**22 words of 64 bits.
MIN_FILTER_BITS, MAX_FILTER_BITS, BITS_PER_WORD = 1 << 16, 1 << 28, 16
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """The text without white space; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _bit(position: Column) -> Column:
    """A 64-bit word with the bit of ``position`` mod 64 set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.bitwiseAND(63).cast("int"))


def block_count(rows: int) -> int:
    """Blocks of pass 1's filter: a power of two within the bounds."""
    blocks = MIN_BLOCKS
    while blocks * WORDS * 64 < ROW_BITS * rows and blocks < MAX_BLOCKS:
        blocks *= 2
    return blocks


def _block(h: Column, blocks: int) -> Column:
    return h.bitwiseAND(F.lit(blocks - 1).cast("bigint"))


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 32).bitwiseAND(WORDS - 1)


def collisions(hashes: DataFrame, h: str, blocks: int) -> DataFrame:
    """Pass 1: (block, marks), one row at most for each block of the filter; a bit of ``marks`` is a word in which rows may share a bit."""
    rows = hashes.select(_block(F.col(h), blocks).alias("block"), _word(F.col(h)).alias("word"), _bit(F.shiftrightunsigned(h, 40)).alias("bit"))
    of = lambda j: F.when(F.col("word") == j, F.col("bit"))
    merged = rows.groupBy("block").agg(*[F.bit_or(of(j)).alias(f"bits{j}") for j in range(WORDS)], *[F.count(of(j)).alias(f"rows{j}") for j in range(WORDS)])
    marks = F.lit(0).cast("bigint")
    for j in range(WORDS):
        marks = marks.bitwiseOR(F.when(F.col(f"rows{j}") > F.bit_count(f"bits{j}"), F.lit(1 << j).cast("bigint")).otherwise(0))
    return merged.select("block", marks.alias("marks")).filter(F.col("marks") != 0)


def _slot(word: Column, bits: int) -> Column:
    return F.xxhash64(word, F.lit(1)).bitwiseAND(F.lit(bits - 1).cast("bigint"))


def repeat_filter(words: DataFrame, bits: int) -> DataFrame:
    """Pass 2's filter: at most ``bits / 64`` rows of (slot_word, slot_bits)."""
    slot = _slot(F.col("word"), bits)
    return (
        words.select(slot.alias("s"))
        .groupBy(F.shiftrightunsigned("s", 6).alias("slot_word"))
        .agg(F.bit_or(_bit(F.col("s"))).alias("slot_bits"))
    )


def filter_bits(n_words: int) -> int:
    """Bits for ``n_words`` entries: a power of two within the bounds."""
    bits = MIN_FILTER_BITS
    while bits < BITS_PER_WORD * n_words and bits < MAX_FILTER_BITS:
        bits *= 2
    return bits


def probe(rows: DataFrame, small: DataFrame, word: Column, bits: int, hit: str) -> DataFrame:
    """``rows`` plus the boolean ``hit``: whether the filter ``small`` may hold ``word``."""
    slot, slot_word, slot_bits = fresh([*rows.columns, hit], "slot", "slot_word", "slot_bits")
    placed = rows.withColumn(slot, _slot(word, bits)).withColumn(slot_word, F.shiftrightunsigned(slot, 6))
    joined = placed.join(F.broadcast(small.withColumnsRenamed({"slot_word": slot_word, "slot_bits": slot_bits})), slot_word, "left")
    found = F.col(slot_bits).bitwiseAND(_bit(F.col(slot))) != 0
    return joined.withColumn(hit, F.coalesce(found, F.lit(False))).drop(slot, slot_word, slot_bits)


def hashed(docs: DataFrame, text: str, h: str, chars: str) -> DataFrame:
    """``docs`` plus hash, length and SHA-256 of each normalised text."""
    norm = fresh([*docs.columns, h, chars, "text_sha256"], "norm")[0]
    more = docs.withColumns({norm: normalised(F.col(text)), chars: F.length(F.coalesce(F.col(text), F.lit("")))})
    return more.withColumns({h: F.xxhash64(norm), "text_sha256": F.sha2(norm, 256)}).drop(norm)


def decided(rows: DataFrame, hashes: DataFrame, n: int, h: str, chars: str, doc_id: str) -> DataFrame:
    """``rows`` plus keep_id, group_size and kept; ``hashes`` are the column ``h`` of all ``n`` of them, staged."""
    block, own, marks = fresh([*rows.columns, *ADDED], "block", "own", "marks")
    blocks = block_count(n)
    found = cut(collisions(packed(hashes.select(h), n, TASK_ROWS), h, blocks)).withColumnsRenamed({"block": own, "marks": marks})
    placed = rows.withColumn(block, _block(F.col(h), blocks))
    probed = placed.join(F.broadcast(found), F.col(block) == F.col(own), "left").drop(block, own)
    hit = F.coalesce(F.col(marks).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), _word(F.col(h)).cast("int"))) != 0, F.lit(False))
    straight = probed.filter(~hit).drop(marks).withColumns({"keep_id": F.col(doc_id), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)})

    maybe = probed.filter(hit).drop(marks)
    order = F.struct(-F.col(chars), F.col(doc_id).isNull(), F.col(doc_id))
    groups = cut(maybe.groupBy("text_sha256").agg(F.min_by(F.col(doc_id), order).alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    # A group of copies may hold a third of the rows: such groups are joined without a shuffle.
    joined = join_groups(maybe, groups, "text_sha256", "group_size", n)
    return straight.unionByName(joined.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id"))))


def narrow(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``; texts are read once."""
    rows, seen = cut_with(hashed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "h", "chars").drop("text"), n=F.count(F.lit(1)))
    return decided(rows, rows, seen["n"], "h", "chars", "doc_id").select("doc_id", *ADDED)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` plus keep_id, group_size, kept and text_sha256."""
    docs = docs.select(*[c for c in docs.columns if c not in ADDED])
    h, chars = fresh([*docs.columns, *ADDED], "h", "chars")
    rows = hashed(docs, text, h, chars)
    hashes, seen = cut_with(rows.select(h), n=F.count(F.lit(1)))
    return decided(rows, hashes, seen["n"], h, chars, doc_id).select(*docs.columns, *ADDED)


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    The ids that go are folded into a filter of bounded size; only rows that hit
    it meet the ids and hashes themselves.
    """
    gone, seen = cut_with(narrow(docs, text, doc_id).filter(~F.col("kept")).select(F.struct("doc_id").alias("word"), "text_sha256").distinct(), n=F.count(F.lit(1)))
    bits = filter_bits(seen["n"])
    hit, norm, gone_id, gone_sha = fresh(docs.columns, "hit", "norm", "gone_id", "gone_sha")
    probed = probe(docs, repeat_filter(gone, bits), F.struct(F.col(doc_id).alias("doc_id")), bits, hit)
    checked = probed.filter(F.col(hit)).withColumn(norm, F.sha2(normalised(F.col(text)), 256))
    left = checked.join(gone.select(F.col("word.doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)), F.col(doc_id).eqNullSafe(F.col(gone_id)) & (F.col(norm) == F.col(gone_sha)), "left_anti")
    return probed.filter(~F.col(hit)).drop(hit).unionByName(left.drop(hit, norm))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and survivor of every row of ``documents``."""
    return narrow(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY n) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS kept,
  sha256(n) AS text_sha256
FROM d
"""
