"""Document fingerprints by randomised edit embedding.

All documents share one table of coin flips, by time and character. A walk over
a text repeats a character for as many steps as the coins of (time, character)
say before it moves on, so that two walks over texts that differ by a few edits
tend to fall into step again after each edit (edit distance becomes Hamming
distance of the walks' outputs). As the time until then has a heavy tail, walks
start afresh at anchors, characters whose last ``CONTEXT`` characters hash to 0
modulo ``SPACING``; an edit thus disturbs its own stretch at most. A fingerprint
samples the output: the coordinates (anchor, time, character with its context)
at which characters begin are dealt to ``GROUPS`` groups with a sign each by a
hash, and a group's digit is the sign of its sum (+, - or 0). The likeness of
two fingerprints is the share of digits that agree among those not 0 in both,
rescaled so that unrelated texts come out at about 0.

Near pairs are found by bit-sampled banding: a band is a sample of digits, and
documents equal in a band are candidates, which are then verified on the whole
fingerprint. Equal fingerprints are collapsed first; within a band's bucket all
are compared with all, in blocks of about two times ``BLOCK`` rows at most, so
that a hot bucket is many small tasks' work. Bands do not get longer with the
number of rows, as that would lose pairs near the threshold; the comparisons of
unrelated texts thus grow with the square of the rows over 3^``DIGITS``. The
registered query does not use banding.

The pairing of each document with the next one (by falling id) is a range
partitioning by id; only the rows at the partitions' edges are matched up in a
second, small step.

Defined results: null text counts as empty; a fingerprint of no text is all 0
digits, its likeness to another such one 1 and to any other 0. Equal texts have
equal fingerprints. Rows of equal ids are ordered by their text, null ids come
last. A single row is its own next document. An empty table gives an empty
result. Whole texts are walked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.arrow_columns import slices
from tidelog.llm.tables import cut, table

GROUPS, TIMES, SYMBOLS, SEED = 256, 2048, 512, 20
CONTEXT, SPACING = 4, 128
BANDS, DIGITS, NEAR = 24, 10, 0.6
BLOCK = 1024
CHUNK = 1 << 20


@cache
def jumps() -> np.ndarray:
    """Steps spent on a character, by (time, character): flips of the shared coins until the first head."""
    coins = np.random.default_rng(SEED).integers(0, 2, (TIMES, SYMBOLS), dtype=np.uint8)
    steps = np.ones((TIMES, SYMBOLS), dtype=np.int32)
    wait = np.full(SYMBOLS, 1, dtype=np.int32)
    for t in range(2 * TIMES - 1, -1, -1):  # twice round, as time is cyclic
        wait = np.where(coins[t % TIMES] == 1, 1, np.minimum(wait + 1, TIMES))
        steps[t % TIMES] = wait
    return steps.ravel()


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit hash well mixed."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def stretches(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where walks start (each text's first character and the anchors), their hashes, and the hash of every character's context."""
    h = np.zeros(len(points), dtype=np.uint64)
    wide = points.astype(np.uint64)
    place = np.arange(len(points)) - np.repeat(first, np.diff(np.append(first, len(points))))
    for back in range(CONTEXT):  # a context never reaches into the text before
        own = wide[: len(wide) - back] * np.uint64((0x9E3779B97F4A7C15 * (2 * back + 1)) & (1 << 64) - 1)
        h[back:] += np.where(place[back:] >= back, own, np.uint64(0))
    h = mixed(h)
    starts = h % np.uint64(SPACING) == 0
    starts &= place >= CONTEXT - 1
    starts[first] = True
    at = np.flatnonzero(starts)
    return at, np.where(np.isin(at, first), np.uint64(SEED), h[at]), h


def walk(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Times at which each character begins, for walks from each of ``first`` to the next; they go in lockstep."""
    steps, lengths = jumps(), np.diff(np.append(first, len(symbols)))
    order = np.argsort(-lengths, kind="stable")
    times = np.zeros(len(symbols), dtype=np.int32)
    at, now = first[order].astype(np.int32), np.zeros(len(first), dtype=np.int32)
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(longest + 1), side="left")
    for step in range(longest):
        n = active[step]
        place, clock = at[:n] + step, now[:n]
        times[place] = clock
        clock += steps[(clock % TIMES) * SYMBOLS + symbols[place]]
    return times


def text_digits(texts: list[str]) -> np.ndarray:
    """Digits of each text, one row each."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    sums = np.zeros(len(texts) * GROUPS)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    if len(points):
        begin = np.cumsum(lengths) - lengths
        first, anchor, context = stretches(points, begin[lengths > 0])
        times = walk((points % SYMBOLS).astype(np.int32), first)
        run = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(points))))
        owner = np.repeat(np.arange(len(texts)), lengths)
        for at in range(0, len(points), CHUNK):
            part = slice(at, at + CHUNK)
            h = anchor[run[part]] + times[part].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + context[part]
            h = mixed(h)
            group = owner[part] * GROUPS + (h % np.uint64(GROUPS)).astype(np.int64)
            sums += np.bincount(group, weights=((h >> np.uint64(40)) & np.uint64(1)) * 2.0 - 1.0, minlength=len(sums))
    return np.sign(sums.reshape(len(texts), GROUPS)).astype(np.int8)


def to_text(row: np.ndarray) -> str:
    """A fingerprint as hex digits: the + bits, then the - bits."""
    return np.packbits(row > 0).tobytes().hex() + np.packbits(row < 0).tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)).astype(np.int8)
    return bits[:GROUPS] - bits[GROUPS:]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness (0 to 1) of fingerprints, row by row."""
    used = ((a != 0) | (b != 0)).sum(1)
    agree = ((a == b) & (a != 0)).sum(1)
    da, db = (a != 0).mean(1), (b != 0).mean(1)
    either = np.maximum(da + db - da * db, 1e-12)
    chance = da * db / 2 / either
    found = np.clip((agree / np.maximum(used, 1) - chance) / (1 - chance), 0, 1)
    return np.where((a == b).all(1), 1.0, found)


def compared(texts: list[str], following: list[str]) -> dict[str, list]:
    """The query's columns for texts and the documents that follow them."""
    edits = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
    chained = following[:-1] == texts[1:]
    both = text_digits(texts + (following[-1:] if chained else following))
    own, after = both[: len(texts)], both[1:] if chained else both[len(texts) :]
    edited = text_digits(edits)
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edits],
        "fingerprint": [to_text(r) for r in own],
        "edited_fingerprint": [to_text(r) for r in edited],
        "near_edited": likeness(own, edited).tolist(),
        "near_next": likeness(own, after).tolist(),
    }


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(names: list[str], columns: dict[str, list], ids: pa.Array, **more: pa.Array) -> pa.RecordBatch:
    kinds = {"n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
    made = {k: pa.array(v, kinds.get(k, pa.string())) for k, v in columns.items()}
    made |= {"doc_id": ids, **more}
    return pa.RecordBatch.from_arrays([made[n] for n in names], names=names)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprints and likeness of each row of ``docs`` (doc_id, text) to its edited text and to the next row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", ")), "edge", "part", "text"]
    empty = {c.split()[0]: None for c in COLUMNS.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        edge = lambda row, kind: _batch(names, {k: [None] for k in empty}, row.column(0), edge=pa.array([kind]), part=pa.array([part], pa.int32()), text=row.column(1))
        for batch in batches:
            for piece in slices(batch, 1):
                if held is None:
                    yield edge(piece.slice(0, 1), "first")
                    rows = piece
                else:
                    rows = pa.Table.from_batches([held, piece]).combine_chunks().to_batches()[0]
                texts = rows.column(1).to_pylist()
                if len(texts) > 1:
                    n = len(texts) - 1
                    void = {"edge": pa.nulls(n, pa.string()), "part": pa.nulls(n, pa.int32()), "text": pa.nulls(n, pa.string())}
                    yield _batch(names, compared(texts[:-1], texts[1:]), rows.column(0).slice(0, n), **void)
                held = rows.slice(len(texts) - 1, 1)
        if held is not None:
            yield edge(held, "last")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                yield _batch(names[:-3], compared(piece.column(1).to_pylist(), piece.column(2).to_pylist()), piece.column(0))

    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    ordered = source.repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    done = cut(ordered.mapInArrow(run, f"doc_id {id_type}, {COLUMNS}, edge string, part int, text string"))
    complete = done.filter(F.col("edge").isNull()).select(*names[:-3])
    first, last = (done.filter(F.col("edge") == kind) for kind in ("first", "last"))
    parts = [r["part"] for r in first.select("part").orderBy("part").collect()]  # one for each partition
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    ends = last.join(following, "part").select("doc_id", "text", "next_part")
    met = ends.join(first.select(F.col("part").alias("next_part"), F.col("text").alias("next_text")), "next_part")
    return complete.unionByName(met.select("doc_id", "text", "next_text").mapInArrow(resolve, f"doc_id {id_type}, {COLUMNS}"))


def fingerprinter() -> Callable[[pa.Array], list[pa.Array]]:
    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([to_text(r) for r in text_digits([t or "" for t in texts.to_pylist()])], pa.string())]

    return run


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the fingerprint of each whole text."""
    from pyspark.sql import types as T

    from tidelog.llm.arrow_columns import with_python_columns

    return with_python_columns(docs, [(text, [T.StructField("fingerprint", T.StringType())], fingerprinter)])


def near_pairs(rows: DataFrame, least: float = NEAR) -> DataFrame:
    """Verified pairs (a, b, near) of different fingerprints of ``rows`` (fingerprint), by banding."""
    chosen = np.random.default_rng(SEED + 1).permutation(GROUPS)[: BANDS * DIGITS].reshape(BANDS, DIGITS)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_pylist()
            all_digits = np.array([from_text(p) for p in prints], dtype=np.int8).reshape(-1, GROUPS)
            keys = [(i, f"{b}:" + (all_digits[i, chosen[b]] + 1).tobytes().hex()) for i in range(len(prints)) for b in range(BANDS)]
            yield pa.RecordBatch.from_arrays([pa.array([prints[i] for i, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.string())], names=["fingerprint", "band"])

    banded = rows.select("fingerprint").distinct().mapInArrow(bands, "fingerprint string, band string")
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    placed = banded.join(sizes, "band").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    # A part meets itself and each other part of its bucket in a block of their own.
    met = placed.select("fingerprint", "band", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    blocks = met.select("fingerprint", "part", F.concat_ws(":", "band", F.least("part", "other"), F.greatest("part", "other")).alias("block"))
    ordered = blocks.repartition("block").sortWithinPartitions("block")
    return ordered.mapInArrow(comparer(least), "a string, b string, near double").distinct()


def _block_pairs(digits: np.ndarray, part: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that are near: of all its pairs, or of those across its two parts."""
    low, high = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    signs = np.concatenate([digits > 0, digits < 0], axis=1).astype(np.float32)
    full = (digits != 0).astype(np.float32)
    agree = signs[low] @ signs[high].T
    n = full.sum(1)
    used = n[low][:, None] + n[high] - full[low] @ full[high].T
    da, db = n[low][:, None] / GROUPS, n[high] / GROUPS
    either = np.maximum(da + db - da * db, 1e-6)
    chance = da * db / 2 / either
    i, j = np.nonzero((agree / np.maximum(used, 1) - chance) / (1 - chance) >= least - 1e-3)  # verified exactly below
    i, j = low[i], high[j]
    if part.min() == part.max():
        i, j = i[i < j], j[i < j]
    kept = likeness(digits[i], digits[j]) >= least
    return i[kept], j[kept]


def comparer(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Near pairs of rows (fingerprint, part, block) that come ordered by block."""

    def compared_blocks(rows: pa.Table) -> pa.RecordBatch:
        prints, part = rows.column(0).to_pylist(), rows.column(1).to_numpy()
        names = np.array(rows.column(2).to_pylist(), dtype=object)
        bits = np.unpackbits(np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), -1), axis=1).astype(np.int8)
        digits = bits[:, :GROUPS] - bits[:, GROUPS:]
        bounds = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(prints)]
        found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, end in zip(bounds, bounds[1:], strict=False):
            if end - at > 1:
                i, j = _block_pairs(digits[at:end], part[at:end], least)
                found_i.append(i + at)
                found_j.append(j + at)
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        near = likeness(digits[i], digits[j])
        pairs = [sorted((prints[x], prints[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array(near, pa.float64())], names=["a", "b", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(2)
            if held and held[-1].column(2)[-1] != names[0]:
                yield compared_blocks(pa.Table.from_batches(held))
                held = []
            last = names.to_pylist().index(names[-1].as_py())  # the last block may go on in the next batch
            if last:
                yield compared_blocks(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield compared_blocks(pa.Table.from_batches(held))

    return run


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every row of ``documents`` and of its edited text."""
    return compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
