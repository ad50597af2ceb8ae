"""Best-fit packing of documents into fixed-length sequences by bin completion.

A document's ids (with one closing id) are cut into pieces only where they are
longer than a sequence. How many pieces have each length is a table of at most
``CAPACITY`` counts, whatever the size of the corpus, and packing is solved on
that table: bin completion takes the largest remaining length, enumerates all
undominated fillings of the room beside it, lazily in order of their waste, and
branches on them, applying a filling first to as many sequences at once as the
counts allow and in the end to fewer. A branch is pruned once its waste exceeds what a better packing than the
incumbent may waste; the first incumbent is best-fit decreasing. The search
ends at the lower bound (all tokens over the capacity, rounded up) or after
``NODES`` nodes, with the best packing found.

Every piece has a rank among the pieces of its length; a filling owns a range
of ranks of each of its lengths, which gives a piece its sequence and its place.
Ranks are counted within ``SLICES`` hash slices of a length, with offsets, as a
single length may hold any share of the pieces.

A text's ids are the library's with its defaults: the vocabulary's special
tokens (``<|endoftext|>``) are one id each where a text spells them.

Defined results: a null or empty text is the closing id alone. Rows of equal or
null ids are packed like any others. Which of equally long pieces go into which
sequence is decided by hash slice, id, piece and content; pieces alike in all of
these may change places. Texts of any length are encoded whole. An empty table
gives an empty result. Columns of the pieces may have any names; sequence_id and
offset replace columns of these names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.arrow_columns import slices
from tidelog.llm.tables import cut, fresh, table
from tidelog.llm.worker_cache import claim

VOCABULARY, CAPACITY, END_ID = "word_bpe_49k.json", 2048, 0
SLICES, NODES = 64, 10_000
#: Fillings of a node that others are tested against, and levels of the search that keep their place in memory.
COMPARED, LIVE = 32, 48
CACHE_CHUNKS, SLICE_BYTES = 350_000, 2 << 20
RUN = re.compile("[^a-z0-9à-öø-ÿ ][,.] ")
SHAPE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

Pattern = tuple[int, ...]
Plan = list[tuple[Pattern, int]]  # (lengths in a sequence, number of such sequences)


# --- tokens -----------------------------------------------------------------


def chunks_of(text: str) -> list[str]:
    """Chunks of ``text`` whose ids, one after another, are the text's."""
    text = text.replace("\n", " ")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split(" ")
    text = text.lower()
    if not RUN.search(text):  # a run of punctuation is one match and stays whole
        text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


class ChunkTokenizer:
    """Packed ids of texts, by white-space chunks with a bounded cache.

    The tokenizer's pre-tokenizer drops white space and no match spans it, so
    the ids of a text are those of its chunks, one after another. A run of Latin
    letters is one match, and so is the punctuation behind it; new runs are
    encoded many at a time and told apart by the mark on the last token of each.
    Texts of Latin-1 are lowered first, and commas and full stops behind a word
    set apart, neither of which changes their ids, so that fewer chunks differ.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Special tokens are cut out of the raw text; what is left has none, also where lowering would make it look so.
        self.tokenizer.encode_special_tokens = True
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.marks = {f" {t}": np.array([i], dtype="<u4").tobytes() for t, i in added.items()}  # no chunk has a space
        self.chunks: dict[str, bytes] = dict(self.marks)
        # For lower-case Latin words, on which the steps before the model only cost time.
        plain = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "added_tokens": []}
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, plain["pre_tokenizer"]["pretokenizers"][-1]]}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def split(self, text: str) -> list[str]:
        """Chunks of ``text``, special tokens with a space before them."""
        if self.special is None or not self.special.search(text):
            return chunks_of(text)
        return [c for i, part in enumerate(self.special.split(text)) for c in ([f" {part}"] if i % 2 else chunks_of(part))]

    def learn(self, new: set[str]) -> None:
        """Add chunks to the cache."""
        shapes = [(c, m[1].lower(), m[2]) for c in new if (m := SHAPE.fullmatch(c))]
        known = self.chunks
        rest = list(new - {c for c, _, _ in shapes} | {t for _, _, t in shapes} - known.keys())
        words = list({w for _, w, _ in shapes} - known.keys())
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(part):
                rest += part
                continue
            packed = ids.tobytes()
            known.update(zip(part, [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        for at in range(0, len(rest), 2000):
            part = rest[at : at + 2000]
            for chunk, done in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[chunk] = np.array(done.ids, dtype="<u4").tobytes()
        known.update((c, known[w] + known[t]) for c, w, t in shapes)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks.clear()
            self.chunks.update(self.marks)
        split = [self.split(t) if t else [] for t in texts]
        new = set().union(*[set(chunks).difference(self.chunks) for chunks in split])
        if new:
            self.learn(new)
        return [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in split]


def loaded(path: str) -> ChunkTokenizer:
    """One tokenizer per worker process, so that its cache outlives a task."""
    kept = claim("packing")
    if path not in kept:
        kept[path] = ChunkTokenizer(path)
    return kept[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32 and, if asked, ids) of ``docs`` (doc_id, text)."""
    path = path or vocabulary_path()
    end = np.array([END_ID], dtype="<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                rows: list[tuple] = []
                source: list[int] = []
                for i, packed in enumerate(tokenizer.encode(part.column(1).to_pylist())):
                    packed += end
                    for n, at in enumerate(range(0, len(packed), 4 * capacity)):
                        own = packed[at : at + 4 * capacity]
                        source.append(i)
                        rows.append((n, at // 4, len(own) // 4, zlib.crc32(own), own))
                n, start, length, crc, own = zip(*rows, strict=True)
                out = [part.column(0).take(pa.array(source)), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out.append(pa.array([np.frombuffer(o, dtype="<i4") for o in own], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --- the packing problem ----------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    return -(-sum(k * n for k, n in counts.items()) // capacity)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """The incumbent: each piece, by falling length, into the fullest sequence with room for it."""
    room: dict[int, dict[Pattern, int]] = {}
    order: list[int] = []  # rooms in use, ascending

    def add(left: int, pattern: Pattern, n: int) -> None:
        if left not in room:
            room[left] = {}
            insort(order, left)
        room[left][pattern] = room[left].get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_left(order, length)
            if at == len(order):
                full = min(todo, max(1, todo // max(1, capacity // length)))
                add(capacity - length, (length,), full)
                todo -= full
                continue
            left = order[at]
            pattern, n = next(iter(room[left].items()))
            use = min(todo, n)
            room[left][pattern] -= use
            if not room[left][pattern]:
                del room[left][pattern]
                if not room[left]:
                    del room[left]
                    order.pop(at)
            add(left - length, (*pattern, length), use)
            todo -= use
    return [(p, n) for group in room.values() for p, n in group.items() if n]


def dominates(a: Pattern, b: Pattern) -> bool:
    """Whether the items of ``b`` fit into those of ``a``, one or more into each (greedy test)."""
    room = sorted(a, reverse=True)
    for item in sorted(b, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= item]
        if not fit:
            return False
        room[min(fit, key=room.__getitem__)] -= item
    return True


def subset_sums(lengths: list[int], have: list[int], room: int) -> list[int]:
    """Sums up to ``room`` of the pieces from each place of ``lengths`` on, as bits; the last is that of no piece."""
    mask, reach = (1 << (room + 1)) - 1, [1]
    for k, n in zip(reversed(lengths), reversed(have), strict=True):
        sums, step = reach[-1], 1
        while n:
            step = min(step, n)
            sums |= (sums << (step * k)) & mask
            n -= step
            step *= 2
        reach.append(sums)
    return reach[::-1]


def fillings(counts: dict[int, int], lengths: list[int], room: int) -> Iterator[Pattern | None]:
    """All undominated ways to fill ``room`` with remaining pieces, lazily, least waste first; None for each dominated one.

    ``lengths``: those in use, falling. A single piece that fills the room
    dominates everything else; other fillings are maximal (no remaining piece
    fits in what they leave), and one found to be dominated by another is left
    out. Subset sums of the shorter lengths, as bits of an integer, lead the
    search, so that each of its branches ends in a filling.
    """
    if counts.get(room, 0) > 0:
        yield (room,)
        return
    usable = [k for k in lengths if k <= room and counts[k] > 0]
    have = [min(counts[k], room // k) for k in usable]
    reach = subset_sums(usable, have, room)

    def exact(at: int, left: int) -> Iterator[Pattern]:
        """Ways to make ``left`` of the lengths from ``at`` on, longest pieces first."""
        if not left:
            yield ()
            return
        for i in range(at, len(usable)):
            if not reach[i] >> left & 1:
                return
            k = usable[i]
            for n in range(min(have[i], left // k), 0, -1):
                if reach[i + 1] >> (left - n * k) & 1:
                    for rest in exact(i + 1, left - n * k):
                        yield (k,) * n + rest

    kept: list[Pattern] = []
    forced: Pattern = ()  # pieces that would fit in the waste: all of them have to be used
    base = 0
    for waste in range(room + 1):
        short = len(usable)
        while usable and usable[-1] <= waste:
            k = usable.pop()
            if counts[k] * k > room:
                return
            forced = (k,) * counts[k] + forced
            base += k * counts[k]
        if len(usable) < short:  # only the lengths above the waste are free to choose from
            del have[len(usable) :]
            reach = subset_sums(usable, have, room)
        left = room - waste - base
        if left < 0:
            return
        if not reach[0] >> left & 1:
            continue
        for way in exact(0, left):
            pattern = way + forced
            if any(dominates(k, pattern) for k in kept):
                yield None
                continue
            if len(kept) < COMPARED:  # a dominated filling that stays costs nodes only
                kept.append(pattern)
            yield pattern


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """The fewest sequences found for ``counts`` pieces of each length."""
    counts = {k: n for k, n in counts.items() if n > 0}
    if not counts:
        return []
    best = best_fit_decreasing(counts, capacity)
    best_n, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    if best_n == bound:
        return best
    left = dict(counts)
    lengths = sorted(left, reverse=True)
    tokens, used, seen = sum(k * n for k, n in left.items()), 0, 0
    path: list[tuple[Pattern, int]] = []
    open_: list[list] = []  # of each level: its options, or None, and how many were used

    def options() -> Iterator[tuple[Pattern, int] | None]:
        """Fillings beside the largest piece, each as often as it goes; then, each less often."""
        largest, usual = lengths[0], []
        have = dict(left)
        have[largest] -= 1
        for way in fillings(have, lengths.copy(), capacity - largest):
            if way is None:
                yield None
                continue
            pattern = (largest, *way)
            most = min(left[k] // m for k, m in Counter(pattern).items())
            usual.append((pattern, most))
            yield pattern, most
        for pattern, most in usual:
            for times in range(most - 1, 0, -1):
                yield pattern, times

    def following() -> tuple[bool, tuple[Pattern, int] | None]:
        """Whether the deepest level has another option, and that option."""
        level = open_[-1]
        if level[0] is None:  # the counts are those of its first visit again
            level[0] = islice(options(), level[1], None)
        level[1] += 1
        for option in level[0]:
            return True, option
        return False, None

    def deepen() -> None:
        open_.append([None, 0])
        if len(open_) > LIVE:
            open_[-LIVE - 1][0] = None

    def take(pattern: Pattern, times: int) -> None:
        nonlocal tokens, used
        for k, m in Counter(pattern).items():
            left[k] -= m * times
            if not left[k]:
                lengths.remove(k)
        tokens -= times * sum(pattern)
        used += times
        path.append((pattern, times))

    def undo() -> None:
        nonlocal tokens, used
        pattern, times = path.pop()
        for k, m in Counter(pattern).items():
            if not left[k]:
                lengths.append(k)
            left[k] += m * times
        lengths.sort(reverse=True)
        tokens += times * sum(pattern)
        used -= times

    deepen()
    while open_ and seen < nodes:
        more, option = following()
        if not more:
            open_.pop()
            if path:
                undo()
            continue
        seen += 1
        if option is None:
            continue
        take(*option)
        if not lengths:
            if used < best_n:
                best, best_n = list(path), used
                if best_n == bound:
                    break
            undo()
        elif used + -(-tokens // capacity) >= best_n:  # the waste so far rules out an improvement
            undo()
        else:
            deepen()
    return best


# --- from the plan to the pieces --------------------------------------------


def ranges(plan: Plan) -> dict[str, np.ndarray]:
    """Ranges of ranks by length: those of ``length`` from ``first`` on go to sequence ``base`` onwards, at ``offset``."""
    cursor: Counter = Counter()
    rows, base = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rows.append((length, cursor[length], base, offset))
            cursor[length] += times
            offset += length
        base += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "base", "offset"), columns, strict=True))


def placer(by: dict[str, np.ndarray], before: np.ndarray, capacity: int) -> Callable:
    """The function from (length, slice, number within both) to (sequence_id, offset)."""
    span = np.int64(1) << 40
    keys = by["length"] * span + by["first"]

    def place(length: np.ndarray, part: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = before[length, part] + number - 1
        at = np.searchsorted(keys, length * span + rank, side="right") - 1
        return by["base"][at] + rank - by["first"][at], by["offset"][at]

    return place


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_pieces`` (at least doc_id, piece, length) plus sequence_id and offset."""
    columns = [c for c in cut_pieces.columns if c not in ("sequence_id", "offset")]
    ties = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in columns]
    slice_, number_ = fresh([*columns, "sequence_id", "offset"], "slice", "number")
    sliced = cut_pieces.select(*columns, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)).cast("int").alias(slice_))
    # At most CAPACITY x SLICES counts reach the driver, at any size of the input.
    counted = sliced.groupBy("length", slice_).agg(F.count(F.lit(1)).alias("n")).collect()
    table_ = np.zeros((capacity + 1, SLICES), dtype=np.int64)
    for row in counted:
        table_[row["length"], row[slice_]] = row["n"]
    totals = table_.sum(1)
    by = ranges(bin_completion({k: int(n) for k, n in enumerate(totals) if n}, capacity))
    before = np.cumsum(table_, 1) - table_
    shared = cut_pieces.sparkSession.sparkContext.broadcast((by, before))  # bounded by CAPACITY and SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = placer(*shared.value, capacity)
        for batch in batches:
            length, part, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", slice_, number_))
            sequence, offset = place(length, part, number)
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    numbered = sliced.withColumn(number_, F.row_number().over(Window.partitionBy("length", slice_).orderBy(*ties)))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.select(*columns).schema)
    return numbered.mapInArrow(run, f"{types}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their places in the sequences."""
    return pack(cut(pieces(docs, path, capacity)), capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every row of ``documents`` and their places."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
