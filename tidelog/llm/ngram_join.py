"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct shingles of ``SHINGLE`` lower-cased words; two
documents link when the Jaccard similarity of their sets is at least
``PERCENT`` / 100. The result is each document's component under those links.

The global order of the n-grams is that of their 64-bit hashes, cut into
fragments by range. Documents are read in batches; a batch sends each fragment
the n-grams it has there, once each (documents of equal word sequence count
once in a batch). A fragment counts the documents that have each n-gram and
answers every batch with those that more than one has, so that the many n-grams
of a single document go no further. With the counts a batch orders each
document's set by rarity and keeps the documents that may link at all: an
overlap of at least PERCENT % of a set of n needs a shared n-gram among the
first n - ceil(PERCENT * n / 100) + 1 in that order, its prefix.

Documents that share a prefix n-gram form its list. A pair's overlap is counted
in each of ``CUTS`` vertical fragments of the two sets (ranges of the global
order) separately and summed per pair. Lists are not expanded into all pairs:
first every document of a list is compared to one pivot, and the links found
contract the documents into components. Rounds with other pivots go on while
each at least halves the pairs left. What is left is settled exactly: lists that still
mix components are gathered into families, and every document outside its
family's main component is counted against every member of the family, in
blocks of bounded size that hand back links only. So no link between
components is missed, and no pairs are spelled out.

Defined results: words are runs of other characters than space and U+0009 to
U+000D, and A-Z are lower-cased. A text of fewer words than a shingle is one
shingle. Null, empty and white-space texts have an empty set, link with nothing
and are components of their own. Equal word sequences link whatever their
number. Rows of equal ids are separate rows of one document; ids are read as
64-bit integers. An empty table gives an empty result. Sets are compared by
64-bit hashes of their n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.arrow_columns import slices
from tidelog.llm.components import stars
from tidelog.llm.exact_dedup import filter_bits, probe, repeat_filter
from tidelog.llm.tables import cut, cut_with, fresh, join_groups, packed, table
from tidelog.llm.worker_cache import claim

SHINGLE, PERCENT = 5, 75
#: Vertical fragments in which overlaps are counted: ranges of the order, told by the upper bits.
CUTS, CUT_SHIFT = 4, 62
BATCH_BYTES, FRAGMENT_BYTES, LEAST_FRAGMENTS = 4 << 20, 8 << 20, 24
#: Pivot rounds end once the lists hold this many pairs a row at most; at the other, these are compared one by one.
FEW, DIRECT = 50, 4
SETS_PER_TASK = 2000
#: Documents outside and members in a block.
OUTSIDE, MEMBERS = 256, 1024
MANY = np.uint32(1 << 31)  # marks an n-gram of several documents of a batch; the rest is their number
WORD_SALTS = [np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1 | 1) for k in (1, 3, 7, 11, 19)]

WIRE = "target long, batch long, hashes binary, owners binary, counts binary, ids binary, nulls binary, keys binary, sizes binary"
PARTS = [c.split()[0] for c in WIRE.split(", ")][2:]


def planes(values: np.ndarray) -> bytes:
    """Bytes of an array, those of equal significance together (which compress well)."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of all shingles of a word sequence, in order, repeats included."""
    from xxhash import xxh3_64_intdigest

    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if len(w) < SHINGLE:
        return _mixed((w * np.array(WORD_SALTS[: len(w)], dtype=np.uint64)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w))) if len(w) else w
    n = len(w) - SHINGLE + 1
    h = np.full(n, SHINGLE, dtype=np.uint64)
    for k in range(SHINGLE):
        h += w[k : k + n] * WORD_SALTS[k]
    return _mixed(h)


def _row(target: int, batch: int, **parts: bytes) -> pa.RecordBatch:
    arrays = [pa.array([target], pa.int64()), pa.array([batch], pa.int64()), *(pa.array([parts.get(p)], pa.binary()) for p in PARTS)]
    return pa.RecordBatch.from_arrays(arrays, names=["target", "batch", *PARTS])


def _heads(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)


def sender(fragments: int):
    """Batches of (doc_id, text) to a row per fragment and one of the batch's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        claim("ngram_join")
        number = TaskContext.get().partitionId() << 24
        for whole in batches:
            for part in slices(whole, 1, BATCH_BYTES):
                seen: dict[int, int] = {}
                keys, hashes, sizes = [], [], []
                for text in part.column(1).to_pylist():
                    words = text.encode().lower().split() if text else []
                    keys.append(key := xxh3_64_intdigest(b" ".join(words)))
                    if key in seen:
                        sizes.append(sizes[seen[key]])
                        hashes.append(np.zeros(0, np.uint64))
                    else:
                        seen[key] = len(sizes)
                        hashes.append(own := np.unique(shingle_hashes(words)))
                        sizes.append(len(own))
                h = np.concatenate(hashes)
                owner = np.repeat(np.arange(len(hashes), dtype=np.uint32), [len(x) for x in hashes])
                del hashes
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
                at = _heads(h)
                count = np.diff(np.append(at, len(h)))
                several = np.repeat(count > 1, count)
                once = np.where(count > 1, MANY | count.astype(np.uint32), owner[at])
                distinct = h[at]
                edges = np.searchsorted(distinct, np.array([(f << 64) // fragments for f in range(1, fragments)], dtype=np.uint64))
                for f, (a, b) in enumerate(zip([0, *edges], [*edges, len(distinct)], strict=True)):
                    if b > a:
                        steps = np.diff(distinct[a:b], prepend=np.uint64(0))
                        yield _row(f, number, hashes=planes(steps), owners=planes(once[a:b]))
                ids = part.column(0)
                yield _row(
                    -1 - number, number, hashes=h[several].tobytes(), owners=owner[several].tobytes(), keys=np.array(keys, np.uint64).tobytes(),
                    sizes=np.array(sizes, np.int64).tobytes(), ids=ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), nulls=ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
                )
                number += 1

    return run


def answer(rows: pa.Table) -> pa.Table:
    """A fragment's answers: for each batch its n-grams that several documents have, and how many do."""
    claim("ngram_join")
    names = rows.schema.names
    if rows.num_rows and rows.column("target")[0].as_py() < 0:
        return rows
    batches = rows.column("batch").to_pylist()
    hashes = [np.cumsum(unplanes(b, np.uint64), dtype=np.uint64) for b in rows.column("hashes").to_pylist()]
    owners = np.concatenate([unplanes(b, np.uint32) for b in rows.column("owners").to_pylist()])
    source = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(x) for x in hashes])
    h = np.concatenate(hashes)
    del hashes
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    number = np.where(owners & MANY, owners & ~MANY, 1)[order].astype(np.int64)
    at = _heads(sorted_h)
    total = np.add.reduceat(number, at)
    total = np.repeat(total, np.diff(np.append(at, len(h))))
    shared = order[total > 1]
    documents = np.minimum(total[total > 1], 65535).astype(np.uint16)
    back = np.argsort(shared, kind="stable")  # by batch, and by hash within it
    shared, documents = shared[back], documents[back]
    bounds = np.searchsorted(source[shared], np.arange(len(batches) + 1))
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            own = shared[a:b]
            out.append(_row(0, batches[i], hashes=planes(np.diff(h[own], prepend=np.uint64(0))), owners=planes(owners[own]), counts=planes(documents[a:b])))
    return pa.Table.from_batches(out, schema=_row(0, 0).schema).select(names)


DOCUMENT = "doc_id long, key long, n long, prefix int, shared array<long>"


def gather(rows: pa.Table) -> pa.Table:
    """A batch's documents; those that may link have their shared n-grams, rarest first, the first ``prefix`` of them being the prefix."""
    claim("ngram_join")
    parts = {p: rows.column(p).to_pylist() for p in PARTS}
    local = next(i for i, k in enumerate(parts["keys"]) if k is not None)
    kind = lambda p, t: np.frombuffer(parts[p][local] or b"", t)
    keys, sizes, ids, nulls = kind("keys", np.int64), kind("sizes", np.int64), kind("ids", np.int64), kind("nulls", np.bool_)
    many_h, many_owner = kind("hashes", np.uint64), kind("owners", np.uint32)
    answers = [i for i in range(rows.num_rows) if i != local]
    h = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(unplanes(parts["hashes"][i], np.uint64), dtype=np.uint64) for i in answers)])
    owner = np.concatenate([np.zeros(0, np.uint32), *(unplanes(parts["owners"][i], np.uint32) for i in answers)])
    documents = np.concatenate([np.zeros(0, np.uint16), *(unplanes(parts["counts"][i], np.uint16) for i in answers)])
    several = (owner & MANY) != 0
    low, high = np.searchsorted(many_h, h[several], "left"), np.searchsorted(many_h, h[several], "right")
    width = high - low
    inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
    h, owner, documents = (
        np.concatenate([h[~several], many_h[inner]]), np.concatenate([owner[~several], many_owner[inner]]), np.concatenate([documents[~several], np.repeat(documents[several], width)]),
    )
    order = np.lexsort((h, documents, owner))
    h, owner = h[order], owner[order]
    counts = np.bincount(owner, minlength=len(keys))
    prefix = sizes - -(-PERCENT * sizes // 100) + 1 - (sizes - counts)
    stays = (prefix > 0) & (counts > 0)
    kept = stays[owner]
    lengths = np.where(stays, counts, 0)
    shared = pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32), mask=np.r_[~stays, False]), pa.array(h[kept].view(np.int64))
    )
    return pa.table({"doc_id": pa.array(ids, mask=nulls), "key": keys, "n": sizes, "prefix": np.where(stays, prefix, 0).astype(np.int32), "shared": shared})


def documents_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, prefix, shared) of every row of ``docs`` (doc_id, text), see ``gather``."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, math.ceil(size / FRAGMENT_BYTES))
    sent = source.mapInArrow(sender(fragments), WIRE)
    answered = sent.groupBy("target").applyInArrow(answer, WIRE)
    return answered.groupBy("batch").applyInArrow(gather, DOCUMENT)


def _fits() -> F.Column:
    """Whether the sizes of a pair, and of what each shares with anyone, leave room for a link."""
    least = F.ceil(PERCENT * (F.col("na") + F.col("nb")) / (100 + PERCENT))
    return (F.least("sa", "sb") >= least) & (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))


def links(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Those of the ``n`` pairs (a, b) that link, by overlaps counted in each fragment of the order apart and summed."""
    keys = pairs.select(F.col("a").alias("word")).unionByName(pairs.select(F.col("b").alias("word"))).distinct()
    bits = filter_bits(2 * n)
    needed = probe(sets, repeat_filter(keys, bits), F.col("key"), bits, "_needed").filter("_needed")  # the others stay where they are
    with_b = pairs.select("a", "b", "na", "nb").join(needed.select(F.col("key").alias("b"), F.col("shared").alias("of_b")), "b")
    both = with_b.join(needed.select(F.col("key").alias("a"), F.col("shared").alias("of_a")), "a")
    part = lambda c, k: F.filter(c, lambda h: F.shiftrightunsigned(h, CUT_SHIFT) == k)
    overlap = sum((F.size(F.array_intersect(part("of_a", k), part("of_b", k))) for k in range(1, CUTS)), F.size(F.array_intersect(part("of_a", 0), part("of_b", 0))))
    total = both.select("a", "b", "na", "nb", overlap.alias("overlap"))
    return total.filter(100 * F.col("overlap") >= PERCENT * (F.col("na") + F.col("nb") - F.col("overlap"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _grouped(lists: DataFrame, turn: int) -> tuple[DataFrame, int, int]:
    """``lists`` (gram, key, n, s, label) without those within one component, each row with its list's ``pivot`` of this turn and main component.

    Also the pairs that all lists hold at most, but for those of a list's main component, and the rows of the lists.
    """
    pivot = F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("rank"), "key", "n", "s", "label")).alias("pivot")
    by_label = lists.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("c"), pivot)
    by_gram = by_label.groupBy("gram").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("most"), F.min("pivot").alias("pivot"))
    mixed = by_gram.select("gram", "all", F.col("most.label").alias("main"), (F.col("all") - F.col("most.c")).alias("out"), "pivot").filter(F.col("out") > 0)
    groups, seen = cut_with(mixed, pairs=F.sum(F.col("out") * F.col("all").cast("double")), rows=F.sum("all"), n=F.count(F.lit(1)))
    rows = seen["rows"] or 0
    if not rows:
        return lists, 0, 0
    joined = cut(join_groups(lists, packed(groups, seen["n"]), "gram", "all", rows).drop("all", "out"))
    return packed(joined, rows), int(seen["pairs"]), rows


def _pivots(lists: DataFrame) -> DataFrame:
    """Pairs of every document of a list and the list's pivot."""
    pairs = lists.filter(F.col("label") != F.col("pivot.label"))
    return pairs.select(
        F.col("pivot.key").alias("a"), F.col("key").alias("b"), F.col("pivot.n").alias("na"), F.col("n").alias("nb"), F.col("pivot.s").alias("sa"), F.col("s").alias("sb")
    ).filter(_fits()).distinct()


def block_links(rows: pa.Table) -> pa.Table:
    """Links of a block between its documents outside the main component and its members, of different components.

    Overlaps are counted in each fragment of the order apart and summed.
    """
    outside = np.array(rows.column("outside").to_pylist(), dtype=bool)
    keys, n, labels = (rows.column(c).to_numpy() for c in ("key", "n", "label"))
    sets = rows.column("shared").combine_chunks()
    values, bounds = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
    members, others = np.flatnonzero(~outside), np.flatnonzero(outside)
    size = np.diff(bounds)[members]
    grams = np.concatenate([values[bounds[i] : bounds[i + 1]] for i in members]) if len(members) else values[:0]
    owner = np.repeat(np.arange(len(members), dtype=np.int32), size)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    own = [np.sort(values[bounds[i] : bounds[i + 1]]) for i in others]
    overlap = np.zeros((len(others), len(members)), dtype=np.int64)
    edges = np.array([k << CUT_SHIFT for k in range(1, CUTS)], dtype=np.uint64)
    cuts = [0, *np.searchsorted(grams, edges), len(grams)]
    for row, mine in enumerate(own):
        own_cuts = [0, *np.searchsorted(mine, edges), len(mine)]
        for k in range(CUTS):
            part, wanted = grams[cuts[k] : cuts[k + 1]], mine[own_cuts[k] : own_cuts[k + 1]]
            low, high = np.searchsorted(part, wanted, "left"), np.searchsorted(part, wanted, "right")
            width = high - low
            hits = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
            overlap[row] += np.bincount(owner[cuts[k] + hits], minlength=len(members))
    linked = (100 * overlap >= PERCENT * (n[others][:, None] + n[members] - overlap)) & (labels[members] != labels[others][:, None])
    u, v = np.nonzero(linked)
    return pa.table({"u": keys[others][u], "v": keys[members][v]})


def _list_pairs(lists: DataFrame) -> DataFrame:
    """Every pair of different components that shares a list: those outside a list's main component with all others of it."""
    outside = lists.filter(F.col("label") != F.col("main")).select("gram", F.col("key").alias("x"), F.col("n").alias("nx"), F.col("s").alias("sx"), F.col("label").alias("lx"))
    met = outside.join(lists, "gram").filter(F.col("label") != F.col("lx"))
    first = F.col("x") < F.col("key")
    side = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    pairs = met.select(
        F.least("x", "key").alias("a"), F.greatest("x", "key").alias("b"), side("nx", "n").alias("na"), side("n", "nx").alias("nb"), side("sx", "s").alias("sa"), side("s", "sx").alias("sb")
    )
    return pairs.filter(_fits()).distinct()


def _left_over(lists: DataFrame, sets: DataFrame, pairs: int, size: int) -> DataFrame:
    """All links (u, v) that are left between components that share a list.

    Where the lists hold few pairs, pair by pair. Else by family (lists tied
    together by the documents they share), in the cheaper of two ways: blocks of
    the documents outside the main component and all members, which suits dense
    families, or the pairs that share a list, which suits loose ones.
    """
    lists = lists.withColumn("tie", F.col("pivot.key")).drop("pivot")
    if pairs <= DIRECT * size:
        return _counted_links(_list_pairs(lists.drop("tie")), sets)
    tied = stars(lists.select(F.col("key").alias("u"), F.col("tie").alias("v")))
    placed = cut(lists.join(tied.select(F.col("u").alias("key"), F.col("v").alias("family")), "key", "left").withColumn("family", F.coalesce("family", "key")))

    members = placed.select("family", "key", "n", "label").distinct()
    by_label = members.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c"))
    main = by_label.groupBy("family").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("all")).withColumn("out", F.col("all") - F.col("m.c"))
    parts = lambda c, size: F.ceil(F.col(c) / F.lit(size)).cast("int")
    sized = main.select("family", F.col("m.label").alias("centre"), "all", "out", parts("out", OUTSIDE).alias("outer"), parts("all", MEMBERS).alias("inner")).filter(F.col("out") > 0)
    in_list = placed.groupBy("family", "gram").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("label") != F.col("main")).alias("out"))
    by_pairs = in_list.groupBy("family").agg(F.sum(F.col("out") * F.col("all").cast("double")).alias("pairs"))
    loose = F.col("pairs") < F.col("all") * F.col("outer") + F.col("out") * F.col("inner")
    sized = cut(sized.join(by_pairs, "family").withColumn("loose", loose))

    rows = members.join(sized.filter(~F.col("loose")), "family")
    part = lambda of, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    columns = ["family", "key", "n", "label"]
    as_member = rows.select(*columns, F.lit(False).alias("outside"), every("outer").alias("o"), part("inner", "m").alias("i"))
    as_outside = rows.filter(F.col("label") != F.col("centre")).select(*columns, F.lit(True).alias("outside"), part("outer", "o").alias("o"), every("inner").alias("i"))
    blocks = as_member.unionByName(as_outside).join(sets, "key").groupBy("family", "o", "i").applyInArrow(block_links, "u long, v long")

    few = _list_pairs(placed.join(sized.filter("loose").select("family"), "family").drop("family", "tie"))
    return blocks.unionByName(_counted_links(few, sets))


def _counted_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    done, seen = cut_with(pairs, n=F.count(F.lit(1)))
    return links(packed(done, seen["n"]), sets, seen["n"])


def components(documents: DataFrame) -> DataFrame | None:
    """(u, v): keys that link, directly or not, with the smallest such key; None where none do."""
    able = documents.filter(F.col("shared").isNotNull())
    rows = able.select("key", "n", F.size("shared").alias("s"), F.explode(F.slice("shared", F.lit(1), F.col("prefix"))).alias("gram")).distinct()
    lists, seen = cut_with(rows, n=F.count(F.lit(1)))
    lists = packed(lists, seen["n"])
    found = sets = None
    turn = before = 0
    while True:
        if found is None:
            labelled = lists.withColumn("label", F.col("key"))
        else:
            own = lists.join(found.select(F.col("u").alias("key"), F.col("v").alias("label")), "key", "left")
            labelled = cut(own.withColumn("label", F.coalesce("label", "key")))
        grouped, pairs, size = _grouped(labelled, turn)
        if not pairs:
            return found
        if sets is None:
            sets, seen = cut_with(able.select("key", "shared").join(grouped.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), n=F.count(F.lit(1)))
            sets = packed(sets, seen["n"], SETS_PER_TASK)
        if turn and (pairs <= FEW * size or 2 * pairs > before):  # few pairs are left, or another pivot would not change that
            break
        new = _counted_links(_pivots(grouped), sets)
        found = stars(new if found is None else found.unionByName(new))
        lists, before, turn = grouped.select("gram", "key", "n", "s"), pairs, turn + 1
    return stars(found.unionByName(_left_over(grouped, sets, pairs, size)))


def ngram_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    documents = cut(documents_of(docs))
    found = components(documents)
    keys = documents.filter(F.col("n") > 0).groupBy("key").agg(F.min("doc_id").alias("least"))
    if found is None:
        of_key = keys.select("key", F.col("least").alias("component_id"))
    else:
        named = keys.join(found.select(F.col("u").alias("key"), "v"), "key", "left").withColumn("label", F.coalesce("v", "key"))
        of_label = named.groupBy("label").agg(F.min("least").alias("component_id"))
        of_key = named.join(of_label, "label").select("key", "component_id")
    joined = documents.select("doc_id", "key", "n").join(of_key, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text) that stay: of each component the document of the smallest id.

    The ids that go are folded into a filter of bounded size. Rows that miss it
    pass straight through; only those that hit meet the ids themselves.
    """
    groups = ngram_components(docs.select("doc_id", "text"))
    gone, seen = cut_with(groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("word")), n=F.count(F.lit(1)))
    bits = filter_bits(seen["n"])
    hit, identity = fresh(docs.columns, "hit", "gone_id")
    probed = probe(docs, repeat_filter(gone, bits), F.col("doc_id").cast("bigint"), bits, hit)
    straight = probed.filter(~F.col(hit)).drop(hit)
    checked = probed.filter(F.col(hit)).drop(hit).join(gone.select(F.col("word").alias(identity)), F.col("doc_id") == F.col(identity), "left_anti")
    return straight.unionByName(checked)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every row of ``documents``."""
    return ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.o >= 75 * (x.n + y.n - p.o)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u, min(v) AS m FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.u = d.doc_id
"""
