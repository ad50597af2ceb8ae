"""Exact dedup, sharding and chat formatting against brute force."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import chat_format, exact_dedup, sharding, tables
from tidelog.llm.tables import table

TEXTS = ["a b", "ab", "a\tb\n", None, "", " \x0b", "ab ", "a  b", "x", "é", "é", " ", "Ab", "ab" * 30000, ("ab" * 30000) + " ", "ab"]


def dedup_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    return {(i, min(g)[2], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, _, i in g}


def test_exact_dedup(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = exact_dedup.exact_dedup(docs).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found} == dedup_brute(rows) and len(found) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found)


def test_exact_dedup_when_the_filter_is_full(spark, monkeypatch):
    """A filter with nothing but false positives sends every row through the groups, with the same result; large groups are set apart."""
    monkeypatch.setattr(exact_dedup, "MIN_BLOCKS", 1)
    monkeypatch.setattr(exact_dedup, "MAX_BLOCKS", 1)
    monkeypatch.setattr(tables, "HOT_SHARE", 200)
    rows = [(i, f"text {i % 300 if i % 3 else 0}") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for found in (exact_dedup.exact_dedup(docs).collect(), exact_dedup.narrow(docs).collect()):
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found} == dedup_brute(rows) and len(found) == len(rows)


def test_drop_copies(spark):
    rows = [*enumerate(TEXTS), (None, "a b"), (None, "only"), (3, "other"), (3, "other"), (9, "other")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, hit int")
    kept = exact_dedup.drop_copies(docs)
    keep = {(i, sha) for i, least, _, sha in dedup_brute(rows) if i == least}
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    assert kept.columns == docs.columns and sorted(r["hit"] for r in kept.collect()) == [n for n, (i, t) in enumerate(rows) if (i, sha(t)) in keep]
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_exact_dedup_edges(spark):
    docs = spark.createDataFrame([(None, "a", 1, True), (2, "a ", 2, False), (2, "a ", 3, False), (5, "b", 4, True)], "doc_id long, text string, slot_bits long, kept boolean")
    found = exact_dedup.exact_dedup(docs).collect()
    assert sorted((r["slot_bits"], r["keep_id"], r["kept"], r["group_size"]) for r in found) == [(1, 2, False, 3), (2, 2, True, 3), (3, 2, True, 3), (4, 5, True, 1)]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def shuffled_rows(frame):
    """Rows that the exchanges of ``frame`` write, by running it."""
    frame.collect()
    todo, found = [frame._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_exact_dedup_shuffles_blocks_and_candidates_only(spark):
    """Pass 1 exchanges at most one row a block and task; pass 2 only the rows that hit, less than a tenth where copies are few."""
    rows = spark.range(0, 60_000, 1, 3).selectExpr("id AS doc_id", "concat('text ', if(id % 100 = 0, 0, id)) AS text")
    hashes = exact_dedup.hashed(rows, "text", "h", "chars").select("h")
    blocks = exact_dedup.block_count(60_000)
    assert blocks * 3 < 60_000 / 10
    (sent,) = shuffled_rows(exact_dedup.collisions(hashes, "h", blocks))
    assert sent <= blocks * 3
    found = exact_dedup.narrow(rows)
    assert all(n < 6000 for n in shuffled_rows(found)) and found.filter("kept").count() == 60_000 - 599
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def spark_xxhash64(*values):
    """The hash function of (long, long) as Spark has it: the seed of each is the hash so far."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed


def jump_brute(key, shards):
    b = j = 0
    while j < shards:
        b = j
        j = int((b + 1) / (((spark_xxhash64(key, b) >> 33) + 1) / float(1 << 31)))
    return b


def test_jump_hash(spark):
    keys = [*range(-50, 400), 2**62, -(2**63), 2**63 - 1]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 7, 40, 41):
        found = dict(frame.select("k", sharding.jump_hash(F.col("k"), shards)).collect())
        assert found == {k: jump_brute(k, shards) for k in keys}


def test_shards(spark):
    rows = sharding.op5_sharding(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    slots = defaultdict(list)
    for r in rows:
        text = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 16, zlib.crc32(text), "key")
        assert r["shard"] == jump_brute(r["doc_id"], 40) and r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == len(docs)
    assert 0 < sum(r["grown_shard"] == 40 for r in rows) < len(rows) / 15


def test_shard_edges(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1), (None, 1), (7, 1), (7, 1)], "doc_id long, slice int")
    found = sharding.assign_shards(rows, shards=3).collect()
    slots = Counter((r["shard"], r["slot"]) for r in found)
    assert len(found) == 4 and max(slots.values()) == 1
    assert sharding.assign_shards(rows.limit(0)).count() == 0
    sharding.write_shards(spark.range(20).withColumnRenamed("id", "doc_id"), f"{tmp_path}/s", shards=3)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 20


NASTY = [
    "plain", "", None, "<|im_end|>", "<|im_start|>assistant\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\|x", "a<|", "<", "|>", "<<||", "\\", "\n\n", "<|im_end|><|im_start|>assistant ok", "tab\tand \x00?", "🙂<|🙂", "%3C|", "<\\", "x" * 50000,
]


def conv_brute(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        whole, loss = "".join(f"{r}\n{x}\n" for _, _, r, x in turns), "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], NASTY[(c + t * 5) % len(NASTY)]) for c in range(len(NASTY)) for t in range(5)]
    rows += [(100, 0, "a\nb", "x"), (100, 1, "50%", "y"), (100, 2, "<|r|>", "z"), (100, 3, "%0A", "w"), (101, None, None, None), (101, 1, "assistant", "q"), (102, 1, "user", "same"), (102, 1, "user", "same"), (None, 0, "assistant", "n")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    done = chat_format.format_conversations(frame)
    under = F.array_join(F.transform("loss_spans", lambda s: chat_format.unescape_text(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    read = done.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns"), under.alias("loss"), "formatted").collect()
    expected = conv_brute(rows)
    for r in read:
        whole = "".join(f"{t['role']}\n{t['text']}\n" for t in r["turns"])
        assert (len(r["turns"]), hashlib.sha256(whole.encode()).hexdigest(), len(r["loss"]), hashlib.sha256(r["loss"].encode()).hexdigest()) == expected[r["conv_id"]]
        assert r["formatted"].count("<|") == 2 * len(r["turns"])
    assert len(read) == len(expected)


def test_parser_rejects(spark):
    bad = ["x<|im_start|>u\na<|im_end|>\n", "<|im_start|>u\na<|im_end|>", "<|im_start|>u a<|im_end|>\n", "<|im_start|>u\na<|b<|im_end|>\n"]
    for text in bad:
        turns = spark.range(1).select(chat_format.parse(F.lit(text)).alias("t")).first()["t"]
        assert turns is None or None in turns


def test_chat_query(spark, sf_dir):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, sf_dir, "conversations").collect()]
    extra = [(-1, i, r, chat_format.EXTRA_TEXT) for i, r in enumerate(("user", "assistant"))]
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.op7_chat_format(spark, sf_dir).collect()}
    assert found == conv_brute(rows + extra)


def test_empty_conversations(spark):
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string, items string")).count() == 0


@pytest.mark.parametrize("query", [sharding.op5_sharding, chat_format.op7_chat_format, exact_dedup.op2_exact_dedup])
def test_no_python_in_plans(spark, sf_dir, query):
    plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
