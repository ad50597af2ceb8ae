"""Assembly within micro-batches: what outlasts them, and that a tenant is the work of several tasks."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators.ordering import BUCKET
from tidelog.streaming import assembler, runner

CELL = "struct<name:string,type_oid:bigint,is_null:boolean,text:string,unchanged:boolean,is_key:boolean>"
LOG = f"tenant string, seq long, tag string, xid long, begin_lsn long, commit_lsn long, end_lsn long, commit_ts timestamp, schema_name string, table_name string, old array<{CELL}>, new array<{CELL}>, old_kind string"


def row(tenant, seq, tag, table="t"):
    control = tag in "BC"
    names = {"CDCxSession": ("UserID", 2950)}.get(table, ("k", 20))
    cells = None if control else [(*names, False, f"{seq}", False, True)]
    begin, commit = (seq if tag == x else None for x in "BC")
    return (tenant, seq, tag, begin, begin, commit, commit, None, *((None, None) if control else ("public", table)), None, cells, None)


#: Tenant a's transaction spans three batches and the shift of its places, b's log has every irregularity, c's is replayed.
BATCHES = [
    [row("a", 1, "B"), row("a", 2, "I", "CDCxSession"), row("a", 3, "I"), row("b", 1, "I"), row("b", 2, "C"), row("b", 3, "B"), row("b", 4, "I")],
    [row("a", 4, "I"), row("b", 5, "B"), row("b", 6, "I"), row("c", 100, "B"), row("c", 101, "I")],
    [row("a", 5, "I"), row("a", 5 * BUCKET, "C"), row("b", 7, "C"), row("c", 100, "B"), row("c", 101, "I"), row("c", 102, "C")],
    [row("a", 5 * BUCKET + 1, "I")],
]
CHANGES = [[], [], [("a", 2, 1), ("a", 3, 1), ("a", 4, 1), ("a", 5, 1), ("b", 6, 5), ("c", 101, 100)], []]
COUNTS = [
    {("b", "STRAY"): 1, ("b", "COMMIT_WITHOUT_BEGIN"): 1}, {("b", "ABORTED"): 1},
    {("a", "COMMITTED"): 1, ("a", "CHANGE"): 4, ("b", "COMMITTED"): 1, ("b", "CHANGE"): 1, ("c", "ABORTED"): 1, ("c", "COMMITTED"): 1, ("c", "CHANGE"): 1}, {("a", "STRAY"): 1},
]


def test_batches_left_open(spark, tmp_path):
    """Each batch is run twice, as after a failure, and gives the same."""
    work = assembler.Assembler(f"{tmp_path}/state", False)
    for number, rows in enumerate(BATCHES):
        for _ in range(2 if number < 3 else 1):
            done = work.assemble(spark.createDataFrame(rows, LOG), number)
            assert sorted((r["tenant"], r["seq"], r["xid"]) for r in done.changes.collect()) == CHANGES[number]
            assert {(r["tenant"], r["status"]): r["n"] for r in done.counts.collect()} == COUNTS[number]
        if number == 2:
            found = runner.batch_rows(done, None, runner.StreamOptions(fallback="none")).collect()
            assert sorted((r["tenant"], r["event_seq"], r["Data"], r["UserID"]) for r in found) == [
                ("a", 3, '{"k":3}', "2"), ("a", 4, '{"k":4}', "2"), ("a", 5, '{"k":5}', "2"), ("b", 6, '{"k":6}', None), ("c", 101, '{"k":101}', None),
            ]
        work.close(spark)
    assert [p.name for p in (tmp_path / "state" / "held").iterdir()] == ["version=3"]


@pytest.mark.parametrize("across", [False, True])
def test_one_tenant_many_tasks(spark, tmp_path, across):
    """One tenant's changes, of one transaction or of many, are placed by several tasks."""
    tags = ["B"] + ["I"] * 30 + ["C"] if across else ["B", "I", "C"] * 10
    rows = [row("a", i * BUCKET // 3, tag) for i, tag in enumerate(tags)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        done = assembler.Assembler(f"{tmp_path}/state", False).assemble(spark.createDataFrame(rows, LOG), 0)
    finally:
        spark.conf.set(key, before)
    files = done.changes.groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == tags.count("I") and len(files) > 1
