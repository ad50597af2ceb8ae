"""Assembly, routing, sessions, journal and views on small logs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog.functions.delta import ROW
from tidelog.operators import checkpoint, journal, metrics, ordering, routing, sessions, transactions, views
from tidelog.plans import catalogue

SCHEMA = f"tenant string, seq long, tag string, xid long, begin_lsn long, commit_lsn long, end_lsn long, commit_ts timestamp, schema_name string, table_name string, old {ROW}, new {ROW}, old_kind string"
WHEN = dt.datetime(2024, 1, 1)


def cell(name, text, oid=25, key=False):
    return (name, oid, text is None, text, False, key)


def row(seq, tag, xid=None, table="a", new=None, old=None, schema="public", tenant="t", kind=None, ts=WHEN):
    control = tag in "BC"
    return (tenant, seq, tag, xid, 100 * seq if tag == "B" else None, 100 * seq if tag == "C" else None, 100 * seq + 8 if tag == "C" else None, ts if tag == "C" else None,
            None if control else schema, None if control else table, old, None if control else (new if new is not None else [cell("id", str(seq), 23, True)]), kind)


SEQUENCE = [row(1, "B", 10), row(2, "I"), row(3, "C"), row(4, "I"), row(5, "B", 11), row(6, "I"), row(7, "B", 12), row(8, "U"), row(9, "D", old=[cell("id", "9", 23)]), row(10, "C"), row(11, "C"), row(12, "B", 13), row(13, "I")]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(SEQUENCE, SCHEMA)


@pytest.mark.parametrize("width", [1 << 20, 4, 1])
def test_assembly(log, width):
    status = {(r["xid"], r["status"]) for r in transactions.transactions(log, width).collect()}
    assert status == {(10, "COMMITTED"), (11, "ABORTED"), (12, "COMMITTED"), (13, "OPEN"), (None, "COMMIT_WITHOUT_BEGIN")}
    done = sorted((r["xid"], r["seq"]) for r in transactions.assemble(log, width=width).collect())
    assert done == [(10, 2), (12, 8), (12, 9)]
    assert [r["seq"] for r in transactions.strays(log, width).collect()] == [4]
    nested = {r["xid"]: [c["seq"] for c in r["changes"]] for r in transactions.nested(transactions.assemble(log, width=width)).collect()}
    assert nested == {10: [2], 12: [8, 9]}


def test_assembly_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert transactions.transactions(empty).count() == 0 and transactions.assemble(empty).count() == 0


def test_size_cap(spark):
    rows = [row(1, "B", 1), *[row(i, "I", new=[cell("x", "abcd")]) for i in range(2, 7)], row(7, "C")]
    assert transactions.assemble(spark.createDataFrame(rows, SCHEMA), max_tx_bytes=8).count() == 3


def test_table_groups(spark):
    rows = [row(1, "B", 1), row(2, "I", table="b"), row(3, "U", table="a"), row(4, "I", table="b"), row(5, "T", table="c"), row(6, "C")]
    groups = transactions.table_groups(transactions.assemble(spark.createDataFrame(rows, SCHEMA))).orderBy("position").collect()
    assert [g["summary"] for g in groups] == ["public.b(2I)", "public.a(1U)", "public.c(T)"]


@pytest.mark.parametrize("width", [1 << 20, 3])
def test_forward_fill_and_numbers(spark, width):
    rows = spark.createDataFrame([("x", i, i * 10 if i % 4 == 0 else None) for i in range(1, 14)] + [(None, 2, 5), (None, 9, None)], "k string, o long, v long")
    filled = {(r["k"], r["o"]): r["f"] for r in ordering.forward_fill(rows, ["k"], "o", F.col("v"), "f", width=width).collect()}
    assert [filled["x", i] for i in range(1, 14)] == [None, None, None, 40, 40, 40, 40, 80, 80, 80, 80, 120, 120] and filled[None, 9] == 5
    numbers = [r["n"] for r in ordering.sequence_number(rows.filter("k = 'x'"), ["k"], "o", "n", width=width).orderBy("o").collect()]
    assert numbers == list(range(1, 14))


def session(seq, user, app="web", tag="I"):
    cells = [cell("SessionID", "s"), cell("UserID", user), cell("AppName", app)]
    return row(seq, tag, table="CDCxSession", new=None if tag == "D" else cells, old=cells if tag == "D" else None)


def test_sessions(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [row(1, "B", 1), session(2, "u1"), session(3, None, "app2"), row(4, "I"), row(5, "C", ts=at(5)), row(6, "B", 2), row(7, "I"), row(8, "C", ts=at(7)), row(9, "B", 3), session(10, ""), row(11, "I"), row(12, "C", ts=at(9)), row(13, "B", 4), row(14, "I"), row(15, "C", ts=at(1))]
    table = spark.createDataFrame([("t", "1", "old", "x", at(2)), ("t", "2", "mid", "y", at(6)), ("t", "3", "new", "z", at(20))], "tenant string, SessionID string, UserID string, AppName string, Moment timestamp")
    own, data = routing.split(transactions.assemble(spark.createDataFrame(rows, SCHEMA)))
    context = routing.session_context(own)
    for fallback, expected in {
        "asof": {4: ("u1", "app2"), 7: ("mid", "y"), 11: (None, "web"), 14: (None, None)}, "latest": {4: ("u1", "app2"), 7: ("new", "z"), 11: (None, "web"), 14: ("new", "z")},
        "none": {4: ("u1", "app2"), 7: (None, None), 11: (None, "web"), 14: (None, None)},
    }.items():
        found = {r["seq"]: (r["user_id"], r["app_name"]) for r in sessions.enrich(data, context, table, fallback).collect()}
        assert found == expected, fallback
    with pytest.raises(ValueError):
        sessions.enrich(data, context, table, "other")


def test_untracked(spark, log):
    changes = transactions.assemble(log)
    assert routing.tracked(changes, ["a"]).count() == 0 and routing.tracked(changes, ["A"]).count() == 3
    assert routing.tracked(changes, [f"n{i}" for i in range(1001)] + ["a"]).count() == 0
    assert routing.tracked(changes, spark.createDataFrame([("t", "a"), ("other", "a")], "tenant string, table_name string")).count() == 0


def test_journal_round_trip(spark, log, tmp_path):
    enriched = sessions.enrich(transactions.assemble(log), routing.session_context(transactions.assemble(log).limit(0)), None, "none")
    rows = journal.journal_rows(enriched)
    assert [r["JournalID"] for r in rows.orderBy("event_seq").collect()] == [1, 2, 3]
    assert {r["LSN"] for r in rows.collect()} == {"0/0000012C", "0/000003E8"}
    for _ in range(2):  # the second attempt replaces the first
        journal.write_batch(rows, f"{tmp_path}/j", 0)
    journal.write_batch(rows.filter("event_seq > 8"), f"{tmp_path}/j", 1)  # a replay under another number
    assert sorted(r["event_seq"] for r in journal.read_journal(spark, f"{tmp_path}/j").collect()) == [2, 8, 9]


def test_views(spark):
    data = '{"id":12345678901234567,"n":12345678901234567890.123,"f":"NaN","ok":true,"d":"2024-01-01","ts":"2024-01-01 00:00:00.5","bad":"infinity","m":"$1,234.50","t":"a\\"b"}'
    rows = spark.createDataFrame([(1, 1, "0/0", "I", data, "u", "o", WHEN, WHEN), (2, 1, "0/0", "T", None, None, None, WHEN, WHEN)], "JournalID long, XID long, LSN string, Operation string, Data string, UserID string, Origin string, CommittedAt timestamp, CapturedAt timestamp")
    columns = [views.SourceColumn(*c) for c in (("id", "int8"), ("n", "numeric"), ("f", "float8"), ("ok", "bool"), ("d", "date"), ("ts", "timestamptz"), ("bad", "timestamptz"), ("m", "money"), ("t", "text"), ("none", "int4"))]
    assert views.create_view(rows, "typed", columns) and not views.create_view(rows, "untyped", [])
    first, second = spark.sql("SELECT * FROM typed ORDER BY CDCxJournalID").collect()
    assert first["id"] == 12345678901234567 and str(first["n"]).startswith("12345678901234567890.123") and first["ok"] is True and first["d"] == dt.date(2024, 1, 1)
    assert first["bad"] is None and str(first["m"]) == "1234.50" and first["t"] == 'a"b' and first["none"] is None and first["ts"] is not None and first["f"] != first["f"]
    assert second["id"] is None and second["CDCxOperation"] == "T"


def test_checkpoints(spark, tmp_path):
    path = f"{tmp_path}/c"
    new = lambda lsn: spark.createDataFrame([("s", lsn, WHEN)], "SlotName string, lsn long, UpdatedAt timestamp")
    for version, lsn in enumerate((500, 300, 700)):
        checkpoint.save(spark, path, new(lsn), version)
        assert checkpoint.resume_lsn(checkpoint.load(spark, path), "s") == max(500, lsn)
    assert checkpoint.resume_lsn(checkpoint.load(spark, path), "other", "0/1F\n") == 31
    assert checkpoint.resume_lsn(checkpoint.load(spark, path), "other") == 0
    checkpoint.save(spark, path, new(600), 2)  # again: from version 1, not from itself
    assert checkpoint.resume_lsn(checkpoint.load(spark, path), "s") == 600
    for version in range(3, 6):
        checkpoint.save(spark, path, new(100 * version), version)
    assert sorted(x.name for x in (tmp_path / "c").iterdir()) == ["version=3", "version=4", "version=5"]
    other = spark.createDataFrame([("o", 5 << 32, WHEN)], "SlotName string, lsn long, UpdatedAt timestamp")
    checkpoint.save(spark, f"{tmp_path}/d", other, 0)
    for _ in range(2):
        checkpoint.gather(spark, [path, f"{tmp_path}/d", f"{tmp_path}/none"], f"{tmp_path}/fleet")
    assert sorted((r["SlotName"], r["ConfirmedLSN"]) for r in checkpoint.load(spark, f"{tmp_path}/fleet").collect()) == [("o", "5/00000000"), ("s", "0/00000258")]
    assert checkpoint.read_lsn(spark, f"{tmp_path}/x.lsn") is None
    checkpoint.write_lsn(spark, f"{tmp_path}/x.lsn", (5 << 32) + 31)
    assert checkpoint.resume_lsn(checkpoint.load(spark, path), "other", checkpoint.read_lsn(spark, f"{tmp_path}/x.lsn")) == (5 << 32) + 31


@pytest.mark.parametrize(("samples", "expected"), [([700], (50, 50, 50)), ([700, 700], (750, 750, 750)), ([50] * 90 + [3000] * 9 + [200000], (50, 3000, 3000))])
def test_percentiles(spark, samples, expected):
    found = metrics.percentiles(spark.createDataFrame([(s,) for s in samples], "us long"), "us").first()
    assert (found["p50"], found["p95"], found["p99"]) == expected


def test_percentiles_of_nothing(spark):
    found = metrics.percentiles(spark.createDataFrame([], "us long"), "us").first()
    assert (found["p50"], found["p99"], found["samples"]) == (0, 0, 0)


def test_reconstruct(spark):
    rows = [("t", "a", 1, "I", '{"id":1,"v":"x","w":"k"}', WHEN), ("t", "a", 2, "U", '{"id":1,"v":"y"}', WHEN), ("t", "a", 3, "I", '{"id":2,"v":"z"}', WHEN), ("t", "a", 4, "D", '{"id":2,"v":"z"}', WHEN)]
    state = journal.reconstruct(spark.createDataFrame(rows, "tenant string, table_name string, event_seq long, Operation string, Data string, CommittedAt timestamp"), "id").collect()
    assert [(r["id"], r["state"]) for r in state] == [("1", {"id": "1", "v": "y", "w": "k"})]


def test_states_of_all_orders(spark, sf_dir):
    """Ordinary updates, whose deltas lack the key, count: every live order, with the status of its last change."""
    found = sorted((int(r["o_orderkey"]), r["status"], r["price"]) for r in catalogue.state_reconstruction(spark, sf_dir).collect())
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", "o_orderstatus AS s", "CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING) AS p").collect()
    assert found == sorted((r["k"], "X" if r["k"] % 3 == 0 else r["s"], r["p"]) for r in orders if r["k"] % 10)


def test_reconstruct_changes(spark):
    cell = lambda name, text, unchanged=False: (name, 25, text is None and not unchanged, text, unchanged, name == "id")
    row = lambda i, v, w="k": [cell("id", i), cell("v", v), cell("w", w)]
    unsent = [cell("id", "7"), cell("v", "z"), cell("w", None, True)]
    rows = [
        (1, "I", None, row("1", "x"), None), (2, "U", None, [cell("id", "1"), cell("v", None), cell("w", None, True)], None),
        (3, "I", None, row("2", "x"), None), (4, "D", row("2", "x"), None, "O"), (5, "I", None, row("3", "x", "old"), None), (6, "U", row("3", "x", "old"), unsent, "O"),
        (7, "D", [cell("id", "1")], None, "K"), (8, "I", None, [cell("id", "1"), cell("v", "again")], None), (9, "I", None, row("4", "x"), None), (10, "U", [cell("id", "4")], row("2", "y"), "K"),
    ]
    changes = spark.createDataFrame([("t", "s", "a", *r) for r in rows], f"tenant string, schema_name string, table_name string, seq long, tag string, old {ROW}, new {ROW}, old_kind string")
    found = {r["id"]: r["state"] for r in journal.reconstruct_changes(changes, "id").collect()}
    assert found == {"1": {"id": "1", "v": "again"}, "7": {"id": "7", "v": "z", "w": "old"}, "2": {"id": "2", "v": "y", "w": "k"}}
    first = {r["id"]: r["state"] for r in journal.reconstruct_changes(changes.filter("seq < 4"), "id").collect()}
    assert first["1"] == {"id": "1", "v": None, "w": "k"}


def test_reconstruct_without_keys_is_an_error(spark):
    rows = [("t", "a", 1, "I", '{"id":1,"v":"x"}', WHEN), ("t", "a", 2, "U", '{"v":"y"}', WHEN)]
    with pytest.raises(Exception, match="no id in the delta of change 2"):
        journal.reconstruct(spark.createDataFrame(rows, "tenant string, table_name string, event_seq long, Operation string, Data string, CommittedAt timestamp"), "id").collect()


@pytest.mark.parametrize("width", [1, 3, 4, 1 << 20])
def test_marks_in_all_buckets(spark, width):
    """A change at the very start of a bucket, a stray before a begin, a transaction over many buckets; no change is joined."""
    rows = [row(2, "B", 1), row(3, "I"), row(4, "I"), row(8, "I"), row(11, "I"), row(12, "C"), row(13, "I"), row(15, "B", 2), row(16, "I"), row(17, "C")]
    done = transactions.assemble(spark.createDataFrame(rows, SCHEMA), width=width)
    assert sorted((r["xid"], r["seq"], r["commit_seq"]) for r in done.collect()) == [(1, s, 12) for s in (3, 4, 8, 11)] + [(2, 16, 17)]
    assert "Join" not in done._jdf.queryExecution().executedPlan().toString()


def test_staged_tables_are_columns(spark, log):
    from tidelog.sources.staging import stage

    staged = stage(log)
    assert staged.schema == log.schema and sorted(staged.collect()) == sorted(log.collect())
    assert all(f.endswith(".parquet") for f in staged.inputFiles())
