"""Protocol frames: decoding, relations in force, streaming."""

import base64
import json
import struct
import time

import pytest
from pyspark.sql import functions as F

from tidelog.operators import transactions
from tidelog.sources import pgoutput as p
from tidelog.streaming import bootstrap, runner, source
from tidelog.streaming.supervisor import FAILED, RECONNECTING, STREAMING, Reconnection, Supervisor

COLUMNS = [("id", 23, True), ("v", 25, False), ("n", 1700, False)]
FRAMES = [
    p.encode_relation(7, "public", "a", COLUMNS), p.encode_begin(100, 5, 10), p.encode_change("I", 7, new=[1, "x", None]), p.encode_change("U", 7, [1, "x", None], [1, ..., "2.50"]),
    p.encode_commit(200, 208, 6), p.encode_relation(7, "public", "a", [("id", 23, True), ("renamed", 25, False)]), p.encode_begin(300, 7, 11), p.encode_change("I", 7, new=[2, "y"]),
    p.encode_change("D", 7, old=[2, None], old_kind="K"), b"T" + struct.pack(">IBII", 2, 0, 7, 8), p.encode_relation(8, "s2", "b", [("k", 20, True)]),
    p.encode_change("I", 8, new=[(9).to_bytes(8, "big")]), p.encode_change("I", 99, new=[1]), p.encode_commit(400, 408, 8), b"Yxx", b"Z", b"B\0", b"",
]


@pytest.fixture(scope="module")
def decoded(spark):
    rows = [("main", i, bytearray(f)) for i, f in enumerate(FRAMES)]
    return p.decode(spark.createDataFrame(rows, "tenant string, seq long, payload binary")).cache()


def test_errors(decoded):
    _, errors = p.change_events(decoded)
    assert sorted((r["seq"], r["error"]) for r in errors.collect()) == [(9, "unknown relation"), (12, "unknown relation"), (15, "unknown message 'Z'"), (16, "short frame"), (17, "empty frame")]


def test_events(decoded):
    log, _ = p.change_events(decoded)
    rows = {(r["seq"], r["table_name"]): r for r in transactions.assemble(log).collect()}
    cells = lambda key, side: [(c["name"], None if c["is_null"] else c["text"]) for c in rows[key][side]]
    assert cells((2, "a"), "new") == [("id", "1"), ("v", "x"), ("n", None)]
    assert rows[3, "a"]["new"][1]["unchanged"] and cells((3, "a"), "new")[2] == ("n", "2.50")
    assert cells((7, "a"), "new") == [("id", "2"), ("renamed", "y")]
    assert rows[8, "a"]["old_kind"] == "K" and cells((8, "a"), "old") == [("id", "2"), ("renamed", None)]
    assert cells((11, "b"), "new") == [("k", "9")]
    assert rows[9, "a"]["tag"] == "T" and rows[2, "a"]["xid"] == 10 and rows[2, "a"]["end_lsn"] == 208


@pytest.mark.parametrize("cut", range(0, 40, 3))
def test_cut_frames_never_fail(cut):
    for f in FRAMES:
        assert isinstance(p.decode_message(f[:cut]), dict)


def test_tuple_edges():
    cells = p.read_tuple(p.Reader(struct.pack(">H", 4) + b"t" + struct.pack(">i", 0) + b"t" + struct.pack(">i", -5) + b"?" + b"t" + struct.pack(">i", 99) + b"ab"))
    assert [c["kind"] for c in cells] == ["t", "n", "n", "n"] and cells[0]["text"] == ""
    assert p.read_tuple(p.Reader(struct.pack(">H", 1) + b"t" + struct.pack(">i", 0)), empty_as_null=True)[0]["kind"] == "n"


def test_envelopes(spark):
    rows = [(0, b"w" + struct.pack(">QQq", 1, 2, 3) + b"hello"), (1, b"k" + struct.pack(">QqB", 9, 3, 1)), (2, b"w" + b"\0" * 24), (3, b"Braw")]
    found = p.demux(spark.createDataFrame([("t", i, bytearray(x)) for i, x in rows], "tenant string, seq long, payload binary")).orderBy("seq").collect()
    assert [(r["kind"], r["data_start"], r["wal_end"], r["reply"], r["payload"] and bytes(r["payload"])) for r in found] == [("w", 1, 2, None, b"hello"), ("k", None, 9, True, None), ("?", None, None, None, None), ("raw", None, None, None, b"Braw")]
    assert len(p.standby_status(5, 6, True)) == 34


@pytest.mark.parametrize("size", [1, 3, 100])
def test_stream_equals_batch(spark, decoded, tmp_path, size):
    """However the frames are cut into micro-batches, the journal is the batch plan's."""
    path = tmp_path / "frames.jsonl"
    path.write_text("".join(json.dumps({"seq": i, "payload": base64.b64encode(f).decode()}) + "\n" for i, f in enumerate(FRAMES)))
    source.register(spark)
    log, _ = p.change_events(decoded)
    expected = {(r["seq"], r["table_name"], r["commit_seq"]) for r in transactions.assemble(log).collect()}
    frames = spark.readStream.schema(source.SCHEMA).format("tidelog_frames").option("path", str(path)).option("maxFrames", str(size)).load()
    if size != 100:  # the source replays everything in one trigger; files give batches of a chosen size
        for i in range(0, len(FRAMES), size * 4):
            part = [("main", k, bytearray(f)) for k, f in list(enumerate(FRAMES))[i : i + size * 4]]
            spark.createDataFrame(part, source.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:04d}")
        frames = spark.readStream.schema(source.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    options = runner.StreamOptions(frames=True, fallback="none", partitions=2, lsn_file=f"{tmp_path}/main.lsn", trigger={"availableNow": True} if size != 100 else {"processingTime": "1 second"})
    query = runner.start(p.decode(frames), f"{tmp_path}/out", f"{tmp_path}/state", options=options)
    if size == 100:
        query.processAllAvailable()
        query.stop()
    else:
        query.awaitTermination(120)
    assert query.exception() is None
    found = runner.read(spark, f"{tmp_path}/out")
    assert {(r["event_seq"], r["table_name"]) for r in found.collect()} == {(s, t) for s, t, _ in expected}
    by_status = {r["status"]: r["n"] for r in runner.counters(spark, f"{tmp_path}/out").collect()}
    assert by_status["COMMITTED"] == 2 and by_status["CHANGE"] == len(expected)
    assert by_status["PARSE_ERROR"] == 3 and by_status["UNKNOWN_RELATION"] == 2
    slots = spark.read.option("basePath", f"{tmp_path}/out/checkpoint").parquet(f"{tmp_path}/out/checkpoint").agg(F.max("ConfirmedLSN")).first()[0]
    assert slots == "0/00000198" and (tmp_path / "main.lsn").read_text() == "0/00000198\n"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


class FakeQuery:
    def __init__(self):
        self.isActive, self.failure = True, None

    def exception(self):
        return self.failure

    def stop(self):
        self.isActive = False


def test_supervisor():
    made = []

    def make(settings):
        def begin():
            if settings.get("bad"):
                raise RuntimeError("no")
            made.append(FakeQuery())
            return made[-1]

        return begin

    s = Supervisor(make, most=2)
    assert s.poll({"a": {"x": 1}, "b": {}, "c": {}}) == {"start": ["a", "b"], "stop": [], "skip": ["c"]}
    assert not s.start_worker("a", {})
    made[1].isActive, made[1].failure = False, RuntimeError("lost")
    assert s.reap() == ["b"]
    assert s.poll({"a": {"x": 2}, "c": {"bad": True}}) == {"start": ["a", "c"], "stop": ["a"], "skip": []}
    assert s.workers["c"].state == FAILED and not s.stop_worker("zzz")
    assert s.close()["workers"] == 2 and not s.workers


def test_worker_reconnects():
    made, broken = [], []

    def begin():
        if broken:
            raise RuntimeError(broken.pop())
        made.append(FakeQuery())
        return made[-1]

    s = Supervisor(lambda settings: begin, policy=lambda: Reconnection(most=3, base_ms=1, jitter=0.0))
    s.poll({"a": {}})
    worker = s.workers["a"]
    made[0].isActive, made[0].failure = False, RuntimeError("lost")
    broken.append("still down")
    assert s.reap() == [] and worker.state == RECONNECTING
    states = []
    while worker.state == RECONNECTING and len(states) < 1000:
        time.sleep(0.005)
        states.append(worker.refresh())
    assert worker.state == STREAMING and worker.query is made[1] and worker.reconnections == 1 and worker.errors == 2
    assert worker.snapshot()["state"] == "STREAMING" and worker.policy.failures == 2
    worker.policy.stable_s = 0.0
    assert worker.refresh() == STREAMING and worker.policy.failures == 0  # it has held
    worker.policy.most = 0
    made[1].isActive, made[1].failure = False, RuntimeError("lost")
    assert s.reap() == ["a"] and not s.workers
    made[:] = []


def test_run_survives_an_unreadable_list():
    s = Supervisor(lambda settings: FakeQuery, policy=lambda: Reconnection(most=0, base_ms=1, jitter=0.0))
    seen, reports = [], []

    def desired():
        seen.append(1)
        if len(seen) == 1:
            raise OSError("away")
        s.shutdown()
        return {"a": {}}

    s.run(desired, tick_s=0.01, poll_s=0.01, health_s=0.0, report=lambda snapshots: reports.append(len(snapshots)))
    assert len(seen) == 2 and reports[0] == 0 and reports[-1] == 1 and not s.workers


def test_reader_answers_and_acknowledges(tmp_path):
    path = tmp_path / "f.jsonl"
    sent = [b"w" + struct.pack(">QQq", 1, 2, 3) + b"one", b"k" + struct.pack(">QqB", 9, 3, 1), b"k" + struct.pack(">QqB", 9, 3, 0), b"w" + struct.pack(">QQq", 1, 2, 3) + b"two", b"raw"]
    path.write_text("".join(json.dumps({"seq": i, "payload": base64.b64encode(f).decode()}) + "\n" for i, f in enumerate(sent)))
    reader = source.FrameReader({"path": str(path), "maxframes": "10", "envelopes": "true", "ackseconds": "0"})
    rows, end = reader.read(reader.initialOffset())
    found = [("main", 0, b"one"), ("main", 3, b"two"), ("main", 4, b"raw")]
    assert list(rows) == found and end == {"position": 4}
    assert (tmp_path / "f.jsonl.replies").read_bytes()[:25] == p.standby_status(0, 0)[:25]
    reader.commit(end)
    (tmp_path / "f.jsonl.confirmed").unlink()
    assert list(reader.read(end)[0]) == [] and (tmp_path / "f.jsonl.confirmed").read_text() == "4"
    reader.most = 2  # a batch is read again whole, whatever the limit is by then
    assert list(reader.readBetweenOffsets({"position": -1}, end)) == found
    assert len((tmp_path / "f.jsonl.replies").read_bytes()) == 34


def test_bootstrap(spark, tmp_path):
    class Half:
        def __init__(self):
            self.ran = []

        def execute(self, statement):
            if "PUBLICATION" in statement:
                raise RuntimeError("exists already")
            self.ran.append(statement)

    spark.createDataFrame([("t", "public", "b"), ("t", "public", "a"), ("u", "public", "c")], "tenant string, table_schema string, table_name string").write.parquet(f"{tmp_path}/tables")
    tables = bootstrap.published(spark, f"{tmp_path}/tables", "t")
    client = Half()
    assert tables == [("public", "a"), ("public", "b")] and bootstrap.published(spark, "", "t") == []
    assert bootstrap.prepare(client, "CDCx", "slot", tables) == 3 and client.ran[-1] == 'ALTER TABLE "public"."b" REPLICA IDENTITY FULL'
    assert bootstrap.prepare(object(), "CDCx", "slot", tables) == 0


def test_reconnection():
    import threading

    waits, tries = [], []
    r = Reconnection(most=3, jitter=0.0)
    assert not r.connect(lambda: tries.append(1) and False, threading.Event(), waits.append)
    assert waits == [0.5, 1.0, 2.0] and r.failures == 3
    assert r.connect(lambda: True, threading.Event(), waits.append) and r.failures == 0
    assert not r.stable()


def test_cli(capsys):
    from tidelog import cli

    assert cli.settings([], {"TIDELOG_MAX_WORKERS": "x", "TIDELOG_PREFIX": "E"}).max_workers == 64
    assert cli.settings(["--prefix", "F"], {"TIDELOG_PREFIX": "E"}).prefix == "F"
    assert cli.main(["--max-workers", "abc"], {}) == cli.EXIT_CONFIG and cli.main(["--nope"], {}) == cli.EXIT_CONFIG
    assert cli.main(["--version"], {}) == cli.EXIT_OK and cli.main([], {}) == cli.EXIT_CONFIG
    assert "secret" not in str(cli.redacted({"password": "secret"}))
