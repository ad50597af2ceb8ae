"""Batch decoding against the decoding of one frame or value at a time."""

import random

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidelog.functions import pgbatch, pgtypes
from tidelog.sources import batches
from tidelog.sources import pgoutput as p

VALUES = [None, ..., "", "x", "éü", b"", b"\x00\x01", "a" * 50, b"\xff" * 16, 12]


def frames(n, rng):
    row = lambda: [rng.choice(VALUES) for _ in range(rng.randrange(6))]
    out = []
    for _ in range(n):
        tag = rng.choice("IUDBCRTYZ")
        if tag in "IUD":
            old = row() if tag == "D" or tag == "U" and rng.random() < 0.7 else None
            f = p.encode_change(tag, rng.randrange(1 << 32), old, row() if tag != "D" else None, rng.choice("KO"))
        elif tag == "B":
            f = p.encode_begin(rng.randrange(1 << 64), rng.randrange(-9, 1 << 60), rng.randrange(1 << 32))
        elif tag == "C":
            f = p.encode_commit(rng.randrange(1 << 64), rng.randrange(1 << 64), 5)
        else:
            f = p.encode_relation(3, "a", "b", [("c", 23, True)]) if tag == "R" else tag.encode() + b"\0" * 9
        luck = rng.random()
        if luck < 0.2:
            f = f[: rng.randrange(len(f) + 1)]
        elif luck < 0.35:
            f = (at := rng.randrange(len(f)), f[:at] + bytes([rng.randrange(256)]) + f[at + 1 :])[1]
        elif luck < 0.4:
            f += b"zz"
        out.append(None if luck > 0.99 else f)
    return out


@pytest.mark.parametrize("most", [1 << 21, 200])
@pytest.mark.parametrize("cut", [(0, 2000), (7, 900)])
def test_frames_of_all_forms(spark, monkeypatch, most, cut):
    monkeypatch.setattr(batches, "MOST_CELLS", most)
    schema = to_arrow_schema(StructType.fromDDL(p.DECODED))
    made = frames(2000, random.Random(1))
    part = pa.record_batch({"tenant": ["m"] * len(made), "seq": range(len(made)), "payload": pa.array(made, pa.binary())}).slice(*cut)
    found, others = batches.decode(part, schema)
    for x in found:
        x.validate(full=True)
    rows = {r["seq"]: r for x in found for r in x.to_pylist()}
    assert len(rows) + len(others) == part.num_rows and len(rows) > part.num_rows // 4
    expected = pa.RecordBatch.from_pylist([{"tenant": "m", "seq": r["seq"]} | p.decode_message(r["payload"]) for r in part.to_pylist()], schema=schema)
    for r in expected.to_pylist():
        assert rows.get(r["seq"], r) == r
    left = {part.column("seq")[int(i)].as_py() for i in others}
    assert left == {r["seq"] for r in expected.to_pylist()} - set(rows)


@pytest.mark.parametrize("oid", [*[t.oid for t in pgtypes.TYPES], 99999])
def test_values_of_all_types(oid):
    rng, longs = random.Random(oid), lambda width, *of: [x.to_bytes(width, "big", signed=True) for x in of]
    day = 86_400_000_000
    some = [None, b"", b"\0", b"\1\2", bytes(range(16)), b"caf\xc3\xa9", b"\xff\xfe12", *longs(4, 2**31 - 1, -(2**31), 9_000_000, -800_000), *longs(8, 2**63 - 1, -(2**63), 10**17 + 5, -(10**17), day)]
    some += [rng.randbytes(rng.choice([1, 2, 4, 8, 16])) for _ in range(200)]
    for cells in (some, [x for x in some if x and len(x) == 8], longs(8, *[d * day + k for d in (-700_000, 0, 5_000_000) for k in (0, 7, 1000)]), longs(8, 0, 5 * day), longs(4, -730_119, 5, 3_000_000), [None], []):
        found = pgbatch.decode(oid, pa.array(cells, pa.binary()))
        found.validate(full=True)
        assert found.to_pylist() == [pgtypes.decode_binary(oid, x) for x in cells]


def test_cells_by_place_and_registered_decoders(monkeypatch):
    monkeypatch.setitem(pgtypes._DECODERS, 23, lambda data: "mine")
    raw = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("bin", pa.binary())]))
    cell = lambda kind, text=None, data=None: {"kind": kind, "text": text, "bin": data}
    rows = [[cell("b", data=b"\0\0\0\5"), cell("t", "x"), cell("b", data=b"\0")], None, [], [cell("u"), cell("n"), cell("b", data=b"hi")]]
    types = [[23, 25], [23], None, [23, 25, 20]]
    found = pgbatch.cell_texts(pa.array([None, *rows], raw).slice(1), pa.array([[1], *types], pa.list_(pa.int64())).slice(1)).to_pylist()
    assert found == [[cell("t", "mine"), cell("t", "x"), cell("t", "\0")], None, [], [cell("u"), cell("n"), cell("n")]]
