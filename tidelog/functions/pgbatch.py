"""Binary values of many cells at once: what ``pgtypes.decode_binary`` gives, by NumPy and Arrow.

Cells are slices of one buffer. Types whose decoder has a form for batches use
it; all others, and decoders that users have registered, run cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidelog.functions import pgtypes

Batch = Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Array]
ASCII = 128
_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)
#: Positions of a uuid's 32 digits among its 36 characters.
_UUID_AT = np.array([i for i in range(36) if i not in (8, 13, 18, 23)])


def slices(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, starts and sizes of a binary or string array (nulls have size 0)."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    sizes = np.diff(at)
    if array.null_count:
        sizes = np.where(array.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at[:-1], sizes


def gather(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of slices put one after another."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return offsets, buffer[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]


def validity(valid: np.ndarray | None) -> pa.Buffer | None:
    return None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())


def made(kind: pa.DataType, offsets: np.ndarray, data: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A binary or string array of such slices; strings are taken to be sound."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [validity(valid), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def texts(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Slices as UTF-8 text; what is none is replaced, cell by cell."""
    offsets, data = gather(buffer, starts, sizes)
    if not (data >= ASCII).any():
        return made(pa.string(), offsets, data, valid)
    raw = made(pa.binary(), offsets, data, valid)
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def numbers(buffer: np.ndarray, starts: np.ndarray, kind: str) -> np.ndarray:
    """Big-endian numbers at these places."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(buffer[starts[:, None] + np.arange(width)]).view(kind).ravel()


def _fixed(kind: str, shown: Callable[[np.ndarray], pa.Array]) -> Batch:
    """Values of a fixed width at the head of each cell; null where the cell is shorter."""

    def decode(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
        whole = sizes >= np.dtype(kind).itemsize
        if whole.all():
            return shown(numbers(buffer, starts, kind))
        at = np.where(whole, np.cumsum(whole) - 1, 0)
        return shown(numbers(buffer, starts[whole], kind)).take(pa.array(at, mask=~whole)) if whole.any() else pa.nulls(len(sizes), pa.string())

    return decode


def _integers(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(values.dtype.newbyteorder("="))).cast(pa.string())


def _by_value(oid: int, kind: str) -> Callable[[np.ndarray], pa.Array]:
    """The scalar decoder on each of the values."""

    def shown(values: np.ndarray) -> pa.Array:
        width, data = np.dtype(kind).itemsize, values.tobytes()
        return pa.array([pgtypes.decode_binary(oid, data[i : i + width]) for i in range(0, len(data), width)], pa.string())

    return shown


#: Days and microseconds since 2000 whose years have the form that NumPy writes.
_DAY_0, _FIRST_DAY, _MOST_DAYS = np.datetime64("2000-01-01", "D"), -730_119, 1 << 26


def _dates(values: np.ndarray) -> pa.Array:
    days = values.astype(np.int64)
    plain = (days >= _FIRST_DAY) & (days < _MOST_DAYS)
    if not plain.all():
        return _by_value(1082, ">i4")(values)
    return pa.array(np.datetime_as_string(_DAY_0 + days, unit="D").astype(object), pa.string())


def _times(oid: int, suffix: str) -> Callable[[np.ndarray], pa.Array]:
    def shown(values: np.ndarray) -> pa.Array:
        micros = values.astype(np.int64)
        days, rest = np.divmod(micros, 86_400_000_000)
        if not ((days >= _FIRST_DAY) & (days < _MOST_DAYS)).all():
            return _by_value(oid, ">i8")(values)
        text = np.datetime_as_string((_DAY_0 + days).astype("datetime64[s]") + rest // 1_000_000, unit="s").astype(object)
        whole = pc.replace_substring(pa.array(text, pa.string()), "T", " ", max_replacements=1)
        part = rest % 1_000_000
        if not part.any():
            return pc.binary_join_element_wise(whole, suffix, "")
        fraction = pc.utf8_lpad(pa.array(part).cast(pa.string()), 6, "0")
        ends = pc.if_else(pa.array(part == 0), "", pc.binary_join_element_wise(".", fraction, ""))
        return pc.binary_join_element_wise(whole, ends, suffix, "")

    return shown


def _hex(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets, data = gather(buffer, starts, sizes)
    return pc.binary_join_element_wise("\\x", made(pa.string(), offsets * 2, _HEX[data].ravel()), "")


def _uuids(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    whole = sizes == 16
    out = np.full((len(sizes), 36), ord("-"), np.uint8)
    out[np.ix_(whole, _UUID_AT)] = _HEX[buffer[starts[whole][:, None] + np.arange(16)]].reshape(-1, 32)
    return made(pa.string(), np.arange(len(sizes) + 1) * 36, out.ravel(), whole)


_BATCH: dict[int, Batch] = {
    16: lambda b, at, n: pc.if_else(pa.array(b[at] != 0), "t", "f"), 21: _fixed(">i2", _integers), 23: _fixed(">i4", _integers), 20: _fixed(">i8", _integers), 26: _fixed(">u4", _integers),
    700: _fixed(">f4", _by_value(700, ">f4")), 701: _fixed(">f8", _by_value(701, ">f8")), 1082: _fixed(">i4", _dates), 1114: _fixed(">i8", _times(1114, "")), 1184: _fixed(">i8", _times(1184, "+00")),
    17: _hex, 2950: _uuids, 3802: lambda b, at, n: texts(b, at + 1, n - 1),
}
#: The decoders that the forms for batches stand for.
_BUILT_IN = {oid: pgtypes.decoder(oid) for oid in _BATCH}


def decode(oid: int, cells: pa.Array) -> pa.Array:
    """Texts of binary cells of a type; null if a cell is null, empty or too short."""
    found = pgtypes.decoder(oid)
    batch = texts if found is pgtypes._text else _BATCH.get(oid) if found is _BUILT_IN.get(oid) else None
    if batch is None:
        return pa.array([pgtypes.decode_binary(oid, x) for x in cells.to_pylist()], pa.string())
    buffer, starts, sizes = slices(cells)
    some = sizes > 0
    if some.all():
        return batch(buffer, starts, sizes)
    if not some.any():
        return pa.nulls(len(cells), pa.string())
    return batch(buffer, starts[some], sizes[some]).take(pa.array(np.cumsum(some) - 1, mask=~some))


def cell_texts(rows: pa.Array, types: pa.Array) -> pa.Array:
    """Tuples (lists of kind, text, bin) whose binary cells are text by the types at their places."""
    offsets, places = rows.offsets.to_numpy().astype(np.int64), types.offsets.to_numpy().astype(np.int64)
    lengths, known = np.diff(offsets), np.diff(places)
    kind, text, data = rows.values.slice(offsets[0], offsets[-1] - offsets[0]).flatten()
    at = np.flatnonzero(pc.fill_null(pc.equal(kind, "b"), False).to_numpy(zero_copy_only=False))
    if len(at) == 0:
        return rows
    row = np.repeat(np.arange(len(rows)), lengths)[at]
    place = at + offsets[0] - offsets[row]
    named = place < known[row]
    oids = np.zeros(len(at), np.int64)
    oids[named] = types.values.to_numpy(zero_copy_only=False)[places[row[named]] + place[named]]
    order, parts = [], []
    for oid in np.unique(oids):
        mine = np.flatnonzero(oids == oid)
        order.append(mine)
        parts.append(decode(int(oid), data.take(pa.array(at[mine]))))
    found = pa.concat_arrays(parts)
    source = np.arange(len(kind))
    source[at[np.concatenate(order)]] = len(kind) + np.arange(len(at))
    text = pa.concat_arrays([text, found]).take(pa.array(source))
    kind = pc.if_else(pc.equal(kind, "b"), pc.if_else(text.is_valid(), "t", "n"), kind)
    cells = pa.StructArray.from_arrays([kind, text, pa.nulls(len(kind), pa.binary())], ["kind", "text", "bin"])
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), cells, mask=rows.is_null())
