"""Decoding of many frames at once, by NumPy and Arrow.

Cells are walked in lockstep: a step reads the next cell of all tuples of a
batch. Frames of the common forms (begin, commit, sound changes) are read this
way; every other frame is left to ``pgoutput.decode_message``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidelog.functions.pgbatch import gather, made, numbers, slices, texts, validity

#: Cells that a batch may have as a rectangle; batches that would have more are halved.
MOST_CELLS = 1 << 21
B, C, I, U, D, K, O, N = b"BCIUDKON"  # noqa: E741
NULL, UNSENT, TEXT, BINARY = b"nutb"


class Tuples:
    """Tuples that begin at ``at``, of frames that end at ``end``; ``sound`` where all could be read."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, sound: np.ndarray):
        n = len(at)
        self.data, self.sound, self.at = data, sound & (at + 2 <= end), at.copy()
        self.counts = np.zeros(n, np.int64)
        rows = np.flatnonzero(self.sound)
        self.counts[rows] = numbers(data, at[rows], ">u2")
        self.at[rows] += 2
        self.sound[rows] = self.at[rows] + self.counts[rows] <= end[rows]
        self.counts[~self.sound] = 0
        most = int(self.counts.max(initial=0))
        self.kinds = np.zeros((n, most), np.uint8)
        self.starts, self.sizes = np.zeros((n, most), np.int64), np.zeros((n, most), np.int64)
        for i in range(most):
            rows = np.flatnonzero(self.sound & (self.counts > i))
            at, last = self.at[rows], end[rows]
            here = at < last
            kind = np.where(here, data[np.where(here, at, 0)], 0)
            valued = (kind == TEXT) | (kind == BINARY)
            fits = here & np.isin(kind, (NULL, UNSENT, TEXT, BINARY)) & (~valued | (at + 5 <= last))
            size = np.zeros(len(rows), np.int64)
            read = fits & valued
            size[read] = numbers(data, at[read] + 1, ">i4")
            fits &= (size >= 0) & (~valued | (at + 5 + size <= last))
            self.kinds[rows, i] = np.where((kind == BINARY) & (size == 0), NULL, kind)
            self.starts[rows, i], self.sizes[rows, i] = at + 5, np.where(valued & fits, size, 0)
            self.at[rows] = at + np.where(valued, 5 + size, 1)
            self.sound[rows[~fits]] = False

    def lists(self, rows: np.ndarray, present: np.ndarray) -> pa.Array:
        """The tuples of these rows as an array of ``pgoutput.RAW``; null where none is present."""
        counts = np.where(present[rows], self.counts[rows], 0)
        inside = np.arange(self.kinds.shape[1])[None, :] < counts[:, None]
        kinds, starts, sizes = (x[rows][inside] for x in (self.kinds, self.starts, self.sizes))
        kind = made(pa.string(), np.arange(len(kinds) + 1), kinds)
        is_text, is_binary = kinds == TEXT, kinds == BINARY
        text = texts(self.data, starts, np.where(is_text, sizes, 0), is_text)
        binary = made(pa.binary(), *gather(self.data, starts, np.where(is_binary, sizes, 0)), is_binary)
        cells = pa.StructArray.from_arrays([kind, text, binary], ["kind", "text", "bin"])
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum(counts, out=offsets[1:])
        return pa.Array.from_buffers(pa.list_(cells.type), len(rows), [validity(present[rows]), pa.py_buffer(offsets.tobytes())], children=[cells])


def _longs(values: np.ndarray, valid: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=~valid)


def decode(batch: pa.RecordBatch, schema: pa.Schema) -> tuple[list[pa.RecordBatch], np.ndarray]:
    """(decoded batches, rows that are of no common form) of frames (tenant, seq, payload)."""
    payload = batch.column("payload")
    data, start, size = slices(payload)
    n = len(start)
    heads = np.zeros(n, np.uint8)
    heads[size > 0] = data[start[size > 0]]
    end = start + size
    change = np.isin(heads, (I, U, D)) & (size >= 8)
    if n > 1 and change.any():
        # Counts of cells are bounded by the frames' sizes; the first tuple's is a fair sign of both.
        rows = np.flatnonzero(change)
        if n * int(np.minimum(numbers(data, start[rows] + 6, ">u2"), size[rows]).max()) > MOST_CELLS:
            half = n // 2
            first, second = (decode(batch.slice(*x), schema) for x in ((0, half), (half, n - half)))
            return first[0] + second[0], np.concatenate([first[1], second[1] + half])
    begin, commit = (heads == B) & (size >= 21), (heads == C) & (size >= 26)

    def read(rows: np.ndarray, at: int, kind: str) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[rows] = numbers(data, start[rows] + at, kind)
        return out

    part = np.zeros(n, np.uint8)
    part[change] = data[start[change] + 5]
    has_old = change & np.isin(part, (K, O)) & (heads != I)
    old = Tuples(data, start + 6, end, has_old)
    at = np.where(has_old, old.at, start + 5)
    wants_new = change & (heads != D) & (~has_old | old.sound) & (at < end)
    wants_new[wants_new] = data[at[wants_new]] == N
    new = Tuples(data, at + 1, end, wants_new)
    last = np.where(wants_new, new.at, at)
    change &= (~has_old | old.sound) & np.where(heads == D, has_old, wants_new & new.sound) & (last == end)
    rows = np.flatnonzero(begin | commit | change)
    none = lambda name: pa.nulls(len(rows), schema.field(name).type)
    control = begin | commit
    lsn = read(begin, 1, ">i8"), read(commit, 2, ">i8")
    micros = np.where(begin, read(begin, 9, ">i8"), read(commit, 18, ">i8"))
    old_kind = pa.array(np.where(part[rows] == K, "K", "O").astype(object), pa.string(), mask=~has_old[rows]) if has_old.any() else none("old_kind")
    columns = {
        "tenant": batch.column("tenant").take(pa.array(rows)), "seq": batch.column("seq").take(pa.array(rows)), "tag": made(pa.string(), np.arange(len(rows) + 1), heads[rows]), "error": none("error"),
        "xid": _longs(read(begin, 17, ">u4")[rows], begin[rows]), "begin_lsn": _longs(lsn[0][rows], begin[rows]), "commit_lsn": _longs(lsn[1][rows], commit[rows]),
        "end_lsn": _longs(read(commit, 10, ">i8")[rows], commit[rows]), "commit_us": _longs(micros[rows], control[rows]), "rel_oid": _longs(read(change, 1, ">u4")[rows], change[rows]),
        "relation": none("relation"), "truncated": none("truncated"), "old_kind": old_kind, "old_raw": old.lists(rows, has_old) if has_old.any() else none("old_raw"),
        "new_raw": new.lists(rows, wants_new) if wants_new.any() else none("new_raw"),
    }
    others = np.ones(n, bool)
    others[rows] = False
    return [pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)], np.flatnonzero(others)
