"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encodings form a monoid under ``join``. A piece of text is cut into halves down
to single tokens, and neighbouring results are joined on the way up: the tokens
at the seam are decoded and encoded again as one window, which doubles on both
sides until the tokens outside it provably cannot change. The proof used: a
sequence of tokens is the BPE encoding of its bytes exactly if every pair of
neighbours is the encoding of its own two tokens' bytes, so the window is large
enough once the two pairs at its edges are. Decoding concatenates up the tree.

Text is first cut by the vocabulary's pattern, each match being encoded alone;
special tokens are ordinary text. Cuts before a single space between two visible
characters are cuts of the pattern as well, so the encodings of such chunks are
cached by their text.

Defined results: null text counts as empty, which has no ids and decodes to no
bytes. Rows are never dropped or merged; whole texts are encoded.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.arrow_columns import with_python_columns
from tidelog.llm.tables import table
from tidelog.llm.worker_cache import claim

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE_CHUNKS, CACHE_PIECES, CACHE_WINDOWS, SHORT, LEAF = 800_000, 600_000, 250_000, 8, 1 << 14
#: Where a chunk may begin: at a space after a visible and before a visible character.
CHUNKS = regex.compile(r"(?<=\S)(?= \S)")
ODD = regex.compile(r"\s | \s|^ | $")


class TreeBpe:
    """Encoder and decoder of one vocabulary of (bytes, rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: b for b, i in ranks.items()}
        self.widths = np.zeros(max(self.tokens, default=0) + 1, dtype=np.int64)
        self.widths[list(self.tokens)] = [len(b) for b in self.tokens.values()]
        self.starts = np.cumsum(self.widths) - self.widths
        self.joined = np.frombuffer(b"".join(self.tokens[i] for i in sorted(self.tokens)), dtype=np.uint8)
        self.windows: dict[bytes, list[int]] = {}
        self.halves: dict[bytes, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[bytes, list[int]] = {}
        self.chunks: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> TreeBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merged(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        ranks = self.ranks
        if len(data) <= 64:
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 1:
                best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if best == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]
        ends = list(range(1, len(data) + 1))  # of the part that begins at an index; 0 where none does
        begins = [-1, *range(len(data))]  # of the part that ends at an index
        heap = [(r, i, i + 2) for i in range(len(data) - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            middle = ends[at]
            if not middle or middle >= len(data) or middle == end or ends[middle] != end:
                continue  # one of its parts has been merged meanwhile
            ends[at], ends[middle], begins[end] = end, 0, at
            if at and (r := ranks.get(data[(before := begins[at]) : end])) is not None:
                heapq.heappush(heap, (r, before, end))
            if end < len(data) and (r := ranks.get(data[at : ends[end]])) is not None:
                heapq.heappush(heap, (r, at, ends[end]))
        found, at = [], 0
        while at < len(data):
            found.append(ranks[data[at : ends[at]]])
            at = ends[at]
        return found

    def window(self, data: bytes) -> list[int]:
        """Encoding of a window, short ones from a cache."""
        found = self.windows.get(data)
        if found is None:
            found = self.merged(data)
            if len(data) <= 64:
                if len(self.windows) >= CACHE_WINDOWS:
                    self.windows.clear()
                self.windows[data] = found
        return found

    def stable(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay as they are."""
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHE_WINDOWS:
                self.pairs.clear()
            self.pairs[pair] = known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation: encoding of the concatenated bytes."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            head, tail = left[-width:], right[:width]
            middle = self.window(b"".join(map(self.tokens.__getitem__, head + tail)))
            left_holds = width >= len(left) or self.stable(left[-width - 1], middle[0])
            right_holds = width >= len(right) or self.stable(middle[-1], right[width])
            if left_holds and right_holds:
                return left[:-width] + middle + right[width:]
            width *= 2

    def encode_piece(self, data: bytes) -> list[int]:
        """Encoding of one match of the pattern, by halves."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > SHORT:
            half = len(data) // 2
            return self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))
        known = self.halves.get(data)
        if known is None:
            if len(self.halves) >= CACHE_WINDOWS:
                self.halves.clear()
            half = len(data) // 2
            self.halves[data] = known = self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))
        return known

    def encode_chunk(self, chunk: str) -> bytes:
        """Encoding of a chunk as packed 32-bit ids."""
        ids: list[int] = []
        for match in self.pattern.findall(chunk):
            data = match.encode()
            own = self.pieces.get(data)
            if own is None:
                own = self.encode_piece(data)
                if len(data) <= 64:
                    if len(self.pieces) >= CACHE_PIECES:
                        self.pieces.clear()
                    self.pieces[data] = own
            ids += own
        packed = array("I", ids).tobytes()
        if len(chunk) <= 64:
            if len(self.chunks) >= CACHE_CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """Encoding of a text as packed 32-bit ids."""
        if ODD.search(text):
            chunks = CHUNKS.split(text)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *[" " + c for c in rest]]
        known = self.chunks.get
        return b"".join([found if (found := known(c)) is not None else self.encode_chunk(c) for c in chunks])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def leaf(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of ids, gathered from the joined vocabulary."""
        widths = self.widths[ids]
        ends = np.cumsum(widths)
        return self.joined[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + widths, widths)].tobytes()

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """Bytes of a sequence of ids, concatenated up the tree."""
        if len(ids) == 0:
            return b""
        if len(ids) <= LEAF:
            return self.leaf(np.asarray(ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _bpe(path: str, pattern: str) -> TreeBpe:
    """One instance per worker, so that its caches outlive a task."""
    kept = claim("byte_bpe")
    if (path, pattern) not in kept:
        kept[path, pattern] = TreeBpe.load(path, pattern)
    return kept[path, pattern]


def encoder(path: str, pattern: str) -> Callable[[pa.Array], list[pa.Array]]:
    bpe = _bpe(path, pattern)

    def encode(texts: pa.Array) -> list[pa.Array]:
        packed = [bpe.encode_packed(t) if t else b"" for t in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        values = np.frombuffer(b"".join(packed), dtype="<i4")
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))]

    return encode


def decoder(path: str, pattern: str) -> Callable[[pa.Array], list[pa.Array]]:
    bpe = _bpe(path, pattern)

    def decode(ids: pa.Array) -> list[pa.Array]:
        values, bounds = ids.values.to_numpy(), ids.offsets.to_numpy()
        return [pa.array([bpe.decode(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())]

    return decode


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN


IDS = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
DECODED = [T.StructField("decoded", T.BinaryType())]


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` plus ids, the encoding of each whole text."""
    path, pattern = _defaults(path, pattern)
    return with_python_columns(docs, [(text, IDS, lambda: encoder(path, pattern))])


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``rows`` plus decoded, the bytes of each sequence of ids."""
    path, pattern = _defaults(path, pattern)
    return with_python_columns(rows, [(ids, DECODED, lambda: decoder(path, pattern))])


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` plus ids and decoded, both made in one pass."""
    path, pattern = _defaults(path, pattern)
    return with_python_columns(docs, [(text, IDS, lambda: encoder(path, pattern)), ("ids", DECODED, lambda: decoder(path, pattern))])


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the encoding, and of its decoding, of every row of ``documents``."""
    rows = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
