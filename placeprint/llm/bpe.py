"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is cut by a pattern; each distinct piece that is no token itself is encoded once per worker. Pieces of similar
length form the rows of one padded matrix of token ids. In every round each row finds its pair of least rank, the
leftmost of equals, in a hashed pair table, merges it and closes the gap; rows without a pair leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeprint.llm.common import bounded_batches, free_name, trim

#: No pair, padding.
NONE = np.int32(2**31 - 1)
#: Pieces of more bytes than this would make a matrix of very many rounds; a heap merges them by the same rule.
MATRIX_BYTES = 2048
#: A worker forgets its pieces when it knows so many.
CACHE_PIECES = 100_000
#: Cells in one matrix at most.
CELLS = 4_000_000


class Vocabulary:
    """Token bytes by id, and a hashed table of all pairs whose joined bytes are a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = np.empty(max(ranks.values()) + 1, dtype=object)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        self.pairs = dict(zip(keys, merged))
        self._build(np.array(keys, dtype=np.uint64), np.array(merged, dtype=np.int32))
        self.cache: dict[str, bytes] = {}

    def _build(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """Open addressing with linear probing, filled in rounds: in each, one key claims a free slot."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        empty = np.uint64(2**64 - 1)
        self.keys, self.merged = np.full(1 << self.bits, empty), np.full(1 << self.bits, NONE, dtype=np.int32)
        at, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[at] == empty
            self.keys[at[free]], self.merged[at[free]] = keys[free], merged[free]
            left = self.keys[at] != keys
            keys, merged, at = keys[left], merged[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged token of each pair, or NONE; NONE on either side gives NONE."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at, out = self._slot(keys), np.full(keys.shape, NONE, dtype=np.int32)
        hit = self.keys[at] == keys
        out[hit] = self.merged[at[hit]]
        open_ = np.nonzero(~hit & (self.merged[at] != NONE))
        for _ in range(self.probes):
            if not len(open_[0]):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            here, wanted = at[open_], keys[open_]
            hit = self.keys[here] == wanted
            out[tuple(x[hit] for x in open_)] = self.merged[here[hit]]
            more = ~hit & (self.merged[here] != NONE)
            open_ = tuple(x[more] for x in open_)
        return out

    def merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar length."""
        width = max(map(len, pieces))
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        size = np.array([len(p) for p in pieces])
        cols = np.arange(width)
        ids = np.where(cols < size[:, None], self.byte_id[flat], NONE)
        ranks = np.full((len(pieces), width), NONE, dtype=np.int32)  # of the pair that starts at a cell
        if width > 1:
            ranks[:, :-1] = self.lookup(ids[:, :-1], ids[:, 1:])
        out: list[np.ndarray] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            ended = best == NONE
            if ended.any():
                for i in np.nonzero(ended)[0]:
                    out[rows[i]] = ids[i, : size[i]]
                stay = ~ended
                rows, ids, ranks, size, at, best = rows[stay], ids[stay], ranks[stay], size[stay], at[stay], best[stay]
                if not len(rows):
                    break
                width = size.max()
                ids, ranks, each = ids[:, :width], ranks[:, :width], np.arange(len(rows))
            cols = np.arange(width)
            take = cols + (cols > at[:, None])
            last = take >= width
            take[last] = width - 1
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            ids[last] = ranks[last] = NONE
            ids[each, at] = best
            size = size - 1
            right = np.minimum(at + 1, width - 1)
            ranks[each, at] = self.lookup(best, np.where(at + 1 < size, ids[each, right], NONE))
            before = np.nonzero(at > 0)[0]
            ranks[before, at[before] - 1] = self.lookup(ids[before, at[before] - 1], best[before])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges of one very long piece, by a heap of (rank, position) over a linked list."""
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], k = r, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (x := get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def learn(self, pieces: set[str]) -> None:
        """Add pieces to the worker's memory of encoded pieces."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(raw) > MATRIX_BYTES:
                self.cache[piece] = self.merge_long(raw).astype("<u4").tobytes()
            else:
                size = len(raw)
                by_length.setdefault(size if size <= 16 else -(-size // 8) * 8 if size <= 64 else 1 << (size - 1).bit_length(), []).append((piece, raw))
        for width, some in by_length.items():
            step = max(1, CELLS // width)
            for i in range(0, len(some), step):
                part = some[i : i + step]
                for (piece, _), ids in zip(part, self.merge_matrix([raw for _, raw in part])):
                    self.cache[piece] = ids.astype("<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, step = [], 512
        for i in range(0, len(texts), step):
            cut = [self.pattern.findall(t) for t in texts[i : i + step]]
            if len(self.cache) > CACHE_PIECES:
                self.cache = {}
            self.learn(set().union(*cut) - self.cache.keys())
            get = self.cache.__getitem__
            out += [b"".join(map(get, pieces)) for pieces in cut]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids; any id that is no token raises."""
        return b"".join(self.bytes_of[np.frombuffer(ids, dtype="<u4")].tolist())


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, a space, its rank, on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


_known: dict[tuple, Vocabulary] = {}


def _vocabulary(key: tuple, shared) -> Vocabulary:
    if key not in _known:
        _known[key] = Vocabulary(shared.value, key[1])
    return _known[key]


def _encode_rows(key: tuple, shared, column: str, name: str):
    """Rows with a struct of ids behind their columns, a few hundred at a time; what a task has learned goes with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(key, shared)
        try:
            for whole in batches:
                for i in range(0, whole.num_rows, 512):
                    b = whole.slice(i, 512)
                    ids = v.encode_all([t or "" for t in b.column(column).to_pylist()])
                    made = pa.StructArray.from_arrays([
                        pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(v.decode(x)).hexdigest() for x in ids], pa.string()),
                    ], ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])
                    yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns) if b.schema.names[k] != column), made], [*(n for n in b.schema.names if n != column), name])
        finally:
            v.cache = {}
            trim()

    return run


def decoder(spark, path: str, pattern: str):
    """A pandas UDF: ids as of encoder() -> the text's bytes; null gives null."""
    shared, key = spark.sparkContext.broadcast(read_ranks(path)), (path, pattern)

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        v = _vocabulary(key, shared)
        return pd.Series([None if x is None else v.decode(bytes(x)) for x in ids], dtype=object)

    return decode


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text", name: str = "bpe", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of df (all by default) with a struct ``name``: n_tokens, ids, ids_sha256, decoded_sha256.

    ids are little-endian unsigned 32-bit integers. The driver reads the rank file (under 1 MB for 50,000 tokens, so a
    broadcast of bounded size); workers build the pair table once. Map-only: no shuffle, every row by itself. Null and
    empty texts have no tokens; repeated rows and ties need no rule; an empty table gives an empty one; a column that is
    called ``name`` is replaced. Bounds the session's Arrow batches.
    """
    spark, key = df.sparkSession, (path, pattern)
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(path))
    carry = [c for c in (df.columns if carry is None else carry) if c != name]
    whole, out = free_name(df, "text"), free_name(df, "made")
    rows = df.select(*[F.col(f"`{c}`") for c in carry], F.col(text).alias(whole))
    made = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, made)])
    return rows.mapInArrow(_encode_rows(key, shared, whole, out), schema).withColumnRenamed(out, name)
