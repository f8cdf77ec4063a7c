"""Exact dedup by Grace hashing: partition into buckets until each fits an open-addressing table of complete contents.

Spark's shuffle files are the spill files, so a lost executor costs a stage retry and no result. Copies that meet in one
scan task are folded there first: a table of bounded bytes and rows keeps what has been seen often when it runs full, so
a hot text sends one row a task as long as the hot texts fit half of the table. Texts that still send very many rows are
met in two rounds, by hash and salt first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeprint.llm.common import bounded_batches, free_name, trim, written

#: Bytes of distinct content in one table, and its entries at most.
TABLE_BYTES = 16 << 20
TABLE_ROWS = 100_000
#: Ids in one row of the folded table, and ids that a task holds at most.
CHUNK_IDS = 4096
HELD_IDS = 400_000
#: Entries that stay in a full table at most.
KEPT = 1024
#: Ways in which a bucket that doesn't fit is partitioned again, and buckets split in one round at most.
FANOUT = 16
MOST_SPLIT = 1000
#: Bytes of content in one shuffle partition; it holds many buckets, one table at a time.
PARTITION_BYTES = 256 << 20
#: A hash is hot if more rows bring it than this and than one in HOT_SHARE of all (so fewer than HOT_SHARE are); its rows
#: meet by SALTS first.
HOT_ROWS = 1024
HOT_SHARE = 100_000
SALTS = 64


class ContentTable:
    """Open addressing with linear probing; a slot names an entry, equality is that of hash and complete content."""

    def __init__(self):
        self.slots, self.hashes, self.contents, self.bytes = np.full(1024, -1, dtype=np.int64).tolist(), [], [], 0

    def put(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry of the content, and whether it is new."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (e := slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            at = (at + 1) & mask
        slots[at] = e = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.hashes) > len(slots):
            self._grow()
        return e, True

    def _grow(self) -> None:
        size = 4 * len(self.slots)
        slots, mask = [-1] * size, size - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = e
        self.slots = slots


_FOLDED = "rep long, chunk int, ids array<long>, h long, bytes long, n long, top long, top_chunk int, content binary"
_FOLDED_TYPES = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
_FOLDED_NAMES = [x.split()[0] for x in _FOLDED.split(", ")]


def _descending(ids: list) -> list:
    """Largest first, nulls last."""
    return sorted(ids, key=lambda v: (v is None, 0 if v is None else -v))


class Fold:
    """Scan side: rows of (doc, hash, content) in, one row for each distinct content out, with the ids of its rows.

    A full table puts out what was seen least and keeps the contents seen most, up to half its bytes. Ids beyond
    CHUNK_IDS of one content go out in rows of their own (without content) as they come.
    """

    def __init__(self, base: int, table_bytes: int):
        self.base, self.made, self.table_bytes = base, 0, table_bytes
        self.table, self.entries, self.out, self.held, self.wide = ContentTable(), [], [], 0, 0

    def put(self, doc, h: int, content: bytes) -> None:
        e, new = self.table.put(h, content)
        if new:  # rep, next chunk, ids, n, top, chunk of top
            self.entries.append([self.base + self.made, 0, [doc], 1, doc, 0])
            self.made += 1
        else:
            entry = self.entries[e]
            entry[2].append(doc)
            entry[3] += 1
            if _better(doc, entry[4]):
                entry[4], entry[5] = doc, entry[1]
            if len(entry[2]) >= CHUNK_IDS:
                self._put_ids(entry)
        self.held += 1
        if self.table.bytes > self.table_bytes or len(self.entries) > TABLE_ROWS or self.held > HELD_IDS:
            self.evict()

    def _put_ids(self, entry: list) -> None:
        self.out.append((entry[0], entry[1], _descending(entry[2]), None, None, None, None, None, None))
        self.held -= len(entry[2])
        entry[1], entry[2] = entry[1] + 1, []

    def _put_entry(self, e: int) -> None:
        rep, chunk, ids, n, top, top_chunk = self.entries[e]
        content = self.table.contents[e]
        self.out.append((rep, chunk, _descending(ids), self.table.hashes[e], len(content), n, top, top_chunk, content))
        self.held -= len(ids)
        self.wide += len(content)

    def evict(self) -> None:
        often = sorted((e for e, x in enumerate(self.entries) if x[3] > 1), key=lambda e: -self.entries[e][3])[:KEPT]
        room, stay = self.table_bytes // 2, set()
        for e in often:
            if len(self.table.contents[e]) <= room:
                room -= len(self.table.contents[e])
                stay.add(e)
        table, entries = ContentTable(), []
        for e, entry in enumerate(self.entries):
            if e in stay:
                if entry[2]:
                    self._put_ids(entry)
                table.put(self.table.hashes[e], self.table.contents[e])
                entries.append(entry)
            else:
                self._put_entry(e)
        self.table, self.entries = table, entries

    def take(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Rows that are ready, once there are many; all of them at the end."""
        if last:
            for e in range(len(self.entries)):
                self._put_entry(e)
            self.table, self.entries = ContentTable(), []
        if last or len(self.out) > 4096 or self.wide > self.table_bytes // 4:
            for i in range(0, len(self.out), 4096):
                cols = zip(*self.out[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FOLDED_TYPES)], _FOLDED_NAMES)
            self.out, self.wide = [], 0


def _fold(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(TaskContext.get().partitionId() << 32, table_bytes)
        for b in batches:
            for doc, h, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                fold.put(doc, h, content.as_py())
            yield from fold.take()
        yield from fold.take(last=True)

    return run


def _buckets(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list[bytes], list[list[tuple]]]]:
    """Rows sorted by their first column, a bucket; after it hash, other columns, content. Of each bucket the distinct
    contents, and the other columns of the rows that bring each. One bucket's table is in memory at a time."""
    table, entries, bucket = ContentTable(), [], None
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(columns - 1)]
        for of, h, *rest, content in zip(*cols, b.column(columns - 1)):
            if of != bucket:
                if entries:
                    yield table.contents, entries
                table, entries, bucket = ContentTable(), [], of
            e, new = table.put(h, content.as_py())
            if new:
                entries.append([tuple(rest)])
            else:
                entries[e].append(tuple(rest))
    if entries:
        yield table.contents, entries


def _best_of(rows: list[tuple]) -> tuple:
    """Of (members, best, best_chunk, n, top): the one of the largest top; of equals, the least representative."""
    return min(rows, key=lambda r: (r[4] is None, 0 if r[4] is None else -r[4], r[1]))


_MERGED = "members array<long>, best long, best_chunk int, n long, top long, h long, content binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First round of hot hashes: the entries of one content and salt become one."""
    types = (pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for contents, entries in _buckets(batches, 9):
        for content, rows in zip(contents, entries):
            best = _best_of(rows)
            one = ([m for r in rows for m in r[0]], best[1], best[2], sum(r[3] for r in rows), best[4], rows[0][5], content)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, types)], [x.split()[0] for x in _MERGED.split(", ")])


_MET = "rep long, winner long, winner_chunk int, keep_id long, group_size long, sha string"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket side: what became of each folded row."""
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    for contents, entries in _buckets(batches, 9):
        out = []
        for content, rows in zip(contents, entries):
            best, total, sha = _best_of(rows), sum(r[3] for r in rows), hashlib.sha256(content).hexdigest()
            out += [(m, best[1], best[2], best[4], total, sha) for r in rows for m in r[0]]
        for i in range(0, len(out), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 65_536]), types)], [x.split()[0] for x in _MET.split(", ")])


def _parts(df: DataFrame, buckets: int, total: int) -> int:
    """Shuffle partitions for so many buckets of so many bytes."""
    return max(1, min(buckets, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))))


def _hot(hashes: DataFrame, h: str) -> DataFrame | None:
    """Hashes that very many rows bring, fewer than HOT_SHARE of them; None if there are none."""
    total = hashes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = written(hashes.where((F.col("rows") > HOT_ROWS) & (F.col("rows") * HOT_SHARE > total)).select(h).repartition(1), "hot-hashes")  # fewer than HOT_SHARE
    return hot if hot.limit(1).count() else None


def _bucket(sizes: DataFrame, table_bytes: int, h: str = "h", depth: int = 12) -> tuple[Column, int, int]:
    """The bucket of a row by its hash column, the number of buckets, all bytes; sizes has that hash and bytes of all rows.

    Buckets by hash first; those whose content exceeds the table are partitioned again by other digits of the hash,
    until all fit or hold one hash only (whose content then is in the table once, however many rows bring it). Where
    more than MOST_SPLIT buckets are too large, twice as many buckets are tried from the start.
    """
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n = max(1, -(-total // (table_bytes // 2)))
    while True:
        at, made = F.pmod(F.col(h), F.lit(n)), n
        for level in range(depth):
            over = sizes.groupBy(at.alias("bucket")).agg(F.sum("bytes").alias("in_bucket"), F.min(h).alias("lo"), F.max(h).alias("hi"))
            over = [r[0] for r in over.where((F.col("in_bucket") > table_bytes) & (F.col("lo") != F.col("hi"))).select("bucket").limit(MOST_SPLIT + 1).collect()]
            if not over:
                return at, made, total
            if len(over) > MOST_SPLIT:
                break
            made += len(over) * FANOUT
            at = F.when(at.isin(over), F.xxhash64(at, F.pmod(F.xxhash64(F.col(h), F.lit(level)), F.lit(FANOUT)))).otherwise(at)
        else:
            return at, made, total
        n *= 2


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str | Column = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; of rows that repeat that id, one. A null text counts as empty, a
    null id as smaller than any other; a group of null ids only has a null keep_id and one kept row. Text may be a
    column that normalises first. Any number of equal (or empty) texts passes: their ids go in rows of bounded length.
    An empty table gives an empty result; other columns of df aren't looked at. Bounds the session's Arrow batches.
    """
    bounded_batches(df.sparkSession)
    content = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    rows = df.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(content).alias("h"), content.cast("binary").alias("content"))
    folded = written(rows.mapInArrow(_fold(table_bytes), _FOLDED), "folded")
    entries = folded.where("h is not null")
    bucket, n, total = _bucket(entries.select("h", "bytes"), table_bytes)
    parts = _parts(df, n, total)
    columns = (F.array("rep").alias("members"), F.col("rep").alias("best"), F.col("top_chunk").alias("best_chunk"), "n", "top", "h", "content")
    ready = entries.select(*columns)
    hot = _hot(entries.groupBy("h").agg(F.count("*").alias("rows")), "h")
    if hot is not None:
        salted = entries.join(F.broadcast(hot), "h", "left_semi").withColumn("bucket", F.xxhash64("h", F.pmod(F.xxhash64("rep"), F.lit(SALTS))))
        salted = salted.select("bucket", F.col("h").alias("key"), *columns).repartition(parts, "bucket").sortWithinPartitions("bucket")
        merged = written(salted.mapInArrow(_merge, _MERGED), "merged")
        ready = entries.join(F.broadcast(hot), "h", "left_anti").select(*columns).unionByName(merged)
    met = ready.select(bucket.alias("bucket"), F.col("h").alias("key"), "*").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _MET)
    out = folded.select("rep", "chunk", "ids").join(met, "rep").select("rep", "chunk", "winner", "winner_chunk", "keep_id", "group_size", "sha", F.posexplode("ids").alias("pos", "doc_id"))
    kept = (F.col("rep") == F.col("winner")) & (F.col("chunk") == F.col("winner_chunk")) & (F.col("pos") == 0)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def _better(a, b) -> bool:
    """Whether id a outranks id b: the larger one, any before null."""
    return a is not None and (b is None or a > b)


def _best_rows(rows: pa.Table, doc_id: str, text: str, h: str) -> tuple[pa.Table, np.ndarray]:
    """Of each distinct text the row of the largest id, in order, and how many rows each stands for."""
    table, best, times = ContentTable(), [], []
    ids = rows[doc_id].to_pylist()
    for i, (doc, of, content) in enumerate(zip(ids, rows[h].to_pylist(), rows[text])):
        e, new = table.put(of, content.as_py() or "")
        if new:
            best.append(i)
            times.append(1)
        else:
            times[e] += 1
            if _better(doc, ids[best[e]]):
                best[e] = i
    order = np.argsort(np.array(best, dtype=np.int64), kind="stable")
    return rows.take(pa.array(np.array(best, dtype=np.int64)[order])).combine_chunks(), np.array(times, dtype=np.int64)[order]


def _rows_fold(doc_id: str, text: str, h: str, window_bytes: int):
    """Scan side for whole rows: of each distinct text of a window of rows, the row of the largest id. Texts that occur
    again within a window stay for the next one, up to half its bytes, so that a hot text sends one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0
        for b in batches:
            held.append(b)
            size, rows = size + b.nbytes, rows + b.num_rows
            if size > window_bytes or rows > TABLE_ROWS:
                best, times = _best_rows(pa.Table.from_batches(held), doc_id, text, h)
                often = np.nonzero(times > 1)[0]
                often = np.sort(often[np.argsort(-times[often], kind="stable")][:KEPT])
                stay = best.take(pa.array(often))
                if stay.nbytes > window_bytes // 2:
                    often, stay = often[:0], best.slice(0, 0)
                yield from best.take(pa.array(np.setdiff1d(np.arange(best.num_rows), often))).combine_chunks().to_batches(max_chunksize=4096)
                held = stay.combine_chunks().to_batches()
                size, rows = stay.nbytes, stay.num_rows
        if held:
            yield from _best_rows(pa.Table.from_batches(held), doc_id, text, h)[0].to_batches(max_chunksize=4096)
        held.clear()
        trim()

    return run


def _rows_meet(doc_id: str, text: str, h: str, bucket: str):
    """Bucket side for whole rows, sorted by bucket: one bucket at a time, of each text the row of the largest id."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            of = b.column(bucket).to_numpy(zero_copy_only=False)
            if not len(of):
                continue
            cuts = [0, *(np.nonzero(of[1:] != of[:-1])[0] + 1).tolist(), len(of)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and held[-1].column(bucket)[0].as_py() != of[lo]:
                    yield from _best_rows(pa.Table.from_batches(held), doc_id, text, h)[0].to_batches(max_chunksize=4096)
                    held = []
                held.append(b.slice(lo, hi - lo))
                if len(held) > 64:  # a bucket of many copies: its table holds each text once
                    held = _best_rows(pa.Table.from_batches(held), doc_id, text, h)[0].to_batches()
        if held:
            yield from _best_rows(pa.Table.from_batches(held), doc_id, text, h)[0].to_batches(max_chunksize=4096)
        held.clear()
        trim()

    return run


def drop_exact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of df that exact_dedup() would keep, whole: of equal texts the one of the largest id, once.

    Texts cross the network once, after copies that meet in a scan task are folded; the rows of texts that occur very
    often meet by hash and salt first. A null text counts as empty (the row that stays keeps its own null); repeated rows
    are copies like any other; an empty table gives an empty one; all columns stay as they are, whatever their names.
    Bounds the session's Arrow batches.
    """
    bounded_batches(df.sparkSession)
    h, at = free_name(df, "h"), free_name(df, "bucket")
    rows = df.withColumn(h, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    bucket, n, total = _bucket(rows.select(h, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")), table_bytes, h)
    parts = _parts(df, n, total)

    def met(some: DataFrame, key: Column, parts: int) -> DataFrame:
        some = some.withColumn(at, key)
        return some.repartition(parts, at).sortWithinPartitions(at).mapInArrow(_rows_meet(doc_id, text, h, at), some.schema).drop(at)

    fold = lambda some: some.mapInArrow(_rows_fold(doc_id, text, h, table_bytes), rows.schema)
    hot = _hot(rows.groupBy(h).agg(F.count("*").alias("rows")), h)
    if hot is None:
        folded = fold(rows)
    else:
        often = fold(rows.join(F.broadcast(hot), h, "left_semi").select(rows.columns))
        often = met(often, F.xxhash64(h, F.pmod(F.spark_partition_id(), F.lit(SALTS))), parts)
        folded = fold(rows.join(F.broadcast(hot), h, "left_anti").select(rows.columns)).unionByName(often)
    return met(folded, bucket, parts).drop(h)
