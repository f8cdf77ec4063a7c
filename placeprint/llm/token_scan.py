"""Token counts of flat unindexed token files by a separator scan.

A file is a run of little-endian unsigned 16-bit ids without header or index; an end-of-document id closes each document.
Blocks of a file are searched for that id as whole arrays; a document that runs over block ends is stitched together by
a prefix scan over what the blocks before it left open. Files of moderate size are read as one value each; larger ones
in byte ranges, blocks of which run in different tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeprint.llm.common import bounded_batches, new_path, written

#: Ends a document; never the id of a word.
EOD = 0
#: Tokens in one block.
BLOCK = 1 << 20
#: Bytes of tokens in one file, on average.
FILE_BYTES = 64 << 20
#: Files up to this size are read as one value, larger ones in ranges of RANGE_BYTES.
WHOLE_BYTES = 256 << 20
RANGE_BYTES = 64 << 20


def word_ids(text: str | None) -> bytes:
    """Ids 1 to 65535 of a text's words, by CRC-32 of their UTF-8 bytes; words as everywhere here."""
    crc = zlib.crc32
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return (np.fromiter(map(crc, words), dtype=np.uint32, count=len(words)) % 65535 + 1).astype("<u2").tobytes()


def encode_words(text: str | Column = "text") -> Column:
    """A column of a text's ids as bytes, without the closing id."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([word_ids(t) for t in texts], dtype=object)

    return ids(F.col(text) if isinstance(text, str) else text)


def write_flat(df: DataFrame, path: str, ids: str, rows_a_file: int) -> None:
    """Write the rows of each partition in their order to flat files of so many rows: part-<partition>-...-c<number>.

    Spark's text writer puts out the bytes of each row as they are and the two bytes of EOD after it, on any file system
    that Spark can write. Nothing is shuffled.
    """
    out = df.select(F.col(ids).cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("maxRecordsPerFile", rows_a_file)
    out.option("lineSep", EOD.to_bytes(2, "little").decode("latin-1")).text(path)


_BLOCKS = "path string, block long, piece long, n long, sizes array<long>, open long, closes boolean"


def _block_scan(block: int, eod: int):
    """For each block of a file (path, number of the first block, bytes): its closed documents, and how many tokens its
    end leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = content.as_buffer()
                if raw.size % 2:
                    raise ValueError(f"{path} isn't a file of 16-bit ids: its length is odd")
                ids = np.frombuffer(raw, dtype="<u2")
                for k, i in enumerate(range(0, len(ids), block)):
                    part = ids[i : i + block]
                    at = np.flatnonzero(part == eod)
                    n = len(at)
                    sizes = np.diff(at, prepend=-1) - 1
                    for j in range(0, max(n, 1), 8192):
                        last = j + 8192 >= n
                        some = sizes[j : j + 8192]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([path]), pa.array([first + k]), pa.array([j]), pa.array([len(some)]), pa.array([some.tolist()], pa.list_(pa.int64())),
                            pa.array([(len(part) - 1 - at[-1] if n else len(part)) if last else 0]), pa.array([n > 0]),
                        ], ["path", "block", "piece", "n", "sizes", "open", "closes"])

    return run


def record_bytes(length: int, most: int) -> int:
    """The largest even number up to ``most`` that divides a file's length: the length of its blocks, as Spark's reader of
    fixed-length records takes no shorter last one."""
    half, best = length // 2, 1
    for d in range(1, int(half**0.5) + 1):
        if half % d == 0:
            best = max([best, *(x for x in (d, half // d) if 2 * x <= most)])
    return 2 * best


def _ranges(spark: SparkSession, path: str, length: int, block: int) -> DataFrame:
    """(path, block, content) of a file read in byte ranges by many tasks."""
    if length % 2:
        raise ValueError(f"{path} isn't a file of 16-bit ids: its length is odd")
    size = record_bytes(length, 2 * block)
    conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(size), "mapreduce.input.fileinputformat.split.maxsize": str(max(size, RANGE_BYTES))}
    kinds = ("org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable")
    records = spark.sparkContext.newAPIHadoopFile(path, *kinds, conf=conf)
    return spark.createDataFrame(records.map(lambda r: (path, r[0], bytes(r[1]))), "path string, block long, content binary")


def scan_flat(spark: SparkSession, path: str, block: int = BLOCK, eod: int = EOD) -> DataFrame:
    """(path, doc, n_tokens, ended) of every document in the flat files below path, doc counting from 0 in each file.

    The closing id counts for none. Tokens after the last one are a document that hasn't ended; a file that is empty or
    ends in the closing id has none such. Two closing ids in a row enclose an empty document. A file of an odd length
    raises. Files up to WHOLE_BYTES are one value each, as many as there are; each larger one is read in ranges of blocks
    whose length divides the file's (down to single ids, slowly, where its length has no other divisor). The prefix scan
    runs by file over its blocks only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = files.where(F.col("length") <= WHOLE_BYTES).select("path", F.lit(0).cast("long").alias("block"), "content")
    for r in files.where(F.col("length") > WHOLE_BYTES).select("path", "length").collect():
        parts = parts.unionAll(_ranges(spark, r["path"], r["length"], block))
    blocks = parts.mapInArrow(_block_scan(block, eod), _BLOCKS)
    before = Window.partitionBy("path").orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, -1)
    run = blocks.withColumn("first_doc", F.coalesce(F.sum("n").over(before), F.lit(0)))
    run = run.withColumn("opened", F.coalesce(F.sum("open").over(before), F.lit(0)))
    # What is open before a block: all that was left open so far, less what was at the last block that closed a document.
    run = run.withColumn("settled", F.coalesce(F.last(F.when(F.col("n") > 0, F.col("opened")), ignorenulls=True).over(before), F.lit(0)))
    run = run.withColumn("carry", F.col("opened") - F.col("settled"))
    # A document that goes on after the last block of its file has its tokens as one more size there.
    after = Window.partitionBy("path").orderBy("block", "piece")
    tail = F.when(F.col("n") > 0, F.col("open")).otherwise(F.col("carry") + F.col("open"))
    run = run.withColumn("tail", F.when(F.lead("n").over(after).isNull() & (tail > 0), tail))
    docs = run.select("path", "first_doc", "carry", "n", "tail", F.posexplode(F.concat("sizes", F.when(F.col("tail").isNotNull(), F.array("tail")).otherwise(F.array().cast("array<long>")))).alias("pos", "size"))
    ended = F.col("pos") < F.col("n")
    return docs.select("path", (F.col("first_doc") + F.col("pos")).alias("doc"), F.when(ended & (F.col("pos") == 0), F.col("size") + F.col("carry")).otherwise(F.col("size")).alias("n_tokens"), ended.alias("ended"))


def count_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bytes_a_file: int = FILE_BYTES, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of every row, by way of flat files: written to the shared folder, scanned, matched by position.

    Ids are written once as a table; each partition of that table becomes flat files in its order, so a file's k-th
    document is known by partition and position, whatever the ids: null, repeated or very frequent ones are like any
    other. Null and empty texts are empty documents. A document that the scan lost, or one too many, raises. An empty
    table gives an empty one; other columns of df aren't looked at. Bounds the session's Arrow batches.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    own = written(df.select(F.col(doc_id).cast("long").alias("doc_id"), encode_words(text).alias("ids")), "token-ids")
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ids") + 2), F.lit(0))).first()
    rows_a_file = max(1, n * bytes_a_file // max(size, 1))
    path = new_path(spark, "tokens")
    write_flat(own, path, "ids", rows_a_file)
    found = scan_flat(spark, path, block).select(
        F.regexp_extract("path", r"/part-([0-9]+)-[^/]*-c([0-9]+)[^/]*$", 1).cast("long").alias("part"),
        (F.regexp_extract("path", r"/part-([0-9]+)-[^/]*-c([0-9]+)[^/]*$", 2).cast("long") * rows_a_file + F.col("doc")).alias("at"), "n_tokens",
    )
    # The same table scanned again has the same partitions; an id counts rows from 0 below its 33rd bit.
    index = own.select("doc_id", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), F.lit(True).alias("there"))
    lost = F.raise_error(F.lit("the scan of the token files doesn't give back the documents that were written")).cast("long")
    out = index.join(found, ["part", "at"], "full")
    return out.select("doc_id", F.when(F.col("there") & F.col("n_tokens").isNotNull(), F.col("n_tokens")).otherwise(lost).alias("n_tokens"))
