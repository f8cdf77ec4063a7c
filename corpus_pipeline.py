"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All but the last return the columns of documents, whatever other columns there are and how they are named.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeprint.llm import bpe, grace_dedup, langid, mixing, simhash
from placeprint.llm.common import free_name, written

#: A document stays if its language is known with at least this score.
LEAST_SCORE = 0.4
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learned from their own labels outside fold 2 of 4.

    Null texts and texts without a letter go, as do those that fit no learned language better than others (and all, if
    no row has a language). Rows that repeat are judged alike; a null id is never held out; an empty table gives an empty
    one.
    """
    name = free_name(docs, "language")
    model = langid.fit(langid.training_rows(docs))
    out = langid.identify(docs, model, name=name)
    return out.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_SCORE)).drop(name)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id.

    A null text equals an empty one; null ids come after all others; of rows that repeat text and id one stays, any of
    them. An empty table gives an empty one.
    """
    return grace_dedup.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id.

    Groups are what links of at most 2 of 64 bits connect among SimHashes of 3-word shingles. Null and empty texts are
    near copies of each other. Rows without an id stay; rows that share an id stay or go together. An empty table gives
    an empty one.
    """
    return simhash.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents as often as their source's budget takes them.

    A null source is one of its own; a source without any word is passed once; null texts have no words. Rows that share
    source and id are taken as often as one another. An empty table gives an empty one.
    """
    return mixing.mix(docs, prefix=free_name(docs, "mixed")).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix as token ids (little-endian unsigned 32-bit), with the digest of the decoded bytes.

    Null and empty texts have no tokens; rows that repeat repeat their ids; an empty table gives an empty one. Of other
    columns only the id and the source go along.
    """
    out = bpe.bpe_encode(docs.select("doc_id", "source", "text"), RANKS, public_tokenizers.PATTERN, name="__bpe", carry=["doc_id", "source"])
    return out.select("doc_id", "source", "__bpe.n_tokens", "__bpe.ids", "__bpe.ids_sha256", "__bpe.decoded_sha256")


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can't express language ID, SimHash or BPE; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents table, each reading what the one before it has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs
