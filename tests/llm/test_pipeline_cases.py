"""Stages of the pipeline on tables with clashing names, nulls, ties and repeats."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

CLASHING = ["__language", "__h", "__bucket", "h", "bucket", "fp", "component_id", "__gone", "mix_epoch", "mix_key", "mix_block", "mix_ppm", "__mix", "__mixed_key", "__source", "__bpe", "bpe", "s", "t", "n"]


@pytest.fixture(scope="module")
def table(spark):
    texts = [None, "", " ", "12 34", "the cat and the dog sat on the mat", "the cat and the dog sat on the mat", "le chat et le chien sont dans la maison", "der Hund und die Katze sind im Haus", "x" * 50_000, "the cat and the dog"]
    rows = [(None if i % 13 == 0 else i % 30, texts[i % len(texts)], ["en", "fr", "de", None][i % 4], ["a", "a", "b", None][i % 4], 1, *([str(i)] * len(CLASHING))) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def test_stages_keep_columns_and_their_values(spark, table, sf_dir):
    import corpus_pipeline as p

    own = Counter(map(tuple, table.collect()))
    for name, stage in p.STAGES[:4]:
        out = stage(spark, table, sf_dir)
        assert out.columns == table.columns and out.schema == table.schema, name
        kept = Counter(map(tuple, out.collect()))
        assert set(kept) <= set(own), name
        if "mixing" not in name:
            assert all(kept[r] <= own[r] for r in kept), name
    encoded = p.encode(spark, table, sf_dir).collect()
    assert Counter((r["doc_id"], r["source"]) for r in encoded) == Counter((r["doc_id"], r["source"]) for r in table.select("doc_id", "source").collect())
    assert all((r["n_tokens"] == 0) == (len(r["ids"]) == 0) for r in encoded)


def test_exact_dedup_keeps_one_row_a_text(spark, table, sf_dir):
    import corpus_pipeline as p

    kept = Counter(r["text"] or "" for r in p.exact_dedup(spark, table, sf_dir).collect())
    assert kept == Counter({r["text"] or "": 1 for r in table.select("text").distinct().collect()})


def test_near_dedup_leaves_rows_without_an_id(spark, table, sf_dir):
    import corpus_pipeline as p

    assert p.near_dedup(spark, table, sf_dir).where("doc_id is null").count() == table.where("doc_id is null").count()


def test_language_id_without_labels_keeps_nothing(spark, table, sf_dir):
    import corpus_pipeline as p

    assert p.language_id(spark, table.withColumn("lang", F.lit(None).cast("string")), sf_dir).count() == 0
    letterless = p.language_id(spark, table, sf_dir).where("text is null or not text rlike '[a-z]'")
    assert letterless.count() == 0
