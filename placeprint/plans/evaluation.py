"""Queries of several baselines a location, single-precision hashes, class means, summaries of labelled clips, and ledgers
that have something to say."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeprint.functions import classify, vectors
from placeprint.operators import diagnostics, joins, learning, scoring, sets
from placeprint.plans.registry import register
from placeprint.plans.scoring import BEST, COS, DRIFT, LONG, SCORES, SOFT, W
from placeprint.sources import tables


def _clips(spark, sf_dir):
    return tables.feature_vectors(spark, sf_dir)


def _three(spark, sf_dir):
    """Three baselines a location: the means of its clips by their id modulo three."""
    clips = _clips(spark, sf_dir).withColumn("part", F.concat_ws("/", "location", (F.col("clip_id") % 3).cast("string")))
    return scoring.mean_vectors(clips, "part").select(F.substring_index("part", "/", 1).alias("location"), "vector")


_THREE = f"""WITH {LONG}, base AS (SELECT location AS base_location, g, list(m ORDER BY pos) AS centroid FROM (SELECT location, clip_id % 3 AS g, pos, avg(x) AS m FROM long GROUP BY ALL) GROUP BY ALL)
SELECT clip_id, base_location, round(max({COS.format(a='vector', b='centroid')}), 6) AS score FROM fv, base GROUP BY ALL"""


@register("score_three_baselines", _THREE)
def score_three_baselines(spark, sf_dir):
    """Every clip's best cosine with any of the three baselines of each location."""
    return scoring.score(_clips(spark, sf_dir), _three(spark, sf_dir), "clip_id").withColumn("score", F.round("score", 6))


@register("score_several_matrices", _THREE)
def score_several_matrices(spark, sf_dir):
    """The same where the baselines don't fit one matrix: dealt by hash into several, so that a location's are apart."""
    return scoring.score(_clips(spark, sf_dir), _three(spark, sf_dir), "clip_id", matrix_numbers=500).withColumn("score", F.round("score", 6))


@register(
    "quantize_hash_single",
    f"""WITH {LONG}, stats AS (SELECT pos, avg(x)::FLOAT AS mean, (stddev_pop(x) + 1e-8)::FLOAT AS std FROM long GROUP BY pos),
z AS (SELECT clip_id, location, pos, greatest((-3)::FLOAT, least(3::FLOAT, ((x::FLOAT - mean)::FLOAT / std)::FLOAT)) AS z FROM long JOIN stats USING (pos)),
q AS (SELECT clip_id, location, pos, round_even((((z + 3::FLOAT)::FLOAT / 6::FLOAT)::FLOAT * 255::FLOAT)::FLOAT, 0)::INT AS q FROM z)
SELECT clip_id, sum(q)::BIGINT AS level_sum, sha256(unhex(string_agg(printf('%02X', q), '' ORDER BY pos)) || encode('device_' || location || '_001') || encode('19723')) AS location_hash FROM q GROUP BY clip_id, location""",
)
def quantize_hash_single(spark, sf_dir):
    """Hashes of vectors quantised in single precision, as they are by default."""
    clips = _clips(spark, sf_dir)
    z = vectors.zscore_single(F.col("vector"), F.col("mean"), F.col("std"))
    q = scoring.with_stats(clips, scoring.global_stats(clips)).withColumn("q", vectors.quantise(z))
    level_sum = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
    return q.select("clip_id", level_sum.alias("level_sum"), vectors.location_hash(F.col("q"), vectors.device_id(F.col("location")), F.lit("19723")).alias("location_hash"))


@register("class_probability_means", f"WITH {SOFT} SELECT clip_id // 10 AS file, base_location AS class, round_even(avg(p), 3) AS probability FROM soft GROUP BY ALL")
def class_probability_means(spark, sf_dir):
    """Mean probability of each class over a file's windows, to three places."""
    clips = _clips(spark, sf_dir)
    soft = diagnostics.soft_max(scoring.score(clips, scoring.mean_vectors(clips), "clip_id", "location"))
    out = soft.groupBy(F.floor(F.col("clip_id") / 10).alias("file"), F.col("base_location").alias("class"))
    return out.agg(F.bround(F.avg("p"), 3).alias("probability"))


_NINE = tuple(f"f{i}" for i in range(9))


def _labelled(spark, sf_dir):
    """Clips with their location as label and the Euclidean distance to its mean vector; nine features and the level."""
    clips = _clips(spark, sf_dir)
    mean = scoring.mean_vectors(clips).withColumnRenamed("vector", "mean")  # one row a location
    diff = F.zip_with("vector", "mean", lambda a, b: (a - b) * (a - b))
    at = clips.join(F.broadcast(mean), "location").withColumn("distance_to_centroid", F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)))
    return at.select(
        "clip_id", F.col("location").alias("label"), F.col("vector")[0].alias("level"), "distance_to_centroid",
        *[F.col("vector")[i].alias(n) for i, n in enumerate(_NINE)],
    )


_LABELLED = f"""{LONG}, mean AS (SELECT location, list(m ORDER BY pos) AS mean FROM (SELECT location, pos, avg(x) AS m FROM long GROUP BY ALL) GROUP BY ALL),
labelled AS (SELECT clip_id, location AS label, vector, list_distance(vector, mean) AS d FROM fv JOIN mean USING (location))"""


@register(
    "label_summary",
    f"WITH {_LABELLED} SELECT label, count(*) AS n, round(avg(vector[1]), 6) AS mean_level, round(avg(d), 6) AS mean_distance, "
    + ", ".join(f"round(avg(vector[{i + 1}]), 6) AS mean_{n}" for i, n in enumerate(_NINE))
    + " FROM labelled GROUP BY label",
)
def label_summary(spark, sf_dir):
    """Rows, mean distance and the means of nine features of each label."""
    out = learning.cluster_summary(_labelled(spark, sf_dir), _NINE)
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@register(
    "typical_clip",
    f"WITH {_LABELLED} SELECT label, round(d, 6) AS distance, clip_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, clip_id) AS rn "
    "FROM labelled) WHERE rn = 1",
)
def typical_clip(spark, sf_dir):
    """The clip nearest to its label's centre."""
    return learning.typical_rows(_labelled(spark, sf_dir)).select("label", F.round("distance_to_centroid", 6).alias("distance"), "clip_id")


@register(
    "score_percentiles",
    f"WITH {SCORES} SELECT * FROM (" + " UNION ALL ".join(f"SELECT {p} AS percent, round(quantile_cont(score, {p / 100}), 6) AS score FROM scores" for p in (0, 1, 37, 50, 99, 100)) + ")",
)
def score_percentiles(spark, sf_dir):
    """Exact percentiles of all scores, found by ranges of values."""
    clips = _clips(spark, sf_dir)
    shares = (0, 1, 37, 50, 99, 100)
    found = joins.percentiles(scoring.score(clips, scoring.mean_vectors(clips), "clip_id"), "score", [p / 100 for p in shares])
    return spark.createDataFrame(list(zip(shares, found)), "percent int, score double").withColumn("score", F.round("score", 6))


@register("unlabelled_documents", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf_dir):
    """Documents (files) that the labels (the ledger) don't name."""
    return sets.unseen(tables.table(spark, sf_dir, "documents").select("doc_id", "source"), tables.table(spark, sf_dir, "labels"), "doc_id")


@register("unlabelled_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unlabelled_difference(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id").subtract(tables.table(spark, sf_dir, "labels").select("doc_id"))


@register(
    "locations_without_baseline",
    """SELECT n_name AS location, count(*) AS files, 'no baseline for ' || n_name AS warning FROM nation JOIN customer ON c_nationkey = n_nationkey
WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) GROUP BY n_name""",
)
def locations_without_baseline(spark, sf_dir):
    """Customers (files) of nations (locations) without a supplier of a large balance (baseline), with the warning."""
    nations = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("location"), "n_nationkey")
    files = tables.table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("location")
    known = tables.table(spark, sf_dir, "supplier").where("s_acctbal > 8000").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("location").distinct()
    return sets.without_baseline(files, known).groupBy("location", "warning").agg(F.count("*").alias("files"))


_ACTIONS = " ".join(f"WHEN '{status}' THEN '{action}'" for status, action in classify.ACTIONS.items())


@register(
    "drift_actions",
    f"WITH {BEST}, s AS (SELECT clip_id, {DRIFT.format(s='best_score', a=W.stable, b=W.moderate)} AS status FROM best) SELECT clip_id, status, CASE status {_ACTIONS} END "
    "AS action FROM s",
)
def drift_actions(spark, sf_dir):
    """What to do about every clip's class."""
    clips = _clips(spark, sf_dir)
    best = scoring.best(scoring.score(clips, scoring.mean_vectors(clips), "clip_id"), "clip_id")
    status = classify.drift_class(F.col("best_score"), W.stable, W.moderate)
    return best.select("clip_id", status.alias("status")).withColumn("action", classify.drift_action(F.col("status")))


@register(
    "ema_vectors",
    f"WITH {LONG}, mean AS (SELECT location, pos, avg(x) AS m FROM long GROUP BY ALL) SELECT clip_id, pos, round(0.95 * m + 0.05 * x, 6) AS x "
    "FROM long JOIN mean USING (location, pos)",
)
def ema_vectors(spark, sf_dir):
    """Each location's mean vector moved by one clip of its own, as a moved baseline for every clip."""
    clips = _clips(spark, sf_dir)
    mean = scoring.mean_vectors(clips).withColumnRenamed("vector", "mean")  # one row a location
    moved = clips.join(F.broadcast(mean), "location").withColumn("vector", vectors.ema(F.col("mean"), F.col("vector")))
    return scoring.long_form(moved, "clip_id").select("clip_id", "pos", F.round("x", 6).alias("x"))
