"""Queries of clustering and classification over feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeprint.operators import learning, sets
from placeprint.plans.registry import register
from placeprint.plans.scoring import LONG
from placeprint.sources import sinks, tables
from placeprint.sources.shared import new_path, written


def _clips(spark, sf_dir):
    return tables.feature_vectors(spark, sf_dir)


def _split(spark, sf_dir):
    at = sets.holdout(_clips(spark, sf_dir), "location", "clip_id")
    scaled = learning.standardised(at, at.where("not held_out"))
    rows = written(learning.prepared(scaled), "split-rows")
    return rows.where("not held_out"), rows.where("held_out")


@register(
    "standard_scaler",
    f"WITH {LONG}, s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM long GROUP BY pos) SELECT clip_id, pos, round((x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) "
    "AS z FROM long JOIN s USING (pos)",
)
def standard_scaler(spark, sf_dir):
    return learning.standardised(_clips(spark, sf_dir)).select("clip_id", F.posexplode("vector").alias("pos", "x")).select("clip_id", "pos", F.round("x", 6).alias("z"))


@register("kmeans_baselines")
def kmeans_baselines(spark, sf_dir):
    """Up to three sub-baselines of each location."""
    return learning.kmeans_by_location(_clips(spark, sf_dir)).select("location", "sub_id", "size", F.round("inertia", 6).alias("inertia"), "centroid")


@register("cluster_label")
def cluster_label(spark, sf_dir):
    return learning.cluster_and_label(_clips(spark, sf_dir)).select("clip_id", "cluster_id", "label", "distance_to_centroid")


@register("cluster_summary")
def cluster_summary(spark, sf_dir):
    return learning.cluster_summary(learning.cluster_and_label(_clips(spark, sf_dir)))


@register("typical_row")
def typical_row(spark, sf_dir):
    return learning.typical_rows(learning.cluster_and_label(_clips(spark, sf_dir)))


@register(
    "silhouette",
    """WITH fv AS (SELECT vec_id AS clip_id, 'loc_' || label AS location, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.clip_id, q.location AS own, f.location AS other, sum(list_distance(q.v, f.v)) AS d, count(*) AS n FROM fv q, fv f WHERE q.clip_id % 100 = 0 GROUP BY ALL),
s AS (SELECT clip_id, max(d / nullif(n - 1, 0)) FILTER (WHERE own = other) AS a, min(d / n) FILTER (WHERE own <> other) AS b FROM d GROUP BY clip_id)
SELECT clip_id, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM s""",
)
def silhouette(spark, sf_dir):
    """Silhouettes under the location labels of the query clips (ids divisible by 100: the stated query set) against all."""
    clips = _clips(spark, sf_dir)
    return learning.silhouettes(clips, clips.where("clip_id % 100 = 0")).withColumn("silhouette", F.round("silhouette", 6))


@register("train_env_logreg")
def train_env_logreg(spark, sf_dir):
    """Held-out predictions of the balanced logistic regression."""
    train, test = _split(spark, sf_dir)
    return learning.predicted(learning.train(train, "logistic"), test).select("clip_id", "label", "prediction", "confidence")


@register("train_env_tree")
def train_env_tree(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return learning.predicted(learning.train(train, "tree"), test).select("clip_id", "label", "prediction", "confidence")


@register("model_bundle")
def model_bundle(spark, sf_dir):
    """A model saved, loaded and applied."""
    train, test = _split(spark, sf_dir)
    path = new_path(spark, "model")
    sinks.save_model(learning.train(train, "tree"), path)
    return learning.predicted(sinks.load_model(spark, path), test).select("clip_id", "prediction", "confidence")


@register("pca")
def pca(spark, sf_dir):
    return learning.principal(_clips(spark, sf_dir)).select("clip_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


@register("cross_validation")
def cross_validation(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return learning.cross_validated(train, folds=5)


@register("learning_curve")
def learning_curve(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return learning.learning_curve(train, test, "tree")


@register("importance_top20")
def importance_top20(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return learning.importances(learning.train(train, "forest"))


@register("leaderboard")
def leaderboard(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return learning.leaderboard(train, test, ("logistic", "tree", "forest"))


@register("leaderboard_machines")
def leaderboard_machines(spark, sf_dir):
    """The linear and the kernel machine, boosted trees and extremely randomised trees, on clips of the first two locations."""
    train, test = _split(spark, sf_dir)
    return learning.leaderboard(train.where("label < 2"), test.where("label < 2"), ("svm", "kernel", "boosted", "extra_trees"))
