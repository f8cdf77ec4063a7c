"""Clustering, scaling, classifiers and their evaluation on ML pipelines."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeprint.operators import scoring, trees
from placeprint.sources.shared import written

#: Locations that the driver holds centres of.
MAX_LOCATIONS = 10_000
#: Steps without a fall of a run's inertia after which its centres only follow rounded ties; every other step lowers it.
STALLED_STEPS = 10


def standardised(clips: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """Vectors less the mean over the population deviation, both of train (or clips); no deviation counts as 1."""
    stats = scoring.global_stats(clips if train is None else train, eps=0.0).withColumn("std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))
    at = scoring.with_stats(clips, stats)
    return at.withColumn("vector", F.zip_with("vector", F.arrays_zip("mean", "std"), lambda x, s: (x - s["mean"]) / s["std"])).drop("mean", "std")


def baselines_of(n: int) -> int:
    """Sub-baselines of a location with n clips."""
    return 1 if n < 6 else min(3, n // 6)


def kmeans_by_location(clips: DataFrame, runs: int = 10, steps: int | None = None, seed: int = 42) -> DataFrame:
    """location, sub_id, centroid, size, inertia: the best of several runs of Lloyd's algorithm in every location at once.

    Runs start from the clips of least hash in each location, whatever its size; equal hashes go by clip_id. Each step is
    one pass over all clips, in which Arrow batches put out sums for each location, run and centre; a location of any
    size costs one partial sum a batch. The driver holds the centres only (bounded by MAX_LOCATIONS). Steps go on until
    the centres of every run have settled, which takes more of them the more clips there are; runs that have settled are
    left out of further passes. If steps is given, centres that have not settled after so many raise.
    """
    spark = clips.sparkSession
    counted = clips.groupBy("location").agg(F.count("*").alias("n")).limit(MAX_LOCATIONS + 1).collect()
    if len(counted) > MAX_LOCATIONS:
        raise ValueError(f"more than {MAX_LOCATIONS} locations")
    if not counted:
        return spark.createDataFrame([], "location string, sub_id int, centroid array<double>, size long, inertia double")
    starts = _starts(clips, counted, 3 * runs, seed)
    centres = {}
    for r in counted:
        k, own = baselines_of(r["n"]), starts[r["location"]]
        centres[r["location"]] = np.stack([[own[(i * k + j) % len(own)] for j in range(k)] for i in range(runs)])
    sums = _lloyd_sums(clips, centres)
    lowest = {loc: np.full(runs, np.inf) for loc in centres}
    stalled = {loc: np.zeros(runs, dtype=int) for loc in centres}
    for step in itertools.count(1):
        moving = {}
        for loc, (s, n, i) in sums.items():
            new, inertia = np.where(n[..., None] > 0, s / np.maximum(n, 1)[..., None], centres[loc]), i.sum(axis=1)
            stalled[loc] = np.where(inertia < lowest[loc], 0, stalled[loc] + 1)
            lowest[loc] = np.minimum(lowest[loc], inertia)
            still = ~np.isclose(new, centres[loc], rtol=0, atol=1e-9).all(axis=(1, 2)) & (stalled[loc] < STALLED_STEPS)
            if still.any():
                moving[loc] = still
                centres[loc] = np.where(still[:, None, None], new, centres[loc])
        if not moving:
            break
        if step == steps:
            raise RuntimeError(f"centres haven't settled after {steps} steps")
        for loc, parts in _lloyd_sums(clips, {loc: centres[loc][still] for loc, still in moving.items()}).items():
            for whole, part in zip(sums[loc], parts):
                whole[moving[loc]] = part
    rows = []
    for loc, (_, n, inertia) in sorted(sums.items()):
        run = int(inertia.sum(axis=1).argmin())
        rows += [(loc, j, centres[loc][run, j].tolist(), int(n[run, j]), float(inertia[run, j])) for j in range(n.shape[1])]
    return spark.createDataFrame(rows, "location string, sub_id int, centroid array<double>, size long, inertia double")


def _starts(clips: DataFrame, counted: list, most: int, seed: int) -> dict:
    """The clips of least hash of each location. Every Arrow batch puts out its own first ones, so that a location's rows
    meet only as that many of each batch; eight times as many as are needed are let through before (small locations whole)."""
    share = F.create_map(*[x for r in counted for x in (F.lit(r["location"]), F.lit(min(1.0, 8 * most / r["n"])))])
    d = F.xxhash64(F.lit(seed), "clip_id")
    drawn = clips.where(F.pmod(d, F.lit(1 << 40)) / float(1 << 40) < share[F.col("location")]).select("location", F.pmod(d, F.lit(1 << 40)).alias("d"), "clip_id", "vector")

    def first(batches):
        for b in batches:
            yield b.sort_values(["location", "d", "clip_id"]).groupby("location", sort=False).head(most)

    schema = drawn.schema
    place = Window.partitionBy("location").orderBy("d", "clip_id")
    rows = drawn.mapInPandas(first, schema).withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).orderBy("location", "place").collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r["location"], []).append(np.array(r["vector"]))
    return out


def _lloyd_sums(clips: DataFrame, centres: dict) -> dict:
    """For each location of the centres: sums of vectors, counts and inertia by (run, centre)."""
    shared = clips.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        total: dict = {}
        for b in batches:
            for loc, rows in b.groupby("location", sort=False):
                if loc not in shared.value:
                    continue
                x, c = np.stack(rows["vector"].to_list()), shared.value[loc]
                d = (x**2).sum(1)[:, None, None] - 2 * (x @ c.reshape(-1, c.shape[2]).T).reshape(len(x), *c.shape[:2]) + (c**2).sum(-1)
                own = d.argmin(axis=2)
                one = np.eye(c.shape[1])[own]
                s, n, i = (one.reshape(len(x), -1).T @ x).reshape(c.shape), one.sum(axis=0), (one * np.maximum(d, 0)).sum(axis=0)
                if loc in total:
                    s, n, i = s + total[loc][0], n + total[loc][1], i + total[loc][2]
                total[loc] = s, n, i
        flat = [np.concatenate([s, n[..., None], i[..., None]], axis=2).ravel() for s, n, i in total.values()]
        yield pd.DataFrame({"location": list(total), "v": flat}, dtype=object)

    parts = clips.select("location", "vector").mapInPandas(run, "location string, v array<double>")
    rows = parts.select("location", F.posexplode("v").alias("pos", "x")).groupBy("location", "pos").agg(F.sum("x").alias("x")).toArrow()
    flat = {loc: np.zeros((*c.shape[:2], c.shape[2] + 2)) for loc, c in centres.items()}
    for loc, own in rows.to_pandas().groupby("location", sort=False):
        flat[loc].flat[own["pos"].to_numpy()] = own["x"].to_numpy()
    shared.destroy()
    return {loc: (f[..., :-2], f[..., -2], f[..., -1]) for loc, f in flat.items()}


#: Names of two and three clusters by rising noise floor.
CLUSTER_NAMES = {2: ("quiet", "noisy"), 3: ("quiet", "moderate", "noisy")}


def cluster_and_label(clips: DataFrame, k: int = 3, level: int = 0, seed: int = 42) -> DataFrame:
    """clips with cluster_id, label and distance_to_centroid: KMeans on standardised vectors, clusters named in the order of
    their mean of the unscaled entry ``level`` (the noise floor)."""
    if k not in CLUSTER_NAMES:
        raise ValueError("k is 2 or 3")
    if clips.limit(k).count() < k:
        raise ValueError("fewer rows than clusters")
    scaled = standardised(clips.withColumn("level", F.col("vector")[level])).withColumn("features", array_to_vector("vector"))
    model = KMeans(k=k, seed=seed, maxIter=50, initSteps=5).fit(scaled)
    out = model.transform(scaled).withColumnRenamed("prediction", "cluster_id")
    names = out.groupBy("cluster_id").agg(F.avg("level").alias("m"))  # k rows
    names = names.withColumn("label", F.element_at(F.array(*[F.lit(n) for n in CLUSTER_NAMES[k]]), F.row_number().over(Window.orderBy("m", "cluster_id")))).drop("m")
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    diff = F.zip_with("vector", F.element_at(centres, F.col("cluster_id") + 1), lambda a, b: (a - b) * (a - b))
    out = out.withColumn("distance_to_centroid", F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)))
    return out.join(F.broadcast(names), "cluster_id").drop("features")


def typical_rows(clustered: DataFrame, key: str = "clip_id") -> DataFrame:
    """The row nearest to its centre for each label; ties: the smallest key."""
    return clustered.groupBy("label").agg(F.min(F.struct("distance_to_centroid", key)).alias("m")).select("label", "m.*")


def cluster_summary(clustered: DataFrame, features: tuple[str, ...] = ()) -> DataFrame:
    """label, n, mean_level, mean_distance, and the mean of each of the features (mean_<name>)."""
    means = [F.avg(f).alias(f"mean_{f}") for f in features]
    return clustered.groupBy("label").agg(F.count("*").alias("n"), F.avg("level").alias("mean_level"), F.avg("distance_to_centroid").alias("mean_distance"), *means)


def silhouettes(clips: DataFrame, queries: DataFrame, label: str = "location", block_rows: int = 5_000) -> DataFrame:
    """clip_id, silhouette (Euclidean) of the query clips against all clips.

    Queries come in blocks of a fixed size; all clips pass each block once as matrices, which put out sums of distances by
    query and label. A cluster of one has silhouette 0.
    """
    spark, n = clips.sparkSession, queries.count()
    blocks = max(1, -(-n // block_rows))
    out = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("clip_id"), F.lit(blocks)) == block).select("clip_id", "vector").toPandas()
        if own.empty:
            continue
        shared = spark.sparkContext.broadcast((own["clip_id"].to_numpy(), np.stack(own["vector"].map(np.asarray)).astype(np.float64)))

        def run(batches, shared=shared):
            ids, q = shared.value
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["vector"].map(np.asarray)).astype(np.float64)
                step = max(1, 4_000_000 // max(q.size, 1))  # differences of so many clips fit 32 MB
                d = np.concatenate([np.sqrt(((q[:, None, :] - x[None, i : i + step]) ** 2).sum(-1)) for i in range(0, len(x), step)], axis=1)
                for name, at in b.reset_index(drop=True).groupby(label).groups.items():
                    yield pd.DataFrame({"clip_id": ids, label: name, "d": d[:, at].sum(axis=1), "n": len(at)})

        part = clips.select("clip_id", label, "vector").mapInPandas(run, f"clip_id long, {label} string, d double, n long")
        out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.createDataFrame([], "clip_id long, silhouette double")
    sums = out.groupBy("clip_id", F.col(label).alias("other")).agg(F.sum("d").alias("d"), F.sum("n").alias("n")).join(
        queries.select("clip_id", F.col(label).alias("own")), "clip_id",
    )
    a = F.max(F.when(F.col("own") == F.col("other"), F.try_divide(F.col("d"), F.col("n") - 1)))
    b = F.min(F.when(F.col("own") != F.col("other"), F.col("d") / F.col("n")))
    return sums.groupBy("clip_id").agg(a.alias("a"), b.alias("b")).select(
        "clip_id", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"),
    )


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with weight: n over the number of classes times the class's own n."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    return rows.join(counts.crossJoin(F.broadcast(total)), label).withColumn("weight", F.col("__n") / (F.col("__k") * F.col("__c"))).drop("__c", "__n", "__k")


def prepared(clips: DataFrame, label: str = "location") -> DataFrame:
    """clips with features (ML vector) and label (codes in alphabetical order)."""
    rows = clips.withColumn("features", array_to_vector("vector"))
    return StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(rows).transform(rows)


def fourier_features(rows: DataFrame, dims: int = 512, gamma: float | None = None, seed: int = 42) -> DataFrame:
    """rows(vector) with features (ML vector): random Fourier features, whose dot products come near the kernel
    exp(-gamma |x - y|^2). A linear machine on them is a kernel machine with a plan of one pass. gamma: 1 / length by default."""

    @F.pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        v = np.stack([np.asarray(r, dtype=np.float64) for r in x])
        rng, width = np.random.default_rng(seed), gamma or 1 / v.shape[1]
        w, shift = rng.normal(0, np.sqrt(2 * width), (v.shape[1], dims)), rng.uniform(0, 2 * np.pi, dims)
        return pd.Series(list(np.sqrt(2 / dims) * np.cos(v @ w + shift)))

    return rows.withColumn("features", array_to_vector(mapped("vector")))


def classifier(kind: str, n: int = 1000, seed: int = 42):
    """An estimator by name: logistic and tree as the environment model has them, the rest of the comparison's learners
    (kernel: the linear machine, for rows with fourier_features())."""
    return {
        "logistic": lambda: LogisticRegression(maxIter=1000, regParam=1 / max(n, 1), standardization=False, weightCol="weight"),
        "tree": lambda: DecisionTreeClassifier(maxDepth=4, weightCol="weight", seed=seed),
        "forest": lambda: RandomForestClassifier(numTrees=100, seed=seed),
        "boosted": lambda: OneVsRest(classifier=GBTClassifier(maxIter=10, seed=seed)),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=50)),
        "kernel": lambda: OneVsRest(classifier=LinearSVC(maxIter=50)),
    }[kind]()


def train(rows: DataFrame, kind: str, seed: int = 42):
    """A fitted pipeline on balanced rows(features, label)."""
    return Pipeline(stages=[classifier(kind, rows.count(), seed)]).fit(balanced(rows))


def predicted(model, rows: DataFrame) -> DataFrame:
    """rows with prediction, and confidence (the largest probability) where the model has probabilities."""
    out = model.transform(rows)
    return out.withColumn("confidence", F.array_max(vector_to_array("probability"))) if "probability" in out.columns else out


def with_probabilities(model, rows: DataFrame, labels: list[str]) -> DataFrame:
    """rows with predicted (a label) and probabilities (label to probability); labels in the order of their codes."""
    names = F.array(*[F.lit(x) for x in labels])
    out = model.transform(rows).withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1))
    return out.withColumn("probabilities", F.map_from_arrays(names, vector_to_array("probability")))


def leaderboard(train_rows: DataFrame, test_rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """model, accuracy, weighted_f1, best first. Predictions are written once and evaluated from there."""
    rows = []
    for kind in kinds:
        own, other = (fourier_features(r) if kind == "kernel" else r for r in (train_rows, test_rows))
        out = trees.predicted(trees.fit(own), other) if kind == "extra_trees" else predicted(train(own, kind), other)
        out = written(out.select("label", "prediction"), "predictions")
        rows.append((kind, *[float(MulticlassClassificationEvaluator(metricName=m).evaluate(out)) for m in ("accuracy", "f1")]))
    return train_rows.sparkSession.createDataFrame(rows, "model string, accuracy double, weighted_f1 double").orderBy(F.desc("accuracy"), "model")


def importances(model, top: int = 20) -> DataFrame:
    """pos, importance of a fitted forest or tree, largest first."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray()
    return SparkSession.active().createDataFrame([(i, float(x)) for i, x in enumerate(values)], "pos int, importance double").orderBy(F.desc("importance"), "pos").limit(top)


def principal(clips: DataFrame, k: int = 2) -> DataFrame:
    """clips with pc, k coordinates of the standardised vectors; signs are arbitrary."""
    rows = standardised(clips).withColumn("features", array_to_vector("vector"))
    return PCA(k=k, inputCol="features", outputCol="__pc").fit(rows).transform(rows).withColumn("pc", vector_to_array("__pc")).drop("__pc", "features")


def cross_validated(rows: DataFrame, folds: int = 5, depths: tuple[int, ...] = (4, 8), sizes: tuple[int, ...] = (20,), seed: int = 42) -> DataFrame:
    """max_depth, num_trees, accuracy of a grid of forests."""
    forest = RandomForestClassifier(seed=seed)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).addGrid(forest.numTrees, list(sizes)).build()
    cv = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, seed=seed, parallelism=4).fit(rows)
    out = [(int(p[forest.maxDepth]), int(p[forest.numTrees]), float(m)) for p, m in zip(grid, cv.avgMetrics)]
    return rows.sparkSession.createDataFrame(out, "max_depth int, num_trees int, accuracy double")


def learning_curve(train_rows: DataFrame, test_rows: DataFrame, kind: str = "forest", shares: tuple[float, ...] = (0.25, 0.5, 1.0), key: str = "clip_id") -> DataFrame:
    """share, accuracy of models trained on growing shares of the rows (each includes the smaller ones)."""
    d = F.pmod(F.xxhash64(F.lit("curve"), key), F.lit(1 << 20)) / float(1 << 20)
    rows = []
    for s in shares:
        out = predicted(train(train_rows.where(d < s), kind), test_rows)
        rows.append((float(s), float(MulticlassClassificationEvaluator(metricName="accuracy").evaluate(out))))
    return train_rows.sparkSession.createDataFrame(rows, "share double, accuracy double")
