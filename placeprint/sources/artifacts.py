"""JSON and CSV artifacts of earlier runs as tables; a missing file is an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of the artifacts.
LEDGER = "location string"
PROVENANCE = "location string, source_files array<string>, merged boolean"
PREDICTION = (
    "num_windows int, avg_scores map<string,double>, vote_counts map<string,int>, final_match string, final_score double, status string, location_verdict string, "
    "verdict_message string, margin double, confidence string, acoustic_hashes array<string>, device_id string, date_bucket string"
)
REPORT = (
    "expected_location string, num_windows int, all_scores map<string,double>, best_match string, best_score double, best_status string, expected_score double, "
    "expected_status string, correct_match boolean, margin double"
)
STATS = "mean array<double>, std array<double>, num_files_used bigint"
THRESHOLDS = (
    "stable_threshold double, moderate_threshold double, same_location_stats struct<mean:double,min:double,max:double,n:bigint>, "
    "diff_location_stats struct<mean:double,min:double,max:double,n:bigint>, locations array<string>, manual_override boolean, calibrated_at string"
)
SIMILARITY = "filename string, true_location string, compared_to string, similarity double, is_same_location boolean"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def json_map(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """A JSON object of objects as rows: the key, and the fields of value (a DDL schema)."""
    fields = T.StructType.fromDDL(value) if "," in value or " " in value else value
    schema = T.StructType([T.StructField(key, T.StringType()), *fields.fields])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), fields))).alias(key, "v"))
    return entries.select(key, "v.*")


def json_list(spark: SparkSession, path: str, of: str = "string", name: str = "value") -> DataFrame:
    """A JSON list as rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{name} {of}")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<{of}>")).alias(name))


def json_lists(spark: SparkSession, path: str, key: str = "location", name: str = "path") -> DataFrame:
    """A JSON object of lists of strings as rows, such as a hold-out split."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string, {name} string")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias(key, "v")).select(key, F.explode("v").alias(name))


def baselines(spark: SparkSession, path: str) -> DataFrame:
    """location, sub_id, centroid from a JSON object of lists of vectors."""
    if not exists(spark, path):
        return spark.createDataFrame([], "location string, sub_id int, centroid array<double>")
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<array<double>>>")).alias("location", "v"))
    return whole.select("location", F.posexplode("v").alias("sub_id", "centroid"))


def json_row(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object as one row."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header row."""
    return spark.read.csv(path, header=True, schema=schema)
