"""The audit's tables, mapped from the driver's: cases, scores, votes, features and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.session import table

METHODS = ["click", "error", "purchase", "signup", "view"]
PAIRS = [("view", "error"), ("view", "click"), ("purchase", "error")]
SITES = ["S0", "S1", "S2"]
#: Positions of a voxel number on the grid (z, y, x) = (5, 4, 10).
GRID = {"z": 5, "y": 4, "x": 10}


def registry(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Methods, paired tests and query sites with their positions."""
    methods = spark.createDataFrame([(m, i) for i, m in enumerate(METHODS)], "method string, method_pos int")
    pairs = spark.createDataFrame(PAIRS, "method string, reference string")
    sites = spark.createDataFrame([(s, i) for i, s in enumerate(SITES)], "site string, site_pos int")
    return methods, pairs, sites


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").cast("double").alias("bal"))
    dice = F.when(F.col("user_id") % 7 != 6, (F.col("bal") + 1000) / 11000)
    site = F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string"))
    return users.join(accounts, "user_id", "left").select(F.col("user_id").cast("string").alias("case_id"), site.alias("site"), dice.alias("dice"), F.col("user_id").cast("bigint").alias("case_pos"))


def scores(spark: SparkSession, sf_dir: str, incomplete: bool = True) -> DataFrame:
    """Mean value of a user's events of one type; the method ``error`` lacks some cases."""
    events = table(spark, sf_dir, "events")
    if incomplete:
        events = events.where(~((F.col("event_type") == "error") & (F.col("user_id") % 11 == 3)))
    mean = events.groupBy("user_id", "event_type").agg(F.avg("value").alias("score"))
    return mean.select(F.col("user_id").cast("string").alias("case_id"), F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("site"), F.col("event_type").alias("method"), F.round("score", 9).alias("score"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 5")
    return rows.select(F.col("l_suppkey").alias("case_id"), F.col("l_linenumber").alias("fold"), (F.col("l_partkey") % 200).alias("voxel")).distinct()


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber >= 6")
    return rows.select(F.col("l_suppkey").alias("case_id"), (F.col("l_partkey") % 200).alias("voxel")).distinct()


def placed(voxels: DataFrame) -> DataFrame:
    """Adds z, y, x of the voxel number."""
    v, plane = F.col("voxel"), GRID["y"] * GRID["x"]
    return voxels.withColumns({"z": F.floor(v / plane).cast("int"), "y": F.floor((v % plane) / GRID["x"]).cast("int"), "x": (v % GRID["x"]).cast("int")})


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight features of each customer's orders in long form, one of them constant and one heavy-tailed."""
    price = F.col("o_totalprice").cast("double")
    wide = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(
        F.avg(price).alias("mean"), F.count("*").cast("double").alias("count"), F.max(price).alias("max"), F.stddev_pop(price).alias("sd"),
        F.sum(price).alias("sum"), F.sqrt(F.sum(price * price)).alias("energy"), F.lit(7.0).alias("constant"), F.pow(F.count("*").cast("double"), F.lit(8.0)).alias("tail"),
    )
    return wide.unpivot("case_id", [c for c in wide.columns if c != "case_id"], "feature", "value")


def reference_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).where("case_id % 3 = 0")
