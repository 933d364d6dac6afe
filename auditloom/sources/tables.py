"""Score and case tables as CSV, embedding and registration caches as Parquet, and work that resumes from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions.columns import missing_to_null

CASES = "case_id string, site string, dice double"
SCORES = "case_id string, site string, method string, score double"
EMBEDDINGS = "backbone string, mode string, site string, case_id string, embedding array<float>"
REGISTRATIONS = "site string, case_id string, ref_case_id string, dsc double, reg_seconds double"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def child_folders(spark: SparkSession, path: str, start: str = "") -> list[str]:
    """Names of the folders directly below a path, in order; only the listing is read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return sorted(f.getPath().getName() for f in found if f.isDirectory() and f.getPath().getName().startswith(start))


def discover_folds(spark: SparkSession, pred_root: str) -> list[str]:
    """Names of the ``fold_*`` folders in order; an error if there is none (O-09)."""
    folds = child_folders(spark, pred_root, "fold_") if exists(spark, pred_root) else []
    if not folds:
        raise FileNotFoundError(f"no fold_* folders below {pred_root}")
    return folds


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """``case_id, site, dice, case_pos`` of a case file or a folder of its parts; positions are row numbers, files by name (O-13).

    Rows are numbered within the blocks of the files, and blocks start from the counts of those before, so that no sort holds the
    table. Ids stay text, and an empty or NaN Dice is null.
    """
    rows = spark.read.schema(CASES).csv(path, header=True, enforceSchema=False)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    sizes = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"))  # one row for each block
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_file", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_at")) - 1
    rows = rows.withColumn("_within", within).join(sizes, ["_file", "_start"])
    return rows.select("case_id", "site", missing_to_null(F.col("dice")).alias("dice"), (F.col("_before") + F.col("_within")).alias("case_pos"))


def load_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All score files of a folder as one long table, ``case_id, site, method, score``; empty if there is none (O-12)."""
    if not exists(spark, folder):
        return spark.createDataFrame([], SCORES)
    rows = spark.read.schema(SCORES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(folder, header=True, enforceSchema=False)
    return rows.withColumn("score", missing_to_null(F.col("score")))


def save_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Write a table as CSV with a header, replacing it; in ``order`` across its parts if given (O-20)."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def save_embeddings(bank: DataFrame, path: str) -> None:
    """Write an embedding bank (``EMBEDDINGS``), one folder for each backbone, mode and site; sites not in it stay (O-24)."""
    slim = bank.select("backbone", "mode", "site", "case_id", F.col("embedding").cast("array<float>").alias("embedding"))
    slim.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("backbone", "mode", "site").parquet(path)


def load_embeddings(spark: SparkSession, path: str, backbone: str, sites: Sequence[str]) -> DataFrame:
    """A backbone's vectors of some sites; only their folders are read (O-14)."""
    if not exists(spark, path):
        return spark.createDataFrame([], EMBEDDINGS)
    bank = spark.read.schema(EMBEDDINGS).parquet(path)
    return bank.where((F.col("backbone") == backbone) & F.col("site").isin(list(sites)))


def resumed(wanted: DataFrame, path: str, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """What ``compute`` gives for the rows of ``wanted``, from ``path`` as far as it is there (O-15, O-25, O-130, O-133).

    Rows whose keys the cache lacks are computed and appended; a cached row is never computed again, whatever has
    changed since. Returns the cache's rows for the wanted keys.
    """
    spark = wanted.sparkSession
    known = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    compute(wanted.join(known.select(*keys).distinct(), list(keys), "left_anti")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).join(wanted.select(*keys).distinct(), list(keys), "left_semi")
