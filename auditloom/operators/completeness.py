"""Which cases, sites and methods an evaluation can use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import missing_to_null, require_unique

MIN_CASES = 4


def evaluated(cases: DataFrame) -> DataFrame:
    """Cases whose Dice is known (O-99)."""
    return cases.withColumn("dice", missing_to_null(F.col("dice"))).where(F.col("dice").isNotNull())


def labelled_sites(sites: DataFrame, cases: DataFrame) -> DataFrame:
    """Each query site with its counts and why it can't be evaluated, if it can't (O-100)."""
    counts = cases.groupBy("site").agg(F.count("*").alias("n_cases"), F.count(missing_to_null(F.col("dice"))).alias("n_labelled"))
    found = sites.join(counts, "site", "left").fillna(0, ["n_cases", "n_labelled"])
    why = F.when(F.col("n_cases") == 0, "no cases").when(F.col("n_labelled") == 0, "no labelled cases").when(F.col("n_labelled") < MIN_CASES, "fewer than 4 labelled cases")
    return found.withColumn("reason", why).withColumn("usable", why.isNull())


def available_methods(methods: DataFrame, scores: DataFrame) -> DataFrame:
    """The registry's methods that have scores, in its order (O-101)."""
    return methods.join(scores, "method", "left_semi")


def available_pairs(pairs: DataFrame, methods: DataFrame) -> DataFrame:
    """Paired tests whose two members are both available (O-101)."""
    kept = methods.select("method")
    return pairs.join(kept, "method", "left_semi").join(kept.withColumnRenamed("method", "reference"), "reference", "left_semi")


def complete_methods(methods: DataFrame, cases: DataFrame, scores: DataFrame) -> DataFrame:
    """Per available method the evaluated cases without a score; a method is complete if there are none (O-102).

    Counts per method come from one semi-join and one aggregate; methods times cases are never laid out.
    """
    wanted = evaluated(cases).select("case_id", "site")
    have = scores.where(missing_to_null(F.col("score")).isNotNull()).join(wanted, ["case_id", "site"], "left_semi")
    counts = have.groupBy("method").agg(F.countDistinct("case_id", "site").alias("n_scored"))
    total = wanted.agg(F.count("*").alias("n_evaluated"))
    out = available_methods(methods, scores).join(counts, "method", "left").fillna(0, ["n_scored"])
    out = out.join(F.broadcast(total))
    return out.withColumn("n_missing", F.col("n_evaluated") - F.col("n_scored")).withColumn("complete", F.col("n_missing") == 0)


def missing_scores(method: str, cases: DataFrame, scores: DataFrame) -> DataFrame:
    """The ``site/case`` list of what a method misses (O-95, O-102)."""
    have = scores.where((F.col("method") == method) & missing_to_null(F.col("score")).isNotNull())
    gone = evaluated(cases).join(have, ["case_id", "site"], "left_anti")
    return gone.select(F.concat_ws("/", "site", "case_id").alias("missing")).orderBy("missing")


def wide_scores(cases: DataFrame, scores: DataFrame, methods: list[str]) -> DataFrame:
    """One row per case, one column per method of the given list; unscored cases stay (O-92, O-103, O-104)."""
    unique = require_unique(scores.where(F.col("method").isin(methods)), "case_id", "site", "method")
    pivoted = unique.groupBy("case_id", "site").pivot("method", methods).agg(F.first("score"))
    return cases.select("case_id", "site", "dice").join(pivoted, ["case_id", "site"], "left")


def complete_scores(cases: DataFrame, scores: DataFrame, methods: DataFrame, sites: DataFrame) -> DataFrame:
    """The input of an evaluation: evaluated cases of usable sites times complete methods."""
    usable = labelled_sites(sites, cases).where("usable").select("site", "site_pos")
    kept = complete_methods(methods, cases.join(usable, "site", "left_semi"), scores).where("complete").select("method")
    rows = evaluated(cases).join(F.broadcast(usable), "site").join(scores.select("case_id", "site", "method", "score"), ["case_id", "site"])
    return rows.join(F.broadcast(kept), "method", "left_semi")
