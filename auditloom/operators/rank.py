"""Selective-risk analytics: how well a score ranks cases by risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of larger tables are made in stretches of the score, so that no sort holds all cases of a method.
STRETCHES = 64
#: Rows up to which one sort per group is the faster plan; it gives the same ranks.
ONE_SORT_ROWS = 1 << 20


def running_risk(cases: DataFrame, by: list[str], conf: Column, risk: Column, tie: list[Column], stretches: int = STRETCHES) -> DataFrame:
    """Rows with ``coverage`` k and ``mean_risk``, the mean risk of the k most confident cases of a group.

    Among equal confidences the later case (by ``tie``, descending) ranks first. The confidence range of each
    group is cut at approximate percentiles; the running sums of a stretch start from the pre-aggregated sums of those before.
    """
    rows = cases.withColumns({"_conf": conf.cast("double"), "_risk": risk.cast("double")})
    if stretches == 1:  # for many small groups
        order = Window.partitionBy(*by).orderBy(F.col("_conf").desc(), *[t.desc() for t in tie])
        k, total = F.row_number().over(order), F.sum("_risk").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return rows.withColumns({"coverage": k, "mean_risk": total / k}).drop("_conf", "_risk")
    bounds = rows.groupBy(*by).agg(F.percentile_approx("_conf", [i / stretches for i in range(1, stretches)], 1000).alias("_bounds"))
    rows = rows.join(bounds, by) if by else rows.crossJoin(F.broadcast(bounds))
    rows = rows.withColumn("_stretch", F.size(F.filter("_bounds", lambda b: b > F.col("_conf")))).drop("_bounds")
    sums = rows.groupBy(*by, "_stretch").agg(F.sum("_risk").alias("_sum"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_stretch", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_sum0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    order = Window.partitionBy(*by, "_stretch").orderBy(F.col("_conf").desc(), *[t.desc() for t in tie])
    rows = rows.join(sums, [*by, "_stretch"])
    k = F.col("_n0") + F.row_number().over(order)
    total = F.col("_sum0") + F.sum("_risk").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumns({"coverage": k, "mean_risk": total / k}).drop("_sum0", "_n0", "_stretch", "_conf", "_risk")


def aurc(cases: DataFrame, by: list[str], conf: Column, risk: Column, tie: list[Column], name: str = "aurc", stretches: int = STRETCHES) -> DataFrame:
    """Area under the risk-coverage curve of each group (O-78)."""
    return running_risk(cases, by, conf, risk, tie, stretches).groupBy(*by).agg(F.avg("mean_risk").alias(name), F.count("*").alias("n"))


def excess_aurc(scored: DataFrame, by: list[str], unit: list[str], tie: list[Column], stretches: int = STRETCHES) -> DataFrame:
    """AURC, its optimum and their difference (O-78 to O-80).

    ``scored``: ``case_id, site, site_pos, case_pos, method, score, dice``, complete. ``by`` must hold the method; ``unit`` is the rest
    of ``by``, on which the optimum depends alone, so it is computed once and not for every method.
    """
    risk = 1 - F.col("dice")
    got = aurc(scored, by, -F.col("score"), risk, tie, "aurc", stretches)
    cases = scored.select(*unit, "site", "case_id", "dice", *{"site_pos", "case_pos", "draw_pos"} & set(scored.columns)).distinct()
    best = aurc(cases, unit, -risk, risk, tie, "oracle_aurc", stretches).drop("n")
    joined = got.join(best, unit) if unit else got.crossJoin(F.broadcast(best))
    return joined.withColumn("eaurc", F.col("aurc") - F.col("oracle_aurc"))


def eaurc_by_method(scored: DataFrame, extra: list[str] | None = None, tie: list[Column] | None = None) -> DataFrame:
    """Within-site (equal-weight mean) and pooled excess AURC of every method (O-81, O-82)."""
    extra = extra or []
    # replicates are many and each is small
    stretches = 1 if extra or scored.limit(ONE_SORT_ROWS + 1).count() <= ONE_SORT_ROWS else STRETCHES
    tie = tie or [F.col("case_pos")]
    site = excess_aurc(scored, [*extra, "site", "method"], [*extra, "site"], tie, stretches)
    within = site.groupBy(*extra, "method").agg(F.avg("eaurc").alias("eaurc_within"))
    pooled = excess_aurc(scored, [*extra, "method"], extra, [F.col("site_pos"), *tie], stretches)
    return within.join(pooled.select(*extra, "method", F.col("eaurc").alias("eaurc_pooled")), [*extra, "method"])
