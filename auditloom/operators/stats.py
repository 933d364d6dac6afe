"""Statistical scoring on features in long form: ``case_id, feature, value`` with a reference population."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import missing_to_null, safe_div

CV_MIN, KURTOSIS_MAX, CORRELATION_MAX = 0.01, 5.0, 0.90


def reference_moments(reference: DataFrame) -> DataFrame:
    """Mean and population standard deviation of each feature (O-64)."""
    value = missing_to_null(F.col("value"))
    return reference.groupBy("feature").agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))


def zscore(features: DataFrame, reference: DataFrame) -> DataFrame:
    """Z-scores against the reference; a feature without variance is only centred (O-64)."""
    sd = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return features.join(F.broadcast(reference_moments(reference)), "feature").withColumn("z", (F.col("value") - F.col("mu")) / sd).drop("mu", "sd")


def rad_l2(features: DataFrame, reference: DataFrame) -> DataFrame:
    """Length of the z-scored vector of each case (O-75)."""
    return zscore(features, reference).groupBy("case_id").agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("rad_l2"))


def fill_mean(features: DataFrame) -> DataFrame:
    """Missing values become the feature's mean, for selection only (O-69)."""
    features = features.withColumn("value", missing_to_null(F.col("value")))
    means = features.groupBy("feature").agg(F.avg("value").alias("_mean"))
    return features.join(F.broadcast(means), "feature").withColumn("value", F.coalesce("value", "_mean")).drop("_mean")


def feature_filter(reference: DataFrame) -> DataFrame:
    """Coefficient of variation, excess kurtosis and stability of each feature, and whether it is kept (O-70a)."""
    stats = reference.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"), F.kurtosis("value").alias("kurtosis"))
    cv = F.col("sd") / F.greatest(F.abs("mu"), F.lit(1e-12))
    stats = stats.withColumn("cv", cv).withColumn("stability", 1 / (F.col("sd") + 1e-12))
    return stats.withColumn("kept", (F.col("cv") >= CV_MIN) & F.coalesce(F.col("kurtosis") <= KURTOSIS_MAX, F.lit(False)))


def correlations(reference: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of features, null for constant ones (O-70b).

    Sums per pair come from one pass over cases as maps of their few features.
    """
    rows = reference.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("f"))
    pair = F.explode(F.flatten(F.transform("f", lambda a: F.transform(F.filter("f", lambda b: b["feature"] > a["feature"]), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    pairs = rows.select(pair.alias("p")).select(F.col("p.a.feature").alias("feature_a"), F.col("p.b.feature").alias("feature_b"), F.col("p.a.value").alias("x"), F.col("p.b.value").alias("y"))
    r = safe_div(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return pairs.groupBy("feature_a", "feature_b").agg(r.alias("r"))


def correlation_prune(order: list[str], matrix: dict[tuple[str, str], float | None], limit: float = CORRELATION_MAX) -> list[str]:
    """Drop features until no pair correlates above the limit (O-70b).

    ``order``: candidates, most stable first. Of the most correlated pair (first in row-major order) the one with the
    larger mean correlation goes, the more stable one on ties. At most a few dozen features: the driver's loop.
    """
    r = lambda a, b: 0.0 if a == b else abs(matrix.get((a, b), matrix.get((b, a))) or 0.0)
    kept = list(order)
    while len(kept) > 1:
        pairs = [(r(a, b), -i, -j, a, b) for i, a in enumerate(kept) for j, b in enumerate(kept) if i < j]
        top, _, _, a, b = max(pairs)
        if top <= limit:
            break
        mean = {f: sum(r(f, g) for g in kept) / len(kept) for f in (a, b)}
        kept.remove(a if mean[a] >= mean[b] else b)
    return kept


def select_features(reference: DataFrame) -> list[str]:
    """Filter, then prune (O-70c); only per-feature statistics reach the driver."""
    stats = [r for r in feature_filter(fill_mean(reference)).collect() if r.kept]
    order = [r.feature for r in sorted(stats, key=lambda r: (-r.stability, r.feature))]
    matrix = {(r.feature_a, r.feature_b): r.r for r in correlations(fill_mean(reference).where(F.col("feature").isin(order))).collect()}
    return correlation_prune(order, matrix)
