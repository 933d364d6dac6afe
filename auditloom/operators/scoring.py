"""Failure scores from features and embeddings in long form: fill, keep, distance to the reference, one row per case and method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import missing_to_null, safe_div
from auditloom.operators import stats
from auditloom.operators.mahalanobis import mahalanobis

KEYS = ("case_id", "site")


def long_features(wide: DataFrame, prefix: str = "original_shape_") -> DataFrame:
    """``case_id, site, feature, value`` of the columns whose names start with a prefix (O-31)."""
    names = [c for c in wide.columns if c.startswith(prefix)]
    rows = wide.select(*KEYS, *[missing_to_null(F.col(c).cast("double")).alias(c) for c in names])
    return rows.unpivot(list(KEYS), names, "feature", "value")


def keep_columns(features: DataFrame, reference: Column) -> DataFrame:
    """Features that are finite once the reference is z-scored with its own statistics (O-73)."""
    own = features.where(reference)
    z = stats.zscore(own, own)
    finite = F.coalesce(F.abs("z") < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.coalesce("z", F.lit(0.0)))
    return features.join(F.broadcast(z.groupBy("feature").agg(F.bool_and(finite).alias("_kept")).where("_kept").select("feature")), "feature", "left_semi")


def keep_rows(features: DataFrame) -> DataFrame:
    """Cases without any missing feature (O-74)."""
    whole = features.groupBy(*KEYS).agg(F.bool_and(missing_to_null(F.col("value")).isNotNull()).alias("_whole")).where("_whole")
    return features.join(whole.select(*KEYS), list(KEYS), "left_semi")


def vectors(features: DataFrame, fill: float | None = None) -> DataFrame:
    """One array ``v`` per case, in the order of feature names; missing values become ``fill``."""
    value = missing_to_null(F.col("value"))
    packed = F.array_sort(F.collect_list(F.struct("feature", (value if fill is None else F.coalesce(value, F.lit(fill))).alias("value"))))
    return features.groupBy(*KEYS).agg(packed.alias("_f")).select(*KEYS, F.transform("_f", lambda f: f["value"]).alias("v"))


def _distances(rows: DataFrame, reference: Column, norm: str, method: str | Column) -> DataFrame:
    keyed = rows.withColumn("_key", F.struct(*KEYS))
    found = mahalanobis(keyed, reference, norm, "_key", "v")
    return found.select("_key.case_id", "_key.site", (F.lit(method) if isinstance(method, str) else method).alias("method"), F.col("md2").alias("score"))


def mask_scores(features: DataFrame, selected: Sequence[str], reference_site: str) -> DataFrame:
    """Rad-MD-Mask: squared distance of the selected shape features, missing ones as zero, z-scored; reference cases leave themselves out (O-71)."""
    rows = vectors(features.where(F.col("feature").isin(list(selected))), 0.0)
    return _distances(rows, F.col("site") == reference_site, "zscore", "rad_md_mask")


def select_and_score(features: DataFrame, reference_site: str) -> tuple[list[str], DataFrame]:
    """Features selected on the reference, and the scores by them (O-72)."""
    own = features.where(F.col("site") == reference_site)
    selected = stats.select_features(own.select(F.struct(*KEYS).alias("case_id"), "feature", "value"))
    return selected, mask_scores(features, selected, reference_site)


def leave_out_l2(features: DataFrame, reference: Column) -> DataFrame:
    """Rad-L2: length of the z-scored vector; a reference case is z-scored with the others' statistics (O-75, O-76).

    A case is left out by taking it from sums of values less the mean, so no refit visits the other rows. A feature that is
    constant over the others is only centred; that is told by the greatest and least values and how many rows hold them.
    """
    own = features.where(reference)
    at = own.groupBy("feature").agg(F.avg("value").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    u = F.col("value") - F.col("m")
    sums = own.join(F.broadcast(at), "feature").groupBy("feature", "m", "lo", "hi").agg(
        F.count("*").alias("n"), F.sum(u).alias("s"), F.sum(u * u).alias("ss"), F.count_if(F.col("value") == F.col("lo")).alias("at_lo"), F.count_if(F.col("value") == F.col("hi")).alias("at_hi")
    )
    left = F.when(reference, 1).otherwise(0)
    n = F.col("n") - left
    mean = safe_div(F.col("s") - left * u, n)
    variance = safe_div(F.col("ss") - left * u * u, n) - mean * mean
    constant = (F.col("at_lo") - F.when(reference & (F.col("value") == F.col("lo")), 1).otherwise(0) == n) | (F.col("at_hi") - F.when(reference & (F.col("value") == F.col("hi")), 1).otherwise(0) == n)
    z = (u - mean) / F.when(constant, 1.0).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0))))
    rows = features.join(F.broadcast(sums), "feature").withColumn("z", z)
    return rows.groupBy(*KEYS).agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("rad_l2"))


def image_scores(features: DataFrame, reference_site: str) -> DataFrame:
    """``rad_md_img`` and ``rad_l2`` of every case with whole features, in long form (O-76).

    ``features``: whole-image radiomics in long form. Columns that the reference makes useless are left out first.
    """
    reference = F.col("site") == reference_site
    kept = keep_columns(keep_rows(features), reference)
    far = _distances(vectors(kept), reference, "l2", "rad_md_img")
    long = leave_out_l2(kept, reference).select(*KEYS, F.lit("rad_l2").alias("method"), F.col("rad_l2").alias("score"))
    return far.unionByName(long)


def embedding_scores(bank: DataFrame, reference_site: str, modes: Sequence[str] = ("img", "ov", "w", "ovw")) -> DataFrame:
    """Scores ``<backbone>_md_<mode>`` of one backbone's vectors; each mode has its own reference, sites without vectors no rows (O-77)."""
    parts = []
    for mode in modes:
        rows = bank.where(F.col("mode") == mode).select("backbone", *KEYS, F.col("embedding").cast("array<double>").alias("v"))
        backbone = rows.select(F.first("backbone").alias("b")).first().b
        if backbone is not None:
            parts.append(_distances(rows, F.col("site") == reference_site, "l2", f"{backbone}_md_{mode}"))
    if not parts:
        raise ValueError(f"no vectors of the reference {reference_site}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
