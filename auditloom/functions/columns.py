"""Column expressions with the conventions all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_to_null(col: Column) -> Column:
    """NaN counts as missing, like null (O-99)."""
    return F.nanvl(col, F.lit(None).cast("double"))


def safe_div(a: Column, b: Column) -> Column:
    """Null where the divisor is zero; plain division raises under ANSI."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def strip_channel(name: Column) -> Column:
    """File name without the channel suffix, which counts only at the end (O-27)."""
    return F.regexp_replace(name, r"_0000(\.nii(\.gz)?)$", "$1")


def base_id(name: Column) -> Column:
    """Case id of an image file: extensions go wherever they stand (O-28)."""
    return F.replace(F.replace(strip_channel(name), F.lit(".nii.gz"), F.lit("")), F.lit(".nii"), F.lit(""))


def side_of(case_id: Column) -> Column:
    """L, R or null for ids of halves (O-29)."""
    return F.when(case_id.rlike("_[LR]$"), F.right(case_id, F.lit(1)))


def close_spacing(spacing: Column, target: float = 1.0, tolerance: float = 0.10) -> Column:
    """All spacings within a relative tolerance of the target (O-32)."""
    return F.forall(spacing, lambda s: F.abs(s - target) / F.greatest(F.lit(target), F.lit(1e-6)) < tolerance)


def resampled_size(size: Column, spacing: Column, target: float = 1.0) -> Column:
    """Grid size after resampling, rounding halves to even (O-33)."""
    return F.bround(size * spacing / target).cast("int")


def l2_normalise(v: Column) -> Column:
    """Unit length, except for norms under 1e-12 (O-63)."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm < 1e-12, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The frame itself; running it fails if a key repeats (O-93, O-103)."""
    checked = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    guard = F.assert_true(F.col("_n") == 1, F.lit(f"repeated key {keys}"))
    return df.join(checked.where(guard.isNull()).drop("_n"), list(keys), "left_semi")
