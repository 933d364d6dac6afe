"""Image kernels on sparse pixels: windowing, overlays, patch coverage, pooling and nearest-neighbour resampling.

A pixel is a row with its image key, its coordinates and a value ``v``; masks hold foreground pixels only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import resampled_size, safe_div

#: Share of the overlay's colour and the colour itself.
ALPHA, COLOUR = 0.4, (255, 80, 0)
#: Least share of a patch that a mask must cover to count in 2D pooling.
LEAST_COVER = 0.10
#: Percentile ranges of the 2D window and of the 3D normalisation.
WINDOW_2D, WINDOW_3D = (0.01, 0.99), (0.0005, 0.9995)


def _with_range(pixels: DataFrame, keys: list[str], shares: tuple[float, float]) -> DataFrame:
    """Adds the exact percentiles ``_lo, _hi`` of each image; they are one row per image."""
    bounds = pixels.groupBy(*keys).agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("_p"))
    bounds = bounds.select(*keys, F.col("_p")[0].alias("_lo"), F.col("_p")[1].alias("_hi"))
    return pixels.join(bounds, keys)


def window_to_bytes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Stretch each image between its 1st and 99th percentile to 0..255, truncated; flat images become zero (O-40)."""
    part = safe_div((F.col("v") - F.col("_lo")) * 255, F.col("_hi") - F.col("_lo"))
    grey = F.coalesce(F.floor(F.least(F.greatest(part, F.lit(0.0)), F.lit(255.0))), F.lit(0)).cast("int")
    return _with_range(pixels, keys, WINDOW_2D).withColumn("grey", grey).drop("_lo", "_hi")


def overlay(grey: DataFrame, mask: DataFrame, on: list[str]) -> DataFrame:
    """Adds ``r, g, b``: grey outside of the mask, blended with the colour inside, truncated (O-42, O-43)."""
    marked = mask.select(*on).distinct().withColumn("_in", F.lit(True))

    def channel(colour: int) -> Column:
        mixed = F.floor(F.least(F.col("grey") * (1 - ALPHA) + colour * ALPHA, F.lit(255.0))).cast("int")
        return F.when(F.col("_in"), mixed).otherwise(F.col("grey"))

    return grey.join(marked, on, "left").withColumns(dict(zip("rgb", map(channel, COLOUR), strict=True))).drop("_in")


def normalise_volume(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Clip each volume to its 0.05th and 99.95th percentile and scale it to -1..1; flat volumes become zero (O-44)."""
    kept = F.least(F.greatest(F.col("v"), F.col("_lo")), F.col("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), safe_div(kept - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 2 - 1).otherwise(0.0)
    return _with_range(voxels, keys, WINDOW_3D).withColumn("scaled", scaled).drop("_lo", "_hi")


def brighten(voxels: DataFrame, mask: DataFrame, on: list[str], by: float = 0.5) -> DataFrame:
    """Raise ``scaled`` inside the mask and clip to -1..1; nothing changes without a mask (O-45)."""
    marked = mask.select(*on).distinct().withColumn("_in", F.lit(True))
    raised = F.least(F.greatest(F.col("scaled") + F.when(F.col("_in"), by).otherwise(0.0), F.lit(-1.0)), F.lit(1.0))
    return voxels.join(marked, on, "left").withColumn("scaled", raised).drop("_in")


def patch_coverage(mask: DataFrame, keys: list[str], height: int, width: int, n: int) -> DataFrame:
    """``patch_row, patch_col, cover``: share of each of n x n patches that the mask covers, by exact overlap of areas (O-59).

    A pixel spans a stretch of patches along each axis and gives each its overlap, so a size that n does not divide
    needs nothing else. Patches that the mask misses have no row.
    """

    def spread(df: DataFrame, at: str, size: int, name: str) -> DataFrame:
        lo, hi = F.col(at) * n / size, (F.col(at) + 1) * n / size
        # integer arithmetic for the ends, so that a border on a patch edge never adds an empty overlap
        first, last = F.floor(F.col(at) * n / size), F.floor(((F.col(at) + 1) * n - 1) / size)
        out = df.withColumn(name, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        share = F.least(hi, F.col(name) + 1) - F.greatest(lo, F.col(name))
        return out.withColumn(f"_{name}", share)

    pixels = mask.select(*keys, "y", "x").distinct()
    both = spread(spread(pixels, "y", height, "patch_row"), "x", width, "patch_col")
    return both.groupBy(*keys, "patch_row", "patch_col").agg(F.sum(F.col("_patch_row") * F.col("_patch_col")).alias("cover"))


def pool(tokens: DataFrame, weights: DataFrame, keys: list[str], patch: list[str], least: float = LEAST_COVER) -> DataFrame:
    """Weighted mean of patch vectors ``token`` per image as rows ``dim, value`` (O-60; with ``least`` zero O-62).

    Weights below ``least`` count as zero; where none is left the plain mean over all patches stands in.
    """
    w = F.coalesce(F.when(F.col("cover") >= least, F.col("cover")), F.lit(0.0))
    joined = tokens.join(weights, [*keys, *patch], "left").withColumn("_w", w)
    parts = joined.select(*keys, "_w", F.posexplode("token").alias("dim", "_v")).withColumn("_v", F.col("_v").cast("double"))
    sums = parts.groupBy(*keys, "dim").agg(F.sum("_w").alias("_sum"), F.sum(F.col("_w") * F.col("_v")).alias("_dot"), F.avg("_v").alias("_plain"))
    return sums.select(*keys, "dim", F.when(F.col("_sum") > 1e-8, safe_div(F.col("_dot"), F.col("_sum"))).otherwise(F.col("_plain")).alias("value"))


def split_tokens(tokens: Column, registers: int) -> tuple[Column, Column]:
    """The class token and the patch tokens of a sequence with some register tokens between them (O-46)."""
    return F.element_at(tokens, 1), F.slice(tokens, F.lit(2 + registers), F.greatest(F.size(tokens) - 1 - registers, F.lit(0)))


def resample_nearest(mask: DataFrame, sizes: dict[str, int], spacing: dict[str, float], target: float = 1.0) -> DataFrame:
    """A mask on a grid of another spacing, each new voxel taking its nearest old one (O-119).

    Voxel centres are matched from the first one on, as coordinates times spacing. Each old voxel names the stretch
    of new ones it is nearest to, so the work follows the foreground and no grid is made.
    """
    out = mask
    for axis, size in sizes.items():
        step = spacing[axis] / target
        new = int(mask.sparkSession.range(1).select(resampled_size(F.lit(size), F.lit(float(spacing[axis])), target)).first()[0])
        low = F.ceil((F.col(axis) - 0.5) * step)
        high = F.ceil((F.col(axis) + 0.5) * step) - 1
        first, last = F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(new - 1)).cast("int")
        held = out.where(first <= last)
        out = held.withColumn(axis, F.explode(F.sequence(first, last)))
    return out
