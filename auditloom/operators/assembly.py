"""Which cases a site has: images, labels, votes and folds meet here, by file name and never by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import base_id


def label_case(file: Column) -> Column:
    """Case id of a label or prediction file, which carries no channel."""
    return F.regexp_replace(file, r"\.nii(\.gz)?", "")


def has_labels(sites: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``labelled`` to ``sites``: whether any label file of the site was found (O-08)."""
    found = labels.select("site").distinct().withColumn("labelled", F.lit(True))
    return sites.join(found, "site", "left").fillna(False, ["labelled"])


def sides(split_axis: Column) -> Column:
    """The halves of a case to explode: L and R where its site is split, one null where it is not."""
    return F.when(split_axis.isNotNull(), F.array(F.lit("L"), F.lit("R"))).otherwise(F.array(F.lit(None).cast("string")))


def with_side(case_id: Column, side: Column) -> Column:
    return F.concat_ws("_", case_id, side)


def site_case_ids(images: DataFrame, sites: DataFrame) -> DataFrame:
    """``site, case_id, base_id, side`` of every image, one row for each half where the site is split (O-19)."""
    halves = images.join(sites.select("site", "split_axis"), "site").withColumn("side", F.explode(sides(F.col("split_axis"))))
    own = base_id(F.col("file"))
    return halves.select("site", with_side(own, F.col("side")).alias("case_id"), own.alias("base_id"), "side")


def site_cases(images: DataFrame, masks: DataFrame, sites: DataFrame, flip_right: bool = True) -> DataFrame:
    """Cases with an image and a mask: ``site, case_id, path, mask_path, side, flipped`` (O-16, O-136).

    ``masks``: ``site, base_id, mask_path``, labels for the reference and vote masks for query sites. Images without a mask
    have no row. Right halves are marked to be mirrored.
    """
    rows = images.withColumn("base_id", base_id(F.col("file"))).join(masks, ["site", "base_id"]).join(sites.select("site", "split_axis"), "site")
    rows = rows.withColumn("side", F.explode(sides(F.col("split_axis"))))
    flipped = F.coalesce(F.col("side") == "R", F.lit(False)) & F.lit(flip_right)
    return rows.select("site", with_side(F.col("base_id"), F.col("side")).alias("case_id"), "path", "mask_path", "side", flipped.alias("flipped"))


def reference_atlas(images: DataFrame, held_out: DataFrame, labels: DataFrame) -> DataFrame:
    """Reference images that some fold held out and that have a label: ``case_id, path, fold`` (O-17)."""
    own = images.withColumn("case_id", base_id(F.col("file"))).join(held_out, "case_id")
    return own.join(labels.select(label_case(F.col("file")).alias("case_id")).distinct(), "case_id", "left_semi").select("case_id", "path", "fold")


def query_atlas(images: DataFrame, votes: DataFrame, sites: DataFrame) -> DataFrame:
    """Query images with a vote mask (``site, base_id``), by halves where the site is split: ``site, case_id, path, side`` (O-18)."""
    rows = images.withColumn("base_id", base_id(F.col("file"))).join(votes, ["site", "base_id"], "left_semi")
    rows = rows.join(sites.select("site", "split_axis"), "site").withColumn("side", F.explode(sides(F.col("split_axis"))))
    return rows.select("site", with_side(F.col("base_id"), F.col("side")).alias("case_id"), "path", "side")


def reference_cases(dice: DataFrame, features: DataFrame) -> DataFrame:
    """Reference cases with both a Dice and shape features (O-90, O-107); running it fails if there is none."""
    both = dice.join(features.select("case_id", "site"), ["case_id", "site"], "left_semi").select("case_id", "site", "dice")
    some = both.agg(F.count("*").alias("_n")).where(F.assert_true(F.col("_n") > 0, F.lit("no usable reference case: a label, a held-out fold with a prediction and a mask are needed")).isNull())
    return both.join(F.broadcast(some)).drop("_n")


def query_cases(ids: DataFrame, dice: DataFrame, features: DataFrame) -> DataFrame:
    """Every case of the query sites; ``dice`` only where the case is labelled and has shape features (O-94, O-106)."""
    known = dice.join(features.select("case_id", "site"), ["case_id", "site"], "left_semi").select("case_id", "site", "dice")
    return ids.select("case_id", "site").join(known, ["case_id", "site"], "left")


def assembly_report(ids: DataFrame, sites: DataFrame, labels: DataFrame, dice: DataFrame, features: DataFrame) -> DataFrame:
    """Per query site its counts and the warning they call for, if any (O-106)."""
    count = lambda df, name: df.groupBy("site").agg(F.count("*").alias(name))
    out = has_labels(sites, labels)
    for df, name in ((ids, "n_cases"), (dice, "n_dice"), (features, "n_features")):
        out = out.join(count(df, name), "site", "left")
    out = out.fillna(0, ["n_cases", "n_dice", "n_features"])
    why = F.when(F.col("n_cases") == 0, "no images; site skipped").when(F.col("n_features") == 0, "no predictions; only image-based scores")
    why = why.when(F.col("labelled") & (F.col("n_dice") == 0), "labels found, but none gives a Dice")
    why = why.when(F.col("n_features") < F.col("n_cases"), "some cases have no usable mask; not evaluated").when(~F.col("labelled"), "no labels; scored, not evaluated")
    return out.select("site", "n_cases", "n_dice", "n_features", "labelled", why.alias("warning"))


def with_features(features: DataFrame, cases: DataFrame) -> DataFrame:
    """Feature rows of known cases only (O-91)."""
    return features.join(cases.select("case_id", "site"), ["case_id", "site"], "left_semi")
