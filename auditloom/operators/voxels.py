"""Mask set algebra on sparse voxels: one row per foreground voxel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import safe_div
from auditloom.session import cut_lineage

VOTES = 3
MIN_AREA = 10
#: Masks, and words of 64 voxels, that a block of masks holds at most on average; words of a mask that a product of matrices takes at once.
BLOCK_MASKS, BLOCK_WORDS, WORDS = 2048, 1 << 20, 16


def usable_folds(folds: DataFrame) -> DataFrame:
    """``case_id, fold, n_files, n_usable``: the folds of each case whose mask has the shape of its first one (O-48).

    ``folds``: ``case_id, fold`` of every mask file, also of empty masks, and ``shape`` if it is known; first is by fold.
    """
    shape = F.col("shape") if "shape" in folds.columns else F.lit(0)
    rows = folds.select("case_id", "fold", shape.alias("shape")).distinct()
    first = rows.groupBy("case_id").agg(F.min_by("shape", "fold").alias("first"), F.count("*").alias("n_files"))
    kept = rows.join(first, "case_id").where(F.col("shape").eqNullSafe(F.col("first")))
    sizes = kept.groupBy("case_id").agg(F.count("*").alias("n_usable"))
    return kept.join(sizes, "case_id").select("case_id", "fold", "n_files", "n_usable")


def vote_cases(folds: DataFrame) -> DataFrame:
    """Whether each case can be voted on: a single file passes through, else two masks of one shape are needed (O-48)."""
    kept = usable_folds(folds).select("case_id", "n_files", "n_usable").distinct()
    return kept.withColumn("votable", (F.col("n_files") == 1) | (F.col("n_usable") >= 2))


def majority_vote(votes: DataFrame, folds: DataFrame | None = None, threshold: int = VOTES) -> DataFrame:
    """Voxels that at least ``threshold`` folds mark; ``votes``: ``case_id, fold, voxel`` of foreground (O-48).

    The threshold is absolute. ``folds`` tells which masks exist (see ``usable_folds``); without it a fold exists that marks
    anything. A case with a single mask file passes through, one with several but fewer than two usable has no rows.
    """
    kept = usable_folds(votes.select("case_id", "fold") if folds is None else folds)
    rows = votes.select("case_id", "fold", "voxel").join(kept, ["case_id", "fold"])
    counted = rows.groupBy("case_id", "voxel", "n_files", "n_usable").agg(F.countDistinct("fold").alias("votes"))
    voted = (F.col("votes") >= threshold) & (F.col("n_usable") >= 2)
    return counted.where(voted | (F.col("n_files") == 1)).drop("n_files", "n_usable")


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``n_a, n_b, n_both`` of two masks per key: one shuffle of flagged voxels instead of a join and two counts."""
    both = a.select(*keys, "voxel", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, "voxel", F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    voxels = both.groupBy(*keys, "voxel").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return voxels.groupBy(*keys).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(F.col("_a") * F.col("_b")).alias("n_both"))


def strict_dice(n_a: Column, n_b: Column, n_both: Column) -> Column:
    """Null if either mask is empty: for risks and warped masks (O-49, O-55)."""
    return F.when((n_a > 0) & (n_b > 0), safe_div(2 * n_both, n_a + n_b))


def ensemble_dice(n_a: Column, n_b: Column, n_both: Column) -> Column:
    """Null only if both masks are empty (O-51)."""
    return safe_div(2 * n_both, n_a + n_b)


def vote_dice(prediction: DataFrame, truth: DataFrame) -> DataFrame:
    """Risk Dice of one mask per case against its truth; cases without one are absent (O-49)."""
    dice = strict_dice(F.col("n_a"), F.col("n_b"), F.col("n_both")).alias("dice")
    return overlap(prediction, truth, ["case_id"]).select("case_id", dice).where("dice is not null")


def label_one(voxels: DataFrame) -> DataFrame:
    """Voxels of label 1, after truncation to whole numbers (O-49, O-55)."""
    return voxels.where(F.col("label").cast("int") == 1)


def fold_dice(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """``case_id, fold, dice`` of every fold's mask (``case_id, fold, voxel``) against its case's truth (``case_id, voxel``); null where either is empty (O-49)."""
    a = predictions.groupBy("case_id", "fold").agg(F.count("*").alias("n_a"))
    b = truth.groupBy("case_id").agg(F.count("*").alias("n_b"))
    met = predictions.join(truth.select("case_id", "voxel"), ["case_id", "voxel"]).groupBy("case_id", "fold").agg(F.count("*").alias("n_both"))
    sizes = a.join(b, "case_id", "left").join(met, ["case_id", "fold"], "left").fillna(0, ["n_b", "n_both"])
    return sizes.select("case_id", "fold", strict_dice(F.col("n_a"), F.col("n_b"), F.col("n_both")).alias("dice"))


def site_dice(predictions: DataFrame, truth: DataFrame, held_out: DataFrame | None = None) -> DataFrame:
    """Risk Dice of each case: the mean over its folds with a Dice, or that of its held-out fold alone (O-50).

    ``held_out`` (``case_id, fold``) is given for the reference site. Cases without any valid Dice have no row. Sites
    that are split come in halves (``halves``), whose ids end in the side; their base id decides the held-out fold.
    """
    found = fold_dice(predictions, truth).where("dice is not null")
    if held_out is not None:
        base = F.regexp_replace("case_id", "_[LR]$", "")
        own = held_out.select(F.col("case_id").alias("_base"), F.col("fold").alias("_fold"))
        found = found.join(own, ((F.col("case_id") == F.col("_base")) | (base == F.col("_base"))) & (F.col("fold") == F.col("_fold")), "left_semi")
    return found.groupBy("case_id").agg(F.avg("dice").alias("dice"))


def halves(voxels: DataFrame, axis: str, size: int) -> DataFrame:
    """Both halves of each case as cases of their own, ``<case>_L`` and ``<case>_R`` (O-35, O-50, O-52)."""
    cut = split_halves(voxels, axis, size)
    return cut.withColumn("case_id", F.concat_ws("_", F.col("case_id").cast("string"), "side")).drop("side")


def mean_pairwise_dice(votes: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """Mean ensemble Dice over unordered pairs of folds of each case, and the score, its negative (O-51 to O-53).

    ``folds`` (``case_id, fold``) tells which masks exist, empty ones included; without it only folds that mark anything do.
    A pair of empty masks has no Dice; a case without any Dice, as with fewer than two masks, keeps a row of nulls.
    Pairs of folds arise per voxel (few folds), not by joining masks with each other.
    """
    votes = votes.select("case_id", "fold", "voxel").distinct()
    folds = (votes if folds is None else folds).select("case_id", "fold").distinct()
    sizes = folds.join(votes.groupBy("case_id", "fold").agg(F.count("*").alias("n")), ["case_id", "fold"], "left").fillna(0, ["n"])
    at = votes.groupBy("case_id", "voxel").agg(F.sort_array(F.collect_set("fold")).alias("folds"))
    pair = F.explode(F.flatten(F.transform("folds", lambda a: F.transform(F.filter("folds", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    shared = at.select("case_id", pair.alias("p")).groupBy("case_id", F.col("p.a").alias("fold_a"), F.col("p.b").alias("fold_b")).agg(F.count("*").alias("n_both"))
    a = sizes.select("case_id", F.col("fold").alias("fold_a"), F.col("n").alias("n_a"))
    b = sizes.select("case_id", F.col("fold").alias("fold_b"), F.col("n").alias("n_b"))
    pairs = a.join(b, "case_id").where("fold_a < fold_b").join(shared, ["case_id", "fold_a", "fold_b"], "left").fillna(0, ["n_both"])
    dice = pairs.withColumn("dice", ensemble_dice(F.col("n_a"), F.col("n_b"), F.col("n_both")))
    means = dice.groupBy("case_id").agg(F.avg("dice").alias("mean_dice"), F.count("dice").alias("n_pairs")).withColumn("score", -F.col("mean_dice"))
    return folds.select("case_id").distinct().join(means, "case_id", "left").fillna(0, ["n_pairs"])


def ensemble_scores(cases: DataFrame, votes: DataFrame, folds: DataFrame) -> DataFrame:
    """The Ens-Mpd score of every listed case, null where its folds give none (O-54)."""
    found = mean_pairwise_dice(votes, folds).select("case_id", "score")
    return cases.join(found, "case_id", "left").withColumn("method", F.lit("ens_mpd")).select("case_id", "site", "method", "score")


def split_halves(voxels: DataFrame, axis: str, size: int) -> DataFrame:
    """Left and right halves along an axis; the right one gets the extra slab and local coordinates (O-35)."""
    mid = size // 2
    right = F.col(axis) >= mid
    return voxels.withColumn("side", F.when(right, "R").otherwise("L")).withColumn(axis, F.when(right, F.col(axis) - mid).otherwise(F.col(axis)))


def mirror(coordinate: Column, size: int) -> Column:
    """Flip along an axis (O-36)."""
    return F.lit(size - 1) - coordinate


def slice_areas(mask: DataFrame, least: int = MIN_AREA) -> DataFrame:
    """Mask pixels per axial slice and whether the slice is used: areas of at least 10, or any where none is (O-57)."""
    areas = mask.groupBy("case_id", "z").agg(F.count("*").alias("area"))
    most = areas.groupBy("case_id").agg(F.max("area").alias("_most"))
    return areas.join(most, "case_id").withColumn("selected", F.col("area") >= F.when(F.col("_most") >= least, least).otherwise(1)).drop("_most")


def _bitmaps(voxels: DataFrame, key: str) -> DataFrame:
    """One row per mask: its rows ``n``, its words of 64 voxels ``at`` in order with their bits ``set``, and ``k1, k2``, 128 bits that equal masks share."""
    voxel = F.col("voxel").cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), voxel.bitwiseAND(F.lit(63)).cast("int"))
    words = voxels.groupBy(key, F.shiftright(voxel, 6).alias("at")).agg(F.bit_or(bit).alias("set"), F.count("*").alias("rows"))
    word = F.when(F.col("at").isNotNull(), F.struct("at", "set"))
    masks = words.groupBy(key).agg(F.sum("rows").alias("n"), F.sort_array(F.collect_list(word)).alias("words"))
    masks = masks.select(key, "n", F.col("words.at").alias("at"), F.col("words.set").alias("set"))
    return masks.withColumns({"k1": F.xxhash64("n", "at", "set"), "k2": F.xxhash64(F.lit(1), "n", "at", "set")})


def _dealt(masks: DataFrame, name: str) -> tuple[DataFrame, int]:
    """One of each class of equal masks, dealt into blocks of about BLOCK_MASKS masks and BLOCK_WORDS words, and the number of blocks."""
    kinds = cut_lineage(masks.groupBy("k1", "k2").agg(F.first(F.struct("n", "at", "set")).alias("m")).select("k1", "k2", "m.*"))
    size = kinds.agg(F.count("*").alias("masks"), F.coalesce(F.sum(F.size("at")), F.lit(0)).alias("words")).first()
    blocks = max(1, -(-size.masks // BLOCK_MASKS), -(-size.words // BLOCK_WORDS))
    return kinds.withColumn(name, F.pmod("k1", F.lit(blocks)).cast("int")), blocks


def _shared(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Number of voxels that each mask of ``a`` shares with each of ``b``: products of 0/1 matrices over WORDS words at a time, of the masks that touch these."""
    sides = []
    for side in (a, b):
        sizes = side["at"].map(len).to_numpy()
        at, bits = (np.concatenate([*side[c], np.zeros(0, np.int64)]).astype(np.int64) for c in ("at", "set"))
        sides.append((np.repeat(np.arange(len(side)), sizes), at, bits))
    common = np.intersect1d(sides[0][1], sides[1][1])
    for k, (mask, at, bits) in enumerate(sides):
        kept = np.isin(at, common)
        place = np.searchsorted(common, at[kept])
        order = np.argsort(place, kind="stable")
        sides[k] = mask[kept][order], place[order], bits[kept][order]
    exact = np.float32 if min(a["n"].max(), b["n"].max()) < 1 << 24 else np.float64
    out = np.zeros((len(a), len(b)), exact)
    for first in range(0, len(common), WORDS):
        rows, dense = [], []
        for mask, place, bits in sides:
            part = slice(*np.searchsorted(place, (first, first + WORDS)))
            touching, row = np.unique(mask[part], return_inverse=True)
            words = np.zeros((len(touching), min(WORDS, len(common) - first)), np.int64)
            words[row, place[part] - first] = bits[part]
            rows.append(touching)
            dense.append(np.unpackbits(words.view(np.uint8), axis=1).astype(exact))
        if len(rows[0]) == len(a) and len(rows[1]) == len(b):
            out += dense[0] @ dense[1].T
        else:
            out[np.ix_(*rows)] += dense[0] @ dense[1].T
    return out


def _best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """The best Dice of each mask of ``a`` with any of ``b``."""
    if a.empty or b.empty:
        return a[["k1", "k2"]].head(0).assign(best=0.0)
    n_a, n_b, shared = a["n"].to_numpy(np.float64), b["n"].to_numpy(np.float64), _shared(a, b)
    best = [(2 * shared[i].astype(np.float64) / (n_a[i] + n_b)).max() for i in range(len(a))]
    return pd.DataFrame({"k1": a["k1"], "k2": a["k2"], "best": best})


def atlas_max_dice(queries: DataFrame, references: DataFrame) -> DataFrame:
    """Best overlap of each query with any reference mask and the score, its negative (O-56, O-97).

    ``voxel`` is a whole number. Equal masks are compared once. Of the rest each block of queries meets each block of references, and
    a task counts the shared voxels of all their pairs at once (``_shared``); only a query's best Dice in a block leaves the task.
    """
    q = cut_lineage(_bitmaps(queries, "case_id"))
    q_kinds, q_blocks = _dealt(q, "_q")
    r_kinds, r_blocks = _dealt(_bitmaps(references, "ref_id"), "_r")
    every = lambda kinds, name, blocks: kinds.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("_q", "_r")
    met = every(q_kinds, "_r", r_blocks).cogroup(every(r_kinds, "_q", q_blocks))
    best = met.applyInPandas(_best, "k1 bigint, k2 bigint, best double").groupBy("k1", "k2").agg(F.max("best").alias("best"))
    return q.select("case_id", "k1", "k2").join(best, ["k1", "k2"]).select("case_id", F.col("best").alias("max_dice"), (-F.col("best")).alias("score"))
