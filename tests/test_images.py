"""Image kernels and volume sources against numpy on literals."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import images
from auditloom.sources import nifti


def pixels(spark, a):
    return spark.createDataFrame([("i", int(y), int(x), float(a[y, x])) for y, x in np.ndindex(a.shape)], "image string, y int, x int, v double")


def test_windowing_is_monotone_and_covers_all_bytes(spark):
    a = np.random.default_rng(7).gamma(2.0, 30.0, (15, 20))
    got = {(r.y, r.x): r.grey for r in images.window_to_bytes(pixels(spark, a), ["image"]).collect()}
    order = sorted(got, key=lambda at: a[at])
    steps = [got[at] for at in order]
    assert steps == sorted(steps) and steps[0] == steps[1] == 0 and steps[-1] == steps[-2] == 255
    middle = order[150]
    lo, hi = np.quantile(a, 0.01), np.quantile(a, 0.99)
    assert got[middle] == int((a[middle] - lo) / (hi - lo) * 255)
    assert {r.grey for r in images.window_to_bytes(pixels(spark, np.full((3, 2), 8.0)), ["image"]).collect()} == {0}


def test_overlay_tints_the_mask_and_nothing_else(spark):
    rows = [("i", 0, x, g) for x, g in enumerate((0, 5, 100, 255))]
    grey = spark.createDataFrame(rows, "image string, y int, x int, grey int")
    mask = spark.createDataFrame([("i", 0, 0), ("i", 0, 3), ("i", 9, 9)], "image string, y int, x int")
    got = {r.x: (r.r, r.g, r.b) for r in images.overlay(grey, mask, ["image", "y", "x"]).collect()}
    assert got[1] == (5, 5, 5) and got[2] == (100, 100, 100)
    assert got[0] == (102, 32, 0)  # two fifths of the colour on black
    assert got[3][0] == 255 and got[3][1] < 255 and got[3][2] == 153


def test_normalise_and_brighten(spark):
    a = np.random.default_rng(0).normal(size=(5, 8))
    got = images.normalise_volume(pixels(spark, a), ["image"])
    lo, hi = np.percentile(a, [0.05, 99.95])
    want = (np.clip(a, lo, hi) - lo) / (hi - lo) * 2 - 1
    assert all(abs(r.scaled - want[r.y, r.x]) < 1e-9 for r in got.collect())
    mask = spark.createDataFrame([("i", 0, 0)], "image string, y int, x int")
    one = {(r.y, r.x): r.scaled for r in images.brighten(got, mask, ["image", "y", "x"]).collect()}
    assert abs(one[0, 0] - min(1, want[0, 0] + 0.5)) < 1e-9 and abs(one[3, 3] - want[3, 3]) < 1e-9


@pytest.mark.parametrize("size", [28, 10])
def test_coverage_is_the_share_of_area(spark, size):
    m = np.random.default_rng(1).random((size, size)) < 0.3
    mask = spark.createDataFrame([("i", int(y), int(x)) for y, x in zip(*np.nonzero(m), strict=True)], "image string, y int, x int")
    got = {(r.patch_row, r.patch_col): r.cover for r in images.patch_coverage(mask, ["image"], size, size, 4).collect()}
    fine = np.kron(m, np.ones((4, 4)))  # 4 x 4 points in each pixel: patches are then whole numbers of points
    want = fine.reshape(4, size, 4, size).mean((1, 3))
    assert all(abs(got.get(ij, 0.0) - want[ij]) < 1e-9 for ij in np.ndindex(4, 4))


def test_pooling_thresholds_and_falls_back(spark):
    tokens = spark.createDataFrame([("i", 0, [1.0, 2.0]), ("i", 1, [3.0, 6.0]), ("j", 0, [1.0, 1.0]), ("j", 1, [2.0, 4.0])], "image string, p int, token array<double>")
    weights = spark.createDataFrame([("i", 0, 0.3), ("i", 1, 0.1), ("j", 0, 0.05)], "image string, p int, cover double")
    got = {(r.image, r.dim): r.value for r in images.pool(tokens, weights, ["image"], ["p"]).collect()}
    assert np.allclose([got["i", 0], got["i", 1], got["j", 0], got["j", 1]], [1.5, 3.0, 1.5, 2.5])
    row = spark.range(1).select(F.array(*map(F.lit, range(7))).alias("t"))
    assert [(r[0], r[1]) for r in row.select(*images.split_tokens(F.col("t"), 2)).collect()] == [(0, [3, 4, 5, 6])]


def test_nearest_resampling(spark):
    m = np.random.default_rng(2).random(20) < 0.4
    mask = spark.createDataFrame([("i", int(x)) for x in np.flatnonzero(m)], "image string, x int")
    got = {r.x for r in images.resample_nearest(mask, {"x": 20}, {"x": 0.7}).collect()}
    assert got == {i for i in range(14) if m[min(19, int(np.floor(i / 0.7 + 0.5)))]}


def test_volumes_round_trip(spark, tmp_path):
    v = (np.random.default_rng(3).random((3, 4, 5)) < 0.4).astype(np.uint8)
    (tmp_path / "a_0000.nii.gz").write_bytes(nifti.encode(v, (3.0, 0.7, 0.5)))
    back, spacing = nifti.decode((tmp_path / "a_0000.nii.gz").read_bytes())
    assert np.array_equal(back, v) and np.allclose(spacing, (3.0, 0.7, 0.5))
    rows = nifti.read_masks(spark, str(tmp_path)).collect()
    assert {(r.z, r.y, r.x) for r in rows} == set(zip(*map(list, np.nonzero(v)), strict=True)) and rows[0].shape == [3, 4, 5]
    assert [r.file for r in nifti.list_volumes(spark, str(tmp_path)).collect()] == ["a_0000.nii.gz"]
    with pytest.raises(ValueError):
        nifti.decode(b"short")


def test_folders_folds_and_config(spark):
    files = spark.createDataFrame([("A", "imagesTr", "x"), ("A", "images", "y"), ("B", "images", "z")], "site string, dir string, file string")
    assert sorted(r.file for r in nifti.prefer_folder(files, ["imagesTr", "images"], ["site"]).collect()) == ["x", "z"]
    text = lambda *cases: json.dumps({"e": {"T": {c: {"mask_1": {"Dice": 0.9}} for c in cases}, "U": {"q": {}}}})
    texts = spark.createDataFrame([(0, text("a", "b")), (1, text("b")), (2, None)], "fold int, value string")
    two = json.dumps({"epoch_10": {"T": {"old": {}}}, "epoch_9": {"T": {"new": {}}}})  # the last by name, not by number
    sites = spark.createDataFrame([("T", "R"), ("U", "Q")], "task string, site string")
    assert {r.case_id: r.fold for r in nifti.fold_membership(texts, sites, "R").collect()} == {"a": 0, "b": 1}
    assert [r.case_id for r in nifti.fold_membership(spark.createDataFrame([(0, two)], "fold int, value string"), sites, "R").collect()] == ["new"]
