"""The audit operators on literals: ties, missing scores, Dice conventions, pruning, p-values."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import bootstrap, completeness, rank, stats, voxels
from auditloom.session import cut_lineage


def test_equal_confidences_rank_the_later_case_first(spark):
    risk = [0.7, 0.0, 0.2, 0.6]
    cases = spark.createDataFrame([("m", i, r, 1.0) for i, r in enumerate(risk)], "method string, pos long, risk double, conf double")
    got = rank.aurc(cases, ["method"], F.col("conf"), F.col("risk"), [F.col("pos")]).first()
    back = np.array(risk[::-1])
    assert abs(got.aurc - np.mean(np.cumsum(back) / np.arange(1, 5))) < 1e-12 and got.n == 4


def test_stretches_equal_one_sort(spark):
    rng = np.random.default_rng(0)
    rows = [("m", i, float(r), float(c)) for i, (r, c) in enumerate(zip(rng.random(500), rng.integers(0, 40, 500), strict=True))]
    cases = spark.createDataFrame(rows, "method string, pos long, risk double, conf double")
    args = (["method"], F.col("conf"), F.col("risk"), [F.col("pos")])
    assert abs(rank.aurc(cases, *args).first().aurc - rank.aurc(cases, *args, stretches=1).first().aurc) < 1e-12


def test_absent_rows_and_nan_scores_both_drop_the_method(spark):
    cases = spark.createDataFrame([(c, "A", 0.5, i) for i, c in enumerate("abcd")], "case_id string, site string, dice double, case_pos long")
    scores = [(c, "A", "full", 1.0) for c in "abcd"] + [(c, "A", "short", 1.0) for c in "abc"] + [(c, "A", "nan", float("nan") if c == "b" else 1.0) for c in "abcd"]
    scores = spark.createDataFrame(scores, "case_id string, site string, method string, score double")
    methods = spark.createDataFrame([("full", 0), ("short", 1), ("nan", 2), ("none", 3)], "method string, method_pos int")
    got = {r.method: (r.n_missing, r.complete) for r in completeness.complete_methods(methods, cases, scores).collect()}
    assert got == {"full": (0, True), "short": (1, False), "nan": (1, False)}
    assert [r.missing for r in completeness.missing_scores("nan", cases, scores).collect()] == ["A/b"]
    with pytest.raises(Exception, match="repeated key"):
        completeness.wide_scores(cases, scores.unionByName(scores), ["full"]).collect()


def test_dice_conventions(spark):
    sizes = spark.createDataFrame([(0, 0, 0), (0, 3, 0), (2, 2, 1)], "a long, b long, i long")
    got = sizes.select(voxels.strict_dice(F.col("a"), F.col("b"), F.col("i")).alias("s"), voxels.ensemble_dice(F.col("a"), F.col("b"), F.col("i")).alias("e")).collect()
    assert [tuple(r) for r in got] == [(None, None), (None, 0.0), (0.5, 0.5)]


def test_p_value_and_interval_need_enough_replicates(spark):
    for n, want in ((100, 2 / 101), (99, None)):
        got = spark.range(n).select(F.lit(0.5).alias("x")).agg(bootstrap.p_value(F.col("x")).alias("p"), bootstrap.interval(F.col("x"))[0].alias("low")).first()
        assert (got.p, got.low) == ((want, 0.5) if want else (None, None))


def test_prune_drops_the_more_correlated_member():
    matrix = {("a", "b"): 0.95, ("b", "c"): 0.92, ("a", "c"): 0.5}
    assert stats.correlation_prune(["a", "b", "c"], matrix) == ["a", "c"]
    assert stats.correlation_prune(["a", "b"], {("a", "b"): -0.99}) == ["b"] and stats.correlation_prune(["a"], {}) == ["a"]


def plain_distances(rows, reference, norm):
    """Squared distances by the definitions, one matrix inverse for each call."""
    if norm == "l2":
        rows, reference = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (rows, reference))
    else:
        mean, sd = reference.mean(0), reference.std(0)
        rows, reference = ((m - mean) / np.where(sd < 1e-12, 1, sd) for m in (rows, reference))
    n, p = reference.shape
    c = reference - reference.mean(0)
    s = c.T @ c / n
    mu = np.trace(s) / p
    apart = ((s - mu * np.eye(p)) ** 2).sum() / p
    noise = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / n / n / p, apart)
    shrunk = s + (mu * np.eye(p) - s) * (noise / apart if noise > 0 else 0)
    d = rows - reference.mean(0)
    return np.array([r @ np.linalg.pinv(shrunk) @ r for r in d])


def test_distances_of_a_matrix_and_unknown_norms():
    from auditloom.operators import mahalanobis

    x = np.random.default_rng(1).normal(size=(9, 2))
    for norm in ("l2", "zscore"):
        unit = mahalanobis.unit_rows(x) if norm == "l2" else x
        assert np.allclose(mahalanobis.moments_of(x, norm).score(unit), plain_distances(x, x, norm))
    with pytest.raises(ValueError, match="unknown"):
        mahalanobis.moments_of(x, "max")


def test_bootstrap_queries_take_all_replicates(spark):
    from auditloom.plans import queries

    for name in ("bootstrap_ci", "paired_tests"):
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert got and all(r.n_boot == bootstrap.REPLICATES == 2000 for r in got)


def test_mahalanobis_downdates_equal_refits(spark):
    from auditloom.operators import mahalanobis

    rng = np.random.default_rng(3)
    x = rng.normal(3, [1, 2, 0.1, 5, 0], (60, 5))
    x[7, 4] += 1  # without this row the last column is constant
    rows = [(i, [float(v) for v in r], i < 40) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "case_id long, v array<double>, ref boolean")
    for norm in ("l2", "zscore"):
        got = {r.case_id: r.md2 for r in mahalanobis.mahalanobis(frame, F.col("ref"), norm).collect()}
        want = [*(plain_distances(x[i : i + 1], np.delete(x[:40], i, 0), norm)[0] for i in range(40)), *plain_distances(x[40:], x[:40], norm)]
        assert np.allclose([got[i] for i in range(60)], want, rtol=1e-6)
    many = spark.range(20_101).select(F.col("id").alias("case_id"), F.array(F.rand(1), F.rand(2)).alias("v"))
    assert mahalanobis.mahalanobis(many, F.col("case_id") > 0, "l2").where("md2 >= 0").count() == 20_101


def test_empty_masks_count_as_folds(spark):
    votes = spark.createDataFrame([("c", f, v) for f in (1, 2) for v in ((7, 8) if f == 1 else (8,))] + [("d", 2, 1), ("e", 4, 5)], "case_id string, fold int, voxel long")
    folds = spark.createDataFrame([("c", 1, 1), ("c", 2, 1), ("c", 3, 1), ("d", 1, 1), ("d", 2, 1), ("d", 3, 2), ("e", 4, 1), ("n", 1, 1)], "case_id string, fold int, shape int")
    got = {r.case_id: (r.mean_dice, r.n_pairs) for r in voxels.mean_pairwise_dice(votes, folds).collect()}
    assert got["c"][1] == 3 and abs(got["c"][0] - 2 / 9) < 1e-12  # 2/3 between the marked folds, zero with the empty one
    assert got["n"] == (None, 0)
    assert voxels.majority_vote(votes, folds, threshold=1).where("case_id = 'd'").count() == 1  # the third has another shape
    assert {r.case_id for r in voxels.majority_vote(votes, folds).collect()} == {"e"}  # a single file passes through
    assert {r.case_id: r.votable for r in voxels.vote_cases(folds).collect()} == {"c": True, "d": True, "e": True, "n": True}


def test_nan_is_missing(spark):
    rows = spark.createDataFrame([("a", "f", 1.0), ("b", "f", float("nan")), ("c", "f", 3.0)], "case_id string, feature string, value double")
    assert sorted(r.value for r in stats.fill_mean(rows).collect()) == [1.0, 2.0, 3.0]
    assert stats.reference_moments(rows).first().mu == 2.0


def test_held_out_folds_and_halves(spark):
    pred = spark.createDataFrame([("k", f, v) for f in (1, 2) for v in (range(4) if f == 1 else range(2))], "case_id string, fold int, voxel long")
    truth = spark.createDataFrame([("k", v) for v in range(4)], "case_id string, voxel long")
    held = spark.createDataFrame([("k", 2)], "case_id string, fold int")
    assert abs(voxels.site_dice(pred, truth).first().dice - (1 + 2 / 3) / 2) < 1e-12
    assert abs(voxels.site_dice(pred, truth, held).first().dice - 2 / 3) < 1e-12
    cut = lambda df: voxels.halves(df.withColumn("x", F.col("voxel")), "x", 4)
    got = {r.case_id: r.dice for r in voxels.site_dice(cut(pred), cut(truth), held).collect()}
    assert got == {"k_L": 1.0}  # the right half has no voxel in the held-out fold


def test_atlas_in_blocks_equals_pairs(spark, monkeypatch):
    monkeypatch.setattr(voxels, "BLOCK_MASKS", 4, raising=False)
    rng = np.random.default_rng(5)
    masks = [{int(v) for v in rng.choice(4000, rng.integers(1, 900)) - 100} for _ in range(24)]
    masks[3], masks[17], masks[5] = masks[1], masks[1], {10**6}  # equal masks, one that meets none
    queries, references = masks[:13], masks[11:]
    table = lambda side, key: spark.createDataFrame([(i, v) for i, m in enumerate(side) for v in m], f"{key} int, voxel long")
    got = {r.case_id: (r.max_dice, r.score) for r in voxels.atlas_max_dice(table(queries, "case_id"), table(references, "ref_id")).collect()}
    best = [max(2 * len(q & r) / (len(q) + len(r)) for r in references) for q in queries]
    assert got == {i: (b, -b) for i, b in enumerate(best)} and best[5] == 0
    assert voxels.atlas_max_dice(table(queries, "case_id"), table([], "ref_id")).count() == 0


def test_atlas_does_not_lay_out_pairs(spark):
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda w: w * 64 + F.pmod(F.xxhash64("case_id", w), F.lit(64))))
    masks = spark.range(6000).withColumnRenamed("id", "case_id").withColumn("voxel", at)
    began, found = time.time(), voxels.atlas_max_dice(masks, masks.withColumnRenamed("case_id", "ref_id"))
    assert found.where("max_dice = 1").count() == 6000
    assert time.time() - began < 25  # 36,000,000 pairs share 16 words each


def test_hashed_draws_are_those_of_the_text():
    for prefix, n in (("42|S|7|", 30_011), ("42|" + "é" * 25 + "|0|", 12_000), ("7|" + "x" * 140 + "|19|", 4_100), ("42||1|", 1)):
        plain = [int(hashlib.md5(f"{prefix}{d}".encode()).hexdigest()[:8], 16) % n for d in range(n)]
        assert bootstrap.hash_draws(prefix, n).tolist() == plain


def test_bootstrap_of_many_cases(spark):
    """More score rows than the old limit of 2^18, with many equal scores."""
    place = {"case_id": F.col("case_pos").cast("string"), "site": F.concat(F.lit("S"), F.col("case_pos") % 3), "site_pos": (F.col("case_pos") % 3).cast("int")}
    cases = spark.range(70_000).withColumnRenamed("id", "case_pos").withColumns(place).withColumn("dice", F.pmod(F.xxhash64("case_pos"), F.lit(1009)) / 1009)
    rows = cases.withColumn("method", F.explode(F.array(*[F.lit(m) for m in "abcd"]))).withColumn("score", F.pmod(F.xxhash64("case_pos", "method"), F.lit(97)) / 97)
    scored = cut_lineage(rows)
    began = time.time()
    got = {(r.rep, r.method): (r.eaurc_within, r.eaurc_pooled) for r in bootstrap.replicate_table(scored, 60).collect()}
    assert len(got) == 240 and time.time() - began < 30
    few = bootstrap.replicate_table(scored, 1, dense_rows=0).collect()
    assert len(few) == 4 and all(np.allclose(got[0, r.method], (r.eaurc_within, r.eaurc_pooled), rtol=0, atol=1e-12) for r in few)


def test_paired_tests_of_many_cases(spark):
    place = {"case_id": F.col("case_pos").cast("string"), "site": F.lit("S"), "site_pos": F.lit(0)}
    cases = spark.range(140_000).withColumnRenamed("id", "case_pos").withColumns(place).withColumn("dice", F.pmod(F.xxhash64("case_pos"), F.lit(1009)) / 1009)
    noise = F.pmod(F.xxhash64("case_pos", "method"), F.lit(97)) / 97
    rows = cases.withColumn("method", F.explode(F.array(F.lit("good"), F.lit("none")))).withColumn("score", F.when(F.col("method") == "good", noise - F.col("dice")).otherwise(noise))
    scored = cut_lineage(rows)
    pairs = spark.createDataFrame([("good", "none")], "method string, reference string")
    began = time.time()
    got = bootstrap.paired_tests(cut_lineage(bootstrap.replicate_table(scored, 120)), cut_lineage(rank.eaurc_by_method(scored)), pairs).collect()
    assert time.time() - began < 40
    assert len(got) == 1 and got[0].n_boot == 120 and got[0].pooled_p == got[0].within_p == 2 / 121
    assert got[0].within_low <= got[0].within_diff <= got[0].within_high < 0 and abs(got[0].within_diff - got[0].pooled_diff) < 1e-12


def test_points_come_from_the_arrays_of_the_replicates(spark, monkeypatch):
    """Equal scores of unequal risks, sites of unequal size; the second site by position comes first by name."""
    sites = F.when(F.col("case_pos") % 5 < 3, "B").otherwise("A")
    place = {"case_id": F.col("case_pos").cast("string"), "site": sites, "site_pos": F.when(sites == "B", 0).otherwise(1)}
    cases = spark.range(700).withColumnRenamed("id", "case_pos").withColumns(place).withColumn("dice", F.pmod(F.xxhash64("case_pos"), F.lit(101)) / 101)
    scored = cut_lineage(cases.withColumn("method", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("score", F.pmod(F.xxhash64("case_pos", "method"), F.lit(13)) / 13))
    as_rows = lambda table, *key: {tuple(r[k] for k in key): (r.eaurc_within, r.eaurc_pooled) for r in table.collect()}
    want, plain = as_rows(rank.eaurc_by_method(scored), "method"), as_rows(bootstrap.replicate_table(scored, 3, dense_rows=0), "rep", "method")
    monkeypatch.setattr(bootstrap, "eaurc_by_method", None)
    monkeypatch.setattr(rank, "eaurc_by_method", None)
    drawn, points = bootstrap.replicates_and_points(scored, 3)
    for got, expected in ((as_rows(points, "method"), want), (as_rows(drawn, "rep", "method"), plain)):
        assert got.keys() == expected.keys() and all(np.allclose(got[k], expected[k], rtol=0, atol=1e-12) for k in got)
    from auditloom.plans import queries

    assert all(r.n_boot == 2000 for r in queries.QUERIES["paired_tests"](spark, "/root/testdata/sf0.001").collect())
