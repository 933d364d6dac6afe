"""Queries on volumes, cases and scores over the driver's tables, with the DuckDB SQL each is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import assembly, evaluate, images, scoring, voxels
from auditloom.operators.mahalanobis import mahalanobis
from auditloom.plans import audit
from auditloom.session import shared_folder, table
from auditloom.sources import nifti, tables


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six mask files of every case; the sixth marks nothing, and some have another shape."""
    rows = audit.votes(spark, sf_dir).select("case_id").distinct().withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(6))))
    return rows.withColumn("shape", F.when((F.col("case_id") + F.col("fold")) % 4 == 0, 2).otherwise(1))


def vote_usable_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.majority_vote(audit.votes(spark, sf_dir), _folds(spark, sf_dir)).select("case_id", "voxel", "votes")


def vote_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.vote_cases(_folds(spark, sf_dir))


def ens_mpd(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"), F.lit("S").alias("site"))
    return _round(voxels.ensemble_scores(cases, audit.votes(spark, sf_dir), _folds(spark, sf_dir)), "score")


def site_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(voxels.site_dice(audit.votes(spark, sf_dir), audit.truth(spark, sf_dir)), "dice")


def _held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"), (F.col("s_suppkey") % 5 + 1).alias("fold"))


def site_dice_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(voxels.site_dice(audit.votes(spark, sf_dir), audit.truth(spark, sf_dir), _held_out(spark, sf_dir)), "dice")


def site_dice_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda df: voxels.halves(audit.placed(df), "x", audit.GRID["x"]).withColumn("voxel", F.struct("z", "y", "x"))
    return _round(voxels.site_dice(cut(audit.votes(spark, sf_dir)), cut(audit.truth(spark, sf_dir))), "dice")


def fold_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs per file, of which the later by name counts; every case is in two folds."""
    key, fold = F.col("s_suppkey").cast("string"), F.col("k")
    rows = table(spark, sf_dir, "supplier").withColumn("k", F.explode(F.array(F.col("s_suppkey") % 5, F.col("s_suppkey") % 3)))
    some = lambda e: F.map_from_entries(F.transform(F.collect_set(F.when(e, key)), lambda k: F.struct(k, F.create_map(F.lit("m"), F.lit("{}")))))
    tasks = lambda e: F.create_map(F.lit("t1"), some(e), F.lit("t2"), F.create_map(F.lit("other"), F.create_map(F.lit("m"), F.lit("{}"))))
    whole = F.to_json(F.create_map(F.lit("epoch_10"), tasks(F.lit(True)), F.lit("epoch_9"), tasks(F.col("s_suppkey") % 2 == 0)))
    texts = rows.groupBy(F.concat(F.lit("fold_"), fold.cast("string")).alias("fold")).agg(whole.alias("value"))
    names = spark.createDataFrame([("t1", "R"), ("t2", "Q")], "task string, site string")
    return nifti.fold_membership(texts, names, "R")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sites, every third of them split."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), n.cast("string")).alias("site"), n.cast("int").alias("site_pos"), F.when(n % 3 == 0, 0).alias("split_axis"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("site"), F.concat(F.lit("c"), key, F.lit("_0000.nii.gz")).alias("file"), F.concat(F.lit("/d/c"), key).alias("path"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("site"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string"), F.lit(".nii.gz")).alias("file"))


def site_case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.site_case_ids(_images(spark, sf_dir), _sites(spark, sf_dir))


def has_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.has_labels(_sites(spark, sf_dir), _labels(spark, sf_dir)).select("site", "labelled")


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _labels(spark, sf_dir).withColumn("base_id", assembly.label_case(F.col("file")))
    return own.select("site", "base_id", F.concat(F.lit("/m/"), "base_id").alias("mask_path"))


def site_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.site_cases(_images(spark, sf_dir), _masks(spark, sf_dir), _sites(spark, sf_dir))


def query_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.query_atlas(_images(spark, sf_dir), _masks(spark, sf_dir), _sites(spark, sf_dir))


def reference_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 1").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("case_id"), (F.col("s_suppkey") % 5).alias("fold"))
    return assembly.reference_atlas(_images(spark, sf_dir), held, _labels(spark, sf_dir))


def _site_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order features by case and site, with gaps; reference site R0."""
    value = F.when((F.col("case_id") % 17 == 0) & (F.col("feature") == "sd"), F.lit(float("nan"))).otherwise(F.col("value"))
    site = F.concat(F.lit("R"), (F.col("case_id") % 3).cast("string"))
    return audit.features(spark, sf_dir).select(F.col("case_id").cast("string").alias("case_id"), site.alias("site"), "feature", value.alias("value"))


def reference_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    dice = audit.cases(spark, sf_dir).where("dice is not null").withColumn("site", F.concat(F.lit("R"), (F.col("case_pos") % 3).cast("string")))
    feats = _site_features(spark, sf_dir).select("case_id", "site").distinct()
    return _round(assembly.reference_cases(dice, feats).select("case_id", "site", "dice"), "dice")


def query_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = audit.cases(spark, sf_dir).withColumn("site", F.concat(F.lit("R"), (F.col("case_pos") % 3).cast("string")))
    feats = _site_features(spark, sf_dir).where("case_id % 5 <> 0").select("case_id", "site").distinct()
    return _round(assembly.query_cases(cases, cases.where("dice is not null"), feats), "dice")


def keep_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _site_features(spark, sf_dir)
    return scoring.keep_columns(rows, F.col("site") == "R0").select("feature").distinct()


def keep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.keep_rows(_site_features(spark, sf_dir)).select("case_id", "site").distinct()


def rad_l2_leave_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.keep_rows(_site_features(spark, sf_dir))
    return scoring.leave_out_l2(rows, F.col("site") == "R0").withColumn("rad_l2", F.round("rad_l2", 4))


def md_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _site_features(spark, sf_dir).where(F.col("feature").isin("mean", "max"))
    packed = scoring.vectors(rows, 0.0).withColumn("key", F.struct("case_id", "site"))
    got = mahalanobis(packed, F.col("site") == "R0", "zscore", "key", "v")
    return got.select("key.case_id", "key.site", F.round("md2", 4).alias("md2"))


def method_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(m,) for m in evaluate.LABELS], "method string")
    return evaluate.with_label(known.unionByName(table(spark, sf_dir, "events").select(F.col("event_type").alias("method")).distinct()))


def half_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size"), F.col("p_size") + 1, F.col("p_size") + 2).cast("array<int>").alias("shape"), F.array((F.col("p_partkey") % 7 + 1).cast("double"), F.lit(0.5), F.lit(2.0)).alias("spacing"))
    parts = parts.withColumn("origin", F.array(F.lit(-1.0), F.lit(2.5), F.col("p_partkey").cast("double"))).withColumn("side", F.explode(F.array(F.lit("L"), F.lit("R"))))
    shape, origin = nifti.half_geometry(F.col("shape"), F.col("spacing"), F.col("origin"), 0, F.col("side"))
    return parts.select("p_partkey", "side", shape[0].alias("n0"), shape[1].alias("n1"), origin[0].alias("o0"), origin[1].alias("o1"), origin[2].alias("o2"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 10 x 20 pixels for each supplier, as far as its parts reach."""
    place = F.col("l_partkey") % 200
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("case_id"), F.floor(place / 20).cast("int").alias("y"), (place % 20).cast("int").alias("x"))
    return rows.agg(F.sum("l_quantity").cast("double").alias("v"))


def window_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.window_to_bytes(_pixels(spark, sf_dir), ["case_id"]).select("case_id", "y", "x", "grey")


def normalised_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(images.normalise_volume(_pixels(spark, sf_dir), ["case_id"]).select("case_id", "y", "x", "scaled"), "scaled")


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).where("v > 50").select("case_id", "y", "x")


def overlay_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.overlay(window_bytes(spark, sf_dir), _mask(spark, sf_dir), ["case_id", "y", "x"]).select("case_id", "y", "x", "r", "g", "b")


def patch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(images.patch_coverage(_mask(spark, sf_dir), ["case_id"], 10, 20, 4), "cover")


def resampled_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.resample_nearest(_mask(spark, sf_dir), {"y": 10, "x": 20}, {"y": 2.0, "x": 0.5})


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/casework-{uuid.uuid4().hex}"


def cases_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as CSV in an order of their own and read again with their row numbers (O-13, O-20)."""
    path = f"{_folder(spark)}/cases.csv"
    rows = audit.cases(spark, sf_dir).select("case_id", "site", "dice")
    tables.save_csv(rows, path, (F.col("site").desc(), "case_id"))
    return _round(tables.load_cases(spark, path), "dice")


def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as one CSV for each of two methods and read as one table (O-12, O-20)."""
    folder = _folder(spark)
    rows = audit.scores(spark, sf_dir).select("case_id", "site", "method", "score")
    for method in ("click", "error"):
        tables.save_csv(rows.where(F.col("method") == method), f"{folder}/{method}.csv")
    return _round(tables.load_scores(spark, folder), "score")


def embedding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written by backbone, mode and site; one backbone's vectors of two sites read again (O-14, O-24)."""
    path = _folder(spark)
    bank = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("b"), (F.col("vec_id") % 2).cast("string")).alias("backbone"), F.lit("img").alias("mode"),
        F.concat(F.lit("S"), (F.col("label") % 3).cast("string")).alias("site"), F.col("vec_id").cast("string").alias("case_id"), "embedding",
    )
    tables.save_embeddings(bank, path)
    got = tables.load_embeddings(spark, path, "b1", ["S0", "S2"])
    return got.select("backbone", "mode", "site", "case_id", F.size("embedding").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        vote_usable_folds, vote_cases, ens_mpd, site_dice, site_dice_reference, site_dice_halves, fold_membership, site_case_ids, has_labels, site_cases,
        query_atlas, reference_atlas, reference_cases, query_cases, keep_columns, keep_rows, rad_l2_leave_out, md_two_features, method_labels,
        half_geometry, window_bytes, normalised_volume, overlay_pixels, patch_coverage, resampled_mask, cases_file, score_files, embedding_files,
    )
}

_VOTES = """votes AS (SELECT DISTINCT l_suppkey AS case_id, l_linenumber AS fold, l_partkey % 200 AS voxel FROM lineitem WHERE l_linenumber <= 5),
truth AS (SELECT DISTINCT l_suppkey AS case_id, l_partkey % 200 AS voxel FROM lineitem WHERE l_linenumber >= 6),
folds AS (SELECT case_id, fold, CASE WHEN (case_id + fold) % 4 = 0 THEN 2 ELSE 1 END AS shape FROM (SELECT DISTINCT case_id FROM votes), range(1, 7) AS r(fold)),
usable AS (SELECT case_id, fold FROM folds f WHERE shape = (SELECT arg_min(shape, fold) FROM folds g WHERE g.case_id = f.case_id)),
cases AS (SELECT case_id, 6::BIGINT AS n_files, count(*) AS n_usable FROM usable GROUP BY case_id)"""
_DICE = """a AS (SELECT case_id, fold, count(*) AS na FROM votes GROUP BY ALL), b AS (SELECT case_id, count(*) AS nb FROM truth GROUP BY ALL),
i AS (SELECT case_id, fold, count(*) AS k FROM votes JOIN truth USING (case_id, voxel) GROUP BY ALL),
d AS (SELECT case_id, fold, 2.0::DOUBLE * coalesce(k, 0) / (na + nb) AS dice FROM a JOIN b USING (case_id) LEFT JOIN i USING (case_id, fold))"""
_FILES = """sites AS (SELECT 'N' || n_nationkey AS site, n_nationkey % 3 = 0 AS split FROM nation),
images AS (SELECT 'N' || s_nationkey AS site, 'c' || s_suppkey AS base_id, '/d/c' || s_suppkey AS path, s_suppkey FROM supplier),
halves AS (SELECT site, base_id, path, s_suppkey, unnest(CASE WHEN split THEN ['L', 'R'] ELSE [NULL] END) AS side FROM images JOIN sites USING (site)),
ids AS (SELECT site, concat_ws('_', base_id, side) AS case_id, base_id, path, side, s_suppkey FROM halves)"""
_FEATURES = """wide AS (
    SELECT o_custkey AS case_id, avg(p) AS mean, count(*)::DOUBLE AS "count", max(p) AS "max", stddev_pop(p) AS sd, sum(p) AS "sum", sqrt(sum(p * p)) AS energy,
           7.0::DOUBLE AS "constant", pow(count(*)::DOUBLE, 8) AS tail
    FROM (SELECT o_custkey, o_totalprice::DOUBLE AS p FROM orders) GROUP BY o_custkey),
f AS (SELECT case_id, 'R' || (case_id % 3) AS site, feature, CASE WHEN case_id % 17 = 0 AND feature = 'sd' THEN NULL ELSE value END AS value FROM (UNPIVOT wide ON COLUMNS (* EXCLUDE case_id) INTO NAME feature VALUE value))"""
_CASES = """cs AS (SELECT u.user_id, CASE WHEN u.user_id % 7 <> 6 THEN (c_acctbal::DOUBLE + 1000) / 11000 END AS dice
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN customer ON c_custkey = u.user_id)"""
_PIXELS = """px AS (SELECT l_suppkey AS case_id, ((l_partkey % 200) // 20)::INT AS y, (l_partkey % 20)::INT AS x, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL),
m AS (SELECT case_id, y, x FROM px WHERE v > 50)"""
_GREY = """w AS (SELECT case_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM px GROUP BY ALL),
grey AS (SELECT case_id, y, x, CASE WHEN hi = lo THEN 0 ELSE floor(least(greatest((v - lo) * 255 / (hi - lo), 0), 255)) END::INT AS g FROM px JOIN w USING (case_id))"""

ORACLE: dict[str, str] = {
    "vote_usable_folds": f"WITH {_VOTES} SELECT case_id, voxel, count(*) AS votes FROM votes JOIN usable USING (case_id, fold) JOIN cases USING (case_id) WHERE n_usable >= 2 GROUP BY ALL HAVING count(*) >= 3",
    "vote_cases": f"WITH {_VOTES} SELECT case_id, n_files, n_usable, n_usable >= 2 AS votable FROM cases",
    "ens_mpd": f"""WITH {_VOTES}, n AS (SELECT f.case_id, f.fold, count(v.voxel) AS n FROM folds f LEFT JOIN votes v USING (case_id, fold) GROUP BY ALL),
        p AS (SELECT a.case_id, a.fold AS f, b.fold AS g, a.n + b.n AS n FROM n a JOIN n b ON a.case_id = b.case_id AND a.fold < b.fold),
        i AS (SELECT a.case_id, a.fold AS f, b.fold AS g, count(*) AS k FROM votes a JOIN votes b ON a.case_id = b.case_id AND a.voxel = b.voxel AND a.fold < b.fold GROUP BY ALL),
        d AS (SELECT case_id, -avg(CASE WHEN n > 0 THEN 2.0::DOUBLE * coalesce(k, 0) / n END) AS score FROM p LEFT JOIN i USING (case_id, f, g) GROUP BY case_id)
        SELECT s_suppkey AS case_id, 'S' AS site, 'ens_mpd' AS method, round(score, 6) AS score FROM supplier LEFT JOIN d ON case_id = s_suppkey""",
    "site_dice": f"WITH {_VOTES}, {_DICE} SELECT case_id, round(avg(dice), 6) AS dice FROM d GROUP BY case_id",
    "site_dice_reference": f"WITH {_VOTES}, {_DICE} SELECT case_id, round(dice, 6) AS dice FROM d WHERE fold = case_id % 5 + 1",
    "site_dice_halves": f"""WITH {_VOTES}, hv AS (SELECT case_id || CASE WHEN voxel % 10 < 5 THEN '_L' ELSE '_R' END AS c, fold, voxel FROM votes),
        ht AS (SELECT case_id || CASE WHEN voxel % 10 < 5 THEN '_L' ELSE '_R' END AS c, voxel FROM truth),
        a AS (SELECT c, fold, count(*) AS na FROM hv GROUP BY ALL), b AS (SELECT c, count(*) AS nb FROM ht GROUP BY ALL),
        i AS (SELECT c, fold, count(*) AS k FROM hv JOIN ht USING (c, voxel) GROUP BY ALL)
        SELECT c AS case_id, round(avg(2.0::DOUBLE * coalesce(k, 0) / (na + nb)), 6) AS dice FROM a JOIN b USING (c) LEFT JOIN i USING (c, fold) GROUP BY c""",
    "fold_membership": "SELECT s_suppkey::VARCHAR AS case_id, 'fold_' || greatest(s_suppkey % 5, s_suppkey % 3) AS fold FROM supplier WHERE s_suppkey % 2 = 0",
    "site_case_ids": f"WITH {_FILES} SELECT site, case_id, base_id, side FROM ids",
    "has_labels": "SELECT 'N' || n_nationkey AS site, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 <> 0) AS labelled FROM nation",
    "site_cases": f"WITH {_FILES} SELECT site, case_id, path, '/m/' || base_id AS mask_path, side, coalesce(side = 'R', false) AS flipped FROM ids WHERE s_suppkey % 4 <> 0",
    "query_atlas": f"WITH {_FILES} SELECT site, case_id, path, side FROM ids WHERE s_suppkey % 4 <> 0",
    "reference_atlas": "SELECT 'c' || s_suppkey AS case_id, '/d/c' || s_suppkey AS path, s_suppkey % 5 AS fold FROM supplier WHERE s_suppkey % 3 <> 1 AND s_suppkey % 4 <> 0",
    "reference_cases": f"WITH {_CASES} SELECT user_id::VARCHAR AS case_id, 'R' || (user_id % 3) AS site, round(dice, 6) AS dice FROM cs WHERE dice IS NOT NULL AND user_id IN (SELECT o_custkey FROM orders)",
    "query_cases": f"""WITH {_CASES} SELECT user_id::VARCHAR AS case_id, 'R' || (user_id % 3) AS site,
        CASE WHEN user_id % 5 <> 0 AND user_id IN (SELECT o_custkey FROM orders) THEN round(dice, 6) END AS dice FROM cs""",
    "keep_columns": f"WITH {_FEATURES} SELECT feature FROM f WHERE site = 'R0' GROUP BY feature HAVING bool_and(value IS NOT NULL)",
    "keep_rows": f"WITH {_FEATURES} SELECT case_id::VARCHAR AS case_id, site FROM f GROUP BY ALL HAVING bool_and(value IS NOT NULL)",
    "rad_l2_leave_out": f"""WITH {_FEATURES}, g AS (SELECT * FROM f WHERE case_id % 17 <> 0),
        o AS (SELECT a.case_id, a.feature, a.value, avg(b.value) AS mu, stddev_pop(b.value) AS sd FROM g a JOIN g b ON a.feature = b.feature AND b.site = 'R0' AND a.case_id <> b.case_id GROUP BY ALL)
        SELECT case_id::VARCHAR AS case_id, 'R' || (case_id % 3) AS site, round(sqrt(sum(pow((value - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 2))), 4) AS rad_l2 FROM o GROUP BY case_id""",
    "md_two_features": f"""WITH {_FEATURES}, v AS (SELECT case_id, site, mean AS x, "max" AS y FROM (SELECT *, 'R' || (case_id % 3) AS site FROM wide)),
        p AS (SELECT a.case_id, a.site, a.x AS ax, a.y AS ay, b.x, b.y, b.case_id AS bid FROM v a JOIN v b ON b.site = 'R0' AND a.case_id <> b.case_id),
        s AS (SELECT case_id, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, corr(x, y) AS r, count(*) AS n FROM p GROUP BY case_id),
        q AS (SELECT p.case_id, any_value(p.site) AS site, any_value((ax - mx) / sx) AS dx, any_value((ay - my) / sy) AS dy, any_value(r) AS r, any_value(n) AS n,
                     avg(pow(pow((x - mx) / sx, 2) + pow((y - my) / sy, 2), 2)) AS fourth FROM p JOIN s USING (case_id) GROUP BY p.case_id),
        w AS (SELECT *, r * r AS d2, least((fourth - 2 - 2 * r * r) / (2 * n), r * r) AS b2 FROM q),
        z AS (SELECT *, r * (1 - CASE WHEN b2 <= 0 THEN 0 ELSE b2 / d2 END) AS c FROM w)
        SELECT case_id::VARCHAR AS case_id, site, round((dx * dx - 2 * c * dx * dy + dy * dy) / (1 - c * c), 4) AS md2 FROM z""",
    "method_labels": "WITH k(method, label, i) AS (VALUES " + ", ".join(f"('{m}', '{name}', {i})" for i, (m, name) in enumerate(evaluate.LABELS.items())) + """)
        SELECT method, label, i::INT AS method_pos FROM k UNION ALL SELECT DISTINCT event_type, event_type, 17 FROM events""",
    "half_geometry": """SELECT p_partkey, side, (CASE WHEN side = 'L' THEN p_size // 2 ELSE p_size - p_size // 2 END)::INT AS n0, (p_size + 1)::INT AS n1,
        (-1.0 + CASE WHEN side = 'R' THEN (p_size // 2) * (p_partkey % 7 + 1) ELSE 0 END)::DOUBLE AS o0, 2.5::DOUBLE AS o1, p_partkey::DOUBLE AS o2 FROM part, (VALUES ('L'), ('R')) AS s(side)""",
    "window_bytes": f"WITH {_PIXELS}, {_GREY} SELECT case_id, y, x, g AS grey FROM grey",
    "normalised_volume": f"""WITH {_PIXELS}, b AS (SELECT case_id, quantile_cont(v, 0.0005) AS lo, quantile_cont(v, 0.9995) AS hi FROM px GROUP BY ALL)
        SELECT case_id, y, x, round(CASE WHEN hi > lo THEN (least(greatest(v, lo), hi) - lo) / (hi - lo) * 2 - 1 ELSE 0 END, 6) AS scaled FROM px JOIN b USING (case_id)""",
    "overlay_pixels": f"""WITH {_PIXELS}, {_GREY} SELECT case_id, y, x, (CASE WHEN i THEN floor(least(g * (1 - 0.4::DOUBLE) + 255 * 0.4::DOUBLE, 255)) ELSE g END)::INT AS r, (CASE WHEN i THEN floor(g * (1 - 0.4::DOUBLE) + 80 * 0.4::DOUBLE) ELSE g END)::INT AS g,
        (CASE WHEN i THEN floor(g * (1 - 0.4::DOUBLE)) ELSE g END)::INT AS b FROM (SELECT grey.*, m.case_id IS NOT NULL AS i FROM grey LEFT JOIN m USING (case_id, y, x))""",
    "patch_coverage": f"""WITH {_PIXELS}, k AS (SELECT unnest(range(4)) AS i),
        c AS (SELECT case_id, a.i AS patch_row, b.i AS patch_col, greatest(0, least(a.i + 1.0::DOUBLE, (y + 1) * 4 / 10.0::DOUBLE) - greatest(a.i, y * 4 / 10.0::DOUBLE)) * greatest(0, least(b.i + 1.0::DOUBLE, (x + 1) * 4 / 20.0::DOUBLE) - greatest(b.i, x * 4 / 20.0::DOUBLE)) AS s FROM m, k a, k b)
        SELECT case_id, patch_row::INT AS patch_row, patch_col::INT AS patch_col, round(sum(s), 6) AS cover FROM c WHERE s > 1e-9 GROUP BY ALL""",
    "resampled_mask": f"""WITH {_PIXELS} SELECT case_id, ny::INT AS y, nx::INT AS x FROM m, range(20) AS a(ny), range(10) AS b(nx)
        WHERE floor(ny / 2.0::DOUBLE + 0.5) = y AND floor(nx * 2.0::DOUBLE + 0.5) = x""",
    "cases_file": f"""WITH {_CASES} SELECT user_id::VARCHAR AS case_id, 'S' || (user_id % 3) AS site, round(dice, 6) AS dice,
        row_number() OVER (ORDER BY 'S' || (user_id % 3) DESC, user_id::VARCHAR) - 1 AS case_pos FROM cs""",
    "score_files": """SELECT user_id::VARCHAR AS case_id, 'S' || (user_id % 3) AS site, event_type AS method, round(round(avg(value), 9), 6) AS score
        FROM events WHERE event_type = 'click' OR event_type = 'error' AND user_id % 11 <> 3 GROUP BY ALL""",
    "embedding_files": "SELECT 'b1' AS backbone, 'img' AS mode, 'S' || (label % 3) AS site, vec_id::VARCHAR AS case_id, len(embedding)::INT AS n FROM embeddings WHERE vec_id % 2 = 1 AND label % 3 <> 1",
}
