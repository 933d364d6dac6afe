"""Registered audit queries and the DuckDB SQL each is checked against. Doubles are rounded to 6 digits on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import columns as C
from auditloom.operators import bootstrap, completeness, mahalanobis, rank, stats, voxels
from auditloom.plans import audit, casework
from auditloom.session import cut_lineage, table

REPLICATES = bootstrap.REPLICATES


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods, _, sites = audit.registry(spark)
    cases, scores = cut_lineage(audit.cases(spark, sf_dir)), cut_lineage(audit.scores(spark, sf_dir))  # read several times below
    return cut_lineage(completeness.complete_scores(cases, scores, methods, sites))


def eaurc_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rank.eaurc_by_method(_scored(spark, sf_dir)), "eaurc_within", "eaurc_pooled")


def aurc_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    stretches = 1 if scored.limit(rank.ONE_SORT_ROWS + 1).count() <= rank.ONE_SORT_ROWS else rank.STRETCHES
    got = rank.excess_aurc(scored, ["site", "method"], ["site"], [F.col("case_pos")], stretches)
    return _round(got.select("site", "method", "n", "aurc", "oracle_aurc", "eaurc"), "aurc", "oracle_aurc", "eaurc")


def labelled_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = audit.registry(spark)[2]
    sites = sites.unionByName(spark.createDataFrame([("S9", 3)], "site string, site_pos int"))
    return completeness.labelled_sites(sites, audit.cases(spark, sf_dir)).select("site", "n_cases", "n_labelled", "usable", "reason")


def complete_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = completeness.complete_methods(audit.registry(spark)[0], audit.cases(spark, sf_dir), audit.scores(spark, sf_dir))
    return got.select("method", "n_scored", "n_missing", "complete")


def missing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.missing_scores("error", audit.cases(spark, sf_dir), audit.scores(spark, sf_dir))


def failure_scores_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = completeness.wide_scores(audit.cases(spark, sf_dir), audit.scores(spark, sf_dir), audit.METHODS)
    return _round(wide, "dice", *audit.METHODS)


def _replicates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return bootstrap.replicates_and_points(_scored(spark, sf_dir), REPLICATES)


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bootstrap.bootstrap_ci(*_replicates(spark, sf_dir))
    return _round(got, *[c for c in got.columns if c not in ("method", "n_boot")])


def paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bootstrap.paired_tests(*_replicates(spark, sf_dir), audit.registry(spark)[1])
    return _round(got, *[c for c in got.columns if c not in ("method", "reference", "n_boot")])


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.majority_vote(audit.votes(spark, sf_dir)).select("case_id", "voxel", "votes")


def vote_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(voxels.vote_dice(voxels.majority_vote(audit.votes(spark, sf_dir)), audit.truth(spark, sf_dir)), "dice")


def mean_pairwise_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(voxels.mean_pairwise_dice(audit.votes(spark, sf_dir)).select("case_id", "mean_dice", "n_pairs"), "mean_dice")


def bilateral_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = voxels.split_halves(audit.placed(voxels.majority_vote(audit.votes(spark, sf_dir))), "x", audit.GRID["x"])
    flipped = F.when(F.col("side") == "R", voxels.mirror(F.col("x"), 5)).otherwise(F.col("x"))
    return halves.groupBy("case_id", "side").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum(flipped).alias("sum_flipped"))


def slice_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.slice_areas(audit.placed(voxels.majority_vote(audit.votes(spark, sf_dir))))


def atlas_max_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = voxels.majority_vote(audit.votes(spark, sf_dir))
    truth = audit.truth(spark, sf_dir).withColumnRenamed("case_id", "ref_id")
    return _round(voxels.atlas_max_dice(masks, truth).select("case_id", "max_dice"), "max_dice")


def area_weighted_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = voxels.slice_areas(audit.placed(voxels.majority_vote(audit.votes(spark, sf_dir)))).where("selected")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    total = vectors.agg(F.count("*").alias("n"))
    joined = areas.join(F.broadcast(total)).withColumn("vec_id", (F.col("case_id") * 5 + F.col("z")) % F.col("n")).join(vectors, "vec_id")
    parts = joined.select("case_id", "area", F.posexplode("embedding").alias("dim", "v"))
    return _round(parts.groupBy("case_id", "dim").agg((F.sum(F.col("v").cast("double") * F.col("area")) / F.sum("area")).alias("value")), "value")


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(C.l2_normalise(F.col("embedding"))).alias("dim", "value"))
    return _round(unit, "value")


def zscore_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.rad_l2(audit.features(spark, sf_dir), audit.reference_features(spark, sf_dir)), "rad_l2")


def feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.feature_filter(audit.reference_features(spark, sf_dir)).select("feature", "cv", "kurtosis", "kept")
    return _round(got, "cv", "kurtosis")


def feature_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.correlations(audit.reference_features(spark, sf_dir)), "r")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def ledoit_wolf_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mahalanobis.shrinkage_terms(_embeddings(spark, sf_dir).where("label = 0"))
    return got.select("n", "p", *[F.round(c, 6).alias(c) for c in ("mu", "frobenius", "fourth", "shrinkage")])


def md_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mahalanobis.mahalanobis(_embeddings(spark, sf_dir), F.col("label") == 0, "l2")


def case_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("S_0000.nii_"), key, F.lit("_L_0000.nii.gz"))).otherwise(F.concat(F.lit("S"), key, F.lit("_R_0000.nii")))
    files = table(spark, sf_dir, "supplier").select(name.alias("file"))
    return files.select("file", C.strip_channel(F.col("file")).alias("stripped"), C.base_id(F.col("file")).alias("case_id"), C.side_of(C.base_id(F.col("file"))).alias("side"))


def unvoted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of any fold without a voxel that all five folds mark (O-95, O-115)."""
    votes = audit.votes(spark, sf_dir)
    return votes.select("case_id").distinct().join(voxels.majority_vote(votes, threshold=5).select("case_id"), "case_id", "left_anti")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        eaurc_by_method, aurc_per_site, labelled_sites, complete_methods, missing_scores, failure_scores_wide, bootstrap_ci, paired_tests,
        majority_vote, vote_dice, mean_pairwise_dice, bilateral_split, slice_selection, atlas_max_dice, area_weighted_embedding, l2_normalize,
        zscore_l2, feature_filter, feature_corr, ledoit_wolf_shrinkage, md_embeddings, case_id_parse, unvoted_cases,
    )
}

_CASES = """cases AS (
    SELECT u.user_id, u.user_id::VARCHAR AS case_id, 'S' || (u.user_id % 3) AS site, u.user_id AS case_pos,
           CASE WHEN u.user_id % 7 <> 6 THEN (c_acctbal::DOUBLE + 1000) / 11000 END AS dice
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN customer ON c_custkey = u.user_id),
scores AS (
    SELECT user_id::VARCHAR AS case_id, 'S' || (user_id % 3) AS site, event_type AS method, round(avg(value), 9) AS score
    FROM events WHERE NOT (event_type = 'error' AND user_id % 11 = 3) GROUP BY ALL),
ok AS (
    SELECT method FROM scores JOIN cases USING (case_id, site) WHERE dice IS NOT NULL
    GROUP BY method HAVING count(*) = (SELECT count(*) FROM cases WHERE dice IS NOT NULL)),
scored AS (
    SELECT c.case_id, c.site, c.case_pos, c.dice, s.method, s.score FROM cases c JOIN scores s USING (case_id, site)
    WHERE dice IS NOT NULL AND method IN (SELECT method FROM ok)
      AND site IN (SELECT site FROM cases WHERE dice IS NOT NULL GROUP BY site HAVING count(*) >= 4))"""
_SITES = """ranked AS (
    SELECT site, method, case_pos,
           sum(1 - dice) OVER (PARTITION BY site, method ORDER BY score, case_pos DESC ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY site, method ORDER BY score, case_pos DESC) AS r,
           sum(1 - dice) OVER (PARTITION BY site, method ORDER BY 1 - dice, case_pos DESC ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY site, method ORDER BY 1 - dice, case_pos DESC) AS o
    FROM scored),
per_site AS (SELECT site, method, count(*) AS n, avg(r) AS aurc, avg(o) AS oracle_aurc, avg(r) - avg(o) AS eaurc FROM ranked GROUP BY site, method)"""
_POOLED = """pooled AS (
    SELECT method, avg(r) - avg(o) AS eaurc FROM (
        SELECT method,
               sum(1 - dice) OVER (PARTITION BY method ORDER BY score, site DESC, case_pos DESC ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY method ORDER BY score, site DESC, case_pos DESC) AS r,
               sum(1 - dice) OVER (PARTITION BY method ORDER BY 1 - dice, site DESC, case_pos DESC ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY method ORDER BY 1 - dice, site DESC, case_pos DESC) AS o
        FROM scored) GROUP BY method),
points AS (SELECT s.method, avg(s.eaurc) AS w, any_value(p.eaurc) AS p FROM per_site s JOIN pooled p USING (method) GROUP BY s.method)"""
_BOOT = f"""placed AS (SELECT case_id, site, dice, row_number() OVER (PARTITION BY site ORDER BY case_pos) - 1 AS i FROM (SELECT DISTINCT case_id, site, dice, case_pos FROM scored)),
sizes AS (SELECT site, count(*) AS n FROM placed GROUP BY site),
draws AS (
    SELECT rep, site, d, ('0x' || substr(md5('42|' || site || '|' || rep || '|' || d), 1, 8))::BIGINT % n AS i
    FROM sizes, range({REPLICATES}) AS r(rep), range(10000) AS q(d) WHERE d < n),
drawn AS (SELECT d.rep, d.site, d.d, s.method, s.score, s.dice FROM draws d JOIN placed p USING (site, i) JOIN scored s ON s.case_id = p.case_id AND s.site = p.site),
bs AS (
    SELECT rep, method, avg(e) AS w FROM (
        SELECT rep, site, method, avg(r) - avg(o) AS e FROM (
            SELECT rep, site, method,
                   sum(1 - dice) OVER (PARTITION BY rep, site, method ORDER BY score, d DESC ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY rep, site, method ORDER BY score, d DESC) AS r,
                   sum(1 - dice) OVER (PARTITION BY rep, site, method ORDER BY 1 - dice, d DESC ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY rep, site, method ORDER BY 1 - dice, d DESC) AS o
            FROM drawn) GROUP BY ALL) GROUP BY ALL),
bp AS (
    SELECT rep, method, avg(r) - avg(o) AS p FROM (
        SELECT rep, method,
               sum(1 - dice) OVER (PARTITION BY rep, method ORDER BY score, site DESC, d DESC ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY rep, method ORDER BY score, site DESC, d DESC) AS r,
               sum(1 - dice) OVER (PARTITION BY rep, method ORDER BY 1 - dice, site DESC, d DESC ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY rep, method ORDER BY 1 - dice, site DESC, d DESC) AS o
        FROM drawn) GROUP BY ALL),
boot AS (SELECT rep, method, w, p FROM bs JOIN bp USING (rep, method))"""
_VOTES = """votes AS (SELECT DISTINCT l_suppkey AS case_id, l_linenumber AS fold, l_partkey % 200 AS voxel FROM lineitem WHERE l_linenumber <= 5),
mask AS (SELECT case_id, voxel, count(DISTINCT fold) AS votes FROM votes GROUP BY ALL HAVING count(DISTINCT fold) >= 3),
truth AS (SELECT DISTINCT l_suppkey AS case_id, l_partkey % 200 AS voxel FROM lineitem WHERE l_linenumber >= 6),
areas AS (SELECT case_id, voxel // 40 AS z, count(*) AS area FROM mask GROUP BY ALL),
slices AS (SELECT case_id, z::INT AS z, area, area >= CASE WHEN max(area) OVER (PARTITION BY case_id) >= 10 THEN 10 ELSE 1 END AS selected FROM areas)"""
_FEATURES = """wide AS (
    SELECT o_custkey AS case_id, avg(p) AS mean, count(*)::DOUBLE AS "count", max(p) AS "max", stddev_pop(p) AS sd, sum(p) AS "sum", sqrt(sum(p * p)) AS energy,
           7.0::DOUBLE AS "constant", pow(count(*)::DOUBLE, 8) AS tail
    FROM (SELECT o_custkey, o_totalprice::DOUBLE AS p FROM orders) GROUP BY o_custkey),
features AS (UNPIVOT wide ON COLUMNS (* EXCLUDE case_id) INTO NAME feature VALUE value)"""
_EMB = "emb AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"

ORACLE: dict[str, str] = {
    "eaurc_by_method": f"WITH {_CASES}, {_SITES}, {_POOLED} SELECT method, round(w, 6) AS eaurc_within, round(p, 6) AS eaurc_pooled FROM points",
    "aurc_per_site": f"WITH {_CASES}, {_SITES} SELECT site, method, n, round(aurc, 6) AS aurc, round(oracle_aurc, 6) AS oracle_aurc, round(eaurc, 6) AS eaurc FROM per_site",
    "labelled_sites": f"""WITH {_CASES}, s(site) AS (VALUES ('S0'), ('S1'), ('S2'), ('S9')),
        c AS (SELECT s.site, count(case_id) AS n_cases, count(dice) AS n_labelled FROM s LEFT JOIN cases USING (site) GROUP BY s.site)
        SELECT site, n_cases, n_labelled, n_labelled >= 4 AS usable,
               CASE WHEN n_cases = 0 THEN 'no cases' WHEN n_labelled = 0 THEN 'no labelled cases' WHEN n_labelled < 4 THEN 'fewer than 4 labelled cases' END AS reason FROM c""",
    "complete_methods": f"""WITH {_CASES}, t AS (SELECT count(*) AS n FROM cases WHERE dice IS NOT NULL)
        SELECT method, count(dice) AS n_scored, any_value(n) - count(dice) AS n_missing, count(dice) = any_value(n) AS complete
        FROM scores JOIN cases USING (case_id, site), t GROUP BY method""",
    "missing_scores": f"WITH {_CASES} SELECT site || '/' || case_id AS missing FROM cases WHERE dice IS NOT NULL AND case_id NOT IN (SELECT case_id FROM scores WHERE method = 'error')",
    "failure_scores_wide": f"WITH {_CASES} SELECT case_id, site, round(any_value(dice), 6) AS dice, "
    + ", ".join(f"round(max(score) FILTER (method = '{m}'), 6) AS {m}" for m in audit.METHODS)
    + " FROM cases LEFT JOIN scores USING (case_id, site) GROUP BY case_id, site",
    "bootstrap_ci": f"""WITH {_CASES}, {_SITES}, {_POOLED}, {_BOOT}
        SELECT method, round(any_value(q.w), 6) AS eaurc_within, round(any_value(q.p), 6) AS eaurc_pooled, count(*) AS n_boot,
               round(quantile_cont(b.w, 0.025), 6) AS within_low, round(quantile_cont(b.w, 0.975), 6) AS within_high,
               round(quantile_cont(b.p, 0.025), 6) AS pooled_low, round(quantile_cont(b.p, 0.975), 6) AS pooled_high
        FROM boot b JOIN points q USING (method) GROUP BY method""",
    "paired_tests": f"""WITH {_CASES}, {_SITES}, {_POOLED}, {_BOOT}, pairs(method, reference) AS (VALUES ('view', 'error'), ('view', 'click'), ('purchase', 'error')),
        d AS (SELECT x.method, x.reference, a.w - b.w AS w, a.p - b.p AS p FROM pairs x JOIN boot a ON a.method = x.method JOIN boot b ON b.method = x.reference AND a.rep = b.rep),
        q AS (SELECT x.method, x.reference, a.w - b.w AS w, a.p - b.p AS p FROM pairs x JOIN points a ON a.method = x.method JOIN points b ON b.method = x.reference)
        SELECT d.method, d.reference, round(any_value(q.w), 6) AS within_diff, round(any_value(q.p), 6) AS pooled_diff, count(d.w) AS n_boot,
               round(quantile_cont(d.w, 0.025), 6) AS within_low, round(quantile_cont(d.w, 0.975), 6) AS within_high,
               round(least(1.0, 2.0 * (least(count(*) FILTER (d.w <= 0), count(*) FILTER (d.w >= 0)) + 1) / (count(*) + 1)), 6)::DOUBLE AS within_p,
               round(quantile_cont(d.p, 0.025), 6) AS pooled_low, round(quantile_cont(d.p, 0.975), 6) AS pooled_high,
               round(least(1.0, 2.0 * (least(count(*) FILTER (d.p <= 0), count(*) FILTER (d.p >= 0)) + 1) / (count(*) + 1)), 6)::DOUBLE AS pooled_p
        FROM d JOIN q USING (method, reference) GROUP BY d.method, d.reference""",
    "majority_vote": f"WITH {_VOTES} SELECT case_id, voxel, votes FROM mask",
    "vote_dice": f"""WITH {_VOTES}, a AS (SELECT case_id, count(*) AS na FROM mask GROUP BY ALL), b AS (SELECT case_id, count(*) AS nb FROM truth GROUP BY ALL),
        i AS (SELECT case_id, count(*) AS ni FROM mask JOIN truth USING (case_id, voxel) GROUP BY ALL)
        SELECT case_id, round(2.0::DOUBLE * coalesce(ni, 0) / (na + nb), 6) AS dice FROM a JOIN b USING (case_id) LEFT JOIN i USING (case_id)""",
    "mean_pairwise_dice": f"""WITH {_VOTES}, s AS (SELECT case_id, fold, count(*) AS n FROM votes GROUP BY ALL),
        p AS (SELECT a.case_id, a.fold AS f, b.fold AS g, a.n + b.n AS n FROM s a JOIN s b ON a.case_id = b.case_id AND a.fold < b.fold),
        i AS (SELECT a.case_id, a.fold AS f, b.fold AS g, count(*) AS k FROM votes a JOIN votes b ON a.case_id = b.case_id AND a.voxel = b.voxel AND a.fold < b.fold GROUP BY ALL)
        SELECT case_id, round(avg(2.0::DOUBLE * coalesce(k, 0) / n), 6) AS mean_dice, count(*) AS n_pairs FROM p LEFT JOIN i USING (case_id, f, g) GROUP BY case_id""",
    "bilateral_split": f"""WITH {_VOTES}, v AS (SELECT case_id, voxel % 10 AS x FROM mask)
        SELECT case_id, CASE WHEN x < 5 THEN 'L' ELSE 'R' END AS side, count(*) AS n, sum(x % 5)::BIGINT AS sum_x,
               sum(CASE WHEN x < 5 THEN x ELSE 4 - x % 5 END)::BIGINT AS sum_flipped FROM v GROUP BY ALL""",
    "slice_selection": f"WITH {_VOTES} SELECT case_id, z, area, selected FROM slices",
    "atlas_max_dice": f"""WITH {_VOTES}, q AS (SELECT case_id, voxel FROM mask), r AS (SELECT case_id AS ref_id, voxel FROM truth),
        qs AS (SELECT case_id, count(*) AS na FROM q GROUP BY ALL), rs AS (SELECT ref_id, count(*) AS nb FROM r GROUP BY ALL),
        i AS (SELECT case_id, ref_id, count(*) AS k FROM q JOIN r USING (voxel) GROUP BY ALL)
        SELECT case_id, round(max(2.0::DOUBLE * coalesce(k, 0) / (na + nb)), 6) AS max_dice FROM qs CROSS JOIN rs LEFT JOIN i USING (case_id, ref_id) GROUP BY case_id""",
    "area_weighted_embedding": f"""WITH {_VOTES}, {_EMB}
        SELECT case_id, dim::INT AS dim, round(sum(x * area) / sum(area), 6) AS value FROM slices JOIN emb ON vec_id = (case_id * 5 + z) % (SELECT count(*) FROM embeddings) WHERE selected GROUP BY case_id, dim""",
    "l2_normalize": f"WITH {_EMB}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS len FROM emb GROUP BY vec_id) SELECT vec_id, dim::INT AS dim, round(CASE WHEN len < 1e-12 THEN x ELSE x / len END, 6) AS value FROM emb JOIN n USING (vec_id)",
    "zscore_l2": f"""WITH {_FEATURES}, m AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM features WHERE case_id % 3 = 0 GROUP BY feature)
        SELECT case_id, round(sqrt(sum(pow((value - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 2))), 6) AS rad_l2 FROM features JOIN m USING (feature) GROUP BY case_id""",
    "feature_filter": f"""WITH {_FEATURES}, m AS (
            SELECT feature, stddev_pop(value) / greatest(abs(avg(value)), 1e-12) AS cv, CASE WHEN stddev_pop(value) > 0 THEN kurtosis_pop(value) END AS k FROM features WHERE case_id % 3 = 0 GROUP BY feature)
        SELECT feature, round(cv, 6) AS cv, round(k, 6) AS kurtosis, cv >= 0.01 AND coalesce(k <= 5, false) AS kept FROM m""",
    "feature_corr": f"""WITH {_FEATURES}, f AS (SELECT * FROM features WHERE case_id % 3 = 0)
        SELECT a.feature AS feature_a, b.feature AS feature_b,
               round(CASE WHEN stddev_pop(a.value) * stddev_pop(b.value) > 0 THEN covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) END, 6) AS r
        FROM f a JOIN f b ON a.case_id = b.case_id AND a.feature < b.feature GROUP BY ALL""",
    "ledoit_wolf_shrinkage": f"""WITH {_EMB}, e AS (SELECT vec_id, dim, x - avg(x) OVER (PARTITION BY dim) AS c FROM emb WHERE label = 0),
        s AS (SELECT a.dim AS i, b.dim AS j, avg(a.c * b.c) AS s FROM e a JOIN e b USING (vec_id) GROUP BY ALL),
        q AS (SELECT count(*) AS n, avg(k) / 64 AS mu, avg(k * k) AS fourth FROM (SELECT vec_id, sum(c * c) AS k FROM e GROUP BY vec_id)),
        t AS (SELECT n, mu, fourth, (SELECT sum(s * s) FROM s) AS fro FROM q),
        u AS (SELECT *, (fro - 64 * mu * mu) / 64 AS d2, (fourth - fro) / (64 * n) AS b2 FROM t)
        SELECT n, 64 AS p, round(mu, 6) AS mu, round(fro, 6) AS frobenius, round(fourth, 6) AS fourth,
               round(CASE WHEN least(b2, d2) <= 0 THEN 0 ELSE least(b2, d2) / d2 END, 6) AS shrinkage FROM u""",
    "case_id_parse": r"""WITH f AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'S_0000.nii_' || s_suppkey || '_L_0000.nii.gz' ELSE 'S' || s_suppkey || '_R_0000.nii' END AS file FROM supplier),
        g AS (SELECT file, regexp_replace(file, '_0000(\.nii(\.gz)?)$', '\1') AS stripped FROM f), h AS (SELECT *, replace(replace(stripped, '.nii.gz', ''), '.nii', '') AS case_id FROM g)
        SELECT file, stripped, case_id, CASE WHEN regexp_matches(case_id, '_[LR]$') THEN right(case_id, 1) END AS side FROM h""",
    "unvoted_cases": f"WITH {_VOTES} SELECT DISTINCT case_id FROM votes WHERE case_id NOT IN (SELECT case_id FROM mask WHERE votes >= 5)",
}
QUERIES |= casework.QUERIES
ORACLE |= casework.ORACLE
