"""The evaluation of failure scores, from case and score tables to the two result tables; nothing is left out in silence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import missing_to_null, require_unique
from auditloom.operators import bootstrap, completeness, rank
from auditloom.session import cut_lineage

# Method keys, their labels, and the paired tests (method, reference), in the order of reports.
LABELS = {
    "ens_mpd": "Ens-Mpd", "atlas_rca": "Atlas-RCA", "rad_l2": "Rad-L2", "rad_md_img": "Rad-MD-Img", "rad_md_mask": "Rad-MD-Mask",
    "dinov3_md_img": "DINOv3-MD-Img", "dinov3_md_ov": "DINOv3-MD-Ov", "dinov3_md_w": "DINOv3-MD-W", "dinov3_md_ovw": "DINOv3-MD-OvW",
    "raddino_md_img": "RadDINO-MD-Img", "raddino_md_ov": "RadDINO-MD-Ov", "raddino_md_w": "RadDINO-MD-W", "raddino_md_ovw": "RadDINO-MD-OvW",
    "3dino_md_img": "3DINO-MD-Img", "3dino_md_ov": "3DINO-MD-Ov", "3dino_md_w": "3DINO-MD-W", "3dino_md_ovw": "3DINO-MD-OvW",
}
PAIRED = (("dinov3_md_ovw", "rad_md_mask"), ("rad_md_mask", "atlas_rca"), ("rad_md_mask", "ens_mpd"), ("dinov3_md_ovw", "atlas_rca"), ("dinov3_md_ovw", "ens_mpd"))
#: Names of the result columns, by scope.
NAMES = {"pooled": "E_AURC_pooled", "within": "E_AURC_within_mean"}


def with_label(methods: DataFrame) -> DataFrame:
    """Adds ``label`` and the report's ``method_pos``; an unknown key is its own label and comes last (O-39)."""
    keys = list(LABELS)
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    place = F.array_position(F.array(*map(F.lit, keys)), F.col("method"))
    return methods.withColumns({"label": F.coalesce(F.try_element_at(known, F.col("method")), F.col("method")), "method_pos": F.when(place > 0, place - 1).otherwise(len(keys)).cast("int")})


def scores_table(cases: DataFrame, scores: DataFrame, sites: DataFrame, methods: Sequence[str] = tuple(LABELS)) -> DataFrame:
    """One row for each case of the query sites, in their order, one column for each method that has scores (O-92, O-103, O-104).

    Methods that no row names have no column; cases without any score stay.
    """
    present = {r.method for r in scores.where(F.col("method").isin(list(methods))).select("method").distinct().collect()}
    wide = completeness.wide_scores(cases.join(sites.select("site"), "site", "left_semi"), scores, [m for m in methods if m in present])
    order = cases.select("case_id", "site", "case_pos").join(sites.select("site", "site_pos"), "site")
    return wide.join(order, ["case_id", "site"]).orderBy("site_pos", "case_pos")


def checked(cases: DataFrame, scores: DataFrame, sites: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Every case of ``sites`` times every method, written once; an error if anything is missing (O-87, O-93, O-105).

    A case without a Dice, a method that lacks a case and a site with fewer than MIN_CASES cases raise ValueError, a
    repeated key fails the run.
    """
    own = cases.withColumn("dice", missing_to_null(F.col("dice"))).join(F.broadcast(sites.select("site", "site_pos")), "site")
    own = cut_lineage(require_unique(own, "case_id", "site"))
    wanted = scores.where(F.col("method").isin(list(methods))).withColumn("score", missing_to_null(F.col("score"))).where("score is not null")
    rows = cut_lineage(require_unique(wanted, "case_id", "site", "method").join(own, ["case_id", "site"]))
    total, unknown = own.agg(F.count("*"), F.count_if(F.col("dice").isNull())).first()
    have = {r.method: r.n for r in rows.groupBy("method").agg(F.count("*").alias("n")).collect()}
    missing = {m: total - have.get(m, 0) for m in methods if have.get(m, 0) < total}
    if missing or unknown:
        raise ValueError(f"cannot evaluate: cases without a score {missing}, cases without a Dice {unknown}")
    sizes = {r.site: r.n for r in sites.select("site").join(own.groupBy("site").agg(F.count("*").alias("n")), "site", "left").fillna(0).collect()}
    if few := {s: n for s, n in sizes.items() if n < completeness.MIN_CASES}:
        raise ValueError(f"sites with fewer than {completeness.MIN_CASES} cases: {few}")
    return rows


def evaluate(
    cases: DataFrame, scores: DataFrame, sites: DataFrame, methods: Sequence[str], pairs: Sequence[tuple[str, str]] = PAIRED,
    replicates: int = bootstrap.REPLICATES, seed: int = bootstrap.SEED, confidence: float = 0.95,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of excess AURCs and of paired tests, and the cases of each site (O-87, O-88, O-89, O-105, O-137).

    ``cases``: ``case_id, site, dice, case_pos``; ``sites``: ``site, site_pos``. Rows come in the order of methods and of pairs.
    """
    scored = checked(cases, scores, sites, methods)
    points = cut_lineage(rank.eaurc_by_method(scored))
    drawn = cut_lineage(bootstrap.replicate_table(scored, replicates, seed))
    table = bootstrap.bootstrap_ci(drawn, points, confidence)
    table = with_label(table).orderBy("method_pos", "method").select("method", "label", *_fields(("low", "high")))
    spark = cases.sparkSession
    asked = [(m, r, i) for i, (m, r) in enumerate(pairs) if m in methods and r in methods]
    asked = spark.createDataFrame(asked, "method string, reference string, pair_pos int")
    tests = bootstrap.paired_tests(drawn, points, asked, confidence).join(F.broadcast(asked), ["method", "reference"]).orderBy("pair_pos")
    tests = tests.withColumnsRenamed({"within_diff": "eaurc_within", "pooled_diff": "eaurc_pooled"})
    tests = tests.select("method", F.col("reference").alias("ref"), *reversed_scopes(_fields(("low", "high", "p"))), "n_boot")
    counts = sites.join(scored.select("site", "case_id").distinct().groupBy("site").agg(F.count("*").alias("n")), "site").orderBy("site_pos").select("site", "n")
    return table, tests, counts


def _fields(ends: Sequence[str]) -> list:
    names = {"low": "ci_lo", "high": "ci_hi", "p": "pval"}
    return [c for scope, name in NAMES.items() for c in (F.col(f"eaurc_{scope}").alias(name), *[F.col(f"{scope}_{e}").alias(f"{name}_{names[e]}") for e in ends])]


def reversed_scopes(columns: list) -> list:
    """Tests name the scope within sites first."""
    half = len(columns) // 2
    return columns[half:] + columns[:half]


def usable(cases: DataFrame, scores: DataFrame, sites: DataFrame, methods: Sequence[str] = tuple(LABELS)) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """What can be evaluated: sites, complete methods in order, and the reports of the sites and methods left out (O-99 to O-102)."""
    spark = cases.sparkSession
    report = cut_lineage(completeness.labelled_sites(sites, cases))
    kept = report.where("usable").select("site", "site_pos")
    own = completeness.evaluated(cases).join(F.broadcast(kept.select("site")), "site", "left_semi")
    registry = spark.createDataFrame([(m, i) for i, m in enumerate(methods)], "method string, method_pos int")
    complete = cut_lineage(completeness.complete_methods(registry, own, scores))
    names = [r.method for r in complete.where("complete").orderBy("method_pos").collect()]
    return kept, names, report.where("not usable"), complete.where("not complete")


def report_lines(table: DataFrame, tests: DataFrame, counts: DataFrame) -> list[str]:
    """The result tables in hundredths, as lines of text (O-26); results are a few rows."""

    def span(name: str, digits: int):
        parts = [F.col(name), F.col(f"{name}_ci_lo"), F.col(f"{name}_ci_hi")]
        return F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", *[F.coalesce(100 * p, F.lit(float("nan"))) for p in parts])

    sizes = counts.collect()
    lines = [f"Excess AURC in hundredths over {sum(r.n for r in sizes)} cases of {', '.join(r.site for r in sizes)}; less is better", f"{'':<17}{'all sites as one':>22}{'mean of sites':>22}"]
    for r in table.select("label", span("E_AURC_pooled", 1).alias("p"), span("E_AURC_within_mean", 1).alias("w")).collect():
        lines.append(f"{r.label:<17}{r.p:>22}{r.w:>22}")
    lines.append("Differences of the first method less the second, in hundredths")
    shown = [F.concat(span(n, 2), F.format_string("  p=%.4f", F.coalesce(F.col(f"{n}_pval"), F.lit(float("nan"))))).alias(s) for s, n in (("within", "E_AURC_within_mean"), ("pooled", "E_AURC_pooled"))]
    for r in tests.select("method", "ref", *shown).collect():
        lines += [f"  {LABELS.get(r.method, r.method)} less {LABELS.get(r.ref, r.ref)}, {scope}: {r[scope]}" for scope in ("within", "pooled")]
    return lines
