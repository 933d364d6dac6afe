"""The four stages of an audit and their command line; they meet in files, so each can be run on its own.

    python -m auditloom.stages --benchmark benchmark.yaml --stage evaluate --out_dir shared/folder
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.columns import base_id
from auditloom.operators import assembly, evaluate, scoring, voxels
from auditloom.plugins import run as plugins
from auditloom.session import cut_lineage, get_spark
from auditloom.sources import nifti, tables
from auditloom.sources.benchmark import Benchmark, Site, load_benchmark

STAGES = ("extract", "fm", "baselines", "evaluate")
Say = Callable[[str], None]


def _images(spark: SparkSession, site: Site) -> DataFrame:
    """``site, path, file`` of a site's images: the first of its two image folders that has any (O-04)."""
    files = nifti.list_volumes(spark, site.images)
    return nifti.prefer_folder(files.withColumn("site", F.lit(site.site)), ["imagesTr", "images"], ["site"])


def _labels(spark: SparkSession, site: Site) -> DataFrame:
    """``site, path, file`` of a site's label files, from the first folder that has any (O-05)."""
    files = nifti.list_volumes(spark, site.images, "*.nii.gz")
    return nifti.prefer_folder(files.withColumn("site", F.lit(site.site)), ["labelsTr", "labels"], ["site"])


def _truth_paths(spark: SparkSession, site: Site) -> DataFrame:
    """``site, base_id, mask_path``: a label for each image, of the one folder or else the other (O-06)."""
    files = nifti.list_volumes(spark, site.images, "*.nii.gz")
    found = nifti.prefer_folder(files, ["labelsTr", "labels"], ["file"])
    return found.select(F.lit(site.site).alias("site"), assembly.label_case(F.col("file")).alias("base_id"), F.col("path").alias("mask_path"))


def _predictions(spark: SparkSession, bench: Benchmark, site: Site, folds: Sequence[str]) -> DataFrame:
    """``site, fold, case_id, path`` of every fold's masks of a site."""
    rows = None
    for fold in folds:
        folder = f"{bench.pred_root}/{fold}/{site.predictions}"
        if tables.exists(spark, folder):
            some = nifti.list_volumes(spark, folder, "*.nii*").withColumn("case_id", assembly.label_case(F.col("file")))
            some = nifti.prefer_extension(some, ["case_id"]).select(F.lit(site.site).alias("site"), F.lit(fold).alias("fold"), "case_id", "path")
            rows = some if rows is None else rows.unionByName(some)
    return rows if rows is not None else spark.createDataFrame([], "site string, fold string, case_id string, path string")


def _held_out(spark: SparkSession, bench: Benchmark, folds: list[str], say: Say) -> DataFrame:
    texts, lacking = nifti.read_fold_files(spark, bench.pred_root, folds, bench.fold_file)
    for fold in lacking:
        say(f"{fold} has no {bench.fold_file}: the reference cases it held out are unknown")
    tasks = spark.createDataFrame(list(bench.tasks.items()), "task string, site string")
    return cut_lineage(nifti.fold_membership(texts, tasks, bench.reference.site))


def _vote_masks(spark: SparkSession, bench: Benchmark, site: Site) -> DataFrame:
    """``site, base_id, mask_path`` of the vote masks written for a query site."""
    folder = bench.path("mv_masks")
    if not tables.exists(spark, folder):
        return spark.createDataFrame([], "site string, base_id string, mask_path string")
    files = nifti.list_volumes(spark, folder, f"{site.site}_*_mv.nii.gz")
    own = F.regexp_extract("file", f"^{site.site}_(.*)_mv[.]nii[.]gz$", 1)
    return files.select(F.lit(site.site).alias("site"), own.alias("base_id"), F.col("path").alias("mask_path"))


def _masks(spark: SparkSession, bench: Benchmark, site: Site) -> DataFrame:
    return _truth_paths(spark, site) if site.role == "reference" else _vote_masks(spark, bench, site)


def _cases(spark: SparkSession, bench: Benchmark, site: Site, flip: bool) -> DataFrame:
    """A site's cases with the contents of image and mask (O-16)."""
    cases = assembly.site_cases(_images(spark, site), _masks(spark, bench, site), bench.table(spark), flip)
    return plugins.with_content(cut_lineage(cases), {"path": "image", "mask_path": "mask"})


def _site_dice(spark: SparkSession, bench: Benchmark, site: Site, folds: Sequence[str], held_out: DataFrame | None) -> DataFrame:
    """Risk Dice of a site's labelled cases (O-50); sites that are split are compared at 1 mm, by halves."""
    truth = _truth_paths(spark, site).select(F.col("base_id").alias("case_id"), F.col("mask_path").alias("path"))
    pairs = _predictions(spark, bench, site, folds).join(truth.withColumnRenamed("path", "truth"), "case_id")
    pairs = plugins.with_content(cut_lineage(pairs), {"path": "a", "truth": "b"})
    axis = site.split_axis

    def run(parts):
        import numpy as np
        import pandas as pd

        from auditloom.operators import volumes

        for part in parts:
            out = []
            for row in part.itertuples():
                a, b = (nifti.decode(x) for x in (row.a, row.b))
                masks = [v.astype(np.int16) for v, _ in (a, b)]
                if axis is not None:
                    masks = [volumes.resample(m, s, 1.0, 0) for m, (_, s) in zip(masks, (a, b), strict=True)]
                for side in ("L", "R") if axis is not None else (None,):
                    p, t = (m == 1 if side is None else volumes.half(m, volumes.zyx_axis(axis), side) == 1 for m in masks)
                    dice = 2.0 * float((p & t).sum()) / float(p.sum() + t.sum()) if p.any() and t.any() else None
                    out.append((row.case_id if side is None else f"{row.case_id}_{side}", row.case_id, row.fold, dice))
            yield pd.DataFrame(out, columns=["case_id", "base_id", "fold", "dice"], dtype=object)

    found = pairs.select("case_id", "fold", "a", "b").mapInPandas(run, "case_id string, base_id string, fold string, dice double").where("dice is not null")
    if held_out is not None:
        found = found.join(held_out.select(F.col("case_id").alias("base_id"), "fold"), ["base_id", "fold"], "left_semi")
    return found.groupBy("case_id").agg(F.avg("dice").alias("dice")).withColumn("site", F.lit(site.site))


def extract(spark: SparkSession, bench: Benchmark, say: Say = print) -> None:
    """Vote masks, shape features, risks and the mask score: writes ``mv_masks``, ``cases.csv``, ``shape_raw.csv``, ``shape_features.csv``, ``scores/shape.csv``.

    Fails before anything is written if there are no folds, no reference labels or no reference case in a fold (O-140).
    """
    folds = tables.discover_folds(spark, bench.pred_root)
    held_out = _held_out(spark, bench, folds, say)
    if not _labels(spark, bench.reference).limit(1).count():
        raise FileNotFoundError(f"no labels below {bench.reference.images}, which the reference {bench.reference.site} cannot do without")
    if not held_out.limit(1).count():
        raise FileNotFoundError(f"no fold's {bench.fold_file} has a case of {bench.reference.site}")
    for site in bench.queries:
        found = cut_lineage(_predictions(spark, bench, site, folds))
        done = _vote_masks(spark, bench, site).select("site", F.col("base_id").alias("case_id"))
        todo = cut_lineage(found.join(done, ["site", "case_id"], "left_anti"))
        written = nifti.write_files(nifti.vote_files(plugins.with_content(todo, {"path": "content"}), done, bench.path("mv_masks"), voxels.VOTES)).count()
        say(f"[{site.site}] voted on {written} cases")
    shapes = [plugins.shape_of_cases(_cases(spark, bench, site, False), site.split_axis or 0) for site in bench.sites]
    feats = shapes[0]
    for part in shapes[1:]:
        feats = feats.unionByName(part)
    feats = cut_lineage(feats)
    dice = [_site_dice(spark, bench, site, folds, held_out if site.role == "reference" else None) for site in bench.sites]
    rows = assembly.reference_cases(dice[0], feats)
    for site, risks in zip(bench.queries, dice[1:], strict=True):
        ids = cut_lineage(assembly.site_case_ids(_images(spark, site), bench.table(spark)))
        risks = cut_lineage(risks)
        own = feats.where(F.col("site") == site.site)
        report = assembly.assembly_report(ids, bench.table(spark).where(F.col("site") == site.site), _labels(spark, site), risks, own).first()
        say(f"[{site.site}] {report.n_cases} cases, Dice {report.n_dice}, shape features {report.n_features}" + (f"; {report.warning}" if report.warning else ""))
        rows = rows.unionByName(assembly.query_cases(ids, risks, own))
    try:
        cases = cut_lineage(rows.join(bench.table(spark).select("site", "site_pos"), "site").select("case_id", "site", "dice", "site_pos"))
    except Exception as e:
        if "no usable reference case" in str(e):
            raise ValueError(f"{bench.reference.site}: no reference case has label, held-out prediction and mask") from e
        raise
    order = cases.orderBy("site_pos", "case_id")
    tables.save_csv(order.select("case_id", "site", "dice"), bench.path("cases.csv"))
    tables.save_csv(feats, bench.path("shape_raw.csv"), ("site", "case_id"))
    selected, scores = scoring.select_and_score(scoring.long_features(assembly.with_features(feats, cases)), bench.reference.site)
    tables.save_csv(spark.createDataFrame([(f, i) for i, f in enumerate(selected)], "feature string, place int").orderBy("place").select("feature"), bench.path("shape_features.csv"))
    tables.save_csv(scores, bench.path("scores", "shape.csv"))
    say(f"Rad-MD-Mask: {len(selected)} shape features")


def fm(spark: SparkSession, bench: Benchmark, backbones: Sequence[str], say: Say = print) -> None:
    """Embeddings of each registered backbone and their scores, ``scores/fm_<backbone>.csv``; sites embedded before are read (O-130, O-141)."""
    names, path = [s.site for s in bench.sites], bench.path("fm_cache")
    for backbone in backbones:
        if backbone not in plugins.EMBEDDERS:
            raise ValueError(f"no embedder is registered for {backbone}: see plugins.run.register_embedder")
        known = {r.site for r in tables.load_embeddings(spark, path, backbone, names).select("site").distinct().collect()}
        for site in bench.sites:
            if site.site not in known:
                tables.save_embeddings(plugins.embed_cases(_cases(spark, bench, site, True), backbone, site.split_axis or 0), path)
        bank = tables.load_embeddings(spark, path, backbone, names)
        if not bank.where(F.col("site") == bench.reference.site).limit(1).count():
            raise ValueError(f"{backbone} gave no vector for the reference {bench.reference.site}")
        tables.save_csv(scoring.embedding_scores(bank, bench.reference.site), bench.path("scores", f"fm_{backbone}.csv"))
        say(f"{backbone}: scores written")


def baselines(spark: SparkSession, bench: Benchmark, registrar: str | None = None, extractor: str | None = None, say: Say = print) -> None:
    """Scores from fold agreement, from registered radiomics and from registration to the reference (O-54, O-76, O-133)."""
    folds = tables.discover_folds(spark, bench.pred_root)
    cases = tables.load_cases(spark, bench.path("cases.csv"))
    have = {r.site for r in cases.select("site").distinct().collect()}
    for site in bench.queries:
        if site.site not in have:
            say(f"[{site.site}] has no cases")
    sites = [s for s in bench.queries if s.site in have]
    parts = []
    for site in sites:
        found = cut_lineage(_predictions(spark, bench, site, folds))
        marked = nifti.read_masks(spark, f"{bench.pred_root}/fold_*/{site.predictions}", "*.nii*").join(found.select("path", "case_id", "fold"), "path")
        shape, folded = F.col("shape"), found.select("case_id", "fold")
        if site.split_axis is not None:
            at, name = 2 - site.split_axis, "xyz"[site.split_axis]
            mid = F.floor(shape[at] / 2)
            side = F.when(F.col(name) >= mid, "R").otherwise("L")
            place = F.when(F.col(name) >= mid, F.col(name) - mid).otherwise(F.col(name))
            marked = marked.withColumn("case_id", F.concat_ws("_", "case_id", side)).withColumn(name, place)
            folded = folded.withColumn("side", F.explode(F.array(F.lit("L"), F.lit("R")))).select(F.concat_ws("_", "case_id", "side").alias("case_id"), "fold")
        votes = marked.select("case_id", "fold", F.struct("z", "y", "x").alias("voxel"))
        parts.append(voxels.ensemble_scores(cases.where(F.col("site") == site.site).select("case_id", "site"), votes, folded))
    for i, part in enumerate(parts):
        parts[i] = part if not i else parts[i - 1].unionByName(part)
    if parts:
        tables.save_csv(parts[-1], bench.path("scores", "ens_mpd.csv"))
    if extractor:
        rows = None
        for site in (bench.reference, *sites):
            own = assembly.site_case_ids(_images(spark, site), bench.table(spark)).join(_images(spark, site).select(base_id(F.col("file")).alias("base_id"), "path"), "base_id")
            some = plugins.radiomics_of_cases(plugins.with_content(cut_lineage(own), {"path": "image"}), extractor, site.split_axis or 0)
            rows = some if rows is None else rows.unionByName(some)
        tables.save_csv(scoring.image_scores(cut_lineage(rows), bench.reference.site), bench.path("scores", "frd.csv"))
    if registrar:
        atlas = assembly.reference_atlas(_images(spark, bench.reference), _held_out(spark, bench, folds, say), _labels(spark, bench.reference))
        atlas = atlas.join(_truth_paths(spark, bench.reference), atlas["case_id"] == F.col("base_id")).select(F.col("case_id").alias("ref_case_id"), F.col("path").alias("ref_path"), F.col("mask_path").alias("ref_mask_path"))
        wanted = None
        for site in sites:
            own = assembly.site_cases(_images(spark, site), _vote_masks(spark, bench, site), bench.table(spark), bench.flip_right).where("side is null")
            wanted = own if wanted is None else wanted.unionByName(own)
        pairs = cut_lineage(wanted.select("site", "case_id", "path", "mask_path").crossJoin(F.broadcast(cut_lineage(atlas))))  # every case meets every reference by definition
        contents = {"path": "image", "mask_path": "mask", "ref_path": "ref_image", "ref_mask_path": "ref_mask"}
        keys = ["site", "case_id", "ref_case_id"]
        found = tables.resumed(pairs, bench.path("atlas_cache"), keys, lambda todo: plugins.register_pairs(plugins.with_content(todo, contents), registrar), tables.REGISTRATIONS)
        tables.save_csv(plugins.atlas_scores(found), bench.path("scores", "atlas_rca.csv"))


def evaluation(spark: SparkSession, folder: str, sites: DataFrame, out: str, wide: bool = True, strict: bool = False, replicates: int = 2000, say: Say = print) -> bool:
    """Evaluate the scores in a folder and write the result tables; whether there was anything to evaluate (O-139, O-140).

    Without scores it fails. Without a usable site or method it says so; with ``strict`` that also ends the program.
    """

    def stop(why: str) -> bool:
        if strict:
            raise SystemExit(why)
        say(why)
        return False

    scores = cut_lineage(tables.load_scores(spark, f"{folder}/scores"))
    if not scores.where(F.col("method").isin(list(evaluate.LABELS))).limit(1).count():
        if strict:
            raise SystemExit(f"{folder}/scores holds no known method")
        raise FileNotFoundError(f"{folder}/scores holds no known method: the stage extract comes first")
    cases = cut_lineage(tables.load_cases(spark, f"{folder}/cases.csv"))
    if wide:
        tables.save_csv(evaluate.scores_table(cases, scores, sites).drop("case_pos", "site_pos"), f"{folder}/failure_scores.csv")
    kept, methods, skipped, dropped = evaluate.usable(cases, scores, sites)
    for r in skipped.orderBy("site_pos").collect():
        say(f"site {r.site} is left out: {r.reason}" + (f", {r.n_labelled}" if r.n_labelled else ""))
    if not kept.limit(1).count():
        return stop("no query site has enough labelled cases")
    for r in dropped.orderBy("method_pos").collect():
        say(f"{r.method} is left out: {r.n_missing} labelled cases lack its score")
    if not methods:
        return stop("every method lacks the score of some labelled case")
    own = cases.where("dice is not null")
    table, tests, counts = evaluate.evaluate(own, scores, kept, methods, replicates=replicates)
    table, tests = cut_lineage(table), cut_lineage(tests)
    for line in evaluate.report_lines(table, tests, counts):
        say(line)
    tables.save_csv(table, f"{out}/eaurc_table.csv")
    tables.save_csv(tests, f"{out}/paired_tests.csv")
    return True


def main(argv: Sequence[str] | None = None) -> None:
    """The command line of all stages, or of the evaluation alone where ``--scores_dir`` is given (O-138, O-139)."""
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    args.add_argument("--benchmark", required=True, help="YAML file")
    args.add_argument("--stage", choices=(*STAGES, "all"), default="all")
    args.add_argument("--out_dir", help="default: outputs/<name>")
    args.add_argument("--data_root", default="datasets")
    args.add_argument("--pred_root", default="predictions")
    args.add_argument("--fm_models", nargs="+", default=["dinov3", "raddino"], help="registered backbones")
    args.add_argument("--registrar", help="a registered registration, such as centroid_shift")
    args.add_argument("--extractor", help="a registered radiomics extractor")
    args.add_argument("--scores_dir", help="evaluate this folder's cases.csv and scores and nothing else")
    asked = args.parse_args(argv)
    spark = get_spark("audit")
    bench = load_benchmark(spark, asked.benchmark, data_root=asked.data_root, pred_root=asked.pred_root, out_dir=None if asked.scores_dir else asked.out_dir)
    sites = spark.createDataFrame([(s.site, i) for i, s in enumerate(bench.queries)], "site string, site_pos int")
    if asked.scores_dir:
        evaluation(spark, asked.scores_dir, sites, asked.out_dir or f"{asked.scores_dir}/evaluation", wide=False, strict=True)
        return
    chosen = STAGES if asked.stage == "all" else (asked.stage,)
    if "extract" in chosen:
        extract(spark, bench)
    if "fm" in chosen:
        fm(spark, bench, asked.fm_models)
    if "baselines" in chosen:
        baselines(spark, bench, asked.registrar, asked.extractor)
    if "evaluate" in chosen:
        evaluation(spark, bench.out_dir, sites, bench.path("evaluation"))


if __name__ == "__main__":
    main()
