"""From volume files to result tables: a small benchmark of two sites, run stage by stage."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom import stages
from auditloom.operators import bootstrap, evaluate, rank, scoring, volumes
from auditloom.plugins import run as plugins
from auditloom.sources import nifti, tables
from auditloom.sources.benchmark import parse_benchmark

SPEC = {
    "name": "toy", "reference_site": "A", "query_sites": ["B", "C"], "dataset_dirs": {"A": "a", "B": "b", "C": "c"}, "pred_dirs": {"A": "pa", "B": "pb", "C": "pc"},
    "task_name_to_tag": {"t": "A"}, "fold_json_name": "val.json", "bilateral_split_sites": ["C"], "bilateral_split_axis": 0,
}


def ball(n, centre, radius):
    z, y, x = np.indices(n)
    return ((z - centre[0]) ** 2 + (y - centre[1]) ** 2 + (x - centre[2]) ** 2 <= radius**2).astype(np.uint8)


@pytest.fixture(scope="module")
def bench(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("audit"), np.random.default_rng(5)
    shape = (10, 12, 14)

    def put(path, volume):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(nifti.encode(volume))

    members = {f"fold_{k}": {} for k in range(3)}
    for site, folder in SPEC["dataset_dirs"].items():
        for i in range(6):
            truth = ball(shape, rng.uniform(4, 6, 3), 2.5 + 0.2 * i)
            if site == "C":  # one ball in each half
                truth = ball(shape, (5, 6, 3), 2 + 0.2 * i) | ball(shape, (5, 6, 10), 2.2)
            put(root / "data" / folder / "images" / f"k{i}_0000.nii.gz", (truth * 50 + rng.integers(0, 9, shape)).astype(np.int16))
            put(root / "data" / folder / "labels" / f"k{i}.nii.gz", truth)
            members[f"fold_{i % 3}"][f"k{i}"] = {"mask": {"Dice": 0.5}}
            for k in range(3):
                noisy = np.roll(truth, int(rng.integers(0, 2)), 1)
                put(root / "pred" / f"fold_{k}" / SPEC["pred_dirs"][site] / f"k{i}.nii.gz", noisy)
    for fold, cases in members.items():
        (root / "pred" / fold / "val.json").write_text(json.dumps({"epoch_9": {"t": cases}, "epoch_10": {"t": {"old": {"mask": {}}}}}))
    return parse_benchmark(SPEC, data_root=f"file://{root}/data", pred_root=f"file://{root}/pred", out_dir=f"file://{root}/out")


def test_extract_fm_baselines_and_evaluate(spark, bench):
    said = []
    with pytest.raises(FileNotFoundError):
        stages.evaluation(spark, bench.out_dir, bench.table(spark).where("role = 'query'"), bench.path("evaluation"))
    stages.extract(spark, bench, said.append)
    cases = tables.load_cases(spark, bench.path("cases.csv"))
    rows = cases.orderBy("case_pos").collect()
    assert [(r.site, r.case_id) for r in rows] == [(s, f"k{i}") for s in "AB" for i in range(6)] + [("C", f"k{i}_{h}") for i in range(6) for h in "LR"]
    assert all(0 < r.dice <= 1 for r in rows)
    assert stages.extract(spark, bench, said.append) is None and any(s.startswith("[B] voted on 0") for s in said)  # nothing is voted on twice
    network = lambda: lambda x: np.asarray(np.stack([x.mean((0, 1)), *x.reshape(-1, 3)[: (x.shape[0] // 2 * 2) ** 2 or 4][:4]]), np.float64)
    plugins.register_embedder("dinov3", network)
    stages.fm(spark, bench, ["dinov3"], said.append)
    stages.baselines(spark, bench, "centroid_shift", say=said.append)
    scores = tables.load_scores(spark, bench.path("scores"))
    got = {r.method: r.n for r in scores.where("site <> 'A'").groupBy("method").agg(F.count("score").alias("n")).collect()}
    assert got == {"rad_md_mask": 18, "ens_mpd": 18, "atlas_rca": 6, **{f"dinov3_md_{m}": 18 for m in volumes.MODES}}
    sites = bench.table(spark).where("role = 'query'").select("site", "site_pos")
    assert stages.evaluation(spark, bench.out_dir, sites, bench.path("evaluation"), replicates=120, say=said.append)
    table = spark.read.csv(bench.path("evaluation", "eaurc_table.csv"), header=True, inferSchema=True).collect()
    assert [r.method for r in table] == ["ens_mpd", "rad_md_mask", *[f"dinov3_md_{m}" for m in volumes.MODES]] and table[0].label == "Ens-Mpd"
    assert all(r.E_AURC_pooled_ci_lo <= r.E_AURC_pooled_ci_hi for r in table)
    tests = spark.read.csv(bench.path("evaluation", "paired_tests.csv"), header=True, inferSchema=True).collect()
    assert [(r.method, r.ref) for r in tests] == [("dinov3_md_ovw", "rad_md_mask"), ("rad_md_mask", "ens_mpd"), ("dinov3_md_ovw", "ens_mpd")]
    assert all(r.n_boot == 120 and 0 < r.E_AURC_pooled_pval <= 1 for r in tests)
    wide = spark.read.csv(bench.path("failure_scores.csv"), header=True)
    assert wide.columns[:3] == ["case_id", "site", "dice"] and wide.count() == 18
    assert any(s.startswith("Excess AURC") for s in said) and any(s.startswith("atlas_rca is left out") for s in said)


def test_evaluate_refuses_gaps_and_small_sites(spark):
    cases = spark.createDataFrame([(f"c{i}", s, 0.1 * i, i) for s in "PQ" for i in range(5 if s == "P" else 3)], "case_id string, site string, dice double, case_pos long")
    scores = cases.select("case_id", "site", F.lit("ens_mpd").alias("method"), F.col("dice").alias("score"))
    sites = spark.createDataFrame([("P", 0), ("Q", 1)], "site string, site_pos int")
    with pytest.raises(ValueError, match="fewer than 4 cases: {'Q': 3}"):
        evaluate.checked(cases, scores, sites, ["ens_mpd"])
    one = sites.where("site = 'P'")
    with pytest.raises(ValueError, match="'ens_mpd': 1"):
        evaluate.checked(cases, scores.where("case_id <> 'c0'"), one, ["ens_mpd"])
    with pytest.raises(ValueError, match="without a Dice 1"):
        evaluate.checked(cases.withColumn("dice", F.when(F.col("case_pos") > 0, F.col("dice"))), scores, one, ["ens_mpd"])
    with pytest.raises(Exception, match="repeated key"):
        evaluate.checked(cases, scores.unionByName(scores), one, ["ens_mpd"])
    assert evaluate.checked(cases, scores, one, ["ens_mpd"]).count() == 5


def test_dense_replicates_equal_relational_ones(spark):
    rng = np.random.default_rng(2)
    dice = rng.integers(0, 9, 14) / 10
    rows = [(f"{s}{i}", s, "PQ".index(s), i, float(dice[i + 7 * (s == "Q")]), m, float(rng.integers(0, 5))) for s in "PQ" for i in range(7) for m in ("a", "b")]
    scored = spark.createDataFrame(rows, "case_id string, site string, site_pos int, case_pos long, dice double, method string, score double")
    both = [{(r.rep, r.method): (r.eaurc_within, r.eaurc_pooled) for r in bootstrap.replicate_table(scored, 12, dense_rows=n).collect()} for n in (1000, 0)]
    assert both[0].keys() == both[1].keys() and len(both[0]) == 24
    assert {k: (both[0][k], both[1][k]) for k in both[0] if not np.allclose(both[0][k], both[1][k])} == {}
    own = bootstrap.replicate_table(scored, 3, published=True).where("method = 'a' and rep = 1").first()
    stream = np.random.default_rng(42)
    drawn = [[stream.integers(0, 7, 7) for _ in "PQ"] for _ in range(2)][1]
    areas = []
    for s, idx in zip("PQ", drawn, strict=True):
        mine = [r for r in rows if r[1] == s and r[5] == "a"]
        risk, score = np.array([1 - mine[i][4] for i in idx]), np.array([mine[i][6] for i in idx])
        curve = lambda key: np.mean([risk[sorted(range(7), key=lambda i: (key[i], -i))[: k + 1]].mean() for k in range(7)])  # noqa: B023, E731
        areas.append(curve(score) - curve(risk))
    assert abs(own.eaurc_within - np.mean(areas)) < 1e-12
    assert rank.eaurc_by_method(scored).count() == 2


def test_resume_computes_only_what_is_missing(spark, tmp_path):
    wanted, asked = spark.createDataFrame([("s", f"c{i}", "r") for i in range(4)], "site string, case_id string, ref_case_id string"), []

    def compute(todo):
        asked.append(todo.count())
        return todo.withColumns({"dsc": F.lit(0.5), "reg_seconds": F.lit(0.0)})

    keys, path = ["site", "case_id", "ref_case_id"], f"file://{tmp_path}/cache"
    for some in (wanted.where("case_id <> 'c3'"), wanted):
        assert tables.resumed(some, path, keys, compute, tables.REGISTRATIONS).count() == some.count()
    assert asked == [3, 1]


def test_files_keep_text_ids_and_row_order(spark, tmp_path):
    (tmp_path / "cases.csv").write_text("case_id,site,dice\n007,Z,0.5\n003,Z,\n010,A,nan\n")
    rows = tables.load_cases(spark, f"file://{tmp_path}/cases.csv").orderBy("case_pos").collect()
    assert [(r.case_id, r.dice) for r in rows] == [("007", 0.5), ("003", None), ("010", None)]
    assert tables.load_scores(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.discover_folds(spark, f"file://{tmp_path}")


def test_description_names_all_faults():
    with pytest.raises(ValueError, match="lacks fold_json_name, name"):
        parse_benchmark({k: v for k, v in SPEC.items() if k not in ("name", "fold_json_name")})
    with pytest.raises(ValueError, match="site C is not in pred_dirs"):
        parse_benchmark(SPEC | {"pred_dirs": {"A": "x", "B": "y"}})
    made = parse_benchmark(SPEC | {"note": 1})
    assert [(s.site, s.split_axis, s.images) for s in made.sites] == [("A", None, "datasets/a"), ("B", None, "datasets/b"), ("C", 0, "datasets/c")]
    assert made.out_dir == "outputs/toy" and made.extra == {"note": 1} and made.reference.role == "reference"


def test_resampling_is_exact_on_cubics_and_keeps_masks_binary():
    at = np.arange(20.0)
    line = (0.01 * at**3 - at).reshape(1, 1, -1)
    fine = volumes.resample(line, (1.0, 1.0, 2.0))
    assert fine.shape == (1, 1, 40) and np.allclose(fine[0, 0, ::2], line[0, 0]) and np.allclose(fine[0, 0, 12:22], 0.01 * (np.arange(12, 22) / 2) ** 3 - np.arange(12, 22) / 2, atol=2e-3)
    assert fine[0, 0, 38] != 0 and fine[0, 0, 39] == 0 and volumes.resample(line, (1.0, 1.0, 2.2)).shape == (1, 1, 44)  # the last is past the half voxel
    mask = ball((8, 8, 8), (4, 4, 4), 3)
    assert set(np.unique(volumes.resample(mask, (2.0, 1.0, 1.0), 1.0, 0))) == {0, 1} and volumes.resample(mask, (1.05, 1, 1)) is mask
    ramp = np.arange(8.0).reshape(1, 1, -1)
    assert np.allclose(volumes.resize_trilinear(ramp, (1, 1, 4))[0, 0], [0.5, 2.5, 4.5, 6.5]) and volumes.hwd_axis(9) == 1 and volumes.zyx_axis(0) == 2


def test_shape_of_a_ball_and_refusals():
    f = volumes.shape_features(ball((31, 31, 31), (15, 15, 15), 10.0))
    assert abs(f["original_shape_MeshVolume"] / (4 / 3 * np.pi * 1000) - 1) < 0.03 and abs(f["original_shape_Sphericity"] - 1) < 0.12
    assert f["original_shape_Maximum3DDiameter"] == 20 and f["original_shape_Elongation"] > 0.99 and len(f) == 14
    assert volumes.shape_features(np.zeros((3, 3, 3))) is None
    line = np.zeros((4, 4, 4))
    line[1, 1, :3] = 1
    with pytest.raises(ValueError):
        volumes.shape_features(line)


def test_vote_files_and_geometry(spark):
    a, b, c = (ball((6, 6, 6), (3, 3, 3), r) for r in (1, 2, 2))
    files = [("S", "x", f"fold_{i}", nifti.encode(v, (2.0, 1.0, 1.0), (1.0, 2.0, 3.0))) for i, v in enumerate((a, b, c))]
    files += [("S", "alone", "fold_0", nifti.encode(a * 7)), ("S", "odd", "fold_0", nifti.encode(a)), ("S", "odd", "fold_1", nifti.encode(a[:5])), ("S", "done", "fold_0", nifti.encode(a))]
    masks = spark.createDataFrame(files, "site string, case_id string, fold string, content binary")
    done = spark.createDataFrame([("S", "done")], "site string, case_id string")
    got = {r.path: bytes(r.content) for r in nifti.vote_files(masks, done, "file:///out").collect()}
    assert set(got) == {"file:///out/S_x_mv.nii.gz", "file:///out/S_alone_mv.nii.gz"}
    assert (nifti.decode(got["file:///out/S_x_mv.nii.gz"])[0] == a).all() and nifti.decode(got["file:///out/S_alone_mv.nii.gz"])[0].max() == 7
    where = nifti.geometry(got["file:///out/S_x_mv.nii.gz"])
    assert where.spacing == (1.0, 1.0, 2.0) and where.origin == (1.0, 2.0, 3.0) and where.shape == (6, 6, 6)
    some = spark.createDataFrame([("p", nifti.encode(a * 5)), ("q", nifti.encode(a * 0))], "path string, content binary")
    assert [(r.path, nifti.decode(bytes(r.content))[0].max()) for r in nifti.binarised(some).collect()] == [("p", 1)]


def test_scores_leave_reference_rows_out(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(2, 1, (12, 3))
    x[:8, 2] = 4.0  # constant over the reference
    rows = [(f"c{i}", "R" if i < 8 else "Q", f"f{j}", float(x[i, j])) for i in range(12) for j in range(3)]
    long = spark.createDataFrame([*rows, ("gap", "Q", "f0", float("nan")), ("gap", "Q", "f1", 1.0), ("gap", "Q", "f2", 1.0)], "case_id string, site string, feature string, value double")
    got = {(r.method, r.case_id): r.score for r in scoring.image_scores(long, "R").collect()}
    assert len(got) == 24 and ("rad_l2", "gap") not in got
    for i in (0, 9):
        ref = np.delete(x[:8], i, 0) if i < 8 else x[:8]
        sd = ref.std(0)
        assert abs(got["rad_l2", f"c{i}"] - np.linalg.norm((x[i] - ref.mean(0)) / np.where(sd < 1e-12, 1, sd))) < 1e-9
    wide = spark.createDataFrame([("c", "R", 1.0, 2.0)], "case_id string, site string, original_shape_A double, other double")
    assert [tuple(r) for r in scoring.long_features(wide).collect()] == [("c", "R", "original_shape_A", 1.0)]
