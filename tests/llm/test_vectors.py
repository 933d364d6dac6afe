import numpy as np
import pytest

from auditloom.llm import ann, vector_dedup

ROWS = "vec_id long, embedding array<float>, label string"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16))
    x[600:] = x[:100] + rng.normal(scale=0.06, size=(100, 16))
    return x.astype(np.float32)


def odd():
    return [(9001, None, "a"), (9002, [0.0] * 16, "a"), (9003, [float("nan")] * 16, "b"), (9004, [None] + [1.0] * 15, "c"), (9005, [], "d")]


def test_links_match_brute_force(spark, vectors):
    rows = [(i, v.tolist(), "l") for i, v in enumerate(vectors)] + [(800, vectors[3].tolist(), "l")]
    got = {r.vec_id: r for r in vector_dedup.vector_groups(spark.createDataFrame(rows + odd(), ROWS)).collect()}
    x = np.array([v for _, v, _ in rows], np.float64)
    s = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.95
    np.fill_diagonal(s, False)
    assert [got[r[0]].n_links for r in rows] == s.sum(1).tolist() and s.sum() > 50
    assert got[800].component_id == 3 and not got[800].kept and got[3].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9001, 9006))
    assert vector_dedup.vector_groups(spark.createDataFrame([], ROWS)).count() == 0


def test_search_recall_and_scores(spark, vectors):
    from pyspark.sql import functions as F

    rows = [(i, v.tolist(), "l") for i, v in enumerate(vectors)]
    got = ann.nearest(spark.createDataFrame(rows + odd(), ROWS), F.col("vec_id") % 20 == 0).collect()
    x, found = vectors.astype(np.float64), []
    for q in range(0, 700, 20):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21)) and q not in [m[1] for m in mine]
        s = x @ x[q]
        assert all(abs(s[v] - score) < 1e-12 for _, v, score in mine)
        s[q] = -np.inf
        found.append(len({m[1] for m in mine} & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(found) >= 0.9
    few = ann.nearest(spark.createDataFrame(rows[:3], ROWS), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 2 and ann.nearest(spark.createDataFrame([], ROWS), F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_with_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(None, [1.0, 0.0], 1, 0.1), (None, [1.0, 0.0], 1, 0.1), (4, [1.0, 0.01], 1, 0.1), (4, [1.0, 0.01], 1, 0.1), (9, [1.0, 0.0, 0.0], 1, 0.1), (2, [0.0, 1.0], 1, 0.1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int, score double")
    got = vector_dedup.vector_groups(frame).collect()
    assert len(got) == len(rows) and {r.vec_id: r.component_id for r in got if r.vec_id in (2, 9)} == {2: 2, 9: 9}
    assert all(r.component_id == 4 for r in got if r.vec_id == 4)
    found = ann.nearest(frame, F.col("vec_id") % 2 == 0).collect()
    assert {(r.query_id, r.vec_id) for r in found} == {(2, 4), (4, 2)}  # of the common length, with an id, each id once
