"""Approximate nearest neighbours over learned partitions of a neighbour graph."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import durable
from auditloom.llm.vectors import usable

#: The index is fitted on SAMPLE rows, or SAMPLE_PER_PARTITION for each partition if that is more: the smallest by a hash of the id. Every row is indexed.
SAMPLE, SAMPLE_PER_PARTITION = 4096, 64
NEIGHBOURS = 12
#: Partitions: one for each so many rows, within these bounds.
ROWS_PER_PARTITION, LEAST_PARTITIONS, MOST_PARTITIONS = 8192, 16, 1024
#: Rows of a partition are searched in blocks of about these many rows and queries.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 8192
#: Share of true neighbours that the calibrated number of probed partitions finds on the sample.
TARGET_RECALL = 0.96


@dataclass
class Router:
    """A small network from a vector to the probabilities of the partitions, and how many of them to probe."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows of largest inner product with each row, itself left out."""
    out = np.empty((len(x), k), np.int32)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05, seed: int = 5) -> np.ndarray:
    """Labels of a balanced partition of the graph: halving along main directions, then moves towards neighbours.

    A node moves to the part that holds most of its neighbours (in either direction), best gains first, as long as
    that part has room; so few edges cross and no part outgrows ``slack`` times its share.
    """
    n, rng = len(x), np.random.default_rng(seed)
    labels, groups = np.zeros(n, np.int64), [np.arange(n)]
    while len(groups) < parts:
        groups.sort(key=len)
        big = groups.pop()
        centred = x[big] - x[big].mean(0)
        v = rng.normal(size=x.shape[1])
        for _ in range(8):
            v = centred.T @ (centred @ v)
            v /= np.linalg.norm(v) or 1
        order = big[np.argsort(centred @ v, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for part, members in enumerate(groups):
        labels[members] = part
    room = int(np.ceil(slack * n / parts))
    rows, cols = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (rows, labels[cols]), 1)
        np.add.at(votes, (cols, labels[rows]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), labels]
        sizes, moved = np.bincount(labels, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[labels[i]] -= 1
                sizes[best[i]] += 1
                labels[i] = best[i]
                moved += 1
        if moved < n // 200:
            break
    return labels


def train_router(x: np.ndarray, labels: np.ndarray, graph: np.ndarray, parts: int, hidden: int = 64, epochs: int = 40, rate: float = 3e-3, seed: int = 9) -> Router:
    """Fit the classifier to where a row's neighbours lie (its own part included), in mini-batches with Adam."""
    rng = np.random.default_rng(seed)
    scale = 1 / max(1e-12, float(np.sqrt((x * x).mean())))
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), labels), 1)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), labels[graph.ravel()]), 1)
    target /= target.sum(1, keepdims=True)
    d = x.shape[1]
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            step += 1
            z = x[batch] * scale
            h = np.maximum(z @ p[0] + p[1], 0)
            o = h @ p[2] + p[3]
            o = np.exp(o - o.max(1, keepdims=True))
            g = (o / o.sum(1, keepdims=True) - target[batch]) / len(batch)
            gh = (g @ p[2].T) * (h > 0)
            for i, grad in enumerate((z.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[i] += 0.1 * (grad - m[i])
                v[i] += 0.001 * (grad * grad - v[i])
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*p, scale)


def calibrate(router: Router, x: np.ndarray, k: int, recall: float, seed: int = 1) -> int:
    """Fewest partitions to probe so that sample rows find ``recall`` of their true neighbours in the sample."""
    at = router.logits(x).argmax(1)
    queries = np.random.default_rng(seed).permutation(len(x))[:1024]
    logits = router.logits(x[queries])
    place = np.empty_like(logits, np.int64)
    np.put_along_axis(place, np.argsort(-logits, axis=1), np.arange(logits.shape[1])[None], axis=1)
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    k = min(k, len(x) - 1)
    true = np.argpartition(-s, k - 1, axis=1)[:, :k]
    needed = place[np.arange(len(queries))[:, None], at[true]]
    found = [(needed < p).mean() for p in range(1, logits.shape[1] + 1)]
    return next((p for p, f in enumerate(found, 1) if f >= recall), logits.shape[1])


def fit_router(x: np.ndarray, parts: int, k: int, recall: float = TARGET_RECALL) -> Router:
    parts = max(1, min(parts, len(x) // SAMPLE_PER_PARTITION))
    if parts == 1:
        d = x.shape[1] if x.ndim == 2 and len(x) else 1
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0)
    graph = neighbour_graph(x, min(NEIGHBOURS, len(x) - 1))
    router = train_router(x, balanced_partition(x, graph, parts), graph, parts)
    router.probes = calibrate(router, x, k, recall)
    return router


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query, scored in double precision."""
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(queries) or not len(rows):
        return empty
    q, x = np.stack(queries["v"]).astype(np.float64), np.stack(rows["v"]).astype(np.float64)
    ids, own, out = rows["id"].to_numpy(np.int64), queries["id"].to_numpy(np.int64), []
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ x.T
        s[own[i : i + 256, None] == ids[None]] = -np.inf
        cut = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        # rounding of the block product must not decide ties: take a little more and score each pair alike
        a, b = np.nonzero((s >= (cut - 1e-9 * (1 + np.abs(cut)))[:, None]) & np.isfinite(s))
        exact = (q[i + a] * x[b]).sum(1)
        order = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        starts = np.searchsorted(a, a)
        top = np.arange(len(a)) - starts < k
        out.append(pd.DataFrame({"query_id": own[i + a[top]], "vec_id": ids[b[top]], "score": exact[top]}))
    return pd.concat(out)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of largest inner product for each query row: ``query_id, rank, vec_id, score``.

    A neighbour graph of a bounded sample is cut into balanced partitions and a small classifier learns where
    a vector's neighbours lie. Every row goes to its most probable partition; a query is searched in as many of its most
    probable ones as reach the target recall on the sample, each in blocks of bounded size, and scored
    on the original vectors in double precision. Nearest first, ties to the smaller id; rows with the query's id are left out.

    Vectors that are null, empty, zero, of another length than most, or that hold null or non-finite components take no part,
    nor do rows without an id. Rows repeated with one id count once, with the best score. All candidates are
    returned if there are fewer than k. An empty table gives no rows; other columns are ignored.
    """
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    base = base.where(usable(F.col("v")) & F.col("id").isNotNull())
    total = base.count()
    parts = max(LEAST_PARTITIONS, min(MOST_PARTITIONS, total // ROWS_PER_PARTITION))
    sample = base.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, SAMPLE_PER_PARTITION * parts)).select("v").toPandas()["v"]
    lengths = [len(v) for v in sample]
    dim = max(set(lengths), key=lengths.count) if lengths else 1
    x = np.stack([np.asarray(v, np.float64) for v in sample if len(v) == dim]) if lengths else np.zeros((0, 1))
    base = base.where(F.size("v") == dim)
    router = fit_router(x, parts, k)

    def route(parts):
        for pdf in parts:
            if len(pdf):
                logits = router.logits(np.stack(pdf["v"]).astype(np.float64))
                order = np.argsort(-logits, axis=1, kind="stable")[:, : router.probes].astype(np.int32)
                pdf["part"] = order[:, 0]
                pdf["probe"] = [list(o) if q else None for o, q in zip(order, pdf["q"], strict=True)]
                yield pdf[["id", "v", "part", "probe"]]

    kind = base.schema["v"].dataType.simpleString()
    placed = durable(base.mapInPandas(route, f"id bigint, v {kind}, part int, probe array<int>"), "ann-index")
    queries = placed.where("probe is not null").select("id", "v", F.explode("probe").alias("part"))
    # sizes of the partitions, at most MOST_PARTITIONS numbers, tell how many blocks each needs
    rows_in = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}
    asks_in = {r.part: r["count"] for r in queries.groupBy("part").count().collect()}
    parts = max(rows_in, default=0) + 1
    blocks = F.array(*[F.lit(-(-rows_in.get(p, 0) // BLOCK_ROWS) or 1) for p in range(parts)])
    turns = F.array(*[F.lit(-(-asks_in.get(p, 0) // BLOCK_QUERIES) or 1) for p in range(parts)])
    of = lambda sizes: F.get(sizes, F.col("part"))
    every = lambda sizes: F.explode(F.sequence(F.lit(0), of(sizes) - 1))
    own = lambda sizes: F.pmod(F.xxhash64("id"), of(sizes)).cast("int")
    left = queries.where(F.col("part") < parts).withColumn("turn", own(turns)).withColumn("block", every(blocks))
    right = placed.select("id", "v", "part").withColumn("block", own(blocks)).withColumn("turn", every(turns))
    keys = ["part", "block", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _search(a, b, k), "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
