"""Near-duplicate vectors by counting collisions on one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import connected_components, durable
from auditloom.llm.vectors import usable

#: Projections in all, and those counted first for every pair in reach of the sorted first projection.
PROJECTIONS, FIRST = 64, 16
#: Chance that a pair exactly at the threshold passes each count.
RECALL = 0.9997
#: Rows per block; a task compares two blocks.
BLOCK = 8192
#: Window half-width and width of the sorted projection's cells, in standard deviations of a threshold pair.
WINDOW, REACH = 1.5, 3.7
#: Projections are compared as bytes in steps of this size; windows are widened by one step.
STEP = 0.04


def least_count(n: int, p: float, recall: float) -> int:
    """Largest count that at least ``recall`` of all pairs reach if each of n projections collides with chance p."""
    tail, c = 0.0, n
    for c in range(n, -1, -1):
        tail += math.comb(n, c) * p**c * (1 - p) ** (n - c)
        if tail >= recall:
            break
    return c


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Smallest position each of n rows reaches over the pairs (a, b), starting from the labels ``root``."""
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def _compare(pdf: pd.DataFrame, cosine: float, seed: int) -> pd.DataFrame:
    """Links within one pair of blocks: per row the weight of its links and the smallest row reached."""
    pdf = pdf.sort_values(["side", "rep"], kind="stable")
    x = np.stack(pdf["v"]).astype(np.float64)
    side, rep, weight = pdf["side"].to_numpy(), pdf["rep"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(1))
    lines = np.random.default_rng(seed).normal(size=(x.shape[1], PROJECTIONS))
    spread = math.sqrt(2 - 2 * cosine)
    made = unit @ lines
    steps = np.clip(np.round(made / STEP), -127, 127).astype(np.int8).view(np.uint8)
    half = int(math.ceil(WINDOW * spread / STEP)) + 1
    chance = math.erf(WINDOW / math.sqrt(2))
    first, total = least_count(FIRST, chance, RECALL), least_count(PROJECTIONS, chance, RECALL)
    same = not (side == 1).any()
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    # windows of the first projection: both sides in its order, so that a tile of queries meets one stretch of rows
    left, right = left[np.argsort(made[left, 0], kind="stable")], right[np.argsort(made[right, 0], kind="stable")]
    reach, links = REACH * spread, np.zeros(len(x), np.int64)
    root = np.arange(len(x))
    for i in range(0, len(left), 256):
        a = left[i : i + 256]
        lo = np.searchsorted(made[right, 0], made[a[0], 0] - reach)
        hi = np.searchsorted(made[right, 0], made[a[-1], 0] + reach, side="right")
        if same:
            lo = max(lo, i)
        for j in range(lo, hi, 4096):
            b = right[j : min(hi, j + 4096)]
            count = np.zeros((len(a), len(b)), np.uint8)
            for k in range(FIRST):
                near = steps[a, k][:, None] - steps[b, k][None]
                near += np.uint8(half)
                count += near <= 2 * half
            at, to = np.nonzero(count >= first)
            at, to = a[at], b[to]
            if same:
                keep = made_order(left, at, to)
                at, to = at[keep], to[keep]
            for s in range(0, len(at), 65536):
                p, q = at[s : s + 65536], to[s : s + 65536]
                near = steps[p] - steps[q]
                near += np.uint8(half)
                passed = (near <= 2 * half).sum(1) >= total
                p, q = p[passed], q[passed]
                close = (x[p] * x[q]).sum(1) / (norm[p] * norm[q]) >= cosine
                p, q = p[close], q[close]
                if len(p):
                    np.add.at(links, p, weight[q])
                    np.add.at(links, q, weight[p])
                    root = _roots(len(x), p, q, root)
    hit = links > 0
    low = pd.Series(rep).groupby(root).transform("min").to_numpy()
    return pd.DataFrame({"rep": rep[hit], "links": links[hit], "low": low[hit]})


def made_order(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keeps each unordered pair of one block once: the one whose first row comes earlier in ``order``."""
    place = np.empty(order.max() + 1, np.int64)
    place[order] = np.arange(len(order))
    return place[a] < place[b]


def vector_groups(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 23) -> DataFrame:
    """Near-duplicate vectors: per row ``id_col, n_links, component_id, kept``.

    Equal vectors are collapsed first. The others are laid out in cells along one sorted random projection, so wide
    that a pair at the threshold lies in one cell or two adjacent ones (up to a chance of about 2 in 10,000), and
    cells in blocks of bounded size. A task takes two blocks, counts for every pair in reach on how many projections
    the two fall within a window around each other, first on a few and then on all, keeps pairs with a
    count that a pair at the threshold reaches with probability ``RECALL``, and verifies those by
    their cosine in double precision. It returns sums and the smallest row reached, never pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and those of another length, link with nothing; a row
    without an id keeps null as its component and is not kept. Repeated rows are separate vectors. Other columns are ignored.
    """
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    good = base.where(usable(F.col("v")))
    classes = good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("rep is not null")
    dims = F.size("v")

    def place(parts):
        first = {}
        for pdf in parts:
            if len(pdf):
                cells = np.empty(len(pdf), np.int32)
                sizes = pdf["v"].map(len).to_numpy()
                for d in np.unique(sizes):
                    if d not in first:
                        first[d] = np.random.default_rng(seed).normal(size=(d, PROJECTIONS))[:, 0]
                    x = np.stack(pdf["v"][sizes == d]).astype(np.float64)
                    cells[sizes == d] = np.floor(x @ first[d] / np.linalg.norm(x, axis=1) / (REACH * math.sqrt(2 - 2 * cosine)))
                yield pdf.assign(cell=cells)

    kind = base.schema["v"].dataType.simpleString()
    classes = durable(classes.mapInPandas(place, f"v {kind}, rep bigint, n bigint, cell int").withColumn("dim", dims), "vec-classes")
    # cells are a handful: the projections of unit vectors spread over a few window widths
    sizes = durable(classes.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "vec-cells")
    dealt = classes.join(sizes, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = sizes.select("dim", F.col("cell").alias("other_cell"), F.col("blocks").alias("other_blocks"))
    beside = sizes.join(other, (sizes["dim"] == other["dim"]) & F.col("other_cell").between(F.col("cell"), F.col("cell") + 1)).drop(other["dim"])
    # pairs of blocks: of one cell each pair once, of two adjacent cells every pair
    pairs = beside.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("same", F.col("cell") == F.col("other_cell"))
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.when(F.col("same"), F.col("block")).otherwise(0), F.col("other_blocks") - 1)))
    pair = F.struct("dim", "cell", "block", "other_cell", "other").alias("pair")
    sides = pairs.select(pair, "dim", "cell", "block", F.lit(0).alias("side"))
    sides = sides.unionByName(pairs.where(~F.col("same") | (F.col("block") != F.col("other"))).select(pair, "dim", F.col("other_cell").alias("cell"), F.col("other").alias("block"), F.lit(1).alias("side")))
    met = dealt.join(sides, ["dim", "cell", "block"]).select("pair", "side", "rep", "n", "v")
    found = met.groupBy("pair").applyInPandas(lambda pdf: _compare(pdf, cosine, seed), "rep bigint, links bigint, low bigint")
    found = durable(found, "vec-links")
    nodes = connected_components(found.select(F.col("rep").alias("u"), F.col("low").alias("v"))).select(F.col("node").alias("rep"), "component")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = classes.select("v", "rep", "n").join(linked, "rep", "left").join(nodes, "rep", "left")
    classes = classes.select(F.col("v").alias("_v"), F.coalesce("component", "rep").alias("_component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"))
    joined = good.join(classes, F.col("v") == F.col("_v"), "left").select("id", F.coalesce("_links", F.lit(0)).alias("n_links"), F.coalesce("_component", "id").alias("component_id"))
    rest = base.where(~usable(F.col("v"))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = joined.unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
