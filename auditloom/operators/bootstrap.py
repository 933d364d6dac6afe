"""Site-stratified paired bootstrap of the excess AURC."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions.columns import missing_to_null
from auditloom.operators.rank import eaurc_by_method
from auditloom.session import cut_lineage

REPLICATES, SEED, MIN_FINITE = 2000, 42, 100
#: Score rows (cases times methods) up to which a task takes whole replicates; 4 bytes each and 8 for each case, sent to every task.
DENSE_ROWS = 1 << 22
#: Hashes of numbers of equal length made at once, and the least for which that is faster than one by one.
HASHES, FEW_HASHES = 1 << 14, 1 << 11
SCORED = ["site", "site_pos", "case_pos", "case_id", "dice", "method", "score"]
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def draws(cases: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """``rep, site, draw_pos, case_id``: n draws with replacement per site and replicate, the same for every method (O-83).

    The draw is a hash of seed, site, replicate and position, so it is the same wherever it is computed.
    """
    place = Window.partitionBy("site").orderBy("case_pos")
    placed = cases.withColumn("_i", F.row_number().over(place) - 1)
    sizes = placed.groupBy("site").agg(F.count("*").alias("_n"))
    every = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("draw_pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    text = F.concat_ws("|", F.lit(str(seed)), "site", F.col("rep").cast("string"), F.col("draw_pos").cast("string"))
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    every = every.withColumn("_i", (number % F.col("_n")).cast("int"))
    return every.join(placed.select("site", "_i", "case_id", "dice", "site_pos"), ["site", "_i"]).select("rep", "site", "site_pos", "draw_pos", "case_id", "dice")


def numpy_draws(spark: SparkSession, sizes: list[tuple[str, int]], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """``rep, site, draw_pos, i`` from numpy's generator, site after site in each replicate: the draws of published results (O-83).

    One stream gives all draws, so the driver makes them; ``draws`` is what larger tables take.
    """
    rng = np.random.default_rng(seed)
    rows = [(r, site, rng.integers(0, n, n).tolist()) for r in range(replicates) for site, n in sizes]
    drawn = spark.createDataFrame(rows, "rep int, site string, i array<bigint>")
    return drawn.select("rep", "site", F.posexplode("i").alias("draw_pos", "i"))


def replicate_table(scored: DataFrame, replicates: int = REPLICATES, seed: int = SEED, dense_rows: int = DENSE_ROWS, published: bool = False) -> DataFrame:
    """``rep, method, eaurc_within, eaurc_pooled`` of every method in every replicate.

    Up to ``dense_rows`` rows of scores are sent to all tasks as arrays, and a task makes whole replicates of them; larger
    tables are drawn and ranked as relations. Both take the same draws. ``published`` takes numpy's stream instead (see ``numpy_draws``).
    """
    rows = scored.select(*SCORED)
    if rows.limit(dense_rows + 1).count() <= dense_rows:
        return _dense_replicates(rows, replicates, seed, published)[0]
    cases = rows.select("case_id", "site", "site_pos", "case_pos", "dice").distinct()
    if published:
        raise ValueError(f"published draws are made for at most {dense_rows} rows of scores")
    drawn = draws(cases, replicates, seed).join(rows.select("case_id", "site", "method", "score"), ["case_id", "site"])
    return eaurc_by_method(drawn, ["rep"], [F.col("draw_pos")])


def replicates_and_points(scored: DataFrame, replicates: int = REPLICATES, seed: int = SEED, dense_rows: int = DENSE_ROWS) -> tuple[DataFrame, DataFrame]:
    """``replicate_table``, checkpointed, and ``eaurc_by_method`` of the cases themselves, both from the same arrays where these can be made."""
    rows = scored.select(*SCORED)
    if rows.limit(dense_rows + 1).count() <= dense_rows:
        table, points = _dense_replicates(rows, replicates, seed, False)
        return cut_lineage(table), rows.sparkSession.createDataFrame([p[1:] for p in points], "method string, eaurc_within double, eaurc_pooled double")
    return cut_lineage(replicate_table(scored, replicates, seed, dense_rows)), cut_lineage(eaurc_by_method(scored))


def _md5(blocks: list[list[np.ndarray]], n: int) -> np.ndarray:
    """First four bytes of the MD5 of each of ``n`` messages, as a big-endian number; a block is 16 little-endian words, those equal in all messages of length one."""
    state = [np.full(n, x, np.uint32) for x in _START]
    for block in blocks:
        a, b, c, d = state
        for i in range(64):
            if i < 16:
                mix, k = c ^ d, i
                mix &= b
                mix ^= d
            elif i < 32:
                mix, k = b ^ c, (5 * i + 1) % 16
                mix &= d
                mix ^= c
            elif i < 48:
                mix, k = b ^ c, (3 * i + 5) % 16
                mix ^= d
            else:
                mix, k = ~d, 7 * i % 16
                mix |= b
                mix ^= c
            mix += a
            mix += block[k] + np.uint32(_SINES[i])
            by = _SHIFTS[i // 16][i % 4]
            high = mix >> np.uint32(32 - by)
            mix <<= np.uint32(by)
            mix |= high
            mix += b
            a, b, c, d = d, mix, b, c
        state = [x + y for x, y in zip(state, (a, b, c, d), strict=True)]
    return state[0].byteswap()


def hash_draws(prefix: str, n: int) -> np.ndarray:
    """For each of 0 to n - 1, written after ``prefix``, the first 32 bits of the text's MD5 modulo n: what ``draws`` takes."""
    head, out = prefix.encode(), np.empty(n, np.int64)
    for digits in range(1, len(str(n)) + 1):
        low, high = 10 ** (digits - 1) if digits > 1 else 0, min(n, 10**digits)
        if high - low < FEW_HASHES:
            out[low:high] = [int.from_bytes(hashlib.md5(head + b"%d" % d).digest()[:4], "big") for d in range(low, high)]
            continue
        length = len(head) + digits
        text = head + b"0" * digits + b"\x80" + b"\0" * ((55 - length) % 64) + (8 * length).to_bytes(8, "little")
        fixed = np.frombuffer(text, "<u4").astype(np.uint32)
        for first in range(low, high, HASHES):
            number = np.arange(first, min(high, first + HASHES), dtype=np.uint32)
            words = [fixed[k : k + 1] for k in range(len(fixed))]
            for at in range(length - 1, length - 1 - digits, -1):
                number, digit = np.divmod(number, np.uint32(10))
                words[at // 4] = words[at // 4] + (digit << np.uint32(8 * (at % 4)))
            out[first : first + len(number)] = _md5([words[k : k + 16] for k in range(0, len(words), 16)], len(number))
    return out % max(n, 1)


def _area(risk: np.ndarray, parts: np.ndarray) -> float:
    """Mean over k of the mean of the first k risks; ``parts`` holds 1 / k."""
    total = np.cumsum(risk)
    total *= parts[: len(risk)]
    return float(total.mean())


def _dense_replicates(rows: DataFrame, replicates: int, seed: int, published: bool) -> tuple[DataFrame, list[tuple]]:
    """Cases lie site after site in arrays: their risks and, for each method, the rank of their score, equal for equal scores.

    A replicate's draws are put in order of these ranks, the later first of equal ones; that is the order of its sites as well.
    The second result is a replicate of number -1 in which each case is drawn once, in its own place.
    """
    spark = rows.sparkSession
    scores = F.transform(F.array_sort(F.collect_list(F.struct("method", "score"))), lambda x: x["score"])
    methods = sorted(r.method for r in rows.select("method").distinct().collect())
    table = rows.groupBy("site_pos", "site", "case_pos", "case_id", "dice").agg(scores.alias("scores")).toPandas()  # at most DENSE_ROWS rows, as the caller has counted
    table = table.sort_values(["site_pos", "site", "case_pos", "case_id"], ignore_index=True)
    sites = list(table[["site_pos", "site"]].drop_duplicates()["site"])
    sizes = table.groupby(["site_pos", "site"], dropna=False).size().tolist()  # in the order of the rows
    score = np.array(table["scores"].tolist(), np.float64).reshape(len(table), len(methods))
    ranks = [np.unique(score[:, m], return_inverse=True)[1].astype(np.int32) for m in range(len(methods))]
    shared = spark.sparkContext.broadcast((1 - table["dice"].to_numpy(np.float64), ranks))

    def one(rep: int, drawn: list[np.ndarray], parts: np.ndarray) -> list[tuple]:
        risk, ranks = shared.value
        if not ranks:
            return []
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        case = np.concatenate([i + first for i, first in zip(drawn, starts, strict=False)])[::-1]  # the later first
        cuts = (len(case) - starts[-2:0:-1]).tolist()  # the last site comes first
        r = risk[case]
        best, best_pool = np.array([_area(np.sort(part), parts) for part in np.split(r, cuts)]), _area(np.sort(r), parts)
        out = []
        for method, rank in zip(methods, ranks, strict=True):
            place = rank[case].astype(np.int64) << 32
            place |= np.arange(len(case))  # distinct keys: places settle equal ranks
            within = np.array([_area(r[np.sort(part) & 0xFFFFFFFF], parts) for part in np.split(place, cuts)])
            place.sort()
            pool = _area(r[place & 0xFFFFFFFF], parts)
            out.append((rep, method, float(np.mean(within - best)), pool - best_pool))
        return out

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        harmonic = 1 / np.arange(1, sum(sizes) + 1)
        for part in parts:
            found = []
            for row in part.itertuples():
                if published:
                    stream = dict(zip(row.sites, row.i, strict=True))
                    drawn = [np.asarray(stream[s], np.int64) for s in sites]
                else:
                    drawn = [hash_draws(f"{seed}|{s}|{row.rep}|", n) for s, n in zip(sites, sizes, strict=True)]
                found += one(row.rep, drawn, harmonic)
            yield pd.DataFrame(found, columns=["rep", "method", "eaurc_within", "eaurc_pooled"], dtype=object)

    if published:
        drawn = numpy_draws(spark, list(zip(sites, sizes, strict=True)), replicates, seed)
        reps = drawn.groupBy("rep", "site").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw_pos", "i"))), lambda x: x["i"]).alias("i"))
        reps = reps.groupBy("rep").agg(F.collect_list("site").alias("sites"), F.collect_list("i").alias("i"))
    else:
        reps = spark.range(0, replicates, 1, max(1, min(replicates, spark.sparkContext.defaultParallelism))).select(F.col("id").cast("int").alias("rep"))
    return reps.mapInPandas(run, "rep int, method string, eaurc_within double, eaurc_pooled double"), one(-1, [np.arange(n) for n in sizes], 1 / np.arange(1, sum(sizes) + 1))


def interval(x: Column, confidence: float = 0.95, least: int = MIN_FINITE) -> tuple[Column, Column]:
    """Percentile interval over the replicates, null under ``least`` of them (O-84)."""
    tail = (1 - confidence) / 2
    return tuple(F.when(F.count(x) >= least, F.percentile(x, q)) for q in (tail, 1 - tail))


def p_value(x: Column, least: int = MIN_FINITE) -> Column:
    """Two-sided bootstrap p-value of a difference (O-85)."""
    fewer = F.least(F.count_if(x <= 0), F.count_if(x >= 0))
    return F.when(F.count(x) >= least, F.least(F.lit(1.0), 2.0 * (fewer + 1) / (F.count(x) + 1)))


def bootstrap_ci(replicates: DataFrame, points: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Point estimates with their intervals (O-88)."""
    columns = []
    for scope in ("within", "pooled"):
        low, high = interval(missing_to_null(F.col(f"eaurc_{scope}")), confidence)
        columns += [low.alias(f"{scope}_low"), high.alias(f"{scope}_high")]
    return points.join(replicates.groupBy("method").agg(F.count("*").alias("n_boot"), *columns), "method")


def paired_tests(replicates: DataFrame, points: DataFrame, pairs: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Differences method minus reference, per replicate and in the point estimates (O-86, O-89)."""

    def differences(table: DataFrame, on: list[str]) -> DataFrame:
        a = table.select(*on, "method", F.col("eaurc_within").alias("_aw"), F.col("eaurc_pooled").alias("_ap"))
        b = table.select(*on, F.col("method").alias("reference"), F.col("eaurc_within").alias("_bw"), F.col("eaurc_pooled").alias("_bp"))
        both = F.broadcast(pairs.select("method", "reference")).join(a, "method").join(b, [*on, "reference"])
        return both.select(*on, "method", "reference", (F.col("_aw") - F.col("_bw")).alias("within"), (F.col("_ap") - F.col("_bp")).alias("pooled"))

    columns = []
    for scope in ("within", "pooled"):
        x = missing_to_null(F.col(scope))
        low, high = interval(x, confidence)
        columns += [low.alias(f"{scope}_low"), high.alias(f"{scope}_high"), p_value(x).alias(f"{scope}_p")]
    spread = differences(replicates, ["rep"]).groupBy("method", "reference").agg(F.count("within").alias("n_boot"), *columns)
    point = differences(points, []).withColumnsRenamed({"within": "within_diff", "pooled": "pooled_diff"})
    return point.join(spread, ["method", "reference"])
