"""What several operators share: durable intermediates and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); where none is set, a local one in local mode, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/auditloom-{os.getpid()}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    return _write(df, f"{shared_dir(df.sparkSession).rstrip('/')}/auditloom/{name}-{uuid.uuid4().hex}")


class Scratch:
    """Written intermediate tables of one operator call, deleted as soon as its last one is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/auditloom/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame, name: str, last: bool = False) -> DataFrame:
        """Write and reread ``df``; after the last table, which stays for the result to read, the others go."""
        self.made += 1
        if not last:
            return _write(df, f"{self.root}/{self.made}-{name}")
        out = _write(df, f"{self.root}-{name}")
        self.drop()
        return out

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Largest bit array of a filter frame; more keys than it serves only make the filter let more rows pass.
FILTER_BITS = 1 << 26


def filter_frame(keys: DataFrame, count: int) -> DataFrame:
    """A Bloom filter of the bigint column ``key`` as a frame of one row, ``_bits array<bigint>``: ten bits for each key, up to FILTER_BITS.

    It is for broadcasting to rows that a join will test exactly afterwards, so that rows without a partner need no shuffle.
    """
    words = 1 << max(6, min(FILTER_BITS, 10 * max(1, count)).bit_length() - 6)
    spots = keys.select(F.explode(F.array(*[_spot(F.col("key"), i, words) for i in range(3)])).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))
    found = spots.select(F.floor(F.col("p") / 64).alias("at"), one.alias("bit"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("bit"))
    packed = found.unionByName(every).groupBy("at").agg(F.bit_or("bit").alias("word"))
    return packed.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("_bits"))


def _spot(key: Column, i: int, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(words * 64))


def maybe_in(rows: DataFrame, key: Column, frame: DataFrame, count: int) -> DataFrame:
    """The rows whose ``key`` passes the filter of ``filter_frame(keys, count)``: all that have a partner, and few others."""
    words = 1 << max(6, min(FILTER_BITS, 10 * max(1, count)).bit_length() - 6)

    def is_set(i: int) -> Column:
        at = _spot(key, i, words)
        word = F.get(F.col("_bits"), F.floor(at / 64).cast("int"))
        return F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1

    return rows.join(F.broadcast(frame)).where(is_set(0) & is_set(1) & is_set(2)).drop("_bits")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for the small frames of iterative plans."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected graph.

    ``edges``: two bigint columns ``u`` and ``v``; loops, repeats and either direction are fine, rows with a
    null end are ignored. Returns ``node, component`` for every node with an edge to another node.

    Alternating large-star and small-star steps: each joins nodes to their smallest neighbour, so the edge count
    never exceeds that of the input and the number of rounds grows with the logarithm of the longest chain.
    Every step is an aggregate and an equi-join; hubs are split by adaptive skew joins. State is checkpointed
    each round, and only counts reach the driver.
    """
    u, v = F.col("u"), F.col("v")
    edges = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges = cut(edges)
    state = _fingerprint(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _fingerprint(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # at rest every edge leads from a node straight to the root of its component
    nodes = edges.select(u.alias("node"), v.alias("component"))
    return nodes.unionByName(nodes.select("component").distinct().select(F.col("component").alias("node"), "component"))
