"""Near-duplicate documents by SimHash: fingerprints, a popcount-grid range join, and classes of linked texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import LOWER, UPPER, connected_components, durable

#: Sixteen segments of four bits make the grid fine enough that unrelated fingerprints rarely share a cell.
SEGMENTS, BITS = 16, 4


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """SimHash of one text as an unsigned 64-bit integer; a text without words gives zero."""
    import re

    import xxhash

    found = re.findall(r"[^\x20\x09-\x0d]+", text.translate(str.maketrans(UPPER, LOWER)))
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    raw = [x.encode("utf-8", "surrogatepass") for x in found]
    if len(raw) <= words:
        hashes = [digest(b" ".join(raw), seed)]
    else:
        joined, ends, at = b" ".join(raw), [], -1
        for x in raw:
            at += len(x) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends]]
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :], strict=False)]
    counts, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, 1 << 15):  # bounded scratch space for very long texts
        block = np.array(hashes[i : i + (1 << 15)], np.uint64)
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``id_col`` and ``fp`` (signed bigint holding the 64 bits) for each row; null texts count as empty."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [fingerprint(x.as_py() or "", words, seed) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(batches, schema)


def cell(fp: Column) -> Column:
    """The popcount embedding packed into a bigint: each nibble becomes the number of its own set bits."""

    def half(x: Column) -> Column:
        pairs = x.bitwiseAND(F.lit(0x55555555)) + F.shiftright(x, 1).bitwiseAND(F.lit(0x55555555))
        return pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftright(pairs, 2).bitwiseAND(F.lit(0x33333333))

    high, low = half(F.shiftrightunsigned(fp, 32)), half(fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.shiftleft(high, 32).bitwiseOR(low)


def grid_points(at: Column) -> Column:
    """The grid points at Manhattan distance of at most one from an embedding, itself included."""
    points = [at]
    for i in range(SEGMENTS):
        count = F.shiftrightunsigned(at, i * BITS).bitwiseAND(F.lit(15).cast("bigint"))
        moved = lambda n, count=count, i=i: at.bitwiseXOR(F.shiftleft(count.bitwiseXOR(n), i * BITS))
        points += [F.when(count < BITS, moved(count + 1)), F.when(count > 0, moved(count - 1))]
    return F.array_compact(F.array(*points))


def links(classes: DataFrame) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints at two or fewer differing bits, as stars.

    ``classes``: one row per distinct ``fp``. Two vectors of segment bit counts at Manhattan distance of at most
    two share a grid point within distance one of both, and that distance is a lower bound of the number of
    differing bits; so the range join is an equi-join on the 1 + 2 * SEGMENTS grid points around each vector.
    A cell that holds a single fingerprint is dropped by a pre-aggregated count. In the cells left, the exact check
    runs on the fingerprints' own neighbours that map to that cell: two fingerprints differ in at most two
    bits exactly if one 64-bit value lies within one bit of both. Everything that meets at such a value is
    mutually linked, so it is tied to its smallest member: no group is ever expanded into all pairs, and a group of
    any size costs rows in proportion to its members.
    """
    fp = F.col("fp")
    cells = classes.select("fp", cell(fp).alias("at")).select("fp", F.explode_outer(grid_points(F.col("at"))).alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("cell")
    met = durable(cells.join(shared, "cell", "left_semi"), "simhash-met")
    bits = F.sequence(F.lit(-1), F.lit(63))
    own = F.transform(bits, lambda i: F.when(i < 0, fp).otherwise(fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(i, F.lit(0))))))
    near = met.select("fp", "cell", F.explode_outer(F.filter(own, lambda m: cell(m) == F.col("cell"))).alias("mid")).where("mid is not null")
    star = near.groupBy("cell", "mid").agg(F.min("fp").alias("v"), F.max("fp").alias("hi")).where("v <> hi").drop("hi")
    return near.join(star, ["cell", "mid"]).where("fp <> v").select(fp.alias("u"), "v").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """Group documents whose SimHash fingerprints are linked, directly or through others.

    Returns one row per input row: ``id_col``, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` (the
    smallest id reachable, the row's own included). Equal fingerprints are collapsed before anything is compared.
    Null and empty texts have fingerprint zero and link like any other; rows with a null id keep a row, join
    their group, and are the component's id only if the whole group has none. Repeated rows stay. Other columns of
    ``docs`` are ignored, whatever their names. An empty table gives no rows.
    """
    marked = durable(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", words, seed), "simhash-fp")
    tied = _tied(marked)
    lows = tied.groupBy("component").agg(F.min("first").alias("component_id"))
    of = tied.join(lows, "component").select("fp", "component_id")
    return marked.join(of, "fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _tied(marked: DataFrame) -> DataFrame:
    """``fp, first, component`` of every distinct fingerprint of ``marked`` (``_id, fp``): its smallest id and its group's smallest fingerprint."""
    classes = durable(marked.groupBy("fp").agg(F.min("_id").alias("first")), "simhash-classes")
    nodes = connected_components(links(classes.select("fp")))
    tied = classes.join(nodes.select(F.col("node").alias("fp"), "component"), "fp", "left")
    return tied.select("fp", "first", F.coalesce("component", "fp").alias("component"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """One row of ``docs`` for each SimHash group, with all columns.

    It is the row with the smallest id; rows without an id come after all others, and rows of one id are told
    apart by a hash of the text. Groups are told apart by their fingerprints, so neither null nor repeated ids join them.
    """
    mark = F.xxhash64(F.col(text_col), F.col(text_col).isNull())
    row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), mark.alias("mark"))
    marked = durable(fingerprints(docs.select(row.alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", words, seed), "simhash-fp")
    kept = _tied(marked).groupBy("component").agg(F.min("first").alias("_row")).select(F.col("_row.id").alias("_kept"), F.col("_row.mark").alias("_kept_mark"))
    rows = docs.withColumn("_mark", mark)
    rows = rows.join(kept, F.col(id_col).eqNullSafe(F.col("_kept")) & (F.col("_mark") == F.col("_kept_mark")), "left_semi")
    return rows.dropDuplicates([id_col, "_mark"]).drop("_mark")
