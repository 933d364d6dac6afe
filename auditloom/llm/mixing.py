"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import WORD, durable

#: Documents of a source are dealt over this many buckets in a seeded random order, so that no sort holds a source.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sources: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """Targets of ``sources`` (``source``, ``size``; one row each): adds ``weight`` and ``target``.

    Weights are given in code-point order of the source, null last, repeating. All sizes together are shared
    by weight; a source stops at ``max_epochs`` times its size, and the excess is shared anew by weight. Sources
    reach their cap in the order of cap per weight, so the repeated clamping has a closed form: with the sources
    in that order, one is clamped exactly if its cap is at most its share of what the ones before it leave.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("_rank", F.row_number().over(everything) - 1).withColumn("weight", F.get(given, F.col("_rank") % len(weights)))
    ranked = ranked.withColumn("_cap", (F.col("size") * max_epochs).cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumns({
        "_left": F.sum("size").over(whole).cast("double") - (F.sum("_cap").over(upto) - F.col("_cap")),
        "_weights": F.sum("weight").over(whole) - (F.sum("weight").over(upto) - F.col("weight")),
    })
    ranked = ranked.withColumn("_clamped", F.col("_cap") * F.col("_weights") <= F.col("_left") * F.col("weight"))
    # the first source that is not clamped sets the level for itself and all after it
    first = F.min(F.when(~F.col("_clamped"), F.struct(F.col("_cap") / F.col("weight"), F.col("_rank"), F.col("_left"), F.col("_weights")))).over(whole)
    ranked = ranked.withColumn("_level", first).withColumn(
        "target", F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level._left") * F.col("weight") / F.col("_level._weights")))
    )
    return ranked.select("source", "size", "weight", "target")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words the mix takes of every document: adds ``size``, ``source_size``, ``target`` and ``taken``.

    A source whose target is r times its size is taken floor(r) times whole; the fractional rest goes to its
    documents in a seeded random order (the md5 of seed and id) until it is used up, and the document at which that
    happens gives only the words still missing. So each source meets the integer part of its target and no
    document is taken more than ``max_epochs`` times.

    The order is laid out in buckets per source: sums per bucket are pre-aggregated, whole buckets are decided from
    those sums, and only the one bucket in which a source's rest runs out is sorted. What reaches the documents is
    one row per source, so they are not shuffled while the sources fit a broadcast, and otherwise by a join
    that splits hot sources. A null source is a source of its own, null text has size zero, ties of the
    random order go by text, and repeated rows (equal id and text) at the cut share what is left in equal whole words.
    Columns of ``docs`` named like a result are replaced, the others stay. An empty table gives no rows.
    """
    src, text, size = F.col("_source"), F.col(text_col), F.col("size")
    base = docs.drop("size", "source_size", "target", "taken").withColumn("size", word_count(text))
    base = base.withColumn("_order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))))
    base = base.withColumn("_bucket", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    tie = F.md5(F.coalesce(text, F.lit("")))

    buckets = durable(base.groupBy(F.col(source_col).alias("source"), F.col("_bucket").alias("bucket")).agg(F.sum("size").alias("words")), "mix-buckets")
    plan = water_fill(buckets.groupBy("source").agg(F.sum("words").alias("size")), weights, max_epochs)
    ratio = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0))
    plan = plan.withColumn("whole", F.least(F.lit(max_epochs), ratio).cast("bigint"))
    rest = F.floor(F.col("target") - F.col("whole") * size).cast("bigint")
    plan = plan.withColumn("rest", F.when(F.col("whole") >= max_epochs, F.lit(0)).otherwise(F.greatest(F.lit(0), rest)).cast("bigint"))

    # the bucket of each source in which the rest runs out, and the class of equal rows in it at which it does
    run = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = buckets.withColumnRenamed("source", "s").withColumn("upto", F.sum("words").over(run))
    edge = plan.join(upto, F.col("source").eqNullSafe(F.col("s"))).where(F.col("upto") > F.col("rest"))
    edge = edge.groupBy("s").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("edge"))
    edge = durable(edge.select(F.col("s").alias("_source"), "edge.*"), "mix-edges")
    rows = base.select(F.col(source_col).alias("_from"), "_bucket", "_order", tie.alias("_tie"), "size")
    rows = rows.join(edge, F.col("_from").eqNullSafe(src) & (F.col("_bucket") == F.col("bucket")))
    rows = rows.groupBy("_source", "before", "rest", "_order", "_tie").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    along = Window.partitionBy("_source").orderBy("_order", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.col("before") + F.sum("words").over(along) - F.col("words")).where(F.col("start") + F.col("words") > F.col("rest"))
    part = F.floor((F.col("rest") - F.col("start")) / F.col("n")).cast("bigint").alias("part")
    cuts = rows.groupBy("_source").agg(F.min(F.struct("_order", "_tie", part)).alias("cut")).withColumnRenamed("_source", "c")
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("c")), "left")
    plan = durable(plan.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", F.col("whole").alias("_whole"), F.col("cut").alias("_cut")), "mix-plan")

    at, here = F.col("_cut._order"), F.col("_order")
    extra = F.when(here < at, size).when(here > at, F.lit(0)).when(tie < F.col("_cut._tie"), size).when(tie > F.col("_cut._tie"), F.lit(0)).otherwise(F.coalesce(F.col("_cut.part"), F.lit(0)))
    out = base.join(plan, F.col(source_col).eqNullSafe(src))
    return out.withColumn("taken", (F.col("_whole") * size + extra).cast("bigint")).drop("_order", "_bucket", "_source", "_whole", "_cut")
