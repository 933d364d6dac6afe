"""A corpus pipeline in five stages: each takes the documents that the one before it kept.

Every stage is written as Parquet in the folder all executors share and read again, so a lost executor never costs
more than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import line_dedup, mixing, packing, simhash, toxicity
from auditloom.llm.common import durable
from auditloom.llm.queries import MAX_EPOCHS, WEIGHTS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _slim(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator needs, and all others as one, so that no name of theirs can clash with its results."""
    held = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(F.lit(0).alias("_"), *held).alias("_held"))


def _whole(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, those ``changed`` with new values."""
    held = df.schema["_held"].dataType.fieldNames()
    return df.select(*[changed.get(c, F.col("_held")[c] if c in held else F.col(c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; all columns stay as they are. Null texts count as empty, repeated rows are judged alike."""
    scored = toxicity.score_toxicity(_slim(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _whole(scored.where(F.col("predicted") == 0), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those of which nothing but white space is left go."""
    cut = line_dedup.dedup_lines(_slim(docs, "doc_id", "text"), short_lines=True)
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _whole(left, docs, n_chars=F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("_held.n_chars")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash group, once if its row is repeated; ids may be null or shared."""
    return _whole(simhash.one_per_group(_slim(docs, "doc_id", "text")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole repetitions, and the first words of one that is taken in part."""
    mixed = mixing.mix(_slim(docs, "doc_id", "text", "source"), WEIGHTS, MAX_EPOCHS)
    size, taken = F.col("size"), F.col("taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(0)).cast("int")
    rest = F.when(size > 0, taken % size).otherwise(F.lit(0))
    copies = whole + F.when(rest > 0, 1).otherwise(0)
    rows = mixed.withColumns({"_whole": whole, "_rest": rest.cast("int")}).where(copies > 0)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.greatest(F.col("_rest"), F.lit(0))), "")
    in_part = F.col("_copy") > F.col("_whole")
    chars = F.when(in_part, F.char_length(cut).cast("bigint")).otherwise(F.col("_held.n_chars"))
    return _whole(rows, docs, text=F.when(in_part, cut).otherwise(F.col("text")), n_chars=chars)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in fixed-length sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Training a classifier, components of near duplicates and tokenisation are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
