"""Proportional stratified interleaving: shards that all have the mixture of the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.common import load, stage, whole_text

ROW_COST = 16
"""Bytes that a row takes besides its text."""


def _running_before(value: str, over) -> Column:
    return F.coalesce(F.sum(value).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def rank_within(df: DataFrame, strata: list[str], fraction: Column, order: list, bins: int) -> DataFrame:
    """Adds ``rank`` (from 0, in ``order``, within the strata) and ``total`` (rows of the stratum).

    ``fraction`` runs from 0 to 1 in the same direction as ``order``.  Rows are numbered within
    (stratum, bin of the fraction) and the rows of the bins before are added, so a stratum that
    holds most rows is still numbered by ``bins`` tasks.  Only the counts, at most strata x bins
    rows, are accumulated in order; they are joined back by (stratum, bin).
    """
    df = df.withColumn("_bin", F.least(F.floor(fraction * bins), F.lit(bins - 1)).cast("int"))
    counts = df.groupBy(*strata, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    if strata:
        ordered, whole = Window.partitionBy(*strata).orderBy("_bin"), Window.partitionBy(*strata)
    else:
        counts = counts.withColumn("_all", F.lit(0))
        ordered, whole = Window.partitionBy("_all").orderBy("_bin"), Window.partitionBy("_all")
    starts = counts.select(*strata, "_bin", _running_before("_n", ordered).alias("_before"),
                           F.sum("_n").over(whole).alias("total"))
    numbered = df.withColumn("_place", F.row_number().over(Window.partitionBy(*strata, "_bin").orderBy(*order)))
    return (numbered.join(starts, [*strata, "_bin"])
            .withColumn("rank", F.col("_before") + F.col("_place") - 1).drop("_bin", "_before", "_place"))


def shard(docs: DataFrame, shards: int, seed: int = 7, rows_per_bin: int = 5_000,
          keys: tuple[str, ...] = ("doc_id",), source: str = "source") -> DataFrame:
    """Deal the rows of ``docs`` out to ``shards`` shards; adds ``shard`` and ``slot``.

    Within each source, rows are shuffled by a seeded hash of their keys and ranked; the rank
    divided by the source's size is the row's fraction.  Rows sorted by fraction are cut into
    shards whose sizes differ by one row at most, so every shard has each source's share to a
    row or two.  ``slot`` counts from 0 without gaps within the shard.

    Defined results: null sources are a stratum of their own; rows with equal keys (repeated
    rows) are told apart by nothing and take neighbouring places; fewer rows than shards leave
    shards empty; an empty table gives no row; other columns are carried along, and columns that
    are called ``shard`` or ``slot`` are replaced.  ``docs`` is read several times: give a stage
    table of ids and sizes, not the texts.
    """
    carried = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    source_of = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))
    df = docs.select(F.struct(*carried).alias("row"), source_of.alias("source"),
                     F.xxhash64(F.lit(seed), *keys).alias("h"))
    bins = max(1, df.count() // rows_per_bin)
    ties = [F.col(f"row.`{k}`") for k in keys]
    even = (F.shiftright("h", 11) + F.lit(2 ** 52)) / F.lit(float(2 ** 53))
    df = rank_within(df, ["source"], even, ["h", *ties], bins)
    df = df.withColumn("f", (F.col("rank") + 0.5) / F.col("total")).drop("rank", "total")
    df = rank_within(df, [], F.col("f"), ["f", F.xxhash64(F.lit(seed), "source"), "source", "h", *ties], bins)
    # shard s begins at rank ceil(s * total / shards); all in whole numbers
    return df.select("row.*", F.expr(f"cast((rank * {shards}) div total as int)").alias("shard"),
                     F.expr(f"rank - (((rank * {shards}) div total * total + {shards - 1}) div {shards})").alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``rows``."""
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(whole_text()) + ROW_COST).cast("long").alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"))
    out = shard(stage(docs, "sizes"), 40, keys=("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
