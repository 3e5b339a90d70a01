"""Stage tables in the shared checkpoint folder (never a machine-local
path): writing a stage cuts the lineage and makes the build restartable."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from murmur.session import checkpoint_dir


def stage_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/murmur-stages/{name}" + (f"-{uuid.uuid4().hex[:12]}" if unique else "")


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_stage(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """``schema`` is needed for a partitioned stage that may have no rows, and so no files."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a stage table and continue from the written copy."""
    spark = df.sparkSession
    return read_stage(spark, write_stage(df, stage_path(spark, name), partition_by))


def write_word_list(words: DataFrame, path: str, col: str = "word") -> None:
    """A small word list (e.g. the top-n stopwords) as one sorted text file."""
    words.select(col).orderBy(col).coalesce(1).write.mode("overwrite").text(path)
