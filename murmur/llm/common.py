"""What the operators of this subpackage share: reading, stage tables and Arrow batch size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.session import configure
from murmur.sources import stages
from murmur.sources.tables import table

WORD_GAP = r"[\x20\x09-\x0D]+"
"""Characters between words (space and the five ASCII controls), as a Java pattern."""

BATCH_ROWS = 512
"""Rows in an Arrow batch: texts are long, and a batch must fit a worker many times over."""

_open_stages: list[str] = []


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, name)


def prepare(spark: SparkSession) -> SparkSession:
    """Session defaults for texts: small Arrow batches (kept if the session names its own)."""
    configure(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the written copy.

    The copy cuts the lineage and survives lost executors.  It stays until ``delete``.
    """
    spark = df.sparkSession
    path = stages.stage_path(spark, f"llm-{name}-{uuid.uuid4().hex[:8]}", unique=False)
    df.write.mode("overwrite").options(**options).parquet(path)
    _open_stages.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def opened_tables() -> Iterator[list[str]]:
    """The paths of the stage tables written inside, listed when it ends."""
    before, paths = len(_open_stages), []
    yield paths
    paths += _open_stages[before:]


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete stage tables, and empty the list.  Whatever read them must have been written."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(hadoop).delete(path, True)


def whole_text(text: Column | str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column | str, divisor: int) -> Column:
    """crc32 of the decimal document id, modulo ``divisor``: the folds of the learned operators."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def narrow(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, cast; a table may hold others with any name."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


def add_column(df: DataFrame, name: str, kind: str, source: str, make) -> DataFrame:
    """``df`` with one more column: ``make`` turns an Arrow array of ``source`` into the new one.

    A column of that name is replaced; the others pass through, whatever their names.  If ``make``
    has a method ``end``, it is called after the last batch of a task.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    given = df.select(*kept, F.col(f"`{source}`").alias("\x00in"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(name, T._parse_datatype_string(kind))])
    names = [field.name for field in schema.fields]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            *columns, made_from = part.columns
            yield pa.RecordBatch.from_arrays([*columns, make(made_from)], names=names)
        getattr(make, "end", lambda: None)()

    return given.mapInArrow(batches, schema)


SMALL_ROWS = 2_000_000
"""Ids that are broadcast at most (16 MB); more of them are joined by a shuffle."""


def small_side(ids: DataFrame) -> DataFrame:
    """A written table of ids as one side of a join: broadcast if its counted size allows it."""
    return F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids
