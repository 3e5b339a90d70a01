"""The vector store: texts, metadata and vectors on disk together with the encoder that made them.

Questions are encoded as they are, by the stored encoder, and searched in the stored table; hits
carry the stored text and metadata.  A store may be laid out by metadata columns, and searches that
are limited to values of these read the folders of those values only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.retrieval import BLOCK_BYTES, SEM_DIGITS, _blocks, _lists, _search, lex_terms
from murmur.operators.vectors import metadata
from murmur.sources.stages import read_stage, stage, write_stage


def bucket(term: Column, dims: int) -> Column:
    """A term's coordinate: the first 32 bits of its md5, modulo the dimension."""
    return (F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long") % dims).cast("int")


class HashEncoder:
    """Text -> unit vector of hashed term counts times idf; fitted in one aggregation, applied row by row."""

    def __init__(self, idf: list[float]):
        self.idf = np.array(idf, np.float64)

    @property
    def dims(self) -> int:
        return len(self.idf)

    @classmethod
    def fit(cls, df: DataFrame, text_col: str, dims: int = 256) -> HashEncoder:
        """Weights from the texts: idf = ln((1 + n) / (1 + rows with the coordinate)) + 1."""
        buckets = F.array_distinct(cls._buckets(text_col, dims))
        n = df.count()
        held = dict(df.select(F.explode(buckets).alias("b")).groupBy("b").count().collect())        # dims rows at most
        return cls([float(np.log((1.0 + n) / (1.0 + held.get(b, 0))) + 1.0) for b in range(dims)])

    @staticmethod
    def _buckets(text_col: str, dims: int) -> Column:
        return F.transform(lex_terms(F.coalesce(F.col(text_col), F.lit(""))), lambda t: bucket(t, dims))

    def encode(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        """Adds the vector of each text; a text without terms (or null) has the zero vector."""
        idf = self.idf
        given = df.drop(out).withColumn(out, self._buckets(text_col, self.dims))
        names = given.columns

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                flat, ends = _lists(part.column(part.num_columns - 1))
                row = np.repeat(np.arange(part.num_rows), np.diff(ends))
                cell = row * len(idf) + flat[ends[0]:ends[-1]]
                counts = np.bincount(cell.astype(np.int64), minlength=part.num_rows * len(idf)).reshape(-1, len(idf))
                raw = counts * idf
                norm = np.sqrt((raw * raw).sum(1, keepdims=True))
                unit = (raw / np.where(norm > 0, norm, 1)).astype(np.float32)
                at = np.arange(part.num_rows + 1, dtype=np.int32) * len(idf)
                column = pa.ListArray.from_arrays(pa.array(at), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column], names=names)

        schema = given.withColumn(out, F.col(out).cast("array<float>")).schema
        return given.mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        write_stage(spark.createDataFrame([(self.idf.tolist(),)], "idf array<double>"), path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HashEncoder:
        return cls(read_stage(spark, path).first()["idf"])


class VectorStore:
    """rows (comment_id, text, metadata, embedding, layout columns) and the encoder, under one folder."""

    def __init__(self, rows: DataFrame, encoder: HashEncoder):
        self.rows, self.encoder = rows, encoder

    @classmethod
    def write(cls, df: DataFrame, path: str, id_col: str, text_col: str, encoder: HashEncoder | None = None,
              layout: list[str] | None = None, dims: int = 256) -> VectorStore:
        """Encode and write ``df``; its other columns fill the metadata.  The encoder is fitted on it if none is given."""
        spark, path, layout = df.sparkSession, path.rstrip("/"), layout or []
        encoder = encoder or HashEncoder.fit(df, text_col, dims)
        encoded = encoder.encode(df, text_col)
        rows = encoded.select(F.col(id_col).alias("comment_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                              metadata(encoded).alias("metadata"), "embedding", *layout)
        write_stage(rows, f"{path}/rows", layout)
        encoder.save(spark, f"{path}/encoder")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorStore:
        path = path.rstrip("/")
        return cls(read_stage(spark, f"{path}/rows"), HashEncoder.load(spark, f"{path}/encoder"))

    def search(self, questions: DataFrame, k: int = 5, qid: str = "qid", text_col: str = "text",
               where: Column | None = None, by: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """(qid, rank, comment_id, text, metadata, semantic_score): the k nearest stored rows of each question.

        Scores are compared at 5 decimals, ties go to the smaller id; a question without a known term
        has score 0 with all rows; with fewer rows than k all are returned.  ``where`` limits all
        questions to some rows; ``by`` limits each to the rows that have its own value in that column
        (none for a null).  Both are pushed to the layout's folders.
        """
        rows = self.rows if where is None else self.rows.filter(where)
        asked = stage(self.encoder.encode(questions.select(
            F.col(qid).cast("long").alias("qid"), F.col(text_col).alias("t"),
            (F.col(by).cast("string") if by else F.lit("")).alias("g")).filter(F.col("qid").isNotNull()), "t"), "encoded-questions")
        group = F.lit("")
        if by:
            # only values that are asked for are read; the planner prunes folders at run time where one side is
            # small and has a comparison (this one also drops nulls)
            values = asked.filter(F.col("g") >= "").select(F.col("g").cast(rows.schema[by].dataType).alias(by)).distinct()
            rows = rows.join(values, by, "left_semi")
            group = F.col(by).cast("string")
        corpus = rows.select(F.col("comment_id").cast("long").alias("comment_id"), F.col("embedding").cast("array<double>").alias("v"), group.alias("g"))

        def prepared():
            for some in _blocks(asked.filter(F.col("g").isNotNull()).select("qid", F.col("embedding").alias("v"), "g"), F.size("v") * 8 + 64, block_bytes):
                if some:
                    yield {"qid": np.array([r["qid"] for r in some], np.int64),
                           "vectors": np.array([r["v"] for r in some], np.float64),
                           "group": np.array([r["g"] for r in some], object)}

        hits = _search(corpus, prepared(), _in_group, k, SEM_DIGITS, "qid", "comment_id", "semantic_score")
        texts = rows.select(F.col("comment_id").cast("long").alias("comment_id"), "text", "metadata")
        out = hits.join(texts, "comment_id").select("qid", "rank", "comment_id", "text", "metadata", "semantic_score")
        return out.withColumnRenamed("qid", qid)


def _in_group(block: dict, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of a batch of rows with the questions; -inf where their groups differ."""
    values, ends = _lists(part.column(1))
    scores = block["vectors"] @ values[ends[0]:ends[-1]].reshape(part.num_rows, -1).T
    groups = np.array(part.column(2).to_pylist(), object)
    return part.column(0).to_numpy(), np.where(block["group"][:, None] == groups[None], scores, -np.inf)
