"""Approximate top-k by inner product on unit vectors: an inverted file of centroid cells with sign sketches.

A vector is stored in the cell of its nearest centroid, with the signs of its products with random
directions.  A question opens its nearest cells, compares sketches there, and takes the exact
product only where few signs differ.  How many cells are opened and how many signs may differ is
chosen when the index is built, from a bounded sample of stored vectors whose neighbours are
searched exactly.  A question that finds fewer than k is searched exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.operators.retrieval import SEM_DIGITS, cosine_top_k, top_k
from murmur.sources.stages import read_stage, stage, stage_path, write_stage

BITS = 1024
SLOTS = 32
"""Folders of the stored cells."""
MOST_CELLS = 4096
"""Cells at most: centroids are broadcast; a cell of a larger corpus is searched in blocks."""
FIT_ROWS = 64
"""Rows a cell that centroids are fitted on: a sample bounded by the number of cells."""
SAMPLE = 128
"""Stored vectors that the search is adjusted with."""
RECALL = 0.95
BLOCK = 8192
"""Rows of a cell, and questions that open it, which meet in one task."""
ROWS = "id long, embedding array<double>, cell int, sketch binary, slot int"
UNIT = ["cell", "block", "part"]


class Shape(NamedTuple):
    """Centroids and the directions of the sketches."""

    centres: np.ndarray
    directions: np.ndarray

    def nearest(self, v: np.ndarray, n: int) -> np.ndarray:
        if not self.centres.shape[1]:
            return np.zeros((len(v), 1), np.int32)
        far = (self.centres ** 2).sum(1) - 2 * v @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)

    def sketches(self, v: np.ndarray) -> np.ndarray:
        if not self.directions.shape[1]:
            return np.zeros((len(v), BITS // 8), np.uint8)
        return np.packbits(v @ self.directions.T > 0, axis=1)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].reshape(len(column), -1).astype(np.float64)


def _words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


class CellIndex:
    """rows (slot, cell, id, embedding, sketch), stored by cell; ``probes`` and ``radius`` as chosen for the recall."""

    def __init__(self, corpus: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding", cells: int | None = None,
                 k: int = 10, recall: float = RECALL, path: str | None = None, seed: int = 7):
        spark = corpus.sparkSession
        given = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("embedding"))
        given = given.filter(F.col("id").isNotNull() & F.col("embedding").isNotNull())
        n = given.count()
        self.cells = min(MOST_CELLS, cells or max(1, int(2 * n ** 0.5)))
        self.id_col, self.spark = id_col, spark
        path = (path or stage_path(spark, "cells")).rstrip("/")
        # the sample is the rows of least hash, so it is the same however the table is partitioned
        fit = given.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS * self.cells)
        fit = stage(fit.select(array_to_vector("embedding").alias("v")), "cell-sample")
        if n:
            model = KMeans(k=self.cells, featuresCol="v", maxIter=8, seed=seed).fit(fit)
            centres = np.array(model.clusterCenters())
        else:
            centres = np.zeros((1, 0))                   # nothing is stored
        directions = np.random.default_rng(seed).standard_normal((BITS, centres.shape[1]))
        self.shape = Shape(centres, directions)
        shared = spark.sparkContext.broadcast(self.shape)

        def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if part.num_rows:
                    v = _matrix(part.column(1))
                    cell = shared.value.nearest(v, 1)[:, 0]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(cell), pa.array(list(map(bytes, shared.value.sketches(v))), pa.binary()),
                         pa.array(cell % SLOTS)], names=["id", "embedding", "cell", "sketch", "slot"])

        rows = given.mapInArrow(place, ROWS)
        write_stage(rows.sortWithinPartitions("slot", "cell"), f"{path}/rows", ["slot"])
        self.rows = read_stage(spark, f"{path}/rows", ROWS)
        self.probes, self.radius = self.shape.centres.shape[0], BITS
        self._adjust(k, recall)
        numbers = spark.createDataFrame([(self.probes, self.radius, id_col, centres.tolist(), directions.tolist())],
                                        "probes int, radius int, id_col string, centres array<array<double>>, directions array<array<double>>")
        write_stage(numbers, f"{path}/shape")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        index = cls.__new__(cls)
        row = read_stage(spark, f"{path.rstrip('/')}/shape").first()
        index.spark, index.rows, index.id_col = spark, read_stage(spark, f"{path.rstrip('/')}/rows", ROWS), row["id_col"]
        index.probes, index.radius = row["probes"], row["radius"]
        index.shape = Shape(np.array(row["centres"]), np.array(row["directions"]))
        index.cells = len(index.shape.centres)
        return index

    def _adjust(self, k: int, recall: float) -> None:
        """Fewest cells, then fewest differing signs, that find the share of the sample's neighbours."""
        sample = self.rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE).select(F.col("id").alias("qid"), "embedding")
        sample = stage(sample, "cell-questions")
        # a stored vector finds itself; its other neighbours count
        found = top_k(self._meet(sample, k + 1, measure=True), k + 1, "qid", "score", "id")
        found = found.filter("qid <> id").select("place", "differ").collect()
        if not found:
            return
        place, differ = np.array([r["place"] for r in found]), np.array([r["differ"] for r in found])
        share = (1 + recall) / 2                          # half of what may be missed by each of the two
        self.probes = int(np.quantile(place, share, method="higher")) + 1
        self.radius = int(np.quantile(differ[place < self.probes], share, method="higher"))

    def _meet(self, questions: DataFrame, k: int, measure: bool = False) -> DataFrame:
        """(qid, id, score, place, differ, compared): the best k of each question by cell; ``compared`` counts exact products.

        ``place`` is the cell's among the question's cells.  With ``measure`` all cells are opened and no sketch decides.
        """
        shared = self.spark.sparkContext.broadcast(self.shape)
        probes, radius = (self.cells, BITS) if measure else (self.probes, self.radius)

        def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                step = max(1, (8 << 20) // (8 * len(shared.value.centres)))
                for begin in range(0, part.num_rows, step):
                    some = part.slice(begin, step)
                    v = _matrix(some.column(1))
                    cell = shared.value.nearest(v, probes)
                    at = pa.array(np.repeat(np.arange(len(v)), cell.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).take(at), some.column(1).take(at), pa.array(cell.ravel()),
                         pa.array(np.tile(np.arange(cell.shape[1], dtype=np.int32), len(v))),
                         pa.array(list(map(bytes, shared.value.sketches(v))), pa.binary()).take(at)],
                        names=["qid", "embedding", "cell", "place", "sketch"])

        asks = questions.select("qid", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
            ask, "qid long, embedding array<double>, cell int, place int, sketch binary")
        # cells that are opened, with the blocks that bound a task: a row a cell, MOST_CELLS at most
        slots = F.col("slot").isin([r[0] for r in asks.select((F.col("cell") % SLOTS).alias("slot")).distinct().collect()])
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        sizes = (self.rows.filter(slots).groupBy("cell").agg(blocks(F.count(F.lit(1))).alias("blocks"))
                 .join(asks.groupBy("cell").agg(blocks(F.count(F.lit(1))).alias("parts")), "cell"))
        sizes = F.broadcast(stage(sizes, "cell-sizes"))
        salt = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
        left = asks.join(sizes, "cell").withColumn("part", salt("qid", "parts")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "parts")
        right = self.rows.filter(slots).join(sizes, "cell").withColumn("block", salt("id", "blocks")).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts")

        def meet(asked: pa.Table, stored: pa.Table) -> pa.Table:
            return _compare(asked, stored, k, radius)

        return left.groupBy(*UNIT).cogroup(right.groupBy(*UNIT)).applyInArrow(
            meet, "qid long, id long, score double, place int, differ int, compared long")

    def top_k(self, questions: DataFrame, k: int = 5, qid: str = "qid", vec_col: str = "embedding") -> DataFrame:
        """(qid, id, semantic_score, rank): k rows for every question with a vector (all rows, if there are fewer)."""
        asked = questions.select(F.col(qid).cast("long").alias("qid"), F.col(vec_col).alias("embedding")).filter(
            F.col("embedding").isNotNull())
        found = stage(top_k(self._meet(asked, k).select("qid", "id", F.col("score").alias("semantic_score")), k, "qid", "semantic_score", "id"),
                      "cell-hits")
        full = found.filter(F.col("rank") == k).select("qid")
        few = cosine_top_k(self.rows.select("id", "embedding"), asked.join(full, "qid", "left_anti"), k, "id")
        both = found.join(full, "qid", "left_semi").unionByName(few)
        return both.select(F.col("qid").alias(qid), F.col("id").alias(self.id_col), "semantic_score", "rank")

    def compared(self, questions: DataFrame, k: int = 5) -> int:
        """Exact products that a search takes."""
        each = self._meet(questions, k).groupBy("qid", "place").agg(F.max("compared").alias("c"))
        return each.agg(F.sum("c")).first()[0] or 0


def _compare(asked: pa.Table, stored: pa.Table, k: int, radius: int) -> pa.Table:
    names = ["qid", "id", "score", "place", "differ", "compared"]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64())
    out = []
    if asked.num_rows and stored.num_rows:
        ids, v, bits = stored.column("id").to_numpy(), _matrix(stored.column("embedding")), _words(stored.column("sketch"))
        qids, places = asked.column("qid").to_numpy(), asked.column("place").to_numpy()
        queries, sketches = _matrix(asked.column("embedding")), _words(asked.column("sketch"))
        for i, q in enumerate(qids):
            differ = np.bitwise_count(bits ^ sketches[i]).sum(1, dtype=np.int32)
            some = np.flatnonzero(differ <= radius)
            if len(some):
                score = np.round((v[some] * queries[i]).sum(1), SEM_DIGITS)
                best = np.lexsort((ids[some], -score))[:k]
                m = len(best)
                out.append((np.full(m, q), ids[some][best], score[best], np.full(m, places[i]), differ[some][best], np.full(m, len(some))))
    columns = list(zip(*out, strict=True)) or [[np.zeros(0)]] * len(names)
    return pa.Table.from_arrays([pa.array(np.concatenate(c).astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds, strict=True)], names=names)
