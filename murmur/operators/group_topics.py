"""Topic models of all groups of a column (sentiments, say) in one fit.

k-means is keyed by (group, cluster): each round is one pass over the rows of all groups and one
aggregation of their partial sums, whatever the number of groups.  Topics are numbered by size
within their group, small clusters and far rows are outliers (-1), as in ``topics.cluster``.  The
model is a table by group, which labels new rows after it is opened again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.operators.topics import topic_count
from murmur.sources.stages import read_stage, stage, write_stage

START_ROWS = 8
"""Rows a cluster that the first centres are drawn from; the sample is bounded by the number of clusters."""
CENTRE_BYTES = 256 << 20
"""Centres of all groups at most: every task has them."""
SCORES = 16 << 20
MODEL = "g string, c int, centre array<double>, n long, mean double, sd double, topic int"


class Centres(NamedTuple):
    """Centres of each group."""

    of: dict[str, np.ndarray]

    def nearest(self, group: str, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, distance) of each row; ties go to the first cluster."""
        centres = self.of[group]
        step = max(1, SCORES // (8 * len(centres)))
        cells, far = [], []
        for begin in range(0, len(v), step):
            some = v[begin:begin + step]
            cell = ((centres * centres).sum(1) - 2 * some @ centres.T).argmin(1)
            cells.append(cell)
            far.append(np.sqrt(((some - centres[cell]) ** 2).sum(1)))
        return np.concatenate(cells), np.concatenate(far)


def _matrix(column) -> np.ndarray:
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].reshape(len(column), -1)


def _by_group(part: pa.RecordBatch, of: dict) -> Iterator[tuple[str, np.ndarray]]:
    """(group, row numbers) of a batch with groups in its first column, groups without a model left out."""
    groups = part.column(0).dictionary_encode()
    codes = groups.indices.to_numpy()
    for code, group in enumerate(groups.dictionary.to_pylist()):
        if group in of:
            yield group, np.flatnonzero(codes == code)


def _first_centres(rows: DataFrame, wanted: dict[str, int], seed: int) -> Centres:
    """Centres far from each other, drawn by their squared distances from a few rows of each group."""
    most = START_ROWS * max(wanted.values())
    order = Window.partitionBy("g").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    some = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)

    def draw(key, given):
        k = wanted.get(key[0], 0)
        if not k:
            return pd.DataFrame({"g": pd.Series(dtype=object), "v": pd.Series(dtype=object)})
        v = np.stack(given.sort_values("r")["v"].to_numpy())[:START_ROWS * k]
        rng = np.random.default_rng(seed)
        picked, far = [0], ((v - v[0]) ** 2).sum(1)
        while len(picked) < k and far.max() > 0:
            picked.append(int(rng.choice(len(v), p=far / far.sum())))
            far = np.minimum(far, ((v - v[picked[-1]]) ** 2).sum(1))
        return pd.DataFrame({"g": key[0], "v": list(v[picked])})

    found: dict[str, list] = {}
    for row in some.groupBy("g").applyInPandas(draw, "g string, v array<double>").collect():
        found.setdefault(row["g"], []).append(row["v"])
    return Centres({g: np.array(v) for g, v in found.items()})


def _sums(rows: DataFrame, centres: Centres) -> DataFrame:
    """(g, c, n, s): rows and sums of vectors of each cluster, for all groups at once."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.of
        n = {g: np.zeros(len(c), np.int64) for g, c in of.items()}
        s = {g: np.zeros_like(c) for g, c in of.items()}
        for part in parts:
            v = _matrix(part.column(1))
            for g, at in _by_group(part, of):
                cell, _ = shared.value.nearest(g, v[at])
                n[g] += np.bincount(cell, minlength=len(n[g]))
                np.add.at(s[g], cell, v[at])
        for g in of:
            some = np.flatnonzero(n[g])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(some)), pa.array(some.astype(np.int32)), pa.array(n[g][some]),
                                                  pa.array(list(s[g][some]))], names=["g", "c", "n", "s"])

    def add(key, parts):
        whole = _matrix(parts.column("s").combine_chunks()).sum(0)
        return pa.table({"g": [key[0].as_py()], "c": pa.array([key[1].as_py()], pa.int32()), "n": [int(np.sum(parts.column("n").to_numpy()))],
                         "s": pa.array([whole], pa.list_(pa.float64()))})

    kind = "g string, c int, n long, s array<double>"
    return rows.select("g", "v").mapInArrow(partial, kind).groupBy("g", "c").applyInArrow(add, kind)


def _placed(rows: DataFrame, centres: Centres) -> DataFrame:
    """(g, id, c, d): each row's cluster and its distance from the centre."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v = _matrix(part.column(2))
            for g, at in _by_group(part, shared.value.of):
                cell, far = shared.value.nearest(g, v[at])
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(at)), part.column(1).take(pa.array(at)), pa.array(cell.astype(np.int32)),
                                                  pa.array(far)], names=["g", "id", "c", "d"])

    return rows.select("g", "id", "v").mapInArrow(place, "g string, id long, c int, d double")


class GroupTopics:
    """A fitted model: one row for each cluster of each group."""

    def __init__(self, model: DataFrame, far: float = 3.0):
        self.model, self.far = model, far

    @classmethod
    def fit(cls, df: DataFrame, group_col: str, vec_col: str = "embedding", id_col: str = "doc_id", k: int | None = None,
            min_topic_size: int = 5, far: float = 3.0, rounds: int = 20, seed: int = 42, path: str | None = None) -> GroupTopics:
        """Fit all groups of at least ``min_topic_size`` rows; ``k`` follows the size of each if it isn't given.

        ``path`` keeps the model, in a folder for each group.
        """
        spark = df.sparkSession
        rows = stage(_rows(df, group_col, vec_col, id_col), "group-rows")
        sizes = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect() if r["count"] >= min_topic_size}
        wanted = {g: min(k or topic_count(n, min_topic_size), n) for g, n in sizes.items()}
        width = rows.select(F.max(F.size("v"))).first()[0] or 0
        if (size := 8 * width * sum(wanted.values())) > CENTRE_BYTES:
            raise ValueError(f"centres of all groups take {size} bytes; at most {CENTRE_BYTES} are sent to the tasks")
        centres = _first_centres(rows, wanted, seed) if wanted else Centres({})
        for _ in range(rounds if wanted else 0):
            moved, new = 0.0, {g: c.copy() for g, c in centres.of.items()}
            for r in _sums(rows, centres).toLocalIterator():
                new[r["g"]][r["c"]] = np.array(r["s"]) / r["n"]
            moved = max(float(np.abs(new[g] - c).max()) for g, c in centres.of.items())
            centres = Centres(new)
            if moved < 1e-4:
                break
        placed = _placed(rows, centres) if wanted else spark.createDataFrame([], "g string, id long, c int, d double")
        stats = placed.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("sd"))
        # clusters of a group: as many rows as it has centres
        order = Window.partitionBy("g").orderBy(F.desc("n"), "c")
        topic = F.when(F.col("n") >= min_topic_size, F.row_number().over(order) - 1).otherwise(-1)
        given = [(g, i, [float(x) for x in c]) for g, m in centres.of.items() for i, c in enumerate(m)]
        table = spark.createDataFrame(given, "g string, c int, centre array<double>")
        model = table.join(stats.withColumn("topic", topic.cast("int")), ["g", "c"]).select(*[f.split()[0] for f in MODEL.split(", ")])
        if path:
            write_stage(model, path, ["g"])
            return cls.open(spark, path, far)
        return cls(stage(model, "group-model"), far)

    @classmethod
    def open(cls, spark: SparkSession, path: str, far: float = 3.0) -> GroupTopics:
        return cls(read_stage(spark, path, MODEL), far)

    def assign(self, df: DataFrame, group_col: str, vec_col: str = "embedding", id_col: str = "doc_id", out: str = "sentiment_topic_id") -> DataFrame:
        """``df`` with the topic of each row; rows of groups without a model (and of null groups) are left out.

        A row far from its centre, or of a cluster that is too small, is an outlier (-1).
        """
        of: dict[str, list] = {}
        for r in self.model.select("g", "c", "centre").orderBy("g", "c").collect():
            of.setdefault(r["g"], []).append(r["centre"])
        centres = Centres({g: np.array(c) for g, c in of.items()})
        numbers = F.broadcast(self.model.select("g", "c", "mean", "sd", "topic"))
        placed = _placed(_rows(df, group_col, vec_col, id_col), centres).join(numbers, ["g", "c"])
        near = F.col("d") <= F.col("mean") + self.far * F.col("sd") + 1e-9
        topics = placed.select(F.col("id").alias("_id"), F.col("g").alias("_g"), F.when(near, F.col("topic")).otherwise(-1).alias(out))
        mine = (F.col(id_col) == F.col("_id")) & (F.col(group_col).cast("string") == F.col("_g"))
        return df.drop(out).join(topics.distinct(), mine).drop("_id", "_g")

    def info(self, assigned: DataFrame, group_col: str, topic_col: str = "sentiment_topic_id") -> DataFrame:
        return assigned.groupBy(group_col, topic_col).agg(F.count(F.lit(1)).alias("count"))


def _rows(df: DataFrame, group_col: str, vec_col: str, id_col: str) -> DataFrame:
    return df.select(F.col(group_col).cast("string").alias("g"), F.col(id_col).cast("long").alias("id"),
                     F.col(vec_col).cast("array<double>").alias("v")).filter("g is not null and id is not null and v is not null")
