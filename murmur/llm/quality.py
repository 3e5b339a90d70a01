"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each class is a Gaussian over transformed statistics of a text, with a covariance shrunk
towards the pooled one and towards its diagonal.  A score is the logistic function of the
difference of the two log densities, taken from Mahalanobis distances by Cholesky factors that
are made once, when the model is fitted.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import add_column, load, narrow, remainder, small_side, stage

KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#$%&*|<>@^~_=+{}[]\\/",
         "loud": b"!?", "stop": b".,;:", "line": b"\n"}
"""Byte classes whose shares are statistics."""
NAMES = ["words", "word_length", *KINDS, "variety", "adjacent", "same_lines", "top_word", "packed"]
_CLASS = np.zeros(256, np.int64)
for _i, _bytes in enumerate(KINDS.values(), 1):
    _CLASS[list(_bytes)] = _i
PACK_BLOCK = 1 << 15
"""Bytes that are packed together: a share of repeats that doesn't depend on the text's length."""


def _packed(data: bytes) -> int:
    """Packed size, by blocks."""
    return sum(len(zlib.compress(data[i:i + PACK_BLOCK], 1)) for i in range(0, len(data), PACK_BLOCK))


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text; of an empty one, those that the constants give."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    out = np.zeros(len(NAMES))
    n = len(words)
    size = sum(map(len, words))
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=len(KINDS) + 1)[1:]
    lines = [line for line in data.split(b"\n") if line.strip()]
    counts = Counter(words)
    # the added constants draw the shares of a very short text towards those of common prose
    out[0] = np.log1p(n)
    out[1] = np.log((size + 50) / (n + 10))
    out[2:2 + len(KINDS)] = np.sqrt(kinds / (len(data) + 50))
    out[-5] = np.log(len(counts) + 20) / np.log(n + 20)
    out[-4] = np.sqrt(sum(map(operator.eq, words, words[1:])) / (n + 10))
    out[-3] = np.sqrt((len(lines) - len(set(lines))) / (len(lines) + 3))
    out[-2] = np.sqrt((max(counts.values(), default=1) - 1) / (n + 10))
    out[-1] = np.log((_packed(data) + 100) / (len(data) + 200))
    return out


def _as_lists(texts: pa.Array) -> pa.Array:
    rows = np.concatenate([np.empty((0, len(NAMES))), *[statistics(t)[None] for t in texts.to_pylist()]])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(NAMES), pa.int32()), pa.array(rows.ravel()))


def with_statistics(docs: DataFrame, text: str = "text", to: str = "statistics") -> DataFrame:
    return add_column(docs, to, "array<double>", text, _as_lists)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log normalisers of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            away = (rows - mean) @ factor.T
            logs.append(constant - 0.5 * np.einsum("ij,ij->i", away, away))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _moments(parts):
    """Count, sums and products of each class, a row for each number that isn't zero."""
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for part in parts:
        for label in (0, 1):
            rows = np.stack([np.zeros(d), *part["statistics"][part["label"] == label]])[1:]
            total[label] += np.concatenate([[len(rows)], rows.sum(0), (rows.T @ rows).ravel()])
    label, at = np.nonzero(total)
    yield pd.DataFrame({"label": label, "at": at, "value": total[label, at]})


def fit(labelled: DataFrame, pooled: float = 0.2, diagonal: float = 0.05) -> Discriminant:
    """Fit on all rows of ``labelled`` (statistics, label 0 or 1; others are left out).

    The moments are summed by Spark; the driver gets a few hundred numbers.  ``pooled`` and
    ``diagonal`` are the shares of the pooled covariance and of the diagonal.  A class without
    rows gets the other's mean and covariance, so that the score is the share of the labels,
    and with no rows at all every score is 0.5.
    """
    d = len(NAMES)
    sums = (labelled.select("statistics", F.col("label").cast("int").alias("label"))
            .filter(F.col("label").isin(0, 1) & F.col("statistics").isNotNull())
            .mapInPandas(_moments, "label int, at int, value double")
            .groupBy("label", "at").agg(F.sum("value").alias("value")))
    total = np.zeros((2, 1 + d + d * d))
    for row in sums.collect():                   # at most 2 x (1 + d + d * d) numbers
        total[row.label, row.at] = row.value
    n = total[:, 0]
    everything = total.sum(0)
    means, covariances = [], []
    for one in (*total, everything):
        one = one if one[0] else everything
        k = max(one[0], 1)
        mean = one[1:1 + d] / k
        means.append(mean)
        covariances.append(one[1 + d:].reshape(d, d) / k - np.outer(mean, mean))
    shared = (covariances[0] * n[0] + covariances[1] * n[1]) / max(n.sum(), 1)
    factors, constants = [], []
    for k in (0, 1):
        shrunk = (1 - pooled) * covariances[k] + pooled * shared
        spread = np.diag(shrunk)
        shrunk = (1 - diagonal) * shrunk + np.diag(diagonal * spread + 1e-4)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(lower)).sum())
    return Discriminant(np.array(means[:2]), np.array(factors), np.array(constants))


def score(rows: DataFrame, model: Discriminant, source: str = "statistics", to: str = "score") -> DataFrame:
    """Adds the score, from statistics or (``source`` a text column) from whole texts.

    Defined results: null and empty texts have the statistics of no words and a score like any; equal
    texts get equal scores; an empty table stays empty; other columns are carried along.
    """
    from_text = dict(rows.dtypes)[source] == "string"

    def make(values: pa.Array) -> pa.Array:
        values = _as_lists(values) if from_text else values
        return pa.array(model.score(values.flatten().to_numpy().reshape(-1, len(NAMES))))

    return add_column(rows, to, "double", source, make)


def _learned(labels: DataFrame, fold: int, held_out: int) -> DataFrame:
    return narrow(labels, {"doc_id": "long", "quality": "int"}).filter(remainder("doc_id", fold) != held_out)


def train(documents: DataFrame, labels: DataFrame, fold: int = 3, held_out: int = 1) -> tuple[Discriminant, DataFrame]:
    """The model, learned from labelled rows outside the held-out fold, and all rows' statistics."""
    rows = stage(with_statistics(narrow(documents, {"doc_id": "long", "text": "string"})).drop("text"), "statistics")
    known = rows.join(_learned(labels, fold, held_out).withColumnRenamed("quality", "label"), "doc_id")
    return fit(known), rows


def train_on_labelled(documents: DataFrame, labels: DataFrame, fold: int = 3, held_out: int = 1) -> Discriminant:
    """The same model, from the statistics of the labelled rows only."""
    learned = stage(_learned(labels, fold, held_out).withColumnRenamed("quality", "label"), "labelled")
    texts = narrow(documents, {"doc_id": "long", "text": "string"}).join(
        small_side(learned.select("doc_id").distinct()), "doc_id", "left_semi")
    return fit(with_statistics(texts).drop("text").join(learned, "doc_id"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels are learned outside the held-out fold only."""
    model, rows = train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return score(rows, model).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
