"""Nearest neighbours and whitening of embeddings, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import neighbours, whitening
from tests.conftest import SF001

KIND = "vec_id long, embedding array<float>, label int"
ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [1.0, None] + [0.0] * 6, 1),
       (904, [float("nan")] + [0.0] * 7, 1), (905, [float("inf")] + [0.0] * 7, 1), (906, [1.0, 2.0], 1)]


def unit_rows(n, d=8, seed=3):
    v = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return [(i, [float(x) for x in row], 0) for i, row in enumerate(v)]


def brute_nearest(rows, k):
    rows = [(i, np.array(v, np.float64)) for i, v, _ in rows
            if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted((-float((v * w).sum()), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_neighbours_with_odd_rows_copies_and_ties(spark):
    # a third of the rows are copies, lengths differ, and other columns clash with inner names
    rows = unit_rows(400) + [(1000 + i, unit_rows(1)[0][1], 0) for i in range(200)] + ODD + [(5, unit_rows(6)[5][1], 0)]
    df = spark.createDataFrame(rows, KIND).withColumn("key", F.lit("x")).withColumn("v", F.lit(1)).withColumn("a.b", F.lit(2))
    got, want = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0)), brute_nearest(
        [r for i, r in enumerate(rows) if r not in rows[:i]], 20)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in want)
    assert recall(got, want) >= 0.9
    for q in got:                                       # scores fall, ties rise by id, and none is its own
        assert [(-s, i) for i, s in got[q]] == sorted((-s, i) for i, s in got[q]) and q not in dict(got[q])
    # of the copies of a query the ones with the least ids come first
    assert got[1000] == [(i, pytest.approx(s)) for i, s in want[1000]]


def test_neighbours_of_few_rows_and_none(spark):
    rows = unit_rows(6)
    df = spark.createDataFrame(rows, KIND)
    assert {q: [i for i, _ in x] for q, x in found(neighbours.nearest(df, F.col("vec_id") % 20 == 0)).items()} == {
        q: [i for i, _ in x] for q, x in brute_nearest(rows, 20).items()}
    assert found(neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0)) == {}
    assert found(neighbours.nearest(df, F.col("vec_id") < 0)) == {}
    assert found(neighbours.nearest(df.limit(1), F.col("vec_id") % 20 == 0)) == {}


def test_small_blocks_and_hot_queries_change_nothing(spark, monkeypatch):
    rows = unit_rows(150) + [(1000 + i, unit_rows(1)[0][1], 0) for i in range(100)]
    df = spark.createDataFrame(rows, KIND)
    whole = found(neighbours.nearest(df, F.col("vec_id") % 2 == 0, k=7))
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    monkeypatch.setattr(neighbours, "HOT", 3)
    assert found(neighbours.nearest(df, F.col("vec_id") % 2 == 0, k=7)) == whole


def test_a_recall_out_of_reach_is_answered_exactly(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RECALL", 2.0)
    rows = unit_rows(200)
    got, want = found(neighbours.nearest(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0)), brute_nearest(rows, 20)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_op12_recall(spark, sf_dir=SF001):
    got = found(neighbours.op12_nearest_neighbours(spark, sf_dir))
    rows = [(r.vec_id, r.embedding, 0) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    hits = 0
    for q in ids[ids % 20 == 0]:
        score = (v * v[ids == q]).sum(1)
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hits += len(set(best) & {i for i, _ in got[q]})
        for i, s in got[q]:
            assert s == pytest.approx(score[ids == i][0], abs=1e-12)
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_inertia_counts_and_eigenpairs():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((30, 30))
    a += a.T
    w = np.linalg.eigvalsh(a)
    assert [whitening.count_above(a, s) for s in np.linspace(-12, 12, 50)] == [(w > s).sum() for s in np.linspace(-12, 12, 50)]
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    for near in (0.0, 1e-13, 1e-10, 1e-7):              # clusters of two, three and many
        values = np.array([5, 5 - near, 3, 3 - near, 3 - 2 * near, 2, *[1.0] * 24])
        b = q * values @ q.T
        e, v = whitening.leading_eigenpairs(b, 10)
        assert np.abs(e - values[:10]).max() < 1e-12
        assert np.abs(v.T @ v - np.eye(10)).max() < 1e-8 and np.abs(b @ v - v * e).max() < 1e-12


def brute_whiten(rows, k=16):
    rows = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000) for i, v, _ in rows
            if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    fit = np.unique([x for _, x in rows], axis=0)
    n, total = len(fit), fit.sum(0)
    centred = (n * fit - total) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return [(i, c + 1, n, int(((n * x - total) ** 2).sum()), abs((n * x - total) / n @ u[:, -1 - c]) / e[-1 - c] ** 0.5, e[-1 - c] / e.sum())
            for i, x in rows for c in range(min(k, 8))]


def test_whitening_with_odd_rows(spark):
    rows = [r for r in unit_rows(60) + unit_rows(20) + ODD if r[0] != 902]
    df = spark.createDataFrame(rows, KIND).withColumn("x", F.lit("clash")).withColumn("i.j", F.lit(1))
    got = sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in whitening.whiten(df).collect())
    want = sorted(brute_whiten(rows))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], atol=1e-9)


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], KIND)
    assert whitening.whiten(one).collect() == [] and whitening.whiten(one.limit(0)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.5], 0) for i in range(9)], KIND)
    got = whitening.whiten(line).collect()
    assert {r.component for r in got} == {1} and all(r.explained == pytest.approx(1) and r.identity_error < 1e-9 for r in got)


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(1, [1e12, 1.0], 0), (2, [-1e12, 2.0], 0), (3, [1e30, 0.0], 0), (4, [0.0, 3.0], 0)]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got.keys() == {1, 2, 4} and got[1].deviation is None and got[4].deviation is not None and got[1].n == 3


def test_op13(spark, sf_dir=SF001):
    got = whitening.op13_embedding_whitening(spark, sf_dir).toPandas()
    ids = [r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert len(got) == 16 * len(ids) and got.identity_error.max() < 1e-9
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / len(w) - np.eye(16)).max() < 0.05 and (np.diff(got.groupby("component").explained.first()) <= 0).all()
