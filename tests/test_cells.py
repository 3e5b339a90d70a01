"""The cell index: recall against brute force, and how little it compares."""

import numpy as np

from murmur.operators import cells
from murmur.operators.cells import CellIndex
from murmur.operators.retrieval import cosine_top_k
from murmur.plans import catalog
from tests.conftest import SF01


def frame(spark, v, id_col="doc_id", first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(v)], f"{id_col} long, embedding array<float>")


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def clustered(n, d=24, groups=60, seed=1):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).standard_normal((groups, d))
    return unit(centres[rng.integers(groups, size=n)] + 0.25 * rng.standard_normal((n, d)))


def recall(got, want):
    want = {(r.qid, r.doc_id) for r in want.collect()}
    rows = got.collect()
    assert len(rows) == len(want)
    return len(want & {(r.qid, r.doc_id) for r in rows}) / len(want)


def test_structured_vectors_open_few_cells(spark):
    docs, asked = frame(spark, clustered(3000)), frame(spark, clustered(60, seed=2), "qid")
    index = CellIndex(docs)
    assert recall(index.top_k(asked, 5), cosine_top_k(docs, asked, 5)) >= 0.9
    assert index.probes < index.cells / 4 and index.compared(asked) < 0.1 * 3000 * 60


def test_registered_query_recalls_and_compares_little(spark):
    docs, asked = catalog.doc_vectors(spark, SF01), catalog.question_vectors(spark, SF01)
    want = cosine_top_k(docs, asked, 5)
    got = catalog.QUERIES["lsh_topk"](spark, SF01).withColumnRenamed("comment_id", "doc_id")
    assert recall(got, want) >= 0.9
    index = catalog.vector_index(spark, SF01)
    assert index.compared(asked) < 0.1 * docs.count() * asked.count()


def test_small_blocks_change_nothing_and_few_hits_are_searched_exactly(spark, monkeypatch):
    docs, asked = frame(spark, clustered(400)), frame(spark, clustered(15, seed=3), "qid")
    index = CellIndex(docs)
    rows = sorted(map(tuple, index.top_k(asked, 4).collect()))
    monkeypatch.setattr(cells, "BLOCK", 9)
    assert sorted(map(tuple, index.top_k(asked, 4).collect())) == rows
    index.probes, index.radius = 1, 0
    assert sorted(map(tuple, index.top_k(asked, 4).collect())) == sorted(map(tuple, cosine_top_k(docs, asked, 4).collect()))


def test_reopened_and_empty(spark, tmp_path):
    docs, asked = frame(spark, clustered(200)), frame(spark, clustered(5, seed=3), "qid")
    path = f"file://{tmp_path}/cells"
    index = CellIndex(docs, path=path)
    assert sorted(map(tuple, CellIndex.open(spark, path).top_k(asked, 3).collect())) == sorted(map(tuple, index.top_k(asked, 3).collect()))
    assert CellIndex(docs.limit(0)).top_k(asked, 3).collect() == []
    assert index.top_k(asked.limit(0), 3).collect() == [] and len(CellIndex(docs.limit(2)).top_k(asked, 3).collect()) == 10
