"""Steps of retrieval that must not grow beyond their input: shuffles of texts, and memory of the workers."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from murmur.operators import inverted
from murmur.operators import retrieval as R
from murmur.sources import tables

TEXTS = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 23))) for i in range(90)] + [
    (7, "w1 w1 again"), (8, None), (200, None), (201, "")]
ASKED = [(1, "w1 w2 again"), (2, "w5 w36 w9 w9"), (3, "none of it")]


def _tables(spark):
    return (spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(5),
            spark.createDataFrame(ASKED, "qid long, text string"))


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_rare_terms_are_weighed_like_frequent_ones(spark, monkeypatch):
    docs, asked = _tables(spark)
    want = R.TfidfIndex(docs)
    hits, vectors = _rows(want.top_k(asked, 6)), _rows(want.weights)
    monkeypatch.setattr(R, "ENTRIES", 40)
    for frequent in (0, 20):
        monkeypatch.setattr(R, "FREQUENT", frequent)
        index = R.TfidfIndex(docs)
        assert not index._frequent()[2] and _rows(index.top_k(asked, 6)) == hits
        got = _rows(index.weights)
        assert [r[:2] for r in got] == [r[:2] for r in vectors] and np.allclose([r[2] for r in got], [r[2] for r in vectors])


def test_rows_of_an_id_are_one_document(spark):
    docs, asked = _tables(spark)
    index = R.TfidfIndex(docs)
    assert index.rows.count() == index.rows.select("doc_id").distinct().count()
    assert index.rows.filter("doc_id = 7").selectExpr("size(terms)").first()[0] == len(
        {f"w{(7 * j) % 37}" for j in range(7)} | {"w1", "again"})


def test_counting_moves_no_text(spark):
    docs, _ = _tables(spark)
    plan = R._counted(docs.coalesce(2), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_postings_of_a_shard_are_bounded(spark, monkeypatch):
    docs, asked = _tables(spark)
    want = _rows(inverted.ImpactIndex(docs).top_k(asked, 4))
    monkeypatch.setattr(inverted, "SHARD_POSTINGS", 60)
    index = inverted.ImpactIndex(docs)
    assert index.directory.agg(F.max("shard")).first()[0] > 2 and _rows(index.top_k(asked, 4)) == want


def test_common_terms_of_many_questions_stay_small_in_a_worker():
    docs, terms, questions = 1500, 50, 200
    block = {"qid": np.arange(questions), "terms": np.repeat(np.arange(terms), questions),
             "q": np.tile(np.arange(questions), terms), "w": np.full(questions * terms, 0.1)}
    lists = pa.array([list(range(terms))] * docs, pa.list_(pa.int64()))
    part = pa.RecordBatch.from_arrays([pa.array(range(docs)), lists, pa.array([[0.5] * terms] * docs)], names=["id", "terms", "w"])
    tracemalloc.start()
    _, scores = R._lexical(block, part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(scores, 0.05 * terms) and peak < 150 << 20       # all 15 million meetings at once are 120 MB a column


def test_hits_are_sent_to_the_texts(spark):
    docs, asked = _tables(spark)
    corpus = docs.withColumnRenamed("doc_id", "comment_id")
    vectors = corpus.select("comment_id", F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    found = R.hybrid_search(corpus, vectors, asked, asked.select("qid", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and plan.count("SortMergeJoin") <= 1


def test_comments_of_some_ids(spark):
    from tests.conftest import SF001

    every = tables.comments(spark, SF001)
    ids = spark.createDataFrame([(3,), (3,), (11,), (10**9,)], "comment_id long")
    want = every.filter("comment_id in (3, 11)")
    assert _rows(tables.comments(spark, SF001, ids)) == _rows(want) and want.count() == 2


def test_batches_for_workers_are_bounded_in_bytes(spark):
    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.nbytes])], names=["n"])

    texts = spark.range(4000).selectExpr("repeat('long text ', 1000) as t").coalesce(1)
    assert texts.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= 9 << 20
