"""The inverted index against a full scan."""

import random

import pytest

from murmur.operators import inverted
from murmur.operators.inverted import ImpactIndex
from murmur.operators.retrieval import TfidfIndex


def corpus(spark, n=400, seed=4):
    """Words of very different frequency, texts of 0 to 300 words, ties and nulls."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 12, 60, 300])))) for i in range(n)]
    texts += [(n + i, "w7 w250 common line") for i in range(40)] + [(n + 50, None), (n + 51, " ")]
    asked = [(j, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for j in range(20)]
    asked += [(30, "w7 w250 common line"), (31, "nothing known"), (32, None), (33, "w0 w1 w2 w3")]
    return (spark.createDataFrame(texts, "doc_id long, text string").repartition(4),
            spark.createDataFrame(asked, "qid long, text string"))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("shard_docs", [8192, 60])
def test_equal_to_a_full_scan_with_fewer_blocks(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(inverted, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(inverted, "QUESTIONS", 7)
    docs, asked = corpus(spark)
    scan, index = TfidfIndex(docs), ImpactIndex(docs)
    for k in (1, 5, 500):
        assert rows(index.top_k(asked, k)) == rows(scan.top_k(asked, k))
    blocks, opened = index.plan_search(asked, 5)
    of_terms = blocks.select("t", *inverted.UNIT).distinct().count()
    assert opened.count() < blocks.count()
    assert opened.select("t", *inverted.UNIT).distinct().count() <= of_terms < index.directory.count()


def test_one_question_opens_few_folders(spark):
    docs, _ = corpus(spark)
    index = ImpactIndex(docs)
    asked = spark.createDataFrame([(1, "w250")], "qid long, text string")
    plan = index.top_k(asked, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan or "PartitionFilters: [(slot" in plan or "slot#" in plan.split("PartitionFilters: [")[1][:60]


def test_reopened_index_answers_alike(spark, tmp_path):
    docs, asked = corpus(spark, 80)
    path = f"file://{tmp_path}/index"
    written = ImpactIndex(docs, path=path)
    assert rows(ImpactIndex.open(spark, path).top_k(asked, 4)) == rows(written.top_k(asked, 4))


def test_empty_corpus_and_no_questions(spark):
    docs, asked = corpus(spark, 10)
    assert rows(ImpactIndex(docs.limit(0)).top_k(asked, 3)) == []
    assert rows(ImpactIndex(docs).top_k(asked.limit(0), 3)) == []


def test_norm_of_a_long_document_is_made_once(spark):
    import time

    docs = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20_000)))], "doc_id long, text string")
    begin = time.perf_counter()
    index = TfidfIndex(docs)
    assert abs(index.rows.selectExpr("aggregate(w, 0D, (s, x) -> s + x * x) as n").first()["n"] - 1) < 1e-9
    assert time.perf_counter() - begin < 30              # made for every term, it is 400 million products
