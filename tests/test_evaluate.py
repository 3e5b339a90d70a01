from pyspark.sql import functions as F

from murmur.operators import evaluate as V
from murmur.operators import routing


def test_quality_and_confidence_edges(spark):
    qs = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    hits = spark.createDataFrame([(2, 0.3), (2, 0.3), (3, 0.2999)], "qid long, hybrid_score double")
    q = {r["qid"]: r for r in V.retrieval_quality(qs, hits).collect()}
    assert q[1]["retrieval_quality"] == "poor" and q[1]["avg_retrieval_score"] == 0.0
    assert q[2]["retrieval_quality"] == "good"
    assert q[3]["retrieval_quality"] == "weak" and q[3]["avg_retrieval_score"] == 0.3
    c = {r["qid"]: r["confidence"] for r in V.confidence(qs, hits).collect()}
    assert c == {1: 0.0, 2: 0.3, 3: 0.3}


def test_score_fallback_order(spark):
    df = spark.createDataFrame([(None, 0.4, 0.9), (None, None, 0.9), (0.1, 0.4, 0.9)],
                               "hybrid_score double, semantic_score double, lexical_score double")
    assert [r[0] for r in df.select(V.retrieval_score(df)).collect()] == [0.4, 0.9, 0.1]
    assert [r[0] for r in df.select(V.confidence_score(df)).collect()] == [0.4, 0.0, 0.1]


def test_faithfulness_edges(spark):
    df = spark.createDataFrame([
        ("", "anything here"),
        ("alpha beta gamma delta", "(alpha) other words"),
        ("alpha beta gamma delta epsilon", "alpha"),
    ], "a string, s string")
    out = df.select(V.faithfulness(F.col("a"), F.col("s")).alias("f")).collect()
    assert out[0]["f"]["faithfulness_overlap"] == 0.0
    assert out[1]["f"]["faithfulness_overlap"] == 0.25 and out[1]["f"]["faithfulness_label"] == "supported"
    assert out[2]["f"]["faithfulness_label"] == "weakly_supported"


def test_lengths(spark):
    df = spark.createDataFrame([(" two  words ", None)], "a string, c string")
    r = df.select(*V.lengths(F.col("a"), F.col("c"))).first()
    assert (r["answer_length_chars"], r["answer_length_words"], r["context_length_words"]) == (12, 2, 0)


def test_context_blocks_in_rank_order(spark):
    hits = spark.createDataFrame([(1, 2, "b", 0.5), (1, 1, "a", 0.9)], "qid long, rank int, text string, hybrid_score double")
    ctx = V.evidence_context(hits).first()["context"]
    assert ctx.index("Source 1") < ctx.index("Source 2")
    assert "Sentiment: unknown" in ctx and "Retrieval score: 0.900000" in ctx


def test_route_normalisation(spark):
    df = spark.createDataFrame([(" RAG_agent\n",), ("foo",), (None,), ("Topic_Agent",)], "r string")
    assert [x[0] for x in df.select(routing.normalise_route(F.col("r"))).collect()] == [
        "rag_agent", "rag_agent", "rag_agent", "topic_agent"]


def test_route_rules(spark):
    df = spark.createDataFrame([("Summarize the comments",), ("What is the sentiment?",),
                                ("Which topics come up?",), ("How does log4j work",)], "q string")
    assert [x[0] for x in df.select(routing.route(F.col("q"))).collect()] == [
        "summary_agent", "sentiment_agent", "topic_agent", "rag_agent"]
