"""Metadata cube, run log and latency sketches against plain Python versions."""

import bisect
import datetime
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from murmur.operators.metadata import EVALUATION_ANSWER, NO_TOPICS, MetadataCube, level
from murmur.plans import ask, runlog

COMMENTS = [(1, "negative", 3, "v1"), (2, "negative", 3, "v2"), (3, "positive", 4, "v1"), (4, None, 3, "v1"),
            (5, "neutral", None, None), (6, "positive", 10, ""), (7, "positive", -1, "v-2")]
SCHEMA = "comment_id long, sentiment string, topic_id int, video_id string"


@pytest.fixture(scope="module")
def cube(spark):
    return MetadataCube.build(spark.createDataFrame(COMMENTS, SCHEMA))


def test_cells_equal_plain_counts(cube):
    rows = cube.cells.collect()
    want = {}
    for _, s, t, v in COMMENTS:
        own = (s, None if t is None else str(t), v)
        for mask in range(8):
            key = tuple(x if mask >> i & 1 else None for i, x in enumerate(own))
            if all(own[i] is not None for i in range(3) if mask >> i & 1):
                want[mask, key] = want.get((mask, key), 0) + 1
    assert {(r.level, (r.sentiment, r.topic_id, r.video_id)): r.n for r in rows} == want and len(rows) == len(want)
    assert level("sentiment", "video_id") == 5


def test_filters_named_in_questions(spark, cube):
    asks = [(1, "How many NEGATIVE ones in video v1"), (2, "count topic #03"), (3, "how many in the video about it"),
            (4, "number of positive, not negative, ones"), (5, "count of topic 77"), (6, None), (7, ""),
            (8, "how many neutral in Video v-2"), (9, "count on topic -1"), (None, "count of topic 3"), (10, "topic 0")]
    got = {r.qid: tuple(r)[1:] for r in cube.filtered_rows(spark.createDataFrame(asks, "qid long, text string")).collect()}
    assert got == {1: ("negative", None, "v1", 1), 2: (None, "3", None, 3), 3: (None, None, None, 7),
                   4: ("negative", None, None, 2), 5: (None, "77", None, 0), 6: (None, None, None, 7), 7: (None, None, None, 7),
                   8: ("neutral", None, "v-2", 0), 9: (None, "-1", None, 1), None: (None, "3", None, 3), 10: (None, "0", None, 0)}


def test_one_level_is_read_as_a_folder(cube):
    plan = cube.values("sentiment")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "level" in plan.split("PartitionFilters: [")[1].split("]")[0]


ROUTED = [(1, "x", "sentiment_agent"), (2, "x", "topic_agent"), (3, "how many neutral", "metadata_agent"),
          (4, "x", "evaluation_agent"), (5, "x", "rag_agent")]


def test_answers_by_route(spark, cube):
    routed = spark.createDataFrame(ROUTED, "qid long, text string, route string")
    assert dict(cube.answers(routed).collect()) == {
        1: "Sentiment distribution: {'positive': 3, 'negative': 2, 'neutral': 1}",
        2: "Top topic clusters: {3: 3, -1: 1, 4: 1, 10: 1}", 3: "Filtered rows: 1", 4: EVALUATION_ANSWER}


def test_absent_columns_and_no_comments(spark):
    routed = spark.createDataFrame(ROUTED, "qid long, text string, route string")
    only = MetadataCube.build(spark.createDataFrame(COMMENTS, SCHEMA).select("comment_id", "sentiment"))
    asks = spark.createDataFrame([(1, "count of topic 3, positive")], "qid long, text string")
    assert [tuple(r) for r in only.filtered_rows(asks).collect()] == [(1, "positive", None, None, 3)]
    assert dict(only.answers(routed).collect())[2] == NO_TOPICS
    none = MetadataCube.build(spark.createDataFrame([], SCHEMA))
    assert dict(none.answers(routed).collect())[3] == "Filtered rows: 0"
    assert dict(none.answers(routed).collect())[1] == "Sentiment distribution: {}"
    assert only.answers(routed.limit(0)).count() == 0


def test_answer_of_every_route(spark, cube):
    qs = spark.createDataFrame([(1, "the reactions"), (2, "which themes"), (3, "how many neutral"), (4, "evaluate"),
                                (5, "log4j"), (6, "a recap"), (7, "unanswered")], "qid long, text string")
    made = spark.createDataFrame([(5, "five"), (6, "six"), (1, "not asked for")], "qid long, answer string")

    def search(q, k):
        return q.select("qid", F.lit(9).cast("long").alias("comment_id"), F.lit("t").alias("text"),
                        F.lit(0.5).alias("hybrid_score"), F.lit(1).alias("rank"))
    answered, hits = ask.answer_questions(qs, search, cube, made)
    got = {r.qid: (r.route, r.answer) for r in answered.collect()}
    assert got[5] == ("rag_agent", "five") and got[6] == ("summary_agent", "six") and got[7] == ("rag_agent", None)
    assert got[1][1].startswith("Sentiment") and got[3] == ("metadata_agent", "Filtered rows: 1")
    assert {r.qid for r in hits.collect()} == {5, 6, 7}


ANSWERED = [(1, "q one", "rag_agent", "alpha beta"), (2, None, "topic_agent", None), (3, "q", "rag_agent", ""),
            (3, "again", "rag_agent", "second"), (None, "no id", "rag_agent", "x")]
HITS = [(1, 70, 2, "other", 0.25), (1, 71, 1, "alpha text", 0.5)]


def _records(spark, answered=ANSWERED, **more):
    return runlog.records(spark.createDataFrame(answered, "qid long, text string, route string, answer string"),
                          spark.createDataFrame(HITS, "qid long, comment_id long, rank int, text string, semantic_score double"), **more)


def test_records(spark):
    latency = spark.createDataFrame([(1, 1.5, 0.5)], "qid long, total_latency_sec double, generation_latency_sec double")
    day = F.lit(datetime.date(2024, 5, 6))
    rows = {r.qid: r for r in _records(spark, latency=latency, day=day, llm_model="m").collect()}
    assert set(rows) == {1, 2, 3}
    one = rows[1]
    assert (one.retrieval_count, one.evidence_count, one.confidence, one.retrieval_quality) == (2, 2, 0.375, "good")
    assert [(e.source_no, e.comment_id, e.score) for e in one.evidence] == [(1, 71, 0.5), (2, 70, 0.25)]
    assert (one.faithfulness_overlap, one.faithfulness_label) == (0.5, "supported")
    assert (one.total_latency_sec, one.generation_latency_sec, one.llm_model, str(one.logged_on)) == (1.5, 0.5, "m", "2024-05-06")
    assert one.answer_length_words == 2 and one.context_length_words > 10 and one.retrieval_strategy == "hybrid"
    assert (rows[2].retrieval_quality, rows[2].evidence_count, rows[2].total_latency_sec) == ("poor", 0, None)
    assert rows[3].question == "again"                     # of equal ids the first by text


def test_a_repeated_batch_adds_nothing(spark):
    path = tempfile.mkdtemp(prefix="murmur-log-") + "/log"
    assert runlog.read(spark, path).count() == 0
    runlog.append(spark, _records(spark, ANSWERED[:2]), path, "a")
    runlog.append(spark, _records(spark), path, "a")
    runlog.append(spark, _records(spark), path, "a")
    runlog.append(spark, _records(spark), path, "b")
    runlog.append(spark, _records(spark, ANSWERED).limit(0), path, "c")
    got = sorted((r.run_id, r.qid, r.route) for r in runlog.read(spark, path).collect())
    routes = {1: "rag_agent", 2: "topic_agent", 3: "rag_agent"}
    assert got == [(run, q, routes[q]) for run in "ab" for q in (1, 2, 3)]
    assert [tuple(r) for r in runlog.route_distribution(runlog.read(spark, path)).collect()] == [("rag_agent", 4), ("topic_agent", 2)]


def test_quantiles_merge_within_their_rank_error(spark):
    rng = random.Random(5)
    rows = [(run, route, datetime.date(2024, 1, 1 + i // 3 % 9), rng.lognormvariate(0, 1.5) if i % 7 else 2.0)
            for i, (run, route) in enumerate([("a", "x"), ("b", "x"), ("b", "y")] * 20_000)]
    rows += [("a", "z", datetime.date(2024, 1, 1), None), ("a", "z", datetime.date(2024, 1, 1), float("nan"))]
    log = spark.createDataFrame(rows, "run_id string, route string, logged_on date, total_latency_sec double")
    sketches = runlog.latency_sketches(log).cache()
    assert sketches.count() == 27                         # rows by run, route and day, not by record
    got = {r.route: r for r in runlog.latency_quantiles(sketches).collect()}
    assert set(got) == {"x", "y"}
    for route in got:
        values = sorted(v for _, r, _, v in rows if r == route)
        assert got[route].n == len(values) and got[route].max_latency_sec == values[-1]
        for name, share in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            low, high = (bisect.bisect_left(values, got[route][name]) / len(values),
                         bisect.bisect_right(values, got[route][name]) / len(values))
            assert low - runlog.RANK_ERROR <= share <= high + runlog.RANK_ERROR
    few = runlog.latency_quantiles(runlog.latency_sketches(log.filter("run_id = 'a'").limit(500)), by=("run_id",)).first()
    assert few.n <= runlog.KLL_K and few.p50 is not None
    assert runlog.latency_quantiles(runlog.latency_sketches(log.limit(0))).count() == 0
