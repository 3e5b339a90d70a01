from pyspark.sql import functions as F

from murmur.operators import explore as X


def comments(spark):
    return spark.createDataFrame([
        (1, "negative", "anger", 0, "v1", 5, "2024-01-01T00:00:00Z", "C++ rocks"),
        (2, "positive", "joy", 1, "v1", None, None, "plain"),
        (3, None, "joy", 1, "v2", 50, "bad", "more text"),
        (4, "positive", "joy", -1, None, 7, "2024-01-02T10:00:00Z", "x"),
    ], "comment_id long, sentiment string, emotion_label string, topic_id int, video_id string, like_count long, "
       "updated_at string, text string")


def test_distribution_drops_nulls_ties_by_value(spark):
    out = [tuple(r) for r in X.distribution(comments(spark), "sentiment").collect()]
    assert out == [("positive", 2), ("negative", 1)]
    assert X.distribution(comments(spark), "absent").count() == 0


def test_request_counts_precedence(spark):
    req = spark.createDataFrame([(1, "positive and negative"), (2, "no label"), (3, "only positive")], "rid long, text string")
    out = {r["rid"]: (r["filter_label"], r["n"]) for r in X.request_counts(comments(spark), req, "rid").collect()}
    assert out == {1: ("negative", 1), 2: (None, 4), 3: ("positive", 2)}


def test_facets_and_likes(spark):
    c = comments(spark)
    assert X.facet_filter(c).count() == 4
    assert X.facet_filter(c, sentiments=["positive"], min_likes=1).count() == 1
    assert X.facet_filter(c, videos=["v1"], topics=[1]).count() == 1


def test_search_literal_and_regex(spark):
    c = comments(spark)
    assert X.search(c, "c++", literal=True).count() == 1
    assert X.search(c, "^pla").count() == 1


def test_sentiment_over_time_drops_bad_times(spark):
    rows = X.sentiment_over_time(comments(spark)).orderBy("date").collect()
    assert [(str(r["date"]), r["negative"], r["positive"]) for r in rows] == [
        ("2024-01-01", 1, 0), ("2024-01-02", 0, 1)]


def test_summary_counts_sum_to_non_null_rows(spark):
    out = X.corpus_summary(comments(spark)).collect()
    sent = sum(r["value"] for r in out if r["section"] == "sentiment")
    assert sent == 3
    assert [r["value"] for r in out if r["section"] == "rows"] == [4]
