import os
import tempfile

from pyspark.sql import functions as F

from murmur.operators import labels, topics
from murmur.plans.build import run_build
from murmur.sources import files
from murmur.streaming import enrich


def test_csv_edge_rows(spark):
    d = tempfile.mkdtemp(prefix="murmur-csv-")
    path = os.path.join(d, "c.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write('﻿author,updated_at,like_count,text,video_id,public\n'
                 'a,2024-01-01T00:00:00Z,1,"line one\nline two",v,true\n'
                 'b,,2,"say ""hi""",v,false\n'
                 'c,,3,,v,true\n'
                 'd,,4,nan,v,true\n')
    rows = files.read_comment_csv(spark, path).orderBy("author").collect()
    assert [r["text"] for r in rows] == ["line one\nline two", 'say "hi"', None, "nan"]
    assert rows[0]["author"] == "a"


def test_thread_flatten(spark):
    d = tempfile.mkdtemp(prefix="murmur-json-")
    page = ('{"items": [{"snippet": {"isPublic": true, "topLevelComment": {"snippet": {"authorDisplayName": "x",'
            ' "publishedAt": "2024-01-01T00:00:00Z", "likeCount": 3, "textOriginal": "hi", "videoId": "v1"}}}}],'
            ' "nextPageToken": "t"}')
    with open(os.path.join(d, "p.json"), "w") as fh:
        fh.write(page + "\n" + '{"items": []}\n')
    rows = files.read_thread_pages(spark, d).collect()
    assert [(r["author"], r["like_count"], r["text"], r["video_id"], r["public"]) for r in rows] == [
        ("x", 3, "hi", "v1", True)]


def test_topic_invariants(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumnRenamed("vec_id", "doc_id")
    out = topics.cluster(emb, k=12, min_topic_size=40)
    sizes = {r["topic_id"]: r["count"] for r in topics.topic_info(out).collect()}
    real = [sizes[t] for t in sorted(t for t in sizes if t >= 0)]
    assert real == sorted(real, reverse=True)
    assert all(n >= 40 for n in real)
    assert out.count() == emb.count()


def test_per_group_skips_small_groups(spark):
    rows = [(i, "big", [float(i % 3), 1.0]) for i in range(5)] + [(10 + i, "small", [1.0, 0.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, sentiment string, embedding array<float>")
    assigned, info = topics.per_group_topics(df, "sentiment", min_topic_size=5, k=2)
    assert {r["sentiment"] for r in info.collect()} == {"big"}
    assert assigned.count() == 5


def test_classifier_beats_majority(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select(
        "doc_id", F.col("quality").cast("string").alias("label"))
    data = d.join(lab, "doc_id")
    train, test = data.filter(F.col("doc_id") % 5 != 0), data.filter(F.col("doc_id") % 5 == 0)
    model = labels.classifier_pipeline("text", "label", features=1 << 16).fit(train)
    scored = labels.classify(model, test)
    acc = scored.filter(F.col("prediction_label") == F.col("label")).count() / scored.count()
    major = max(r["count"] for r in test.groupBy("label").count().collect()) / test.count()
    assert acc >= major


def test_batch_model_guard(spark):
    df = spark.createDataFrame([(1, "  "), (2, "abcd")], "id long, t string")
    out = {r["id"]: (r["prediction_label"], r["prediction_score"])
           for r in labels.batch_score(df, "t", labels.toy_sentiment_model, label_map=labels.map_sentiment).collect()}
    assert out == {1: ("neutral", 0.0), 2: ("positive", round(4 / 97, 6))}


def test_build_restarts_from_stages(spark):
    root = tempfile.mkdtemp(prefix="murmur-build-")
    raw = (spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
           .select(F.col("doc_id").alias("comment_id"), "text", F.col("source").alias("video_id")))
    out = run_build(spark, raw, root, k=4, min_topic_size=5)
    n = out["final_analysis"].count()
    assert n == out["processed"].count() and n > 0
    assert "entities" in out["entities"].columns and out["topic_info"].count() > 0
    before = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if "part-" in f}
    again = run_build(spark, raw, root, k=4, min_topic_size=5)             # every stage is read back
    after = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if "part-" in f}
    assert again["final_analysis"].count() == n
    assert {f for f in before if f.endswith(".parquet")} == {f for f in after if f.endswith(".parquet")}
    # other input or parameters are built anew
    less = raw.filter("comment_id % 2 = 0")
    assert run_build(spark, less, root, k=4, min_topic_size=5)["processed"].count() < out["processed"].count()


def test_a_fourth_sentiment_has_its_column(spark):
    from murmur.operators.explore import sentiment_over_time

    rows = [(1, "2024-01-01 10:00:00", "ironic"), (2, "2024-01-01 11:00:00", "negative"), (3, "2024-01-02 11:00:00", "ironic")]
    df = spark.createDataFrame(rows, "id long, updated_at string, sentiment string")
    got = {str(r.date): (r.negative, r.neutral, r.positive, r.ironic) for r in sentiment_over_time(df).collect()}
    assert got == {"2024-01-01": (1, 0, 0, 1), "2024-01-02": (0, 0, 0, 1)}


def test_far_rows_are_outliers(spark):
    rows = [(i, [1.0 + i % 5 * 0.01, 0.0]) for i in range(60)] + [(100 + i, [-1.0 - i % 5 * 0.01, 0.0]) for i in range(60)]
    rows += [(999, [1.0, 1.5])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    got = {r.doc_id: r.topic_id for r in topics.cluster(df, k=2).collect()}
    assert got[999] == -1 and {got[i] for i in range(60)} == {got[0]} != {got[100]}
    assert topics.topic_count(200) < topics.topic_count(20_000) < topics.topic_count(2_000_000)


def test_streaming_enrichment_and_watermark(spark):
    src = tempfile.mkdtemp(prefix="murmur-src-")
    rows = [(1, "a", "2024-01-01 10:00:00", 1, "great great tool", "v"),
            (2, "b", "2024-01-01 11:00:00", 2, "terrible scam", "v"),
            (3, "c", "2024-01-03 11:00:00", 2, "fine", "v")]
    df = spark.createDataFrame(rows, "comment_id long, author string, updated_at string, like_count long, "
                                     "text string, video_id string").withColumn("updated_at", F.to_timestamp("updated_at"))
    df.write.mode("overwrite").parquet(src)
    sink, ck = tempfile.mkdtemp(prefix="murmur-sink-"), tempfile.mkdtemp(prefix="murmur-ck-")
    q = enrich.start(enrich.daily_sentiment(enrich.enrich_stream(enrich.read_landed(spark, src), spark.createDataFrame([("scam",)], "term string"))),
                     sink, ck, available_now=True)
    q.awaitTermination(120)
    got = {(str(r["day_start"])[:10], r["sentiment"], r["n"]) for r in spark.read.parquet(sink).collect()}
    assert ("2024-01-01", "positive", 1) in got and ("2024-01-01", "negative", 1) in got
