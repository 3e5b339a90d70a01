"""The stored vector table: encoding, search and its limits."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from murmur.operators.store import HashEncoder, VectorStore

ROWS = [(1, "ransomware attack on hospital servers", "v1", "negative"), (2, "phishing mail with a fake invoice", "v2", "neutral"),
        (3, "ransomware gang leaks data", "v2", "negative"), (4, "phishing mail with a fake invoice", "v1", "neutral"),
        (5, None, "v1", None), (6, "  ", "v3", "positive")]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "id long, words string, video_id string, sentiment string")
    path = f"file://{tmp_path_factory.mktemp('store')}/s"
    VectorStore.write(df, path, "id", "words", layout=["video_id"], dims=64)
    return VectorStore.open(spark, path)


def test_vectors_are_weighted_counts(store):
    from hashlib import md5

    def slot(t):
        return int(md5(t.encode()).hexdigest()[:8], 16) % 64
    texts = {i: [w for w in (t or "").split() if len(w) > 1] for i, t, _, _ in ROWS}
    held = Counter(b for t in texts.values() for b in {slot(w) for w in t})
    for r in store.rows.collect():
        raw = [0.0] * 64
        for w in texts[r.comment_id]:
            raw[slot(w)] += math.log(7 / (1 + held[slot(w)])) + 1
        norm = math.sqrt(sum(x * x for x in raw)) or 1
        assert r.embedding == pytest.approx([x / norm for x in raw], abs=1e-6)
        assert r.text == (dict((i, t) for i, t, _, _ in ROWS)[r.comment_id] or "") and r.metadata.video_id == r.video_id


def asked(spark):
    return spark.createDataFrame([(1, "Ransomware on servers?", "v1"), (2, "a fake invoice", "v2"), (3, "zzz", None)],
                                 "qid long, text string, video_id string")


def test_questions_in_words(spark, store):
    got = {q: [r.comment_id for r in sorted(store.search(asked(spark), 2).filter(F.col("qid") == q).collect(), key=lambda r: r["rank"])]
           for q in (1, 2, 3)}
    assert got == {1: [1, 3], 2: [2, 4], 3: [1, 2]}
    assert store.search(asked(spark), 50).count() == 18 and store.search(asked(spark).limit(0)).count() == 0


def test_limits_are_partition_filters(spark, store):
    one = store.search(asked(spark), 9, where=F.col("video_id") == "v2")
    assert {r.comment_id for r in one.collect()} == {2, 3}
    assert "(video_id#" in one._jdf.queryExecution().toString().split("PartitionFilters: [")[1][:80]
    own = store.search(asked(spark), 9, by="video_id")
    assert {(r.qid, r.comment_id) for r in own.collect()} == {(1, 1), (1, 4), (1, 5), (2, 2), (2, 3)}
    assert "dynamicpruning" in own._jdf.queryExecution().toString()


def test_empty_store(spark, tmp_path):
    df = spark.createDataFrame([], "id long, words string")
    store = VectorStore.write(df, f"file://{tmp_path}/s", "id", "words", dims=8)
    assert store.search(asked(spark), 3).collect() == []
    assert HashEncoder.load(spark, f"file://{tmp_path}/s/encoder").dims == 8
