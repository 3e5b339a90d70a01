"""Topic models of all groups in one fit."""

import numpy as np
from pyspark.sql import functions as F

from murmur.operators import group_topics
from murmur.operators.group_topics import Centres, GroupTopics


def rows(spark):
    """Group a: blobs of 40, 25 and 2 rows; b: of 30 and 20; c: too small; and nulls."""
    rng = np.random.default_rng(3)
    out, i = [], 0
    for group, sizes in (("a", (40, 25, 2)), ("b", (30, 20)), ("c", (3,)), (None, (4,))):
        for j, n in enumerate(sizes):
            for _ in range(n):
                v = np.zeros(6)
                v[j] = 10.0
                out.append((i, group, [float(x) for x in v + 0.1 * rng.standard_normal(6)]))
                i += 1
    return spark.createDataFrame([*out, (i, "a", None)], "doc_id long, mood string, embedding array<float>").repartition(3)


def test_groups_are_clustered_apart(spark, tmp_path):
    df = rows(spark)
    path = f"file://{tmp_path}/models"
    model = GroupTopics.fit(df, "mood", k=3, far=9.0, path=path)
    got = GroupTopics.open(spark, path, far=9.0).assign(df, "mood")
    assert sorted(map(tuple, got.select("doc_id", "sentiment_topic_id").collect())) == sorted(
        map(tuple, model.assign(df, "mood").select("doc_id", "sentiment_topic_id").collect()))
    info = {(r.mood, r.sentiment_topic_id): r["count"] for r in model.info(got, "mood").collect()}
    assert info[("a", 0)] == 40 and info[("a", 1)] == 25 and info[("a", -1)] == 2
    assert sum(n for (g, _), n in info.items() if g == "b") == 50 and {g for g, _ in info} == {"a", "b"}
    assert got.count() == got.select("doc_id").distinct().count() == 117
    assert [f for f in (tmp_path / "models").iterdir() if f.name.startswith("g=")]          # a folder for each group


def test_one_round_is_plain_k_means(spark):
    df = group_topics._rows(rows(spark), "mood", "embedding", "doc_id")
    given = [(r.g, np.array(r.v)) for r in df.collect()]
    centres = Centres({"a": np.eye(6)[:4] * 9, "b": np.eye(6)[:2] * 9})
    got = {(r.g, r.c): (r.n, np.array(r.s)) for r in group_topics._sums(df, centres).collect()}
    want = {}
    for g, v in given:
        if g in centres.of:
            c = int(((centres.of[g] - v) ** 2).sum(1).argmin())
            n, s = want.get((g, c), (0, np.zeros(6)))
            want[g, c] = n + 1, s + v
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and np.allclose(got[x][1], want[x][1]) for x in want)


def test_no_group_is_large_enough(spark):
    df = rows(spark).filter("mood = 'c'")
    model = GroupTopics.fit(df, "mood")
    assert model.assign(df, "mood").collect() == [] and model.model.count() == 0
    assert GroupTopics.fit(df.limit(0), "mood").model.count() == 0


def test_equal_rows_are_one_cluster(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a").alias("mood"), F.expr("array(1f, 2f)").alias("embedding"))
    got = GroupTopics.fit(df, "mood", k=4).assign(df, "mood")
    assert {tuple(r) for r in got.groupBy("sentiment_topic_id").count().collect()} == {(0, 50)}
