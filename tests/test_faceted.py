"""Searches within a part of one store equal those of an index of this part alone."""

import tempfile

import pytest
from pyspark.sql import functions as F

from murmur.operators.faceted import FacetStore
from murmur.operators.retrieval import TfidfIndex, hybrid_search

ROWS = [(i, t, [float(i % 3), 1.0] if i % 4 else None, v, m) for i, (t, v, m) in enumerate([
    ("alpha beta beta", "001", "pos"), ("alpha gamma", "1", "pos"), ("beta delta alpha", "001", "neg"), ("", "001", "pos"),
    (None, "1", "neg"), ("gamma gamma delta", None, "pos"), ("delta beta", "", "neg"), ("alpha beta beta", "1", "pos"),
    ("omega", "x/y=z", None), ("alpha " * 3000 + "omega", "x/y=z", "pos")])]
SCHEMA = "comment_id long, text string, embedding array<double>, video string, mood string"
LIMITS = [{}, {"video": "001"}, {"video": ["1", "001"], "mood": "pos"}, {"video": [None]}, {"video": "x/y=z"}, {"mood": "none"},
          {"video": [None, "1"]}]


@pytest.fixture(scope="module")
def given(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df, FacetStore.write(df.withColumn("extra", F.lit(1)), tempfile.mkdtemp(prefix="murmur-facets-"), ["video", "mood"])


def _own(df, limits):
    for c, values in limits.items():
        values = values if isinstance(values, list) else [values]
        same = F.col(c).isin([v for v in values if v])
        df = df.filter((same | (F.coalesce(F.col(c), F.lit("")) == "")) if None in values else same)
    return df


@pytest.mark.parametrize("limits", LIMITS, ids=str)
def test_equal_to_an_index_of_the_part(spark, given, limits):
    df, store = given
    part = _own(df, limits)
    qs = spark.createDataFrame([(1, "alpha beta"), (2, "omega delta"), (3, ""), (4, None), (5, "unknown")], "qid long, text string")
    qv = spark.createDataFrame([(1, [1.0, 0.0]), (5, [0.0, 1.0])], "qid long, embedding array<double>")
    want = TfidfIndex(part, "comment_id", "text").top_k(qs, 4)
    assert sorted(map(tuple, store.lexical(qs, 4, **limits).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    index = TfidfIndex(part.withColumnRenamed("comment_id", "doc_id"))
    both = hybrid_search(part.select("comment_id", "text"), part.filter("embedding is not null").select("comment_id", "embedding"),
                         qs, qv, 3, 0.7, index).drop("text")
    got = store.hybrid(qs, qv, 3, 0.7, **limits).select(*both.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, both.collect()))


def test_only_folders_of_the_part_are_read(given):
    _, store = given
    for table in (store.rows, store.terms, store.frequencies):
        plan = store._limit(table, {"video": ["1"], "mood": "pos"})._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "video" in filters and "mood" in filters
    assert store.part(video="1") is store.part(video="1")
    with pytest.raises(ValueError):
        store.part(author="a")
    files = store._limit(store.terms, {"video": "001"}).select(F.input_file_name()).distinct().collect()
    assert files and all("video=001" in f[0] for f in files)


def test_empty_store(spark):
    store = FacetStore.write(spark.createDataFrame([], SCHEMA), tempfile.mkdtemp(prefix="murmur-facets-"), ["video"])
    qs = spark.createDataFrame([(1, "alpha")], "qid long, text string")
    assert store.lexical(qs, 3, video="1").count() == 0
