"""The pipeline, each stage held against brute force on what the stage before kept."""

import re

import pytest

import corpus_pipeline as pipeline
from tests.conftest import SF001
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows that go into each stage, and what the last returns."""
    docs, out = spark.read.parquet(f"{SF001}/documents.parquet"), []
    for name, step in pipeline.STAGES:
        out.append(docs.collect())
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        step(spark, docs, SF001).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    return [*out, docs.collect()]


def pairs(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_quality_stage_follows_the_labels(spark, kept):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    left = {r.doc_id for r in kept[1]}
    right = [(quality[r.doc_id] == 1) == (r.doc_id in left) for r in kept[0] if r.doc_id in quality]
    assert sum(right) >= 0.9 * len(right)


def test_line_stage(kept):
    want = brute.op6(pairs(kept[1]))
    left = {d: t for d, (_, n, t) in want.items() if n == 0 or re.search(r"[^\x20\x09-\x0D]", t)}
    assert {r.doc_id: r.text for r in kept[2]} == left
    assert all(r.n_chars == len(r.text) for r in kept[2])


def test_near_copy_stage(kept):
    want = brute.op1(pairs(kept[2]), 5, 80)
    assert sorted(r.doc_id for r in kept[3]) == sorted(d for d, (_, c) in want.items() if d == c)


def test_benchmark_stage(spark, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    want = brute.op5(pairs(kept[3]), items)
    assert sorted(r.doc_id for r in kept[4]) == sorted(d for d, w in want.items() if not w[4])


def test_token_stage_and_run(spark, kept):
    assert sorted(r.doc_id for r in kept[5]) == sorted(r.doc_id for r in kept[4])
    assert sorted(map(tuple, pipeline.run(spark, SF001).collect())) == sorted(map(tuple, kept[5]))


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one", None, None, 3), (4, "word " * 4000, "en", "a", 20000),
            (4, "word " * 4000, "en", "a", 20000), (5, "a b c d e f g h", "en", "a", 15), (6, "A B c d e f g h", "en", "a", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, step in pipeline.STAGES[1:]:
            n = step(spark, frame, SF001).count()
            assert n == {"line_dedup": 6, "near_copies": 6}.get(name, 7) if frame is docs else n == 0, name
        step = pipeline.STAGES[0][1](spark, frame, SF001)
        assert step.columns == COLUMNS and step.count() <= frame.count()
