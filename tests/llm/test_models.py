import math

import numpy as np
import pytest

from murmur.llm import language_id, lm, quality
from murmur.llm.catalog import QUERIES
from tests.conftest import SF01, SF001
from tests.llm import brute

ODD = [(1, None), (2, ""), (3, " \n"), (4, "12 34 !!"), (5, "a"), (6, "the cat and the dog " * 3000), (7, "le chat et le chien"),
       (7, "le chat et le chien")]


def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.selectExpr("*", "1 as score", "2 as statistics", "3 as language", "4 as block", "5 as n")


def test_quality_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = QUERIES["op4_quality_classifier"](spark, SF01).collect()
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (brute.remainder(r.doc_id, 3) == 1)
    right = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(right) > 50 and sum(right) >= 0.95 * len(right)


def test_quality_ignores_labels_of_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 "
                                          "then 1 - quality else quality end as quality")
    one, two = quality.train(docs, labels)[0], quality.train_on_labelled(docs, flipped)
    assert np.allclose(one.means, two.means) and np.allclose(one.factors, two.factors)


def test_quality_is_the_gaussian_density(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.normal(k, 1 + k, len(quality.NAMES)).tolist(), int(k)) for k in (0, 1) for _ in range(300)]
    model = quality.fit(spark.createDataFrame(rows, "statistics array<double>, label int"), pooled=0.0, diagonal=0.0)
    x = np.array([r for r, _ in rows])
    logs = []
    for k in (0, 1):
        part = x[[label == k for _, label in rows]]
        cov = np.cov(part.T, bias=True) + 1e-4 * np.eye(x.shape[1])
        away = x - part.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))), atol=1e-6)


def test_quality_of_odd_rows(spark):
    schema = "statistics array<double>, label int"
    none = quality.fit(spark.createDataFrame([], schema))
    some = quality.fit(spark.createDataFrame([([0.0] * len(quality.NAMES), 1), ([1.0] * len(quality.NAMES), None)], schema))
    for model in (none, some):
        rows = quality.score(odd(spark), model, "text").collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and rows[0].block == 4
    assert {round(r.score, 6) for r in quality.score(odd(spark), none, "text").collect()} == {0.5}
    assert quality.score(odd(spark).limit(0), none, "text").count() == 0


def test_language_on_held_out_documents(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op8_language_id"](spark, SF01).collect()
    assert len(rows) == len(docs)
    right = [r.lang_pred == docs[r.doc_id] for r in rows if r.held_out]
    assert all(r.held_out == (brute.remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(right) >= 0.97 * len(right)


def test_language_of_odd_rows(spark):
    known = [(i, t, c) for i, (t, c) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"),
             ("le chat et le chien", "fr"), ("el gato y el perro", "es"), ("blip blop blup", "qq"), ("none", None), ("12", "en")] * 5)]
    train = spark.createDataFrame(known, "doc_id long, text string, lang string")
    model = language_id.fit(train)
    assert ("", "germanic", "romance") in model.weights and ("germanic", "de", "en") in model.weights
    rows = language_id.identify(odd(spark), model).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r.language for r in rows}
    assert all(tuple(got[d]) == ("und", 0.0) for d in (1, 2, 3, 4))
    assert got[6].lang_pred == "en" and got[7].lang_pred == "fr"
    assert language_id.identify(odd(spark).limit(0), model).count() == 0
    alone = language_id.fit(train.filter("lang = 'fr'"))
    assert tuple(language_id.identify(odd(spark), alone).collect()[5].language) == ("fr", 1.0)
    nothing = language_id.fit(train.limit(0))
    assert {r.language.lang_pred for r in language_id.identify(odd(spark), nothing).collect()} == {"und"}


def test_machines_separate():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(1, 1, (100, 6)), rng.normal(-1, 1, (100, 6))])
    sides = np.repeat([1.0, -1.0], 100)
    w = language_id.separate(x, sides)
    assert (np.sign(x @ w[:-1] + w[-1]) == sides).mean() > 0.95


def test_filter_gives_counts_back(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-1 << 63, (1 << 63) - 1, 4000)
    counts = rng.integers(3, 5000, 4000)
    made = lm.build_filter(spark.createDataFrame([(int(k), int(n)) for k, n in zip(keys, counts, strict=True)],
                                                 "key long, n long"), 3.0)
    levels = made.levels(keys.view(np.uint64))
    want = lm.level_of(counts, 3.0)
    assert (levels >= want).all() and (levels == want).mean() > 0.95          # never too low, seldom too high
    assert (lm.value_of(want, 3.0) / counts < lm.BASE).all() and (counts / lm.value_of(want, 3.0) < lm.BASE).all()
    others = rng.integers(-1 << 63, (1 << 63) - 1, 4000).view(np.uint64)
    assert (made.levels(others) > 0).mean() < 0.03


def held(rows, want):
    for r in rows:
        out, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score <= 0


def test_op9(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    rows = QUERIES["op9_lm_scoring"](spark, SF01).collect()
    assert len(rows) == len(docs)
    held(rows, brute.op9_base(docs))
    fresh = [r for r in rows if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


@pytest.mark.parametrize("block", [lm.BLOCK_BYTES, 100])
def test_scores_of_odd_rows(spark, monkeypatch, block):
    from pyspark.sql import functions as F

    from murmur.llm.common import remainder

    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    docs = odd(spark).withColumn("train", remainder("doc_id", 5) != 1)
    rows = lm.language_model_scores(docs).collect()
    assert len(rows) == len(ODD)
    # equal rows count each
    want = brute.op9_base([(d, t) for d, t in ODD[:-1]])
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert [r.n_tokens for r in rows if r.doc_id == 6] == [want[6][1]]
    assert len({r.score for r in rows if r.doc_id == 7}) == 1
    nothing = lm.language_model_scores(docs.withColumn("train", F.lit(False))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in nothing)
    assert lm.language_model_scores(docs.limit(0)).count() == 0


def test_pairs_of_rare_words_count(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a b c d " * 100_000, True), (2, "rare pair", True), (3, "rare pair", True), (4, "rare pair", False),
            (5, "pair rare", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r.doc_id: r.score for r in lm.language_model_scores(docs).filter(F.col("held_out")).collect()}
    assert got[4] > got[5] + 1


def test_a_word_seen_once_is_known_at_any_size(spark):
    from pyspark.sql import functions as F

    bulk = spark.range(40, numPartitions=8).select("id", F.repeat(F.lit("a "), 1_000_000).alias("text"), F.lit(True).alias("train"))
    rows = [(100, "once", True), (101, "once", False), (102, "never", False)]
    docs = bulk.union(spark.createDataFrame(rows, "id long, text string, train boolean")).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.score for r in lm.language_model_scores(docs).filter(F.col("held_out")).collect()}
    assert got[101] > got[102] + 0.3


def test_packed_numbers():
    places = np.random.default_rng(0).integers(0, 1 << 20, 1000).astype(np.uint32)
    assert (lm._unpacked(lm._packed(places)) == places).all() and len(lm._unpacked(lm._packed(places[:0]))) == 0
