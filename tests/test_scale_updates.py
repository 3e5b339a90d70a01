"""Gazetteer phrases are found without moving n-grams, and an update writes only what it must."""

import os
import tempfile

from pyspark.sql import functions as F

from murmur.functions import entities as E
from murmur.plans.incremental import IncrementalCorpus


def _entities(df, phrases):
    out = E.with_gazetteer(df, phrases, "doc_id", "clean_text")
    return out, {r["doc_id"]: [tuple(e) for e in r["entities"]] for r in out.collect()}


def test_ngrams_are_not_shuffled(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Kali Linux on windows, north star"), (2, None), (3, "north korea north Korea"), (4, "")], "doc_id long, clean_text string")
    phrases = E.gazetteer_table(spark)
    out, found = _entities(df, phrases)
    assert found == {1: [("kali linux", "PRODUCT"), ("windows", "PRODUCT")], 2: [], 3: [("north korea", "GPE")] * 2, 4: []}
    plan = out._jdf.queryExecution().toString()
    assert "hashpartitioning(phrase" not in plan
    monkeypatch.setattr(E, "FIRST_WORDS", 3)                   # a gazetteer with more first words, too large to be sent
    monkeypatch.setattr(E, "LEXICON_BLOCK_BYTES", 10)
    assert _entities(df, phrases)[1] == found


def _files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_new_rows_are_added_and_seen_rows_not_written(spark):
    schema = "comment_id long, text string"
    store = IncrementalCorpus(spark, tempfile.mkdtemp(prefix="murmur-inc-"), buckets=2, top_n=1)
    rows = [(i, f"The attack of the hacker and the system{i}x, attack") for i in range(6)]
    store.update(spark.createDataFrame(rows, schema))
    before = _files(f"{store.folder}/processed")
    keyed = store._keyed(spark.createDataFrame(rows + [(7, "The server of the network")], schema))
    assert keyed.filter(F.col("_row").isNotNull()).count() == 1
    store.update(spark.createDataFrame(rows + [(7, "The server of the network")], schema))
    after = _files(f"{store.folder}/processed")
    assert before < after and store.processed.count() == 7
    store.update(spark.createDataFrame(rows[1:], schema))
    assert store.processed.count() == 5 and store.final.count() == 5
