"""The DuckDB oracle gate on the smallest data: Spark and SQL must agree."""

import duckdb
import pytest

from murmur.plans.catalog import ORACLE, QUERIES
from murmur.sources.tables import TABLES
from scripts.oracle_check import digest

SF = "/root/testdata/sf0.001"
NAMES = ["clean_text", "language_id", "zipf_top50", "final_text", "tfidf_topk", "cosine_topk", "hybrid_topk_a03",
         "keyword_hits", "gazetteer_entities", "sentiment_over_time", "corpus_summary", "evidence_context",
         "faithfulness", "enrichment_stage", "topic_words", "route_dispatch"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
