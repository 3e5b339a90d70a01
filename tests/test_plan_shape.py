"""Physical-plan guards for the properties that matter at scale."""

from murmur.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = QUERIES[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()          # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pair_tables(spark):
    for name in ("cosine_topk", "hybrid_topk", "tfidf_topk", "keyword_hits"):
        p = plan(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_topk_uses_group_limit(spark):
    assert "WindowGroupLimit" in plan(spark, "tfidf_topk")


def test_text_stage_has_no_pushed_filter_below_spread(spark):
    # the English filter is a generator, evaluated once above the projection
    p = plan(spark, "zipf_top50")
    assert "Filter (size" not in p and "Filter size" not in p


def test_keywords_are_narrow(spark):
    p = plan(spark, "keyword_hits")
    assert p.count("Exchange") <= 1          # only the spread of the single-file input
