from pyspark.sql import functions as F

from murmur.functions import entities as E
from tests.conftest import one


def test_cves_case_and_duplicates(spark):
    assert one(spark, E.cves(F.col("v")), "cve-2021-44228 and CVE-2021-44228") == ["cve-2021-44228", "CVE-2021-44228"]


def test_ips_not_range_checked(spark):
    assert one(spark, E.ips(F.col("v")), "999.999.1.2 and 10.0.0.1") == ["999.999.1.2", "10.0.0.1"]


def test_hash_lengths(spark):
    for n, hit in ((31, False), (32, True), (40, True), (64, True), (65, False)):
        assert bool(one(spark, E.hashes(F.col("v")), "x " + "a" * n + " y")) is hit


def found(spark, texts, terms, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, v string")
    lexicon = spark.createDataFrame([(t,) for t in terms], "term string")
    return {r.id: r.cyber_keywords for r in E.with_keywords(df, lexicon, "v", **kw).collect()}


def test_keywords_substring_sorted_distinct(spark):
    got = found(spark, ["Friday: a Zero Day exploit, friday", "nothing here", None, ""], ["ida", "zero day", "apt", "ida"])
    assert got == {0: ["ida", "zero day"], 1: [], 2: [], 3: []}
    assert found(spark, ["x"], []) == {0: []}


def test_keywords_of_a_large_lexicon_in_blocks(spark):
    terms = [f"term{i}x" for i in range(50_000)]
    texts = ["term7x and Term49999x", "term7 x", None, "term12x" * 3]
    want = {0: ["term49999x", "term7x"], 1: [], 2: [], 3: ["term12x"]}
    assert found(spark, texts, terms) == want
    assert found(spark, texts, terms, block_bytes=100_000) == want


def test_shipped_lexicon():
    from murmur.sources.lexicon import shipped_terms

    assert len(shipped_terms()) >= 365 and shipped_terms() == sorted(set(shipped_terms()))


def test_all_terms_union(spark):
    c, kw = F.col("v"), F.array(F.lit("ransomware"))
    out = one(spark, E.all_terms(E.regex_entities(c), kw), "10.0.0.1 ransomware 10.0.0.1")
    assert out == ["10.0.0.1", "ransomware"]


def test_gazetteer_longest_match(spark):
    table = [("kali linux", "PRODUCT"), ("north korea", "GPE"), ("linux", "PRODUCT"), ("friday", "DATE"),
             ("the bank of north korea today", "ORG"), ("korea", "GPE")]
    df = spark.createDataFrame([(1, "Kali Linux on North Korea servers; linux friday"), (2, None), (3, "nothing"),
                                (4, "at the Bank of North Korea, today")], "id long, clean_text string")
    rows = E.with_gazetteer(df, E.gazetteer_table(spark, table), "id").collect()
    got = {r.id: [(e["text"], e["label"]) for e in r.entities] for r in rows}
    assert got == {1: [("kali linux", "PRODUCT"), ("north korea", "GPE"), ("linux", "PRODUCT"), ("friday", "DATE")],
                   2: [], 3: [], 4: [("the bank of north korea today", "ORG")]}


def test_filter_on_entities_adds_no_second_tokeniser(spark):
    df = spark.createDataFrame([(1, "linux")], "id long, clean_text string")
    out = E.with_gazetteer(df, E.gazetteer_table(spark), "id").filter(F.size("entities") > 0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert out.count() == 1
