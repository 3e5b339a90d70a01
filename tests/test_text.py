from pyspark.sql import functions as F

from murmur.functions import text as T
from murmur.functions.language import language_of
from murmur.operators import corpus
from tests.conftest import one


def clean(spark, s):
    return one(spark, T.clean_text(F.col("v")), s)


def test_mentions_hit_mail_addresses(spark):
    assert clean(spark, "a@b.com") == "a USER_MENTION .com"


def test_repeated_marks(spark):
    assert clean(spark, "hm!!! ok?? no!") == "hm MULTI_EXCLAMATION ok MULTI_QUESTION no!"


def test_runs_shortened_to_two(spark):
    assert clean(spark, "sooooo") == "soo"


def test_run_rule_precedes_url_rule(spark):
    assert clean(spark, "x www.example.com y") == "x ww.example.com y"


def test_run_rule_rewrites_identifiers(spark):
    out = clean(spark, "CVE-2021-44428 CVE-2000-1234 cve-2021-44228 111.111.1.1 10.0.0.1")
    assert out == "CVE-2021-4428 CVE-200-1234 cve-2021-44228 11.11.1.1 10.0.0.1"


def test_url_rule_precedes_tag_rule(spark):
    assert clean(spark, '<a href="http://x.io/a">click</a> more > z') == "z"


def test_line_breaks_and_unicode_spaces(spark):
    assert clean(spark, "a b c\rd\ne\tf g") == "a b c d e f g"


def test_emoji_names_longest_first(spark):
    assert clean(spark, "ok \U0001F44D\U0001F3FB and \U0001F44D") == "ok :thumbs_up_light_skin_tone: and :thumbs_up:"


def test_null_text_stays_null(spark):
    assert clean(spark, None) is None


def test_no_run_of_three_after_cleaning(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bad = corpus.clean(df).filter(F.col("clean_text").rlike(r"(?s)(.)\1\1")).count()
    assert bad == 0


def test_tokens_keep_security_ids_whole(spark):
    toks = one(spark, T.tokens(F.col("v")), "Patch CVE-2021-44228 now, sha-256 ok")
    assert toks == ["patch", "cve-2021-44228", "now", "sha-256", "ok"]


def test_lemmas_keep_rule_and_order(spark):
    out = one(spark, T.lemmas(F.col("v")), "The hackers used SQL and XSS at 2 servers, servers")
    assert out == ["hacker", "use", "sql", "xss", "server", "server"]


def test_remove_words_keeps_duplicates(spark):
    out = one(spark, T.remove_words(F.col("v"), ["b"]), ["a", "b", "a", "c"], "v array<string>")
    assert out == ["a", "a", "c"]


def test_guard_blank_and_prefix(spark):
    assert one(spark, T.guard_model_input(F.col("v")), "  \t ") is None
    assert len(one(spark, T.guard_model_input(F.col("v")), "x" * 600)) == 600


def test_sentiment_label_map(spark):
    assert one(spark, T.sentiment_label(F.col("v")), "LABEL_Positive") == "positive"
    assert one(spark, T.sentiment_label(F.col("v")), "NEGATIVE") == "negative"
    assert one(spark, T.sentiment_label(F.col("v")), "LABEL_1") == "neutral"


def test_language_profiles(spark):
    assert one(spark, language_of(F.col("v")), "the cat and the dog of the house") == "en"
    assert one(spark, language_of(F.col("v")), "le chat et la maison des amis") == "fr"
    assert one(spark, language_of(F.col("v")), "xyz qqq") == "unknown"


def test_language_accuracy_on_documents(spark):
    df = corpus.with_language(corpus.clean(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    right = df.filter(F.col("language") == F.col("lang")).count()
    assert right / df.count() > 0.95


def test_final_tokens_subset_and_no_stopword(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows, freq, stop = corpus.preprocess(df)
    assert len(stop) == 50
    for r in rows.select("lemmas", "final_tokens").collect():
        assert not set(r["final_tokens"]) & set(stop)
        assert set(r["final_tokens"]) <= set(r["lemmas"])


def test_rank_words_matches_window(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    freq = corpus.word_frequency(corpus.prepare(df))
    got = {r["word"]: r["rank"] for r in corpus.rank_words(freq).collect()}
    want = sorted(((-r["frequency"], r["word"]) for r in freq.collect()))
    assert got == {w: i + 1 for i, (_, w) in enumerate(want)}


def test_min_length_by_source(spark):
    df = spark.createDataFrame([("a", "short"), ("a", "x" * 60), ("b", "short")], "video_id string, text string")
    assert corpus.min_length_by_source(df, ["a"]).count() == 2
    assert corpus.min_length_by_source(df, []).count() == 3
