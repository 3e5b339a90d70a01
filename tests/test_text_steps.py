"""The steps of the text functions that are skipped or written otherwise give what the plain chain gives."""

import random

from pyspark.sql import functions as F

from murmur.functions import text as T
from murmur.functions.language import language_of_tokens
from murmur.resources.words import LANGUAGE_PROFILES, SECURITY_KEEP_PATTERN

PIECES = ["a", "www", "ww", "http", "http://x", "@", "@me", "!", "!!", "?", "??", "<", ">", "<b>", " ", "  ", "\n", "\r", "\t", "\x0b", "\x1c",
          "\x85", "\xa0", " ", " ", "　", "\U0001F44D", "\U0001F3FB", "é", "中", "_", "-", "CVE-2021-44228", "sha-256", "$1", "\\"]


def _texts(n=3000):
    draw = random.Random(5)
    return [None, "", " ", "\n"] + ["".join(draw.choice(PIECES) for _ in range(draw.randint(1, 14))) for _ in range(n)]


def test_clean_text_is_the_plain_chain(spark):
    plain = T.demojize(F.col("v"))
    for pattern, repl in T.CLEAN_STEPS:
        plain = F.regexp_replace(plain, pattern, repl)
    df = spark.createDataFrame([(t,) for t in _texts()], "v string")
    other = df.select("v", T.clean_text(F.col("v")).alias("a"), F.trim(plain).alias("b")).filter("not (a <=> b)")
    assert other.collect() == []


def test_emoji_guard_needs_no_ascii_test(spark):
    out = F.col("v")
    for emoji, name in sorted(T.EMOJI_NAMES, key=lambda p: -len(p[0])):
        out = F.replace(out, F.lit(emoji), F.lit(name))
    df = spark.createDataFrame([(t,) for t in _texts()], "v string")
    assert df.filter(~T.demojize(F.col("v")).eqNullSafe(out)).count() == 0


def test_blank_is_no_other_character(spark):
    df = spark.createDataFrame([(t,) for t in _texts()], "v string")
    blank = F.regexp_replace(F.coalesce("v", F.lit("")), "^[" + T.WS + "]+|[" + T.WS + "]+$", "") == ""
    assert df.filter(T.guard_model_input(F.col("v")).isNull() != blank).count() == 0


def test_kept_tokens_and_language(spark):
    toks = T.tokens(F.col("v"))
    df = spark.createDataFrame([(t,) for t in _texts()] + [("The XSS of c2 and sha-1, sha-x md5 isn't the ip nor VPN",)], "v string")

    def keep(t):
        return t.rlike("^(" + SECURITY_KEEP_PATTERN + ")$") | (~t.isin(T.STOPWORDS_EN) & (F.length(t) > 2) & t.rlike(r"^\p{L}+$"))
    assert df.filter(~F.filter(toks, lambda t: T.keep_token(t)).eqNullSafe(F.filter(toks, keep))).count() == 0

    draw = random.Random(6)
    words = [w for p in LANGUAGE_PROFILES.values() for w in p] + ["word", "mot"]
    rows: list = [(None,), ([],), (["word"],)] + [([draw.choice(words) for _ in range(draw.randint(1, 9))],) for _ in range(500)]

    def plain(ws):
        hits = {lang: sum(w in p for w in ws or []) for lang, p in LANGUAGE_PROFILES.items()}
        best = min(hits, key=lambda lang: (-hits[lang], lang))
        return best if hits[best] else "unknown"
    got = spark.createDataFrame(rows, "v array<string>").select("v", language_of_tokens(F.col("v")).alias("l")).collect()
    assert [r["l"] for r in got] == [plain(r["v"]) for r in got]
