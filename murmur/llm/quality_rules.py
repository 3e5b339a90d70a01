"""Quality rules as a short-circuit cascade, ordered by what each rejects for its cost.

Every rule is a condition on figures of one text, made by SQL functions alone.  On a bounded
sample the operator measures how long each rule's figures take and how many documents the rule
rejects; rules run in falling order of rejections per second, and a document that one rule
rejects isn't looked at by those behind it.  The order never changes the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import WORD_GAP, load, stage, whole_text

SAMPLE_ROWS = 400
"""Documents that order the rules; at most so many are looked at.  They decide the order only."""
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def without(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def window_hashes(words: Column, width: int = WINDOW) -> Column:
    """A 64-bit hash of each run of ``width`` words."""
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    return F.when(F.size(words) >= width,
                  F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))
                  ).otherwise(F.array().cast("array<bigint>"))


def repeat_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words inside a window whose hash occurs twice or more.

    Windows are sorted by (hash, start); equal neighbours are repeats.  Their starts in order
    then cover ``width`` words each, less what the one before has covered.
    """
    def starts_of(pairs: Column) -> Column:
        again = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i - 1)["h"] == p["h"], F.lit(False))
                         | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False)))
        return F.sort_array(F.transform(again, lambda p: p["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # the one-element transform names the sorted pairs, so that they are made once
    starts = F.flatten(F.transform(F.array(pairs), starts_of))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(0).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition on columns of the table that the cascade is given; null keeps."""

    name: str
    rejects: Column


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected), in falling order of documents rejected per second.

    The sample is a written table of bounded size.  The time of reading it is taken off.
    """
    total = max(1, sample.count())
    found = []
    for rule in [Rule("none", F.col("text").isNull()), *rules]:
        seconds, share = float("inf"), 0.0
        for _ in range(2):                      # the first run compiles
            began = time.perf_counter()
            share = (sample.agg(F.count_if(rule.rejects)).first()[0] or 0) / total
            seconds = min(seconds, time.perf_counter() - began)
        found.append((rule, seconds, share))
    idle = found[0][1]
    timed = [(rule, max(seconds - idle, 1e-3), share) for rule, seconds, share in found[1:]]
    return sorted(timed, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(docs: DataFrame, rules: list[Rule], order: list[Rule] | None = None) -> Column:
    """The first rule in ``order`` that rejects a row, else null.  Those behind it aren't evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(order or rules):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict


def figures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Whole texts with their words, lines and counts."""
    df = docs.select(*[F.col(f"`{c}`") for c in keep], whole_text().alias("text"))
    df = df.select("*", words_of(F.col("text")).alias("words"), lines_of(F.col("text")).alias("lines"))
    df = df.select("*", window_hashes(F.col("words")).alias("windows"))
    return df.select(
        *keep, "text", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("windows")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Limits that prose in any of the languages keeps well within."""
    text, words = F.col("text"), F.col("n_words")
    letters = without(text, r"\p{L}+")
    return [
        Rule("few_words", words < 20),
        Rule("repeats", 100 * F.col("n_repeat_words") > 30 * words),
        Rule("symbols", 10 * F.col("n_symbols") > 2 * words),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words)),
        Rule("shouting", 2 * without(text, r"\p{Lu}+") > letters),
        Rule("exclamations", 10 * without(text, "[!?]+") > 3 * words),
        Rule("few_letters", 10 * letters < 6 * F.col("word_chars")),
    ]


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, keep: tuple[str, ...] = ("doc_id",),
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Figures and verdict of each document; ``rejected_by`` names the first rule, null if kept.

    Defined results: null texts count as empty, and texts without words are rejected as too
    short; very long texts are taken whole (sorting their windows takes n log n); repeated rows
    get equal figures and the same ``kept``; ties between rules are broken by name; an empty
    table gives no row.  Only the columns in ``keep`` are carried along, so others may have any
    name; which rule of several is named depends on the measured order, ``kept`` doesn't.
    """
    rules = rules or default_rules()
    sample = figures(stage(docs.select(*keep, "text").limit(sample_rows), "sample"), list(keep))
    order = [rule for rule, _, _ in order_rules(stage(sample, "figures"), rules)]
    made = figures(docs, list(keep))
    return made.withColumn("rejected_by", cascade(made, rules, order))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default rules over all documents."""
    out = quality_rules(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base_failed().alias("base_failed"),
                      (F.col("rejected_by").isNull() & ~base_failed()).alias("kept"))
