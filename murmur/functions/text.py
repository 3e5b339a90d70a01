"""Column expressions for text normalisation, tokens and lemmas.

Everything here is a native Spark expression (regexp_replace, higher-order
array functions); nothing leaves the JVM.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.resources.words import (EMOJI_NAMES, LEMMA_PAIRS, SECURITY_KEEP_PATTERN,
                                    STOPWORDS_EN)

# Unicode whitespace as Python's str.isspace() sees it, spelt out so Java and
# RE2 (the DuckDB oracle) read the same class.
WS = (r"\t\n\x0B\f\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}")
WORD = r"\p{L}\p{N}_"
TOKEN_PATTERN = r"cve-\d{4}-\d+|sha-\d+|[" + WORD + r"]+"
# Code-point ranges that hold the emoji of the name table.
EMOJI_GUARD = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}]"

CLEAN_STEPS = [
    # (pattern, replacement) in the order that defines clean_text
    ("@[" + WORD + "]+", " USER_MENTION "),
    (r"[\x{2028}\x{2029}\r\n\t]", " "),
    ("!{2,}", " MULTI_EXCLAMATION "),
    (r"\?{2,}", " MULTI_QUESTION "),
    (r"(?s)(.)\1{2,}", "$1$1"),
    ("http[^" + WS + "]+|www[^" + WS + "]+", " "),
    ("(?s)<.*?>", " "),
    ("[" + WS + "]+", " "),
]
CLEAN_MARKS = [["@"], None, ["!!"], ["??"], [], ["http", "www"], ["<"], []]
"""A step changes only texts that hold one of these ([]: any text).  The line breaks of the second step
are left to the last, which makes one space of any whitespace: no step between tells them apart."""
FAST = {r"(?s)(.)\1{2,}": r"(?s)(.)\1\1++",
        "[" + WS + "]+": "[[^!-~]&&[" + WS + "]]++"}
"""Java forms of steps on all texts, with equal matches: no way back, and ASCII told by one range."""


def demojize(c: Column, table=EMOJI_NAMES) -> Column:
    """Emoji -> ``:name:``; longer sequences are replaced first.

    The replace chain only runs on rows that hold a character of the emoji
    ranges, so plain text pays one regex test, and ASCII text a comparison of lengths.
    """
    out = c
    for emoji, name in sorted(table, key=lambda p: -len(p[0])):
        out = F.replace(out, F.lit(emoji), F.lit(name))
    return F.when((F.octet_length(c) > F.char_length(c)) & c.rlike(EMOJI_GUARD), out).otherwise(c)


def _once(c: Column, make) -> Column:
    """``make`` of a value that it uses several times, and that is computed once."""
    return F.transform(F.array(c), make)[0]


def clean_text(c: Column, emoji: bool = True) -> Column:
    """The ordered normalisation chain (mentions, line breaks, !!/??, runs,
    URLs, tags, whitespace).  The order is part of the result."""
    if emoji:
        c = demojize(c)
    for (pattern, repl), marks in zip(CLEAN_STEPS, CLEAN_MARKS, strict=True):
        if marks == []:
            c = F.regexp_replace(c, FAST[pattern], repl)
        elif marks:
            c = _once(c, _replaced(pattern, repl, marks))
    return F.trim(c)


def _replaced(pattern: str, repl: str, marks: list[str]):
    def step(c: Column) -> Column:
        found = reduce(or_, [c.contains(mark) for mark in marks])
        return F.when(found, F.regexp_replace(c, pattern, repl)).otherwise(c)
    return step


def tokens(c: Column) -> Column:
    """Lower-cased tokens; hyphenated CVE / SHA ids stay whole."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


# Security tokens that are plain words, and shapes, which all have a hyphen.
_KEEP_WORDS = [p for p in SECURITY_KEEP_PATTERN.split("|") if re.fullmatch(r"\w+", p)]
_KEEP_SHAPES = "|".join(p for p in SECURITY_KEEP_PATTERN.split("|") if not re.fullmatch(r"\w+", p))


def keep_token(t: Column, stopwords=STOPWORDS_EN) -> Column:
    """Security tokens are always kept; other tokens must be alphabetic, longer
    than two characters and not a stopword."""
    return ((~t.isin(list(stopwords)) & (F.length(t) > 2) & t.rlike(r"^\p{L}+$"))
            | t.isin(_KEEP_WORDS) | (t.contains("-") & t.rlike("^(" + _KEEP_SHAPES + ")$")))


def lemma(t: Column, pairs=LEMMA_PAIRS) -> Column:
    keys = [k for k, _ in pairs]
    mapping = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return F.when(t.isin(keys), F.element_at(mapping, t)).otherwise(t)


def lemmas(c: Column, stopwords=STOPWORDS_EN, pairs=LEMMA_PAIRS) -> Column:
    """Kept tokens mapped to their lemma; order and duplicates kept."""
    return lemmas_of_tokens(tokens(c), stopwords, pairs)


def lemmas_of_tokens(toks: Column, stopwords=STOPWORDS_EN, pairs=LEMMA_PAIRS) -> Column:
    return F.transform(F.filter(toks, lambda t: keep_token(t, stopwords)),
                       lambda t: lemma(t, pairs))


def remove_words(arr: Column, words: list[str]) -> Column:
    """Drop the given words from an array, keeping order and duplicates
    (unlike array_except)."""
    if not words:
        return arr
    return F.filter(arr, lambda x: ~x.isin(list(words)))


def join_words(arr: Column) -> Column:
    return F.array_join(arr, " ")


def guard_model_input(c: Column) -> Column:
    """Model-input guard: null for blank text (the caller substitutes the
    default label), else the whole text."""
    blank = ~F.coalesce(c, F.lit("")).rlike("[^" + WS + "]")
    return F.when(blank, F.lit(None).cast("string")).otherwise(c)


def sentiment_label(label: Column) -> Column:
    """Map a model label to positive / negative / neutral by substring."""
    low = F.lower(label)
    return (F.when(low.contains("positive"), "positive")
             .when(low.contains("negative"), "negative")
             .otherwise("neutral"))
