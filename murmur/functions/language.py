"""Language identification by function-word profiles (narrow, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions.text import tokens
from murmur.resources.words import LANGUAGE_PROFILES


def _hits(toks: Column, words: list[str]) -> Column:
    return F.size(F.filter(toks, lambda t: t.isin(words)))


def language_of(c: Column, profiles: dict[str, list[str]] = LANGUAGE_PROFILES) -> Column:
    """Language of a text column (tokenises it; prefer language_of_tokens on a
    token column computed once)."""
    return language_of_tokens(tokens(c), profiles)


def language_of_tokens(toks: Column, profiles: dict[str, list[str]] = LANGUAGE_PROFILES) -> Column:
    """Language whose profile words occur most often among the tokens; ties go
    to the alphabetically first language; no profile word -> ``unknown``.

    One hash-set lookup per token, and one per language for profile words only, inside the
    row: the work stays in the scan stage and never shuffles.
    """
    words = sorted({w for p in profiles.values() for w in p})
    best = F.transform(F.array(F.filter(toks, lambda t: t.isin(words))), lambda known: F.array_min(F.array(*[
        F.struct((-_hits(known, profiles[lang])).alias("neg"), F.lit(lang).alias("lang")) for lang in sorted(profiles)])))
    return F.transform(best, lambda b: F.when(F.coalesce(b["neg"], F.lit(0)) < 0, b["lang"]).otherwise(F.lit("unknown")))[0]
