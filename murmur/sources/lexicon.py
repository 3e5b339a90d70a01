"""Lexicons: one term per line, trimmed, lower-cased, blanks dropped,
distinct.  A lexicon is a table of any size; the shipped one is package data."""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.resources.words import SECURITY_OBJECTS, SECURITY_PHRASE_HEADS


def shipped_terms() -> list[str]:
    """Our own security lexicon: the listed terms, and every phrase of an
    object and a head (``cloud breach``, ``email scam``, ...)."""
    listed = files("murmur.resources").joinpath("security_terms.txt").read_text(encoding="utf-8").splitlines()
    phrases = [f"{o} {h}" for o in SECURITY_OBJECTS for h in SECURITY_PHRASE_HEADS]
    return sorted({t.strip().lower() for t in [*listed, *phrases]} - {""})


def read_lexicon(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The lexicon at ``path``, or the shipped one."""
    if path is None:
        return spark.createDataFrame([(t,) for t in shipped_terms()], "term string")
    return (spark.read.text(path)
            .select(F.lower(F.trim(F.col("value"))).alias("term"))
            .filter(F.col("term") != "")
            .distinct())
