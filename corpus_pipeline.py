"""From raw documents to training tokens, in stages that are each written as Parquet.

1. quality: documents that the quality classifier rejects go.
2. line_dedup: lines like a line before them go, and documents of which no word is left.
3. near_copies: of documents linked by common five-word shingles, the one with the least id stays.
4. decontaminate: documents with a passage of the benchmark go.
5. byte_bpe: token counts and digests of the documents that are left.

Every stage works on all that the one before kept.  Rows with equal ids are one document: they
stay or go together.  Null and empty texts have no words; what becomes of them is up to the
quality stage, and the others keep them.  An empty table passes through as one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import bpe, common, decontaminate, jaccard_join, line_dedup, quality
from murmur.sources import stages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

KNOWN = (200_000, 100_000)
"""Words and pieces that a worker of the token stage remembers, until its task ends: it stays alive beside other stages."""

_left_over: list[str] = []


def _step(make: Stage) -> Stage:
    """A stage that first deletes the intermediate tables of the stage before, whose result is written by now."""
    @wraps(make)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.prepare(spark)
        common.delete(spark, _left_over)
        with common.opened_tables() as tables:
            out = make(spark, docs, sf_dir)
        _left_over.extend(tables)
        return out

    return run_step


@_step
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from the labelled documents; scores come from the texts alone."""
    model = quality.train_on_labelled(docs, common.load(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, "text", "\x00score")
    return scored.filter(F.col("\x00score") >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


@_step
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text."""
    out = line_dedup.line_dedup(docs)
    some = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    columns["n_chars"] = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("bigint"))
    return out.filter(some).select(*[c.alias(name) for name, c in columns.items() if name in docs.columns])


@_step
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8 or more."""
    groups = jaccard_join.jaccard_join(docs)
    others = groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(common.small_side(common.stage(others, "near-copies")), "doc_id", "left_anti").select(*docs.columns)


@_step
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ten consecutive words of a benchmark text, or a whole shorter one, are enough."""
    found = decontaminate.find_matches(docs, common.load(spark, sf_dir, "benchmark"), to="\x00matches")
    return found.filter(F.size("\x00matches.spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


@_step
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return bpe.digests(docs, bpe.Vocabulary(spark, known=KNOWN), release=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode_tokens),
]

ORACLE_SQL = None
"""The classifier and the encoding can't be said in SQL; tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents."""
    docs = common.load(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stages.stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
