"""Evidence assembly and answer evaluation, set-wise over question tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import WS

STRIP_CHARS = ".,:;!?()[]{}\"'"
MIN_SCORE = 0.3          # retrieval quality: avg >= 0.3 is good
SUPPORTED = 0.25         # faithfulness: overlap >= 0.25 is supported


def retrieval_score(df: DataFrame) -> Column:
    """hybrid, else semantic, else lexical, else 0.0 (absent columns skipped)."""
    cols = [F.col(c).try_cast("double") for c in ("hybrid_score", "semantic_score", "lexical_score")
            if c in df.columns]
    return F.coalesce(*cols, F.lit(0.0))


def confidence_score(df: DataFrame) -> Column:
    """hybrid, else semantic, else 0.0 (no lexical fallback)."""
    cols = [F.col(c).try_cast("double") for c in ("hybrid_score", "semantic_score") if c in df.columns]
    return F.coalesce(*cols, F.lit(0.0))


def retrieval_quality(questions: DataFrame, hits: DataFrame, qid: str = "qid",
                      min_score: float = MIN_SCORE) -> DataFrame:
    """Per question: count, avg / max / min score (3 decimals) and a label from
    the unrounded average; questions without hits are 'poor' with zeros."""
    agg = (hits.select(qid, retrieval_score(hits).alias("_s")).groupBy(qid)
               .agg(F.count(F.lit(1)).alias("retrieval_count"), F.avg("_s").alias("_avg"),
                    F.max("_s").alias("_max"), F.min("_s").alias("_min")))
    out = questions.select(qid).join(agg, qid, "left")
    return out.select(
        qid,
        F.coalesce("retrieval_count", F.lit(0)).cast("bigint").alias("retrieval_count"),
        F.coalesce(F.round("_avg", 3), F.lit(0.0)).alias("avg_retrieval_score"),
        F.coalesce(F.round("_max", 3), F.lit(0.0)).alias("max_retrieval_score"),
        F.coalesce(F.round("_min", 3), F.lit(0.0)).alias("min_retrieval_score"),
        F.when(F.col("retrieval_count").isNull(), "poor")
         .when(F.col("_avg") >= min_score, "good").otherwise("weak").alias("retrieval_quality"))


def confidence(questions: DataFrame, hits: DataFrame, qid: str = "qid") -> DataFrame:
    agg = (hits.select(qid, confidence_score(hits).alias("_s")).groupBy(qid)
               .agg(F.round(F.avg("_s"), 3).alias("confidence")))
    return questions.select(qid).join(agg, qid, "left").select(
        qid, F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def _field(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("unknown"))


def context_block(rank: str = "rank") -> Column:
    """One numbered evidence block (9 labelled fields, missing -> unknown)."""
    score = F.format_string("%.6f", F.col("hybrid_score"))
    return F.concat(
        F.lit("\nSource "), F.col(rank).cast("string"),
        F.lit("\nComment: "), _field("text"),
        F.lit("\nProcessed text: "), _field("processed_text"),
        F.lit("\nSentiment: "), _field("sentiment"),
        F.lit("\nEmotion: "), _field("emotion_label"),
        F.lit("\nTopic ID: "), _field("topic_id"),
        F.lit("\nVideo ID: "), _field("video_id"),
        F.lit("\nAuthor: "), _field("author"),
        F.lit("\nLike count: "), _field("like_count"),
        F.lit("\nRetrieval score: "), F.coalesce(score, F.lit("unknown")),
        F.lit("\n"))


def evidence_context(hits: DataFrame, qid: str = "qid", rank: str = "rank") -> DataFrame:
    """Per question, the blocks in rank order joined by a newline.  The hits
    are k rows per question, so one task per question group stays small."""
    for c in ("text", "processed_text", "sentiment", "emotion_label", "topic_id", "video_id", "author",
              "like_count", "hybrid_score"):
        if c not in hits.columns:          # absent metadata reads as unknown
            hits = hits.withColumn(c, F.lit(None).cast("string" if c != "hybrid_score" else "double"))
    blocks = hits.select(qid, F.struct(F.col(rank).alias("r"), context_block(rank).alias("b")).alias("rb"))
    return (blocks.groupBy(qid).agg(F.array_sort(F.collect_list("rb")).alias("_l"))
                  .select(qid, F.array_join(F.transform("_l", lambda x: x["b"]), "\n").alias("context")))


def terms(c: Column) -> Column:
    """Distinct lower-cased words longer than 3 characters after stripping
    punctuation from both ends."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[" + WS + "]+")
    stripped = F.transform(words, lambda w: F.btrim(w, F.lit(STRIP_CHARS)))
    return F.array_distinct(F.filter(stripped, lambda w: F.length(w) > 3))


def faithfulness(answer: Column, source: Column) -> Column:
    """struct(faithfulness_overlap, faithfulness_label): share of the answer's
    terms found in the source text."""
    a = terms(answer)
    s = terms(source)
    ratio = F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, s)) / F.size(a))
    return F.struct(F.round(ratio, 3).alias("faithfulness_overlap"),
                    F.when(ratio >= SUPPORTED, "supported").otherwise("weakly_supported")
                     .alias("faithfulness_label"))


def word_count(c: Column) -> Column:
    words = F.split(F.coalesce(c, F.lit("")), "[" + WS + "]+")
    return F.size(F.filter(words, lambda w: w != "")).cast("bigint")


def lengths(answer: Column, context: Column) -> list[Column]:
    return [F.length(F.coalesce(answer, F.lit(""))).cast("bigint").alias("answer_length_chars"),
            word_count(answer).alias("answer_length_words"),
            F.length(F.coalesce(context, F.lit(""))).cast("bigint").alias("context_length_chars"),
            word_count(context).alias("context_length_words")]
