"""Preprocessing stage: clean text, language, English filter, lemmas, corpus
word frequency, frequency stopwords and final tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import text as T
from murmur.functions.language import language_of_tokens
from murmur.sources.stages import stage


def clean(df: DataFrame, text_col: str = "text", emoji: bool = True) -> DataFrame:
    return df.withColumn("clean_text", T.clean_text(F.col(text_col), emoji=emoji))


def with_tokens(df: DataFrame, col: str = "clean_text") -> DataFrame:
    """Tokens computed once; language and lemmas both read this column (an
    expression used twice would otherwise be evaluated twice)."""
    return df if "_tokens" in df.columns else df.withColumn("_tokens", T.tokens(F.col(col)))


def with_language(df: DataFrame, col: str = "clean_text", keep_tokens: bool = False) -> DataFrame:
    df = with_tokens(df, col)
    df = (df.withColumn("language", language_of_tokens(F.col("_tokens")))
            .withColumn("is_english", F.col("language") == "en"))
    return df if keep_tokens else df.drop("_tokens")


def keep_where(df: DataFrame, cond) -> DataFrame:
    """Keep rows where ``cond`` holds, evaluated once, where it stands.

    A plain ``filter`` on a column computed by an expensive projection is
    pushed below that projection (and below a repartition), which evaluates
    the expression twice and before the rows are spread.  An inline generator
    over a one-element array is not moved by the optimizer.
    """
    flag = F.when(cond, F.array(F.struct(F.lit(True).alias("_keep"))))
    return df.select("*", F.inline(flag)).drop("_keep")


def english_only(df: DataFrame) -> DataFrame:
    return keep_where(df, F.col("language") == "en")


def with_lemmas(df: DataFrame, col: str = "clean_text") -> DataFrame:
    df = with_tokens(df, col)
    return (df.withColumn("lemmas", T.lemmas_of_tokens(F.col("_tokens")))
              .withColumn("lemma_text", T.join_words(F.col("lemmas")))
              .drop("_tokens"))


def prepare(df: DataFrame, text_col: str = "text") -> DataFrame:
    """clean -> language -> English only -> lemmas (all narrow, one stage)."""
    return with_lemmas(english_only(with_language(clean(df, text_col), keep_tokens=True)))


def word_frequency(df: DataFrame, col: str = "lemmas") -> DataFrame:
    """(word, frequency) over all lemma arrays; map-side partial counts keep
    the shuffle to one row per distinct word and partition.

    explode_outer + a null filter above it: with plain explode Spark infers
    ``size(lemmas) > 0`` and pushes it below the projection that computes the
    lemmas, computing them twice."""
    return (df.select(F.explode_outer(col).alias("word")).filter(F.col("word").isNotNull())
              .groupBy("word").agg(F.count(F.lit(1)).alias("frequency")))


def top_words(freq: DataFrame, n: int) -> DataFrame:
    """The n most frequent words with rank 1..n (ties by word).

    ``orderBy().limit()`` plans as TakeOrderedAndProject: every partition keeps
    its own n best, only those reach the final task.
    """
    top = freq.orderBy(F.col("frequency").desc(), F.col("word")).limit(n)
    w = Window.orderBy(F.col("frequency").desc(), F.col("word"))
    return top.withColumn("rank", F.row_number().over(w).cast("int"))


def rank_words(freq: DataFrame) -> DataFrame:
    """Rank 1..n over the whole vocabulary without a single-task window.

    A range-partitioned sort orders the words; each row's position inside its
    partition comes from monotonically_increasing_id, the sorted table is
    written (which fixes the positions), and per-partition
    offsets (one row per partition) are a running sum broadcast back.
    """
    ordered = (freq.orderBy(F.col("frequency").desc(), F.col("word"))
                   .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = stage(ordered, "ordered-words")
    part = F.shiftright(F.col("_mid"), 33)
    sizes = ordered.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))
    return (ordered.join(F.broadcast(offsets), part == offsets["_p"])
                   .select("word", "frequency",
                           (F.col("_off") + (F.col("_mid") - F.shiftleft(part, 33)) + 1)
                           .cast("int").alias("rank")))


def stopword_list(freq: DataFrame, n: int) -> list[str]:
    """The top-n words as a Python list (bounded by n, used as a literal)."""
    return [r["word"] for r in top_words(freq, n).select("word").collect()]


def with_final_tokens(df: DataFrame, stopwords: list[str], col: str = "lemmas") -> DataFrame:
    return (df.withColumn("final_tokens", T.remove_words(F.col(col), stopwords))
              .withColumn("final_text", T.join_words(F.col("final_tokens"))))


def preprocess(df: DataFrame, text_col: str = "text", top_n: int = 50):
    """Full preprocessing stage: returns (rows, word frequency, stopwords).  The
    prepared rows are written once; the counts and the final tokens read them."""
    rows = stage(prepare(df, text_col), "prepared")
    freq = word_frequency(rows)
    stop = stopword_list(freq, top_n)
    return with_final_tokens(rows, stop), freq, stop


def language_distribution(df: DataFrame, top: int = 10) -> DataFrame:
    return (df.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col("language")).limit(top))


def english_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(F.col("is_english").cast("long")).alias("english"),
                  F.sum((~F.col("is_english")).cast("long")).alias("non_english"))


def min_length_by_source(df: DataFrame, sources: list[str], min_len: int = 60,
                         source_col: str = "video_id", text_col: str = "text") -> DataFrame:
    """Per-source minimum length: only rows of the listed sources must be at
    least ``min_len`` characters long."""
    if not sources:
        return df
    return df.filter(~F.col(source_col).isin(sources) | (F.length(text_col) >= min_len))
