"""Exploration queries over the analysed-comment table: distributions,
facet filters, search, previews, time pivots and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTIMENTS = ["negative", "neutral", "positive"]


def distribution(df: DataFrame, col: str, top: int | None = None, name: str = "n") -> DataFrame:
    """Value counts with nulls dropped, most frequent first (ties by value);
    an absent column gives an empty frame."""
    if col not in df.columns:
        spark = df.sparkSession
        return spark.createDataFrame([], T.StructType([T.StructField(col, T.StringType()),
                                                       T.StructField(name, T.LongType())]))
    out = (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
             .orderBy(F.col(name).desc(), F.col(col)))
    return out.limit(top) if top else out


def equality_filter(df: DataFrame, **conds) -> DataFrame:
    """AND of ``col == value`` for every argument that is not None."""
    preds = [F.col(c) == F.lit(v) for c, v in conds.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def request_label(text) -> F.Column:
    """Sentiment named in a request: negative, else positive, else neutral."""
    low = F.lower(text)
    return (F.when(low.contains("negative"), "negative").when(low.contains("positive"), "positive")
             .when(low.contains("neutral"), "neutral"))


def request_counts(comments: DataFrame, requests: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Rows left after the filter each request names (all rows when it names
    none).  The per-sentiment counts are a handful of rows, broadcast."""
    per = comments.groupBy(F.col("sentiment").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = comments.agg(F.count(F.lit(1)).alias("n")).select(F.lit("__all__").alias("key"), "n")
    counts = F.broadcast(per.filter(F.col("key").isNotNull()).unionByName(total))
    req = requests.select(id_col, request_label(F.col(text_col)).alias("filter_label"))
    return (req.join(counts, F.coalesce(F.col("filter_label"), F.lit("__all__")) == counts["key"], "left")
               .select(id_col, "filter_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def facet_filter(df: DataFrame, sentiments=(), emotions=(), topics=(), videos=(), min_likes: int = 0) -> DataFrame:
    """Multi-select facets (empty = all), ANDed, plus minimum likes (null = 0)."""
    preds = []
    for col, values in (("sentiment", sentiments), ("emotion_label", emotions), ("topic_id", topics),
                        ("video_id", videos)):
        if values and col in df.columns:
            preds.append(F.col(col).isin(list(values)))
    if min_likes and "like_count" in df.columns:
        preds.append(F.coalesce(F.col("like_count"), F.lit(0)) >= min_likes)
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def facet_values(df: DataFrame, cols=("sentiment", "emotion_label", "topic_id", "video_id")) -> DataFrame:
    """(facet, value) of every distinct non-null value, as strings, in one pass."""
    pairs = [F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in cols if c in df.columns]
    rows = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.facet", "p.value")
    return rows.filter(F.col("value").isNotNull()).distinct()


def dashboard_counts(df: DataFrame, filtered: DataFrame) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    kept = filtered.agg(F.count(F.lit(1)).alias("filtered_rows"),
                        F.countDistinct("video_id").alias("videos"))
    # both sides are single-row aggregates, joined on a constant key
    key = F.lit(1)
    return (total.withColumn("_k", key).join(kept.withColumn("_k", key), "_k")
                 .drop("_k").withColumn("columns", F.lit(len(df.columns)).cast("bigint")))


def search(df: DataFrame, term: str, literal: bool = False, col: str = "text") -> DataFrame:
    """Case-insensitive search; regex by default, literal substring on request."""
    if literal:
        cond = F.lower(F.col(col)).contains(term.lower())
    else:
        cond = F.col(col).rlike("(?i)" + term)
    return df.filter(F.coalesce(cond, F.lit(False)))


def project_existing(df: DataFrame, wanted) -> DataFrame:
    return df.select([c for c in wanted if c in df.columns])


def preview(df: DataFrame, n: int = 100, order: str = "comment_id") -> DataFrame:
    return df.orderBy(order).limit(n)


def to_day(c: F.Column, dtype) -> F.Column:
    """Timestamp (or text that parses as one, else null) -> date."""
    if isinstance(dtype, T.StringType):
        return F.to_date(F.try_to_timestamp(c))
    return F.to_date(c)


def sentiment_over_time(df: DataFrame, ts: str = "updated_at", labels=SENTIMENTS) -> DataFrame:
    """Comment counts per day and sentiment, sentiments as columns, 0 when
    absent; rows whose time does not parse are dropped.  The columns are
    ``labels`` and whatever other labels the data has."""
    day = to_day(F.col(ts), df.schema[ts].dataType)
    rows = df.select(day.alias("date"), "sentiment").filter(F.col("date").isNotNull()
                                                           & F.col("sentiment").isNotNull())
    found = {r["sentiment"] for r in rows.select("sentiment").distinct().collect()}   # one row per column
    columns = [*labels, *sorted(found - set(labels))]
    return rows.groupBy("date").pivot("sentiment", columns).count().na.fill(0)


def corpus_summary(df: DataFrame, topic_top: int = 15) -> DataFrame:
    """Long table (section, key, value): row count, column list and the
    language / sentiment / topic (top n) / emotion distributions.

    Each row gives one (section, key) pair per distribution and one for the
    row count; one aggregation over one scan counts them all."""
    sections = {"language": "language", "sentiment": "sentiment", "topic_id": "topic", "emotion_label": "emotion"}
    pairs = [F.struct(F.lit("rows").alias("section"), F.lit("rows").alias("key"))]
    pairs += [F.struct(F.lit(name).alias("section"), F.col(c).cast("string").alias("key"))
              for c, name in sections.items() if c in df.columns]
    counted = (df.select(F.explode(F.array(*pairs)).alias("p")).select("p.section", "p.key")
               .filter(F.col("key").isNotNull()).groupBy("section", "key").agg(F.count(F.lit(1)).alias("value")))
    w = Window.partitionBy("section").orderBy(F.col("value").desc(), F.col("key").try_cast("int"), "key")
    counted = (counted.withColumn("_r", F.row_number().over(w))
                      .filter((F.col("section") != "topic") | (F.col("_r") <= topic_top)).drop("_r"))
    columns = df.sparkSession.createDataFrame([("columns", c, i + 1) for i, c in enumerate(df.columns)],
                                              "section string, key string, value long")
    return counted.unionByName(columns)
