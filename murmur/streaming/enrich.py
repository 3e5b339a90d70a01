"""Structured Streaming: enrichment of newly landed comments (stateless) and
sentiment counts per day with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions import entities as E
from murmur.functions import text as TX
from murmur.operators import labels

LANDED_SCHEMA = T.StructType([
    T.StructField("comment_id", T.LongType()), T.StructField("author", T.StringType()),
    T.StructField("updated_at", T.TimestampType()), T.StructField("like_count", T.LongType()),
    T.StructField("text", T.StringType()), T.StructField("video_id", T.StringType()),
])


def read_landed(spark: SparkSession, path: str, schema: T.StructType = LANDED_SCHEMA,
                max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def enrich_stream(stream: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Row-wise enrichment (clean text, identifiers, keywords, labels); no
    state, so every micro-batch is independent."""
    df = stream.withColumn("clean_text", TX.clean_text(F.col("text")))
    df = E.with_keywords(labels.with_model_input(df, "clean_text"), lexicon)
    g, t, c = F.col("_g"), F.col("_t"), F.col("clean_text")
    p, e = labels.polarity(g, t), labels.emotion(g, t)
    return df.select(
        "*", p["sentiment"].alias("sentiment"), p["sentiment_score"].alias("sentiment_score"),
        e["emotion_label"].alias("emotion_label"), E.regex_entities(c).alias("regex_entities")).drop("_g", "_t")


def daily_sentiment(enriched: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Counts per (day, sentiment); the watermark bounds the state and lets a
    day's counts be emitted once rows older than ``lateness`` stop arriving."""
    return (enriched.withWatermark("updated_at", lateness)
                    .groupBy(F.window("updated_at", "1 day").alias("day"), "sentiment")
                    .agg(F.count(F.lit(1)).alias("n"))
                    .select(F.col("day.start").alias("day_start"), "sentiment", "n"))


def start(df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append", available_now: bool = False):
    """Parquet sink with its checkpoint in the shared checkpoint folder, so a
    restarted query resumes where it stopped."""
    w = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start(sink_path)
