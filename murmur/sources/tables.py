"""Readers for the Parquet tables and the fixture views built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def comments(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """The analysed-comment table the explore / agent operators read.

    Built from the driver tables: documents give text and video (``source``),
    events give author, time and likes, labels give sentiment, embeddings give
    the topic.  Only the needed columns are read from each table.  ``only`` (comment_id) limits
    the comments before the joins: a small written table is sent to the tables, which then don't move.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("label"))
    if only is not None:
        ids = only.select(F.col("comment_id").alias("_only")).distinct()
        d, e = d.join(ids, d.doc_id == ids._only, "left_semi"), e.join(ids, e.event_id == ids._only * 5, "left_semi")
        lab, m = lab.join(ids, lab.doc_id == ids._only, "left_semi"), m.join(ids, m.vec_id == ids._only, "left_semi")
    joined = (d.join(e, e.event_id == d.doc_id * 5, "left")
               .join(lab, "doc_id", "left")
               .join(m, m.vec_id == d.doc_id, "left"))
    return joined.select(
        F.col("doc_id").alias("comment_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
        F.col("ts").alias("updated_at"),
        F.floor("value").cast("bigint").alias("like_count"),
        F.col("text"),
        F.col("source").alias("video_id"),
        F.col("lang").alias("language"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
         .when(F.col("quality") == 0, "neutral").alias("sentiment"),
        F.when(F.col("event_type") == "error", "anger").when(F.col("event_type") == "purchase", "joy")
         .when(F.col("event_type") == "signup", "optimism").otherwise("sadness").alias("emotion_label"),
        F.coalesce(F.col("label"), F.lit(-1)).alias("topic_id"),
    )


COMMENTS_SQL = """
select d.doc_id as comment_id, concat('user', cast(e.user_id as varchar)) as author,
       e.ts as updated_at, cast(floor(e.value) as bigint) as like_count,
       d.text, d.source as video_id, d.lang as language,
       case when l.toxic = 1 then 'negative' when l.quality = 1 then 'positive'
            when l.quality = 0 then 'neutral' end as sentiment,
       case e.event_type when 'error' then 'anger' when 'purchase' then 'joy'
            when 'signup' then 'optimism' else 'sadness' end as emotion_label,
       coalesce(m.label, -1) as topic_id
from documents d
left join events e on e.event_id = d.doc_id * 5
left join labels l on l.doc_id = d.doc_id
left join embeddings m on m.vec_id = d.doc_id
"""


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread CPU-heavy rows over all cores when the scan gives fewer
    partitions than the cluster has task slots (one big file, one row group).

    On a large input the scan already has many splits and nothing happens, so
    no extra shuffle is paid there.  Hashing on ``key`` lets a later join or
    aggregation on the same key reuse the layout.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, key) if key else df.repartition(slots)
