"""Topic modelling: k-means clusters over document vectors, size-ordered
topic ids with small clusters as outliers (-1), class-based TF-IDF topic
words, and per-sentiment topic models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.sources.stages import stage


def topic_count(n: int, min_topic_size: int = 10) -> int:
    """Topics for n documents: one for each ``min_topic_size`` squared, at least two, growing with the root of n."""
    return max(2, round((n / (2 * min_topic_size)) ** 0.5))


def cluster(df: DataFrame, vec_col: str = "embedding", k: int | None = None, seed: int = 42,
            min_topic_size: int = 10, id_col: str = "doc_id", out: str = "topic_id",
            model_path: str | None = None, far: float = 3.0) -> DataFrame:
    """Fit k-means (distributed, fixed seed) and label each row with its
    topic: clusters are renumbered by size (0 = largest, ties by cluster id).
    Outliers are -1: rows of clusters below ``min_topic_size``, and rows whose
    distance from the centre is more than ``far`` standard deviations above the
    cluster's mean.  Without ``k`` the number of topics follows the data
    (``topic_count``).  ``model_path`` saves the fitted model."""
    feats = stage(df, "topic-vectors").withColumn("_v", array_to_vector(F.col(vec_col)))
    k = k or topic_count(feats.count(), min_topic_size)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c", maxIter=30).fit(feats)
    if model_path:
        model.write().overwrite().save(model_path)
    centres = [c.tolist() for c in model.clusterCenters()]          # k rows
    centre = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.col("_c") + 1)
    if len(centres) * len(centres[0]) > 2000:                       # too many for literals: a small table
        table = df.sparkSession.createDataFrame(list(enumerate(centres)), "_c int, _m array<double>")
        assigned = model.transform(feats).join(F.broadcast(table), "_c")
    else:
        assigned = model.transform(feats).withColumn("_m", centre)
    gap = F.aggregate(F.zip_with(F.col(vec_col), F.col("_m"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    assigned = assigned.withColumn("_d", F.sqrt(gap)).drop("_v", "_m")
    sizes = assigned.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"), F.avg("_d").alias("_mean"),
                                       F.coalesce(F.stddev_pop("_d"), F.lit(0.0)).alias("_sd"))
    # at most k rows: one small task orders them
    order = Window.orderBy(F.col("_n").desc(), F.col("_c"))
    relabel = (sizes.filter(F.col("_n") >= min_topic_size)
                    .withColumn(out, (F.row_number().over(order) - 1).cast("int")).select("_c", out, "_mean", "_sd"))
    near = F.col("_d") <= F.col("_mean") + far * F.col("_sd") + 1e-9
    return (assigned.join(F.broadcast(relabel), "_c", "left")
                    .withColumn(out, F.when(near, F.coalesce(F.col(out), F.lit(-1))).otherwise(-1))
                    .drop("_c", "_d", "_mean", "_sd"))


def topic_info(assigned: DataFrame, topic_col: str = "topic_id") -> DataFrame:
    return (assigned.groupBy(topic_col).agg(F.count(F.lit(1)).alias("count"))
                    .orderBy(topic_col))


def topic_details(assigned: DataFrame, words: DataFrame, topic_col: str = "topic_id", id_col: str = "doc_id",
                  vec_col: str = "embedding", text_col: str = "text", n_docs: int = 3) -> DataFrame:
    """Topic info with name (``id_word1_word2_word3_word4``), top words and
    the documents nearest to the topic centroid (top n by inner product)."""
    sums = assigned.groupBy(topic_col).agg(F.count(F.lit(1)).alias("count"))
    centroid = (assigned.select(topic_col, array_to_vector(vec_col).alias("_x"))
                        .groupBy(topic_col).agg(vector_to_array(Summarizer.mean(F.col("_x"))).alias("_centroid")))
    near = (assigned.join(F.broadcast(centroid), topic_col)
                    .withColumn("_s", F.aggregate(F.zip_with(vec_col, "_centroid", lambda a, b: a * b),
                                                  F.lit(0.0), lambda acc, x: acc + x)))
    w = Window.partitionBy(topic_col).orderBy(F.col("_s").desc(), F.col(id_col))
    reps = (near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_docs)
                .groupBy(topic_col).agg(F.array_sort(F.collect_list(F.struct("_r", text_col))).alias("_d"))
                .select(topic_col, F.transform("_d", lambda x: x[text_col]).alias("representative_docs")))
    top = (words.groupBy(topic_col).agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_w"))
                .select(topic_col, F.transform("_w", lambda x: x["word"]).alias("representation")))
    name = F.concat_ws("_", F.col(topic_col).cast("string"), F.slice("representation", 1, 4))
    return (sums.join(top, topic_col, "left").join(reps, topic_col, "left")
                .withColumn("name", name))


def ctfidf_words(tokens: DataFrame, topic_col: str = "topic_id", token_col: str = "tokens",
                 top_n: int = 10) -> DataFrame:
    """Class-based TF-IDF: W(t, c) = tf(t, c) * ln(1 + A / f(t)), A = mean
    words per class, f(t) = frequency of t over all classes; top n words
    per topic (ties by word), weights at 6 decimals."""
    words = (tokens.select(topic_col, F.explode_outer(token_col).alias("word"))
                   .filter(F.col("word").isNotNull()))
    tf = words.groupBy(topic_col, "word").agg(F.count(F.lit(1)).alias("tf"))
    ft = tf.groupBy("word").agg(F.sum("tf").alias("ft"))
    per_class = tf.groupBy(topic_col).agg(F.sum("tf").alias("_words"))
    avg_words = per_class.agg(F.avg("_words").alias("A"))
    scored = (tf.join(ft, "word")
                .join(F.broadcast(avg_words.withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k"))
                .select(topic_col, "word",
                        F.round(F.col("tf") * F.log(F.lit(1.0) + F.col("A") / F.col("ft")), 6).alias("weight")))
    w = Window.partitionBy(topic_col).orderBy(F.col("weight").desc(), F.col("word"))
    return (scored.withColumn("rank", F.row_number().over(w).cast("int"))
                  .filter(F.col("rank") <= top_n))


def per_group_topics(df: DataFrame, group_col: str = "sentiment", min_topic_size: int = 5,
                     k: int | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """One topic model per non-null group value (each a distributed fit);
    groups smaller than ``min_topic_size`` are skipped.  The group values
    are a handful of labels, so they are listed on the driver."""
    sizes = df.filter(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    groups = [r[group_col] for r in sizes.filter(F.col("n") >= min_topic_size).orderBy(group_col).collect()]
    rows, infos = [], []
    for g in groups:
        sub = df.filter(F.col(group_col) == g)
        assigned = cluster(sub, min_topic_size=min_topic_size, out="sentiment_topic_id", k=k, **kw)
        rows.append(assigned)
        infos.append(topic_info(assigned, "sentiment_topic_id").withColumn(group_col, F.lit(g)))
    if not rows:
        spark = df.sparkSession
        empty = spark.createDataFrame([], T.StructType([T.StructField("sentiment_topic_id", T.IntegerType()),
                                                        T.StructField("count", T.LongType()),
                                                        T.StructField(group_col, T.StringType())]))
        return df.limit(0).withColumn("sentiment_topic_id", F.lit(-1)), empty
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows),
            reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), infos))
