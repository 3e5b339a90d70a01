"""The run log: one record for each answered question, with parameters, retrieval and answer metrics,
latency and evidence; and the statistics that are read from it.

The log is a Parquet table in folders by run and route.  Appending is keyed by (run, question): a
batch that is repeated, in part or whole, adds only the questions that the run doesn't hold yet.  One
writer a run is assumed; different runs may be written at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.operators import evaluate

PARAMETERS = {"dataset_path": None, "llm_model": None, "retrieval_strategy": "hybrid"}
KLL_K = 800
"""Size of a latency sketch: the rank of a quantile is off by 0.6 % at most, with 99 % confidence."""
RANK_ERROR = 0.006

SCHEMA = """qid long, question string, logged_on date, dataset_path string, llm_model string, retrieval_strategy string,
answer string, retrieval_count long, avg_retrieval_score double, max_retrieval_score double, min_retrieval_score double,
retrieval_quality string, confidence double, evidence_count long, faithfulness_overlap double, faithfulness_label string,
answer_length_chars long, answer_length_words long, context_length_chars long, context_length_words long,
generation_latency_sec double, total_latency_sec double,
evidence array<struct<source_no:int,comment_id:long,score:double>>, run_id string, route string"""


def _columns() -> list[str]:
    return [part.split()[0] for part in SCHEMA.replace("\n", " ").split(", ")]


def records(answered: DataFrame, hits: DataFrame | None = None, latency: DataFrame | None = None,
            day: Column | None = None, **parameters: str) -> DataFrame:
    """A record for each row of ``answered`` (qid, text, route, answer).

    ``hits`` (qid, comment_id, rank, text, scores) are the evidence, and make the context;
    ``latency`` (qid, total_latency_sec, generation_latency_sec if known) is what the caller measured.
    Questions without hits have no evidence and retrieval quality "poor"; unknown latency is null;
    rows without an id have no key and aren't logged.  Of rows with equal ids the first by text,
    route and answer counts.
    """
    w = Window.partitionBy("qid").orderBy("text", "route", "answer")
    rows = (answered.filter(F.col("qid").isNotNull()).select("qid", "text", "route", "answer")
            .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r"))
    if hits is None:
        hits = rows.sparkSession.createDataFrame([], "qid long, comment_id long, rank int, text string, hybrid_score double")
    score = evaluate.retrieval_score(hits)
    place = F.struct(F.col("rank").cast("int").alias("source_no"), F.col("comment_id").cast("bigint").alias("comment_id"),
                     score.alias("score"))
    found = hits.groupBy("qid").agg(
        F.array_sort(F.collect_list(place)).alias("evidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]), " ").alias("_source"))
    rows = (rows.join(evaluate.retrieval_quality(rows, hits), "qid").join(evaluate.confidence(rows, hits), "qid")
            .join(found, "qid", "left").join(evaluate.evidence_context(hits), "qid", "left"))
    if latency is not None:
        rows = rows.join(latency, "qid", "left")
    for name in ("generation_latency_sec", "total_latency_sec"):
        rows = rows.withColumn(name, F.col(name).try_cast("double") if name in rows.columns else F.lit(None).cast("double"))
    supported = evaluate.faithfulness(F.col("answer"), F.col("_source"))
    given = PARAMETERS | parameters
    rows = rows.select(
        "*", F.col("text").alias("question"), (F.current_date() if day is None else day).alias("logged_on"),
        *[F.lit(given[p]).cast("string").alias(p) for p in PARAMETERS],
        supported["faithfulness_overlap"].alias("faithfulness_overlap"),
        supported["faithfulness_label"].alias("faithfulness_label"),
        F.coalesce(F.size("evidence"), F.lit(0)).cast("bigint").alias("evidence_count"),
        *evaluate.lengths(F.col("answer"), F.col("context")), F.lit(None).cast("string").alias("run_id"))
    return rows.select(*_columns())


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log; a missing one reads as empty."""
    return spark.read.schema(SCHEMA).parquet(path) if _exists(spark, path) else spark.createDataFrame([], SCHEMA)


def append(spark: SparkSession, new: DataFrame, path: str, run_id: str) -> None:
    """Add the records of the questions that the run doesn't hold yet (only the run's own folder is read)."""
    held = read(spark, path).filter(F.col("run_id") == run_id).select("qid")
    missing = new.withColumn("run_id", F.lit(run_id)).join(held, "qid", "left_anti").select(*_columns())
    missing.write.mode("append").partitionBy("run_id", "route").parquet(path)


def route_distribution(log: DataFrame) -> DataFrame:
    """(route, n), most frequent first."""
    return log.groupBy("route").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "route")


def latency_sketches(log: DataFrame, k: int = KLL_K) -> DataFrame:
    """(run_id, route, logged_on, n, least, largest, sum, sketch): a row for each day of a route and run.

    The sketches merge, so quantiles of any routes and days need these rows and not the log.
    """
    known = log.filter(F.col("total_latency_sec").isNotNull() & ~F.isnan("total_latency_sec"))
    seconds = F.col("total_latency_sec")
    return known.groupBy("run_id", "route", "logged_on").agg(
        F.count(F.lit(1)).alias("n"), F.min(seconds).alias("least"), F.max(seconds).alias("largest"),
        F.sum(seconds).alias("sum"), F.kll_sketch_agg_double(seconds, k).alias("sketch"))


def latency_quantiles(sketches: DataFrame, by=("route",), shares=(0.5, 0.95, 0.99)) -> DataFrame:
    """Latency for each value of ``by``: count, mean, extremes and a column pNN for each share, merged from sketches.

    Up to ``KLL_K`` latencies a quantile is exact (the least value with a share of all at or below it);
    above, its rank is off by ``RANK_ERROR`` at most, with 99 % confidence.
    """
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("least").alias("least"),
                                       F.max("largest").alias("largest"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(
        *by, "n", F.round(F.col("sum") / F.col("n"), 6).alias("avg_latency_sec"), F.col("least").alias("min_latency_sec"),
        F.col("largest").alias("max_latency_sec"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(f"p{round(100 * s)}") for s in shares])
