"""Answering a table of questions: route each question, run the operator of
its route set-wise, assemble evidence, evaluate and append to the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import evaluate, explore, retrieval, routing
from murmur.operators.metadata import MetadataCube

RETRIEVAL_K = {"rag_agent": 5, "summary_agent": 10}


def dispatch(routed: DataFrame, search, k_by_route=RETRIEVAL_K) -> DataFrame:
    """Evidence hits for the retrieval routes; ``search(questions, k)``
    returns hybrid hits (qid, comment_id, ..., hybrid_score, rank)."""
    parts = [search(routed.filter(F.col("route") == r).select("qid", "text"), k).withColumn("route", F.lit(r))
             for r, k in k_by_route.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tool_results(comments: DataFrame) -> DataFrame:
    """Answers of the non-retrieval routes, one row per route (broadcast)."""
    sent = explore.distribution(comments, "sentiment")
    topic = explore.distribution(comments, "topic_id", 10)

    def as_json(df, key):
        return df.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), "n"))))
                      .alias("tool_result"))
    return (as_json(sent, "sentiment").withColumn("route", F.lit("sentiment_agent"))
            .unionByName(as_json(topic, "topic_id").withColumn("route", F.lit("topic_agent"))))


def answer_log(questions: DataFrame, hits: DataFrame, answers: DataFrame | None = None,
               comments: DataFrame | None = None, text_of: DataFrame | None = None) -> DataFrame:
    """One evaluation record per question: route, confidence, retrieval
    quality, evidence, faithfulness and lengths of the supplied answer."""
    routed = questions.withColumn("route", routing.route(F.col("text")))
    rec = (routed.join(evaluate.confidence(routed, hits), "qid", "left")
                 .join(evaluate.retrieval_quality(routed, hits), "qid", "left"))
    ev = hits.groupBy("qid").agg(F.array_sort(F.collect_list(
        F.struct(F.col("rank").alias("source_no"), "comment_id", "hybrid_score"))).alias("evidence"))
    rec = rec.join(ev, "qid", "left")
    if answers is not None:
        rec = rec.join(answers.select("qid", "answer"), "qid", "left")
        if text_of is not None:
            src = (hits.select("qid", "comment_id", "rank").join(text_of, "comment_id").groupBy("qid")
                       .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))),
                                                     lambda x: x["text"]), " ").alias("_source")))
            rec = rec.join(src, "qid", "left")
            f = evaluate.faithfulness(F.col("answer"), F.col("_source"))
            rec = rec.withColumn("faithfulness_overlap", f["faithfulness_overlap"]) \
                     .withColumn("faithfulness_label", f["faithfulness_label"]).drop("_source")
        rec = rec.select("*", *evaluate.lengths(F.col("answer"), F.lit(None).cast("string"))[:2])
    if comments is not None:
        rec = rec.join(F.broadcast(tool_results(comments)), "route", "left")
    return rec


def append_log(log: DataFrame, path: str) -> None:
    """Append-only run log, partitioned by route."""
    log.write.mode("append").partitionBy("route").parquet(path)


def answer_questions(questions: DataFrame, search, cube: MetadataCube, generated: DataFrame | None = None,
                     k_by_route=RETRIEVAL_K) -> tuple[DataFrame, DataFrame]:
    """Answers of all routes and the evidence: ``(qid, text, route, answer)`` and the hits.

    Retrieval routes search, and their answer is the one in ``generated`` (qid, answer), which a model
    made; null without one.  The other routes are answered from the cube.
    """
    routed = questions.select("qid", "text", routing.route(F.col("text")).alias("route"))
    hits = dispatch(routed, search, k_by_route)
    told = cube.answers(routed)
    if generated is not None:
        wanted = routed.filter(F.col("route").isin(list(k_by_route))).select("qid")
        told = told.unionByName(generated.select("qid", "answer").join(wanted, "qid", "left_semi"))
    return routed.join(told, "qid", "left"), hits
