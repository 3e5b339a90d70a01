"""Queries on answered questions: metadata answers from the cube, the run log and what is read from it.

The questions of the given tables name no route words and no filters, so each gets a tag made of its
own key, the same in Spark and SQL (see ``tagged``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import routing
from murmur.operators.metadata import EVALUATION_ANSWER, MetadataCube
from murmur.plans import ask, runlog
from murmur.plans import oracle as O
from murmur.plans.catalog import _C, hybrid, questions, register, text_index, user_questions
from murmur.plans.tagged import _TQ, ROUTE_TAGS, tag_sql, with_tag
from murmur.sources import stages
from murmur.sources.tables import comments, table

ASK_TAGS = ["", "please evaluate it", "give me a summary", "how many likes", "what do they feel", "which themes",
            "how many negative ones", "count of topic 3 ones", "number of Positive ones in video src2",
            "how many in the video about it", "count of NEUTRAL ones of topic #07 in Video src11",
            "how many in video src5 on topic 999"]


def asked(spark, sf_dir) -> DataFrame:
    """(qid, text): the users' turns, tagged."""
    q = user_questions(spark, sf_dir).withColumn("_k", F.col("conv_id") + F.col("turn") / 2)
    q = with_tag(q.withColumn("_k", F.col("_k").cast("bigint")), "_k", ASK_TAGS)
    return q.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")


def _routes_sql(questions: str) -> str:
    """CTE rt (qid, text, route); the patterns are those written out in ``tagged``."""
    case = _TQ[_TQ.index("CASE WHEN regexp_matches"):_TQ.index(" AS route FROM uq")]
    return f"rt AS (SELECT qid, text, {case} AS route FROM {questions})"


_ASKED = f"""(SELECT conv_id * 1000 + turn AS qid,
    concat(text, ' ', {tag_sql("conv_id + turn // 2", ASK_TAGS)}) AS text FROM conversations WHERE role = 'user')"""

# filters by plain counting of all comments for each different filter; told: (qid, answer)
_TOLD = f"""fl AS (SELECT qid,
    CASE WHEN contains(lower(text), 'negative') THEN 'negative' WHEN contains(lower(text), 'positive') THEN 'positive'
         WHEN contains(lower(text), 'neutral') THEN 'neutral' END AS s,
    TRY_CAST(nullif(regexp_extract(lower(text), '\\btopic\\s*#?\\s*(-?[0-9]+)', 1), '') AS BIGINT) AS t,
    (SELECT min(source) FROM documents WHERE source = regexp_extract(rt.text, '(?i)\\bvideo\\s+([\\w-]+)', 1)) AS v
    FROM rt WHERE route = 'metadata_agent'),
df AS (SELECT DISTINCT s, t, v FROM fl),
nf AS (SELECT s, t, v, (SELECT count(*) FROM c WHERE (df.s IS NULL OR c.sentiment = df.s) AND (df.t IS NULL OR c.topic_id = df.t)
                        AND (df.v IS NULL OR c.video_id = df.v)) AS n FROM df),
ds AS (SELECT 'Sentiment distribution: {{' || string_agg('''' || sentiment || ''': ' || n, ', ' ORDER BY n DESC, sentiment) || '}}' AS answer
       FROM (SELECT sentiment, count(*) AS n FROM c WHERE sentiment IS NOT NULL GROUP BY sentiment)),
dt AS (SELECT 'Top topic clusters: {{' || string_agg(topic_id || ': ' || n, ', ' ORDER BY n DESC, topic_id) || '}}' AS answer
       FROM (SELECT topic_id, count(*) AS n FROM c GROUP BY topic_id ORDER BY n DESC, topic_id LIMIT 10)),
told AS (SELECT qid, 'Filtered rows: ' || n AS answer FROM fl JOIN nf ON fl.s IS NOT DISTINCT FROM nf.s
             AND fl.t IS NOT DISTINCT FROM nf.t AND fl.v IS NOT DISTINCT FROM nf.v
         UNION ALL SELECT qid, answer FROM rt, ds WHERE route = 'sentiment_agent'
         UNION ALL SELECT qid, answer FROM rt, dt WHERE route = 'topic_agent'
         UNION ALL SELECT qid, {O.q(EVALUATION_ANSWER)} FROM rt WHERE route = 'evaluation_agent')"""


@register("metadata_cube", f"""{_C}
SELECT sentiment, CAST(topic_id AS VARCHAR) AS topic_id, video_id, count(*) AS n FROM c
GROUP BY CUBE (sentiment, topic_id, video_id)
HAVING (grouping(sentiment) = 1 OR sentiment IS NOT NULL) AND (grouping(video_id) = 1 OR video_id IS NOT NULL)""")
def q_metadata_cube(spark, sf_dir):
    return MetadataCube.build(comments(spark, sf_dir)).cells.select("sentiment", "topic_id", "video_id", "n")


@register("metadata_filtered_rows", f"""{_C}, {_routes_sql(_ASKED)}, {_TOLD}
SELECT fl.qid, fl.s AS sentiment, CAST(fl.t AS VARCHAR) AS topic_id, fl.v AS video_id, nf.n
FROM fl JOIN nf ON fl.s IS NOT DISTINCT FROM nf.s AND fl.t IS NOT DISTINCT FROM nf.t AND fl.v IS NOT DISTINCT FROM nf.v""")
def q_metadata_filtered_rows(spark, sf_dir):
    """The filters that each metadata question names, and the comments that they leave."""
    asks = asked(spark, sf_dir).filter(routing.route(F.col("text")) == "metadata_agent")
    return MetadataCube.build(comments(spark, sf_dir)).filtered_rows(asks)


def _tool_answers(spark, sf_dir) -> DataFrame:
    routed = asked(spark, sf_dir).withColumn("route", routing.route(F.col("text")))
    cube = MetadataCube.build(comments(spark, sf_dir))
    return routed.join(cube.answers(routed), "qid", "left").select("qid", "text", "route", "answer")


@register("agent_answers_tagged", f"""{_C}, {_routes_sql(_ASKED)}, {_TOLD}
SELECT rt.qid, route, answer FROM rt LEFT JOIN told USING (qid)""")
def q_agent_answers_tagged(spark, sf_dir):
    """Answers of the routes without retrieval, for all users' turns; the others have none here (see ``qa_log``)."""
    return _tool_answers(spark, sf_dir).select("qid", "route", "answer")


# --- the run log ------------------------------------------------------------------------

def tool_log(spark, sf_dir) -> DataFrame:
    """A log of all users' turns, appended in two batches that overlap; the latency is an event's value."""
    ev = table(spark, sf_dir, "events").select((F.floor(F.col("event_id") / 8) * 1000 + F.col("event_id") % 8).alias("qid"),
                                               F.col("value").alias("total_latency_sec"), F.to_date("ts").alias("asked_on"))
    made = runlog.records(_tool_answers(spark, sf_dir), latency=ev, day=F.col("asked_on"), dataset_path="documents")
    made = stages.stage(made, "run-log-batch")
    path = stages.stage_path(spark, "run_log")
    runlog.append(spark, made.filter(F.col("qid") % 3 == 0), path, "first")
    runlog.append(spark, made, path, "first")
    runlog.append(spark, made, path, "first")
    return runlog.read(spark, path)


_LOG = f"""{_C}, {_routes_sql(_ASKED)}, {_TOLD},
lg AS (SELECT rt.qid, rt.route, told.answer, e.value AS total_latency_sec, CAST(e.ts AS DATE) AS logged_on
       FROM rt LEFT JOIN told USING (qid) LEFT JOIN events e ON e.event_id = (rt.qid // 1000) * 8 + rt.qid % 1000)"""


@register("run_log", f"""{_LOG}
SELECT 'first' AS run_id, qid, route, logged_on, 'documents' AS dataset_path, 'hybrid' AS retrieval_strategy, answer,
       length(coalesce(answer, '')) AS answer_length_chars, {O.word_count("answer")} AS answer_length_words,
       'poor' AS retrieval_quality, 0.0 AS confidence, CAST(0 AS BIGINT) AS evidence_count, total_latency_sec FROM lg""")
def q_run_log(spark, sf_dir):
    return tool_log(spark, sf_dir).select(
        "run_id", "qid", "route", "logged_on", "dataset_path", "retrieval_strategy", "answer", "answer_length_chars",
        "answer_length_words", "retrieval_quality", "confidence", "evidence_count", "total_latency_sec")


@register("log_route_distribution", f"{_LOG} SELECT route, count(*) AS n FROM lg GROUP BY route ORDER BY n DESC, route")
def q_log_route_distribution(spark, sf_dir):
    return runlog.route_distribution(tool_log(spark, sf_dir))


@register("log_latency_quantiles", f"""{_LOG}
SELECT route, count(*) AS n, round(avg(total_latency_sec), 6) AS avg_latency_sec, min(total_latency_sec) AS min_latency_sec,
       max(total_latency_sec) AS max_latency_sec, quantile_disc(total_latency_sec, 0.5) AS p50,
       quantile_disc(total_latency_sec, 0.95) AS p95, quantile_disc(total_latency_sec, 0.99) AS p99
FROM lg WHERE total_latency_sec IS NOT NULL GROUP BY route""")
def q_log_latency_quantiles(spark, sf_dir):
    """From written sketches of route and day.  The SQL is exact, as the sketches are up to KLL_K latencies a route
    (larger tables are off by RANK_ERROR; tests hold that bound)."""
    return runlog.latency_quantiles(stages.stage(runlog.latency_sketches(tool_log(spark, sf_dir)), "latency-sketches"))


_BENCH = f"""(SELECT item_id AS qid, concat(text, ' ', {tag_sql("item_id", ROUTE_TAGS)}) AS text FROM benchmark)"""


def _qa_sql() -> str:
    hits = []
    for r, k in ask.RETRIEVAL_K.items():
        qs = f"(SELECT qid, text FROM rt WHERE route = '{r}')"
        vq = f"(SELECT q.qid, e.embedding FROM {qs} q JOIN embeddings e ON e.vec_id = q.qid)"
        hits.append(f"SELECT qid, comment_id, rank, hybrid_score FROM ({O.hybrid_sql(k, 0.7, questions=qs, vquestions=vq)})")
    unknown = "".join(f" || chr(10) || '{name}: unknown'" for name in
                      ("Processed text", "Sentiment", "Emotion", "Topic ID", "Video ID", "Author", "Like count"))
    block = (f"chr(10) || 'Source ' || rank || chr(10) || 'Comment: ' || text{unknown} || chr(10) || 'Retrieval score: ' || "
             "printf('%.6f', hybrid_score) || chr(10)")
    overlap, label = O.faithfulness("answer", "source")
    return f"""{_C}, {_routes_sql(_BENCH)}, {_TOLD},
h AS ({" UNION ALL ".join(hits)}),
ht AS (SELECT h.*, coalesce(d.text, 'unknown') AS text FROM h JOIN documents d ON d.doc_id = h.comment_id),
ag AS (SELECT qid, count(*) AS n, avg(hybrid_score) AS av, max(hybrid_score) AS mx, min(hybrid_score) AS mn,
              string_agg({block}, chr(10) ORDER BY rank) AS context, string_agg(text, ' ' ORDER BY rank) AS source,
              string_agg(rank || ':' || comment_id, ' ' ORDER BY rank) AS evidence FROM ht GROUP BY qid),
re AS (SELECT conv_id AS qid, arg_min(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
an AS (SELECT rt.qid, rt.route, CASE WHEN route IN ('rag_agent', 'summary_agent') THEN re.answer ELSE told.answer END AS answer
       FROM rt LEFT JOIN told USING (qid) LEFT JOIN re USING (qid)),
al AS (SELECT an.qid, an.route, an.answer, ag.* EXCLUDE (qid), e.value AS total_latency_sec
       FROM an LEFT JOIN ag ON ag.qid = an.qid LEFT JOIN events e ON e.event_id = an.qid)
SELECT 'bench' AS run_id, qid, route, 'documents' AS dataset_path, 'hybrid' AS retrieval_strategy, answer,
       coalesce(n, 0) AS retrieval_count, coalesce(round(av, 3), 0.0) AS avg_retrieval_score,
       coalesce(round(mx, 3), 0.0) AS max_retrieval_score, coalesce(round(mn, 3), 0.0) AS min_retrieval_score,
       CASE WHEN n IS NULL THEN 'poor' WHEN av >= 0.3 THEN 'good' ELSE 'weak' END AS retrieval_quality,
       coalesce(round(av, 3), 0.0) AS confidence, coalesce(n, 0) AS evidence_count, evidence,
       {overlap} AS faithfulness_overlap, {label} AS faithfulness_label,
       length(coalesce(answer, '')) AS answer_length_chars, {O.word_count("answer")} AS answer_length_words,
       length(coalesce(context, '')) AS context_length_chars, {O.word_count("context")} AS context_length_words,
       total_latency_sec FROM al"""


@register("qa_log", _qa_sql())
def q_qa_log(spark, sf_dir):
    """The log of the tagged benchmark questions, over all six routes: answers of the retrieval routes are the first
    reply of the conversation with the same id, where there is one."""
    qs = with_tag(questions(spark, sf_dir), "qid", ROUTE_TAGS)
    index = text_index(spark, sf_dir)            # one index for all routes
    replies = (table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
               .groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("answer")))
    answered, hits = ask.answer_questions(qs, lambda q, k: hybrid(spark, sf_dir, k, 0.7, qs=q, index=index),
                                          MetadataCube.build(comments(spark, sf_dir)), replies)
    hits = stages.stage(hits.select("qid", "comment_id", "rank", "text", "hybrid_score"), "log-hits")
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("qid"), F.col("value").alias("total_latency_sec"))
    path = stages.stage_path(spark, "qa_log")
    runlog.append(spark, runlog.records(answered, hits, ev, dataset_path="documents"), path, "bench")
    shown = F.array_join(F.transform("evidence", lambda e: F.concat(e["source_no"].cast("string"), F.lit(":"),
                                                                    e["comment_id"].cast("string"))), " ")
    return runlog.read(spark, path).withColumn("evidence", shown).select(
        "run_id", "qid", "route", "dataset_path", "retrieval_strategy", "answer", "retrieval_count", "avg_retrieval_score",
        "max_retrieval_score", "min_retrieval_score", "retrieval_quality", "confidence", "evidence_count", "evidence",
        "faithfulness_overlap", "faithfulness_label", "answer_length_chars", "answer_length_words", "context_length_chars",
        "context_length_words", "total_latency_sec")
