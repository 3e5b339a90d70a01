"""Queries on texts that hold what the given tables lack: identifiers, emoji,
named phrases, irony cues, route and sentiment words.

Each row's text gets a tag made of its own key, the same in Spark and SQL, so
that the operators give many different values.  The patterns in the SQL are
written out here and don't come from the Spark side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import entities as E
from murmur.operators import corpus, evaluate, explore, labels, routing
from murmur.plans import oracle as O
from murmur.plans.catalog import _C, _PAIRS, docs, qa_pairs, register, user_questions
from murmur.resources.words import EMOJI_NAMES, GAZETTEER, IRONY_CUES
from murmur.sources.tables import comments, table

ROUTE_TAGS = ["", "please evaluate it", "give me a summary", "how many likes", "the overall mood", "which themes"]
SENTIMENT_TAGS = ["", "only NEGATIVE ones", "the Positive ones", "neutral"]
CUES = [" ".join(IRONY_CUES[i:i + 3]) for i in range(0, 9, 3)] + ["", IRONY_CUES[0]]
EMOJI = [e for e, _ in EMOJI_NAMES]
PHRASES = [p for p, _ in GAZETTEER]


def tag(key: Column, tags: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in tags]), (F.pmod(key, F.lit(len(tags))) + 1).cast("int"))


def tag_sql(key: str, tags: list[str]) -> str:
    return f"[{', '.join(O.q(t) for t in tags)}][({key}) % {len(tags)} + 1]"


def with_tag(df: DataFrame, key: str, tags: list[str], col: str = "text") -> DataFrame:
    return df.withColumn(col, F.concat(col, F.lit(" "), tag(F.col(key), tags)))


def _identifier(doc_id: Column) -> Column:
    n = doc_id.cast("string")
    return F.concat(F.lit(" Cve-20"), F.lpad(F.pmod(doc_id, F.lit(30)).cast("string"), 2, "0"), F.lit("-"),
                    F.lpad(n, 5, "7"), F.lit(" 10.0."), F.pmod(doc_id, F.lit(999)).cast("string"), F.lit(".1 "),
                    F.md5(n.cast("binary")))


@register("regex_entities_tagged", r"""
WITH t AS (SELECT doc_id, concat(text, ' Cve-20', lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0'), '-',
                                 lpad(CAST(doc_id AS VARCHAR), 5, '7'), ' 10.0.', CAST(doc_id % 999 AS VARCHAR), '.1 ',
                                 md5(CAST(doc_id AS VARCHAR))) AS text FROM documents)
SELECT doc_id, regexp_extract_all(text, '(?i)\bcve-[0-9]{4}-[0-9]{4,7}\b') AS cves,
       regexp_extract_all(text, '\b([0-9]{1,3}[.]){3}[0-9]{1,3}\b') AS ips,
       regexp_extract_all(text, '\b[0-9a-fA-F]{32,64}\b') AS hashes FROM t""")
def q_regex_entities_tagged(spark, sf_dir):
    c = F.col("text")
    d = docs(spark, sf_dir).withColumn("text", F.concat("text", _identifier(F.col("doc_id"))))
    return d.select("doc_id", E.cves(c).alias("cves"), E.ips(c).alias("ips"), E.hashes(c).alias("hashes"))


@register("gazetteer_tagged", f"""
WITH t AS (SELECT doc_id, concat(text, ' ', {tag_sql("doc_id", PHRASES)}, ' x ', {tag_sql("doc_id + 7", PHRASES)})
           AS clean_text FROM documents),
{O.gazetteer_ctes("t", GAZETTEER)}
SELECT doc_id, list_transform({O.gazetteer_select(GAZETTEER)}, lambda e: e.text || '/' || e.label) AS entities FROM gz1""")
def q_gazetteer_tagged(spark, sf_dir):
    text = F.concat("text", F.lit(" "), tag(F.col("doc_id"), PHRASES), F.lit(" x "), tag(F.col("doc_id") + 7, PHRASES))
    d = docs(spark, sf_dir).select("doc_id", text.alias("clean_text"))
    named = E.with_gazetteer(d, E.gazetteer_table(spark), "doc_id")
    return named.select("doc_id", F.transform("entities", lambda e: F.concat(e["text"], F.lit("/"), e["label"])).alias("entities"))


@register("clean_emoji_tagged", f"""
WITH {O.clean_ctes(f"(SELECT doc_id, concat(text, ' ', {tag_sql('doc_id', EMOJI)}) AS text FROM documents)")}
SELECT doc_id, clean_text FROM cl3""")
def q_clean_emoji_tagged(spark, sf_dir):
    return corpus.clean(with_tag(docs(spark, sf_dir), "doc_id", EMOJI)).select("doc_id", "clean_text")


@register("irony_tagged", f"""
WITH t AS (SELECT doc_id, concat(text, ' ', {tag_sql("doc_id", CUES)}) AS g FROM documents),
w AS (SELECT doc_id, len(list_filter(regexp_extract_all(lower(g), {O.q(O.TOKEN_PATTERN)}),
             lambda x: x IN {O.in_list(IRONY_CUES)})) AS c FROM t)
SELECT doc_id, CASE WHEN c >= 2 THEN 'irony' ELSE 'non_irony' END AS irony_label,
       round(c / (c + 2.0), 6) AS irony_score FROM w""")
def q_irony_tagged(spark, sf_dir):
    d = labels.with_model_input(with_tag(docs(spark, sf_dir), "doc_id", CUES), "text")
    i = labels.irony(F.col("_g"), F.col("_t"))
    return d.select("doc_id", i["irony_label"].alias("irony_label"), i["irony_score"].alias("irony_score"))


_TQ = f"""uq AS (SELECT conv_id, turn, concat(text, ' ', {tag_sql("conv_id + turn", ROUTE_TAGS)}) AS text
    FROM conversations WHERE role = 'user'),
rt AS (SELECT *, CASE WHEN regexp_matches(lower(text), 'evaluat|hallucinat|quality|accuracy|error rate|faithful|mistake')
           THEN 'evaluation_agent'
       WHEN regexp_matches(lower(text), 'summar|overview|overall|in short|recap|main points') THEN 'summary_agent'
       WHEN regexp_matches(lower(text), 'filter|how many|count|number of|likes|video|between|dated|per day')
           THEN 'metadata_agent'
       WHEN regexp_matches(lower(text), 'sentiment|positive|negative|neutral|feel|reaction|opinion|mood')
           THEN 'sentiment_agent'
       WHEN regexp_matches(lower(text), 'topic|theme|cluster|discuss|talk about|subjects') THEN 'topic_agent'
       ELSE 'rag_agent' END AS route FROM uq)"""


def tagged_routes(spark, sf_dir) -> DataFrame:
    q = user_questions(spark, sf_dir).withColumn("_k", F.col("conv_id") + F.col("turn"))
    return with_tag(q, "_k", ROUTE_TAGS).select("conv_id", "turn", routing.route(F.col("text")).alias("route"))


@register("route_tagged", f"WITH {_TQ} SELECT conv_id, turn, route FROM rt")
def q_route_tagged(spark, sf_dir):
    return tagged_routes(spark, sf_dir)


@register("route_distribution_tagged", f"WITH {_TQ} SELECT route, count(*) AS n FROM rt GROUP BY route ORDER BY n DESC, route")
def q_route_distribution_tagged(spark, sf_dir):
    return explore.distribution(tagged_routes(spark, sf_dir), "route")


@register("latency_by_route_tagged", f"""WITH {_TQ},
l AS (SELECT route, e.value AS s FROM rt JOIN events e ON e.event_id = rt.conv_id)
SELECT route, count(*) AS n, round(avg(s), 6) AS avg_latency_sec, max(s) AS max_latency_sec,
       min(s) AS min_latency_sec FROM l GROUP BY route""")
def q_latency_by_route_tagged(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("conv_id"), F.col("value").alias("s"))
    return (tagged_routes(spark, sf_dir).join(ev, "conv_id").groupBy("route")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("avg_latency_sec"),
                 F.max("s").alias("max_latency_sec"), F.min("s").alias("min_latency_sec")))


@register("request_filter_tagged", f"""{_C},
rq AS (SELECT conv_id, turn, [NULL, 'negative', 'positive', 'neutral'][(conv_id + turn) % 4 + 1] AS filter_label
       FROM conversations WHERE role = 'user'),
n AS (SELECT sentiment, count(*) AS n FROM c GROUP BY sentiment)
SELECT conv_id, turn, filter_label, CASE WHEN filter_label IS NULL THEN (SELECT count(*) FROM c) ELSE coalesce(n, 0) END AS n
FROM rq LEFT JOIN n ON n.sentiment = rq.filter_label""")
def q_request_filter_tagged(spark, sf_dir):
    """The requests' own words name no label (checked by the plain query), so the tag decides."""
    req = user_questions(spark, sf_dir).withColumn("_k", F.col("conv_id") + F.col("turn"))
    req = with_tag(req, "_k", SENTIMENT_TAGS).select(F.struct("conv_id", "turn").alias("rid"), "text")
    return explore.request_counts(comments(spark, sf_dir), req, "rid").select("rid.conv_id", "rid.turn", "filter_label", "n")


_FO, _FL = O.faithfulness("answer", "question")


@register("faithfulness_tagged", f"""WITH {_PAIRS.replace("a.text AS answer", "concat(a.text, CASE WHEN u.turn % 4 = 0 THEN ' ' || u.text ELSE '' END) AS answer")}
SELECT conv_id, turn, {_FO} AS faithfulness_overlap, {_FL} AS faithfulness_label FROM pairs""")
def q_faithfulness_tagged(spark, sf_dir):
    """Every other answer repeats its question."""
    repeated = F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" "), "question")).otherwise("")
    p = qa_pairs(spark, sf_dir).withColumn("answer", F.concat("answer", repeated))
    f = evaluate.faithfulness(F.col("answer"), F.col("question"))
    return p.select("conv_id", "turn", f["faithfulness_overlap"].alias("faithfulness_overlap"),
                    f["faithfulness_label"].alias("faithfulness_label"))
