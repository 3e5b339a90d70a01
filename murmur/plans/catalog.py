"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables.  Computed columns carry the same names (and types) as in
the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import entities as E
from murmur.operators import cells, corpus, evaluate, explore, faceted, group_topics, inverted, labels, retrieval, routing, store, topics, vectors
from murmur.plans import ask, incremental
from murmur.plans import oracle as O
from murmur.session import checkpoint_dir
from murmur.resources.words import GAZETTEER
from murmur.sources import csv_splits, files, lexicon, stages
from murmur.sources.tables import COMMENTS_SQL, comments, spread, table

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), "doc_id")


# --- preprocessing -----------------------------------------------------------

@register("clean_text", f"""
WITH {O.clean_ctes("(SELECT doc_id, text FROM documents)")}
SELECT doc_id, clean_text FROM cl3""")
def q_clean_text(spark, sf_dir):
    return corpus.clean(docs(spark, sf_dir)).select("doc_id", "clean_text")


@register("clean_html", f"""
WITH {O.clean_ctes("(SELECT page_id, html AS text FROM pages)")}
SELECT page_id, clean_text FROM cl3""")
def q_clean_html(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), "page_id")
    return corpus.clean(pages).select("page_id", "clean_text")


@register("min_length_by_source", """
SELECT doc_id, source AS video_id, length(text) AS n_chars FROM documents
WHERE NOT (source IN ('src0', 'src1', 'src2')) OR length(text) >= 60""")
def q_min_length(spark, sf_dir):
    d = docs(spark, sf_dir).withColumnRenamed("source", "video_id")
    return (corpus.min_length_by_source(d, ["src0", "src1", "src2"], 60)
            .select("doc_id", "video_id", F.length("text").cast("bigint").alias("n_chars")))


@register("language_id", f"""
WITH {O.clean_ctes("(SELECT doc_id, text, lang FROM documents)")}
SELECT doc_id, lang, {O.language("clean_text")} AS language FROM cl3""")
def q_language_id(spark, sf_dir):
    return (corpus.with_language(corpus.clean(docs(spark, sf_dir)))
            .select("doc_id", "lang", "language"))


@register("language_distribution", f"""
WITH {O.clean_ctes("(SELECT doc_id, text FROM documents)")},
lg AS (SELECT {O.language("clean_text")} AS language FROM cl3)
SELECT language, count(*) AS n FROM lg GROUP BY language ORDER BY n DESC, language LIMIT 10""")
def q_language_distribution(spark, sf_dir):
    return corpus.language_distribution(corpus.with_language(corpus.clean(docs(spark, sf_dir))))


@register("english_counts", f"""
WITH {O.clean_ctes("(SELECT doc_id, text FROM documents)")},
lg AS (SELECT {O.language("clean_text")} = 'en' AS is_english FROM cl3)
SELECT sum(CAST(is_english AS BIGINT)) AS english, sum(CAST(NOT is_english AS BIGINT)) AS non_english
FROM lg""")
def q_english_counts(spark, sf_dir):
    return corpus.english_counts(corpus.with_language(corpus.clean(docs(spark, sf_dir))))


@register("tokens_kept", f"""
WITH {O.prepared_ctes()}
SELECT doc_id, lemmas, array_to_string(lemmas, ' ') AS lemma_text FROM en""")
def q_tokens_kept(spark, sf_dir):
    return corpus.prepare(docs(spark, sf_dir)).select("doc_id", "lemmas", "lemma_text")


@register("zipf_top50", f"""
WITH {O.word_frequency_ctes()}
SELECT word, frequency, CAST(row_number() OVER (ORDER BY frequency DESC, word) AS INTEGER) AS rank
FROM wf ORDER BY frequency DESC, word LIMIT 50""")
def q_zipf_top50(spark, sf_dir):
    return corpus.top_words(corpus.word_frequency(corpus.prepare(docs(spark, sf_dir))), 50)


@register("word_frequency", f"""
WITH {O.word_frequency_ctes()}
SELECT word, frequency, CAST(row_number() OVER (ORDER BY frequency DESC, word) AS INTEGER) AS rank
FROM wf""")
def q_word_frequency(spark, sf_dir):
    checkpoint_dir(spark)
    return corpus.rank_words(corpus.word_frequency(corpus.prepare(docs(spark, sf_dir))))


@register("final_text", f"""
WITH {O.word_frequency_ctes()},
st AS (SELECT list(word) AS stop FROM (SELECT word FROM wf ORDER BY frequency DESC, word LIMIT 50))
SELECT doc_id, list_filter(lemmas, lambda x: NOT list_contains(stop, x)) AS final_tokens,
       array_to_string(list_filter(lemmas, lambda x: NOT list_contains(stop, x)), ' ') AS final_text
FROM en, st""")
def q_final_text(spark, sf_dir):
    rows, _, _ = corpus.preprocess(docs(spark, sf_dir))
    return rows.select("doc_id", "final_tokens", "final_text")


@register("final_text_incremental", ORACLE["final_text"])
def q_final_text_incremental(spark, sf_dir):
    """The same after two updates of a stored corpus: first the documents of some sources, then all."""
    d = docs(spark, sf_dir).withColumnRenamed("doc_id", "comment_id")
    kept = incremental.IncrementalCorpus(spark, stages.stage_path(spark, "incremental"), buckets=16)
    kept.update(d.filter(F.crc32(F.col("source").cast("binary")) % 2 == 0))
    kept.update(d)
    return kept.final.select(F.col("comment_id").alias("doc_id"), "final_tokens", "final_text")


# --- retrieval -------------------------------------------------------------------

def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def question_vectors(spark, sf_dir) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return (questions(spark, sf_dir).join(emb, F.col("qid") == F.col("vec_id"))
            .select("qid", "embedding"))


def doc_vectors(spark, sf_dir, doc_filter=None) -> DataFrame:
    d = docs(spark, sf_dir)
    if doc_filter is not None:
        d = d.filter(doc_filter)
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return emb.join(d.select("doc_id"), F.col("vec_id") == F.col("doc_id")).select("doc_id", "embedding")


@register("tfidf_topk", f"""
WITH {O.tfidf_ctes(O.DOC_CORPUS, O.QUESTIONS)}
SELECT qid, id AS comment_id, lexical_score, rank FROM {O.ranked('lx_sc', 'qid', 'lexical_score', 'id', 5)}""")
def q_tfidf_topk(spark, sf_dir):
    return (text_index(spark, sf_dir).top_k(questions(spark, sf_dir), 5)
            .select("qid", F.col("doc_id").alias("comment_id"), "lexical_score", "rank"))


@register("tfidf_topk_indexed", f"""
WITH {O.tfidf_ctes(O.DOC_CORPUS, O.QUESTIONS)}
SELECT qid, id AS comment_id, lexical_score, rank FROM {O.ranked('lx_sc', 'qid', 'lexical_score', 'id', 5)}""")
def q_tfidf_topk_indexed(spark, sf_dir):
    """The rows of tfidf_topk from postings with impact bounds: only blocks that can matter are opened."""
    index = inverted.ImpactIndex(docs(spark, sf_dir).select("doc_id", "text"))
    return index.top_k(questions(spark, sf_dir), 5).select("qid", F.col("doc_id").alias("comment_id"), "lexical_score", "rank")


@register("cosine_topk", f"""
WITH {O.cosine_ctes(O.VEC_CORPUS, O.VEC_QUESTIONS)}
SELECT qid, id AS comment_id, semantic_score, rank FROM {O.ranked('sm_sc', 'qid', 'semantic_score', 'id', 5)}""")
def q_cosine_topk(spark, sf_dir):
    return (retrieval.cosine_top_k(doc_vectors(spark, sf_dir), question_vectors(spark, sf_dir), 5)
            .select("qid", F.col("doc_id").alias("comment_id"), "semantic_score", "rank"))


_FINAL = f"""{O.word_frequency_ctes()},
st AS (SELECT list(word) AS stop FROM (SELECT word FROM wf ORDER BY frequency DESC, word LIMIT 50)),
ft AS (SELECT doc_id AS id, documents.source, array_to_string(list_filter(lemmas, lambda x: NOT list_contains(stop, x)), ' ') AS text
       FROM en JOIN documents USING (doc_id), st)"""


def final_store(spark, sf_dir, layout=None) -> store.VectorStore:
    """Processed English documents, written with their encoder and opened again."""
    rows, _, _ = corpus.preprocess(docs(spark, sf_dir))
    rows = rows.join(docs(spark, sf_dir).select("doc_id", F.col("source").alias("video_id")), "doc_id")
    path = stages.stage_path(spark, "vector-store")
    store.VectorStore.write(rows.select("doc_id", "final_text", "video_id"), path, "doc_id", "final_text", layout=layout)
    return store.VectorStore.open(spark, path)


@register("store_topk", f"""
WITH {_FINAL}, {O.store_ctes("ft", O.QUESTIONS, 256)}
SELECT qid, vs_top.id AS comment_id, ft.text, source AS video_id, semantic_score, rank
FROM {O.ranked('vs_sc', 'qid', 'semantic_score', 'id', 5)} vs_top JOIN ft USING (id)""")
def q_store_topk(spark, sf_dir):
    """Questions in words, encoded by the stored encoder and answered from the stored table."""
    hits = final_store(spark, sf_dir).search(questions(spark, sf_dir), 5)
    return hits.select("qid", "comment_id", "text", F.col("metadata.video_id").alias("video_id"), "semantic_score", "rank")


@register("store_topk_filtered", f"""
WITH {_FINAL}, {O.store_ctes("ft", O.QUESTIONS, 256)},
own AS (SELECT qid, s.id, source, semantic_score FROM vs_sc s JOIN ft USING (id) WHERE source = 'src' || (qid % 7))
SELECT qid, id AS comment_id, source AS video_id, semantic_score, rank FROM {O.ranked('own', 'qid', 'semantic_score', 'id', 5)}""")
def q_store_topk_filtered(spark, sf_dir):
    """Each question within one video of its own: the store is laid out by video, and others aren't read."""
    asked = questions(spark, sf_dir).withColumn("video_id", F.concat(F.lit("src"), (F.col("qid") % 7).cast("string")))
    hits = final_store(spark, sf_dir, ["video_id"]).search(asked, 5, by="video_id")
    return hits.select("qid", "comment_id", F.col("metadata.video_id").alias("video_id"), "semantic_score", "rank")


def text_index(spark, sf_dir) -> retrieval.TfidfIndex:
    return retrieval.TfidfIndex(docs(spark, sf_dir).select(F.col("doc_id"), "text"))


def hybrid(spark, sf_dir, k=5, alpha=0.7, doc_filter=None, qs=None, index=None):
    qs = questions(spark, sf_dir) if qs is None else qs
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    qvec = qs.join(emb, F.col("qid") == F.col("vec_id")).select("qid", "embedding")
    d = docs(spark, sf_dir)
    if doc_filter is not None:
        d = d.filter(doc_filter)
    text_of = d.select(F.col("doc_id").alias("comment_id"), "text")
    vecs = doc_vectors(spark, sf_dir, doc_filter).withColumnRenamed("doc_id", "comment_id")
    return retrieval.hybrid_search(text_of, vecs, qs, qvec, k, alpha, index)


HYBRID_COLS = ["qid", "comment_id", "semantic_score", "lexical_score", "hybrid_score", "rank"]


@register("hybrid_topk", O.hybrid_sql(5, 0.7))
def q_hybrid_topk(spark, sf_dir):
    return hybrid(spark, sf_dir, 5, 0.7).select(*HYBRID_COLS)


@register("hybrid_topk_indexed", O.hybrid_sql(5, 0.7))
def q_hybrid_topk_indexed(spark, sf_dir):
    index = inverted.ImpactIndex(docs(spark, sf_dir).select("doc_id", "text"))
    return hybrid(spark, sf_dir, 5, 0.7, index=index).select(*HYBRID_COLS)


@register("hybrid_topk_a03", O.hybrid_sql(5, 0.3))
def q_hybrid_topk_a03(spark, sf_dir):
    return hybrid(spark, sf_dir, 5, 0.3).select(*HYBRID_COLS)


@register("hybrid_topk_filtered", O.hybrid_sql(5, 0.7, "source IN ('src1', 'src2', 'src3', 'src4', 'src5')"))
def q_hybrid_topk_filtered(spark, sf_dir):
    flt = F.col("source").isin("src1", "src2", "src3", "src4", "src5")
    return hybrid(spark, sf_dir, 5, 0.7, flt).select(*HYBRID_COLS)


# --- entities and keywords ----------------------------------------------------------

def clean_docs(spark, sf_dir) -> DataFrame:
    return corpus.clean(docs(spark, sf_dir)).select("doc_id", "clean_text")


_CLEAN_DOCS = O.clean_ctes("(SELECT doc_id, text FROM documents)")
_TERMS = lexicon.shipped_terms()


@register("regex_entities", f"""
WITH {_CLEAN_DOCS}
SELECT doc_id, regexp_extract_all(clean_text, {O.q(E.CVE_PATTERN)}) AS cves,
       regexp_extract_all(clean_text, {O.q(E.IP_PATTERN)}) AS ips,
       regexp_extract_all(clean_text, {O.q(E.HASH_PATTERN)}) AS hashes FROM cl3""")
def q_regex_entities(spark, sf_dir):
    c = F.col("clean_text")
    return clean_docs(spark, sf_dir).select("doc_id", E.cves(c).alias("cves"), E.ips(c).alias("ips"),
                                            E.hashes(c).alias("hashes"))


@register("regex_entities_raw", f"""
SELECT page_id, regexp_extract_all(html, {O.q(E.CVE_PATTERN)}) AS cves,
       regexp_extract_all(html, {O.q(E.IP_PATTERN)}) AS ips,
       regexp_extract_all(html, {O.q(E.HASH_PATTERN)}) AS hashes FROM pages""")
def q_regex_entities_raw(spark, sf_dir):
    """entity_source="raw": identifiers read before cleaning rewrites them."""
    c = F.col("html")
    return (table(spark, sf_dir, "pages")
            .select("page_id", E.cves(c).alias("cves"), E.ips(c).alias("ips"), E.hashes(c).alias("hashes")))


@register("keyword_hits", f"""
WITH {_CLEAN_DOCS}
SELECT doc_id, {O.keywords("clean_text", _TERMS)} AS cyber_keywords FROM cl3""")
def q_keyword_hits(spark, sf_dir):
    return E.with_keywords(clean_docs(spark, sf_dir), lexicon.read_lexicon(spark)).select("doc_id", "cyber_keywords")


@register("keyword_counts", f"""
WITH {_CLEAN_DOCS},
kw AS (SELECT unnest({O.keywords("clean_text", _TERMS)}) AS term FROM cl3)
SELECT term, count(*) AS n FROM kw GROUP BY term""")
def q_keyword_counts(spark, sf_dir):
    d = E.with_keywords(clean_docs(spark, sf_dir), lexicon.read_lexicon(spark))
    kw = d.select(F.explode_outer("cyber_keywords").alias("term"))
    return kw.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@register("keyword_join", f"""
WITH {_CLEAN_DOCS},
lx AS (SELECT unnest({O.q(chr(10).join(_TERMS))}.string_split(chr(10))) AS term)
SELECT doc_id, coalesce(list(term ORDER BY term) FILTER (WHERE term IS NOT NULL), []) AS cyber_keywords
FROM cl3 LEFT JOIN lx ON contains(lower(clean_text), term) GROUP BY doc_id""")
def q_keyword_join(spark, sf_dir):
    """Documents with the lexicon terms that they contain, the lexicon in many
    blocks: the same rows as in one."""
    return E.with_keywords(clean_docs(spark, sf_dir), lexicon.read_lexicon(spark), block_bytes=2048).select(
        "doc_id", "cyber_keywords")


@register("all_terms", f"""
WITH {_CLEAN_DOCS}
SELECT doc_id, list_sort(list_distinct(flatten([
    regexp_extract_all(clean_text, {O.q(E.CVE_PATTERN)}), regexp_extract_all(clean_text, {O.q(E.IP_PATTERN)}),
    regexp_extract_all(clean_text, {O.q(E.HASH_PATTERN)}), {O.keywords("clean_text", _TERMS)}])))
    AS all_extracted_terms FROM cl3""")
def q_all_terms(spark, sf_dir):
    d = E.with_keywords(clean_docs(spark, sf_dir), lexicon.read_lexicon(spark))
    return d.select("doc_id", E.all_terms(E.regex_entities(F.col("clean_text")), F.col("cyber_keywords"))
                    .alias("all_extracted_terms"))


@register("gazetteer_entities", f"""
WITH {_CLEAN_DOCS},
{O.gazetteer_ctes("cl3", GAZETTEER)}
SELECT doc_id, {O.gazetteer_select(GAZETTEER)} AS entities FROM gz1""")
def q_gazetteer_entities(spark, sf_dir):
    return E.with_gazetteer(clean_docs(spark, sf_dir), E.gazetteer_table(spark), "doc_id").select("doc_id", "entities")


# --- exploration over the analysed-comment table ----------------------------------

_C = f"WITH c AS ({COMMENTS_SQL})"


def dist_sql(col: str, top: int | None = None) -> str:
    lim = f" LIMIT {top}" if top else ""
    return (f"{_C} SELECT {col}, count(*) AS n FROM c WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY n DESC, {col}{lim}")


@register("sentiment_distribution", dist_sql("sentiment"))
def q_sentiment_distribution(spark, sf_dir):
    return explore.distribution(comments(spark, sf_dir), "sentiment")


@register("emotion_distribution", dist_sql("emotion_label"))
def q_emotion_distribution(spark, sf_dir):
    return explore.distribution(comments(spark, sf_dir), "emotion_label")


@register("topic_top10", dist_sql("topic_id", 10))
def q_topic_top10(spark, sf_dir):
    return explore.distribution(comments(spark, sf_dir), "topic_id", 10)


@register("topic_top15", dist_sql("topic_id", 15))
def q_topic_top15(spark, sf_dir):
    return explore.distribution(comments(spark, sf_dir), "topic_id", 15)


@register("comments_per_video", dist_sql("video_id"))
def q_comments_per_video(spark, sf_dir):
    return explore.distribution(comments(spark, sf_dir), "video_id")


@register("metadata_filter", f"""{_C}
SELECT comment_id, sentiment, topic_id, video_id FROM c WHERE sentiment = 'negative' AND topic_id = 3""")
def q_metadata_filter(spark, sf_dir):
    return (explore.equality_filter(comments(spark, sf_dir), sentiment="negative", topic_id=3, video_id=None)
            .select("comment_id", "sentiment", "topic_id", "video_id"))


@register("request_filter_counts", f"""{_C},
rq AS (SELECT conv_id, turn, CASE WHEN contains(lower(text), 'negative') THEN 'negative'
           WHEN contains(lower(text), 'positive') THEN 'positive'
           WHEN contains(lower(text), 'neutral') THEN 'neutral' END AS filter_label
       FROM conversations WHERE role = 'user')
SELECT conv_id, turn, filter_label,
       CASE WHEN filter_label IS NULL THEN (SELECT count(*) FROM c)
            ELSE (SELECT count(*) FROM c WHERE c.sentiment = rq.filter_label) END AS n
FROM rq""")
def q_request_filter_counts(spark, sf_dir):
    req = (table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
           .select(F.struct("conv_id", "turn").alias("rid"), "text"))
    out = explore.request_counts(comments(spark, sf_dir), req, "rid")
    return out.select("rid.conv_id", "rid.turn", "filter_label", "n")


_FACETS = dict(sentiments=["negative", "positive"], emotions=["anger", "joy", "sadness"],
               topics=[0, 1, 2, 3, 4, -1], videos=[], min_likes=20)


@register("facet_filter", f"""{_C}
SELECT comment_id, sentiment, emotion_label, topic_id, like_count FROM c
WHERE sentiment IN ('negative', 'positive') AND emotion_label IN ('anger', 'joy', 'sadness')
  AND topic_id IN (0, 1, 2, 3, 4, -1) AND coalesce(like_count, 0) >= 20""")
def q_facet_filter(spark, sf_dir):
    return (explore.facet_filter(comments(spark, sf_dir), **_FACETS)
            .select("comment_id", "sentiment", "emotion_label", "topic_id", "like_count"))


@register("facet_values", f"""{_C}
SELECT DISTINCT * FROM (
  SELECT 'sentiment' AS facet, CAST(sentiment AS VARCHAR) AS value FROM c
  UNION ALL SELECT 'emotion_label', CAST(emotion_label AS VARCHAR) FROM c
  UNION ALL SELECT 'topic_id', CAST(topic_id AS VARCHAR) FROM c
  UNION ALL SELECT 'video_id', CAST(video_id AS VARCHAR) FROM c) WHERE value IS NOT NULL""")
def q_facet_values(spark, sf_dir):
    return explore.facet_values(comments(spark, sf_dir))


@register("dashboard_counts", f"""{_C},
f AS (SELECT * FROM c WHERE sentiment IN ('negative', 'positive') AND emotion_label IN ('anger', 'joy', 'sadness')
      AND topic_id IN (0, 1, 2, 3, 4, -1) AND coalesce(like_count, 0) >= 20)
SELECT (SELECT count(*) FROM c) AS total_rows, (SELECT count(*) FROM f) AS filtered_rows,
       (SELECT count(DISTINCT video_id) FROM f) AS videos, CAST(10 AS BIGINT) AS columns""")
def q_dashboard_counts(spark, sf_dir):
    c = comments(spark, sf_dir)
    return explore.dashboard_counts(c, explore.facet_filter(c, **_FACETS))


@register("comment_search", f"""{_C}
SELECT comment_id, video_id FROM c WHERE regexp_matches(text, '(?i)wor(th|ld)')""")
def q_comment_search(spark, sf_dir):
    return explore.search(comments(spark, sf_dir), "wor(th|ld)").select("comment_id", "video_id")


@register("comment_search_literal", f"""{_C}
SELECT comment_id, video_id FROM c WHERE contains(lower(text), 'the, ')""")
def q_comment_search_literal(spark, sf_dir):
    return explore.search(comments(spark, sf_dir), "The, ", literal=True).select("comment_id", "video_id")


@register("preview100", f"""{_C}
SELECT comment_id, author, like_count, video_id, sentiment, topic_id FROM c ORDER BY comment_id LIMIT 100""")
def q_preview100(spark, sf_dir):
    wanted = ["comment_id", "author", "like_count", "video_id", "sentiment", "topic_id", "not_a_column"]
    return explore.preview(explore.project_existing(comments(spark, sf_dir), wanted), 100)


@register("sentiment_over_time", f"""{_C},
t AS (SELECT CAST(updated_at AS DATE) AS date, sentiment FROM c WHERE updated_at IS NOT NULL AND sentiment IS NOT NULL)
SELECT date, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
       count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
       count(*) FILTER (WHERE sentiment = 'positive') AS positive FROM t GROUP BY date""")
def q_sentiment_over_time(spark, sf_dir):
    return explore.sentiment_over_time(comments(spark, sf_dir))


def _summary_sql():
    cols = ["comment_id", "author", "updated_at", "like_count", "text", "video_id", "language", "sentiment",
            "emotion_label", "topic_id"]
    col_rows = " UNION ALL ".join(f"SELECT 'columns' AS section, '{c}' AS key, CAST({i + 1} AS BIGINT) AS value"
                                  for i, c in enumerate(cols))
    return f"""{_C},
d AS (SELECT 'language' AS section, language AS key, count(*) AS value FROM c WHERE language IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'sentiment', sentiment, count(*) FROM c WHERE sentiment IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'emotion', emotion_label, count(*) FROM c WHERE emotion_label IS NOT NULL GROUP BY 2),
tp AS (SELECT 'topic' AS section, CAST(topic_id AS VARCHAR) AS key, count(*) AS value FROM c GROUP BY topic_id
       ORDER BY value DESC, topic_id LIMIT 15)
SELECT 'rows' AS section, 'rows' AS key, count(*) AS value FROM c
UNION ALL {col_rows}
UNION ALL SELECT * FROM d UNION ALL SELECT * FROM tp"""


@register("corpus_summary", _summary_sql())
def q_corpus_summary(spark, sf_dir):
    return explore.corpus_summary(comments(spark, sf_dir))


# --- evidence and evaluation -------------------------------------------------------

def enriched_hits(spark, sf_dir, k=5, alpha=0.7) -> DataFrame:
    """Hybrid hits with the comment's metadata and its processed text (only
    the k hits per question are cleaned, after the join)."""
    hits = stages.stage(hybrid(spark, sf_dir, k, alpha).select(*HYBRID_COLS), "hits")
    meta = comments(spark, sf_dir, hits).select("comment_id", "text", "sentiment", "emotion_label", "topic_id",
                                                "video_id", "author", "like_count")
    joined = hits.join(meta, "comment_id")
    return corpus.clean(joined).withColumnRenamed("clean_text", "processed_text")


_HY = f"({O.hybrid_sql(5, 0.7)})"
_ENRICHED = f"""{_C},
eh AS (SELECT h.*, c.text, c.sentiment, c.emotion_label, c.topic_id, c.video_id, c.author, c.like_count
       FROM {_HY} h JOIN c USING (comment_id)),
{O.clean_ctes("eh", prefix="ec")}"""


@register("evidence_listing", f"""{_ENRICHED}
SELECT qid, rank AS source_no, comment_id, text, video_id, sentiment, topic_id, hybrid_score FROM ec3""")
def q_evidence_listing(spark, sf_dir):
    return enriched_hits(spark, sf_dir).select("qid", F.col("rank").alias("source_no"), "comment_id", "text",
                                               "video_id", "sentiment", "topic_id", "hybrid_score")


def _block_sql() -> str:
    def f(c):
        return f"coalesce(CAST({c} AS VARCHAR), 'unknown')"
    return ("concat(chr(10) || 'Source ', CAST(rank AS VARCHAR), chr(10) || 'Comment: ', " + f("text")
            + ", chr(10) || 'Processed text: ', " + f("clean_text") + ", chr(10) || 'Sentiment: ', " + f("sentiment")
            + ", chr(10) || 'Emotion: ', " + f("emotion_label") + ", chr(10) || 'Topic ID: ', " + f("topic_id")
            + ", chr(10) || 'Video ID: ', " + f("video_id") + ", chr(10) || 'Author: ', " + f("author")
            + ", chr(10) || 'Like count: ', " + f("like_count") + ", chr(10) || 'Retrieval score: ', "
            + "coalesce(printf('%.6f', hybrid_score), 'unknown'), chr(10))")


@register("evidence_context", f"""{_ENRICHED}
SELECT qid, string_agg({_block_sql()}, chr(10) ORDER BY rank) AS context FROM ec3 GROUP BY qid""")
def q_evidence_context(spark, sf_dir):
    return evaluate.evidence_context(enriched_hits(spark, sf_dir))


@register("retrieval_quality", f"""
WITH h AS {_HY},
a AS (SELECT qid, count(*) AS n, avg(coalesce(hybrid_score, semantic_score, lexical_score, 0.0)) AS av,
             max(coalesce(hybrid_score, semantic_score, lexical_score, 0.0)) AS mx,
             min(coalesce(hybrid_score, semantic_score, lexical_score, 0.0)) AS mn FROM h GROUP BY qid)
SELECT b.item_id AS qid, coalesce(n, 0) AS retrieval_count, coalesce(round(av, 3), 0.0) AS avg_retrieval_score,
       coalesce(round(mx, 3), 0.0) AS max_retrieval_score, coalesce(round(mn, 3), 0.0) AS min_retrieval_score,
       CASE WHEN n IS NULL THEN 'poor' WHEN av >= 0.3 THEN 'good' ELSE 'weak' END AS retrieval_quality
FROM benchmark b LEFT JOIN a ON a.qid = b.item_id""")
def q_retrieval_quality(spark, sf_dir):
    return evaluate.retrieval_quality(questions(spark, sf_dir), hybrid(spark, sf_dir, 5, 0.7))


@register("retrieval_confidence", f"""
WITH h AS {_HY},
a AS (SELECT qid, round(avg(coalesce(hybrid_score, semantic_score, 0.0)), 3) AS confidence FROM h GROUP BY qid)
SELECT b.item_id AS qid, coalesce(confidence, 0.0) AS confidence FROM benchmark b LEFT JOIN a ON a.qid = b.item_id""")
def q_retrieval_confidence(spark, sf_dir):
    return evaluate.confidence(questions(spark, sf_dir), hybrid(spark, sf_dir, 5, 0.7))


def qa_pairs(spark, sf_dir) -> DataFrame:
    """User question -> following assistant answer, per conversation."""
    conv = table(spark, sf_dir, "conversations")
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


_PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant')"""
_FO, _FL = O.faithfulness("answer", "question")


@register("faithfulness", f"""WITH {_PAIRS}
SELECT conv_id, turn, {_FO} AS faithfulness_overlap, {_FL} AS faithfulness_label FROM pairs""")
def q_faithfulness(spark, sf_dir):
    f = evaluate.faithfulness(F.col("answer"), F.col("question"))
    return qa_pairs(spark, sf_dir).select("conv_id", "turn", f["faithfulness_overlap"].alias("faithfulness_overlap"),
                                          f["faithfulness_label"].alias("faithfulness_label"))


@register("answer_lengths", f"""WITH {_PAIRS}
SELECT conv_id, turn, CAST(length(answer) AS BIGINT) AS answer_length_chars,
       {O.word_count("answer")} AS answer_length_words, CAST(length(question) AS BIGINT) AS context_length_chars,
       {O.word_count("question")} AS context_length_words FROM pairs""")
def q_answer_lengths(spark, sf_dir):
    return qa_pairs(spark, sf_dir).select("conv_id", "turn",
                                          *evaluate.lengths(F.col("answer"), F.col("question")))


@register("qa_eval_record", f"""WITH {_PAIRS}
SELECT conv_id, turn, {O.route("question")} AS route, {_FO} AS faithfulness_overlap, {_FL} AS faithfulness_label,
       CAST(length(answer) AS BIGINT) AS answer_length_chars, {O.word_count("answer")} AS answer_length_words
FROM pairs""")
def q_qa_eval_record(spark, sf_dir):
    f = evaluate.faithfulness(F.col("answer"), F.col("question"))
    lens = evaluate.lengths(F.col("answer"), F.col("question"))[:2]
    return qa_pairs(spark, sf_dir).select(
        "conv_id", "turn", routing.route(F.col("question")).alias("route"),
        f["faithfulness_overlap"].alias("faithfulness_overlap"), f["faithfulness_label"].alias("faithfulness_label"),
        *lens)


# --- routing -------------------------------------------------------------------------

def user_questions(spark, sf_dir) -> DataFrame:
    return (table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
            .select("conv_id", "turn", "text"))


_UQ = "uq AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"


@register("route_questions", f"""WITH {_UQ}
SELECT conv_id, turn, {O.route("text")} AS route FROM uq""")
def q_route_questions(spark, sf_dir):
    return user_questions(spark, sf_dir).select("conv_id", "turn", routing.route(F.col("text")).alias("route"))


@register("route_distribution", f"""WITH {_UQ}, r AS (SELECT {O.route("text")} AS route FROM uq)
SELECT route, count(*) AS n FROM r GROUP BY route ORDER BY n DESC, route""")
def q_route_distribution(spark, sf_dir):
    r = user_questions(spark, sf_dir).select(routing.route(F.col("text")).alias("route"))
    return explore.distribution(r, "route")


@register("latency_by_route", f"""WITH {_UQ},
r AS (SELECT conv_id, {O.route("text")} AS route FROM uq),
l AS (SELECT r.route, e.value AS total_latency_sec FROM r JOIN events e ON e.event_id = r.conv_id)
SELECT route, count(*) AS n, round(avg(total_latency_sec), 6) AS avg_latency_sec,
       max(total_latency_sec) AS max_latency_sec, min(total_latency_sec) AS min_latency_sec FROM l GROUP BY route""")
def q_latency_by_route(spark, sf_dir):
    r = user_questions(spark, sf_dir).select("conv_id", routing.route(F.col("text")).alias("route"))
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("conv_id"),
                                               F.col("value").alias("total_latency_sec"))
    return (r.join(ev, "conv_id").groupBy("route")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total_latency_sec"), 6).alias("avg_latency_sec"),
                 F.max("total_latency_sec").alias("max_latency_sec"),
                 F.min("total_latency_sec").alias("min_latency_sec")))


@register("route_normalise", """
SELECT conv_id, turn, CASE WHEN lower(trim(role)) IN ('sentiment_agent', 'topic_agent', 'rag_agent', 'summary_agent',
  'metadata_agent', 'evaluation_agent') THEN lower(trim(role)) ELSE 'rag_agent' END AS route FROM conversations""")
def q_route_normalise(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", routing.normalise_route(F.col("role")).alias("route"))


# --- labels ----------------------------------------------------------------------------

def model_input(spark, sf_dir) -> DataFrame:
    return labels.with_model_input(clean_docs(spark, sf_dir), "clean_text")


_MI = f"""{_CLEAN_DOCS},
mi0 AS (SELECT doc_id, clean_text, {O.guard("clean_text")} AS g FROM cl3),
mi AS (SELECT *, {O.tokens("g")} AS toks FROM mi0)"""
_PL, _PS = O.polarity("g", "toks")
_EL, _ES = O.emotion("g", "toks")
_IL, _IS = O.irony("g", "toks")


@register("polarity_sentiment", f"""WITH {_MI}
SELECT doc_id, {_PL} AS sentiment, {_PS} AS sentiment_score FROM mi""")
def q_polarity_sentiment(spark, sf_dir):
    p = labels.polarity(F.col("_g"), F.col("_t"))
    return model_input(spark, sf_dir).select("doc_id", p["sentiment"].alias("sentiment"),
                                             p["sentiment_score"].alias("sentiment_score"))


@register("emotion_lexicon", f"""WITH {_MI}
SELECT doc_id, {_EL} AS emotion_label, {_ES} AS emotion_score FROM mi""")
def q_emotion_lexicon(spark, sf_dir):
    e = labels.emotion(F.col("_g"), F.col("_t"))
    return model_input(spark, sf_dir).select("doc_id", e["emotion_label"].alias("emotion_label"),
                                             e["emotion_score"].alias("emotion_score"))


@register("enrichment_stage", f"""WITH {_MI}
SELECT doc_id, {_PL} AS sentiment, {_PS} AS sentiment_score, {_IL} AS irony_label, {_IS} AS irony_score,
       {_EL} AS emotion_label, {_ES} AS emotion_score,
       regexp_extract_all(clean_text, {O.q(E.CVE_PATTERN)}) AS cves,
       regexp_extract_all(clean_text, {O.q(E.IP_PATTERN)}) AS ips,
       regexp_extract_all(clean_text, {O.q(E.HASH_PATTERN)}) AS hashes,
       {O.keywords("clean_text", _TERMS)} AS cyber_keywords FROM mi""")
def q_enrichment_stage(spark, sf_dir):
    return enrich(E.with_keywords(model_input(spark, sf_dir), lexicon.read_lexicon(spark))).select(
        "doc_id", "sentiment", "sentiment_score", "irony_label", "irony_score", "emotion_label", "emotion_score",
        "cves", "ips", "hashes", "cyber_keywords")


def enrich(df: DataFrame) -> DataFrame:
    """One projection adding sentiment, irony, emotion and identifier columns."""
    g, t, c = F.col("_g"), F.col("_t"), F.col("clean_text")
    p, i, e = labels.polarity(g, t), labels.irony(g, t), labels.emotion(g, t)
    ents = E.regex_entities(c)
    return df.select(
        "*", p["sentiment"].alias("sentiment"), p["sentiment_score"].alias("sentiment_score"),
        i["irony_label"].alias("irony_label"), i["irony_score"].alias("irony_score"),
        e["emotion_label"].alias("emotion_label"), e["emotion_score"].alias("emotion_score"),
        ents["cves"].alias("cves"), ents["ips"].alias("ips"), ents["hashes"].alias("hashes")).drop("_g", "_t")


@register("batch_model_scores", f"""WITH {_CLEAN_DOCS},
g AS (SELECT doc_id, {O.guard("clean_text")} AS g FROM cl3)
SELECT doc_id, CASE WHEN g IS NULL THEN 'neutral' WHEN length(g) % 2 = 0 THEN 'positive' ELSE 'negative' END
         AS prediction_label,
       CASE WHEN g IS NULL THEN 0.0 ELSE round((length(g) % 97) / 97.0, 6) END AS prediction_score FROM g""")
def q_batch_model_scores(spark, sf_dir):
    scored = labels.batch_score(clean_docs(spark, sf_dir), "clean_text", labels.toy_sentiment_model,
                                label_map=labels.map_sentiment)
    return scored.select("doc_id", "prediction_label", "prediction_score")


@register("classifier_scores")
def q_classifier_scores(spark, sf_dir):
    """Quality classifier trained on the labelled documents, scoring every
    document (rows-only check; accuracy is tested in pytest)."""
    d = clean_docs(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    model = labels.classifier_pipeline("clean_text", "label").fit(d.join(lab, "doc_id"))
    return labels.classify(model, d).select("doc_id", "prediction_label", "prediction_score")


# --- topics, vectors --------------------------------------------------------------------

def text_vectors(spark, sf_dir) -> DataFrame:
    """(doc_id, final_tokens, final_text, embedding) of every English document, from its processed text."""
    rows, _, _ = corpus.preprocess(docs(spark, sf_dir))
    return vectors.embed(rows, "final_tokens", 128).select("doc_id", "final_tokens", "final_text", "embedding")


@register("topic_clusters")
def q_topic_clusters(spark, sf_dir):
    """Topics of every English document, from its processed text (rows-only:
    cluster ids are a model output; invariants are tested in pytest)."""
    return topics.cluster(text_vectors(spark, sf_dir).select("doc_id", "embedding")).select("doc_id", "topic_id")


@register("topic_info")
def q_topic_info(spark, sf_dir):
    return topics.topic_info(topics.cluster(text_vectors(spark, sf_dir)))


def sentiment_rows(spark, sf_dir) -> DataFrame:
    c = comments(spark, sf_dir).select(F.col("comment_id").alias("doc_id"), "sentiment")
    return text_vectors(spark, sf_dir).join(c, "doc_id").select("doc_id", "sentiment", "embedding")


@register("topics_per_sentiment")
def q_topics_per_sentiment(spark, sf_dir):
    """Topics within each sentiment, all fitted together."""
    rows = stages.stage(sentiment_rows(spark, sf_dir), "sentiment-rows")
    model = group_topics.GroupTopics.fit(rows, "sentiment")
    return model.assign(rows, "sentiment").select(F.col("doc_id").alias("comment_id"), "sentiment", "sentiment_topic_id")


@register("sentiment_topic_rules", f"""
WITH {O.prepared_ctes()}, c AS ({COMMENTS_SQL})
SELECT sentiment, count(*) AS n_rows, count(*) AS n_in_model, true AS gapless, true AS by_size, true AS large_enough, true AS in_model
FROM en JOIN c ON c.comment_id = en.doc_id WHERE sentiment IS NOT NULL GROUP BY sentiment HAVING count(*) >= 5""")
def q_sentiment_topic_rules(spark, sf_dir):
    """What must hold of the topics of each sentiment, whatever the clusters: every row once, ids by size without gaps."""
    rows = stages.stage(sentiment_rows(spark, sf_dir), "sentiment-rows")
    model = group_topics.GroupTopics.fit(rows, "sentiment")
    topic = F.when(F.col("topic") >= 0, F.struct("topic", "n"))
    ruled = model.model.groupBy(F.col("g").alias("sentiment")).agg(
        F.sum("n").alias("n_in_model"), F.array_sort(F.collect_list(topic)).alias("t"), F.collect_set("topic").alias("known"))
    ruled = ruled.select("sentiment", "n_in_model", "known", F.forall(F.transform("t", lambda x, i: x["topic"] == i), lambda x: x).alias("gapless"),
                         (F.reverse(F.array_sort("t.n")) == F.col("t.n")).alias("by_size"), F.forall("t.n", lambda n: n >= 5).alias("large_enough"))
    given = model.assign(rows, "sentiment").groupBy("sentiment").agg(F.count(F.lit(1)).alias("n_rows"), F.collect_set("sentiment_topic_id").alias("used"))
    return given.join(ruled, "sentiment").select("sentiment", "n_rows", "n_in_model", "gapless", "by_size", "large_enough", (
        F.size(F.array_except("used", F.array_union("known", F.array(F.lit(-1))))) == 0).alias("in_model"))


@register("topic_rules", f"""
WITH {O.prepared_ctes()}
SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_documents, true AS gapless, true AS large_enough FROM en""")
def q_topic_rules(spark, sf_dir):
    """What must hold of the topics of all English documents: every document once, and no gap in the ids.

    Far rows leave a topic after it is numbered, so sizes are those of the rows that stay.
    """
    given = stages.stage(topics.cluster(text_vectors(spark, sf_dir).select("doc_id", "embedding")).select("doc_id", "topic_id"), "topic-rows")
    sizes = given.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).filter("topic_id >= 0")
    ruled = sizes.agg((F.max("topic_id") + 1 == F.count(F.lit(1))).alias("gapless"), (F.min("n") >= 1).alias("large_enough"))
    return given.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("n_documents")).crossJoin(F.broadcast(ruled))


@register("topic_words", f"""
WITH t AS (SELECT e.label AS topic_id, unnest(regexp_extract_all(lower(d.text), {O.q(O.LEX_SQL_PATTERN)})) AS word
           FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
tf AS (SELECT topic_id, word, count(*) AS tf FROM t GROUP BY ALL),
ft AS (SELECT word, sum(tf) AS ft FROM tf GROUP BY word),
a AS (SELECT avg(n) AS A FROM (SELECT topic_id, sum(tf) AS n FROM tf GROUP BY topic_id)),
s AS (SELECT topic_id, word, round(tf * ln(1 + A / ft), 6) AS weight FROM tf JOIN ft USING (word), a)
SELECT topic_id, word, weight, rank FROM {O.ranked('s', 'topic_id', 'weight', 'word', 10)}""")
def q_topic_words(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("topic_id"))
    d = docs(spark, sf_dir).join(emb, F.col("vec_id") == F.col("doc_id"))
    toks = d.select("topic_id", retrieval.lex_terms(F.col("text")).alias("tokens"))
    return topics.ctfidf_words(toks, "topic_id", "tokens", 10)


@register("embed_text")
def q_embed_text(spark, sf_dir):
    """Preprocess -> hashed, normalised vectors -> vector table written as a
    stage and read back (the vector store)."""
    rows, _, _ = corpus.preprocess(docs(spark, sf_dir))
    vt = vectors.vector_table(vectors.embed(rows, "final_tokens", 256), "doc_id", "final_text")
    return stages.stage(vt, "vector_store")


def vector_index(spark, sf_dir) -> cells.CellIndex:
    return cells.CellIndex(doc_vectors(spark, sf_dir), k=5)


@register("lsh_topk")
def q_lsh_topk(spark, sf_dir):
    """Approximate search: cells of centroids, sketches of random signs, exact products of what is left."""
    return (vector_index(spark, sf_dir).top_k(question_vectors(spark, sf_dir), 5)
            .select("qid", F.col("doc_id").alias("comment_id"), "semantic_score", "rank"))


# --- filters before the search -----------------------------------------------------------

FACET_FILTERS = {"videos": {"source": ["src1", "src2", "src3", "src4", "src5"]},
                 "english": {"lang": "en"},
                 "both": {"source": ["src3", "src8", "src19"], "lang": "en"}}


def facet_store(spark, sf_dir) -> faceted.FacetStore:
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("comment_id"), "embedding")
    rows = docs(spark, sf_dir).withColumnRenamed("doc_id", "comment_id").join(emb, "comment_id", "left")
    return faceted.FacetStore.write(rows, stages.stage_path(spark, "facet-store"), ["source", "lang"])


def _facets_sql() -> str:
    parts = []
    for name, limits in FACET_FILTERS.items():
        where = " AND ".join(f"{c} IN {O.in_list([v] if isinstance(v, str) else v)}" for c, v in limits.items())
        parts.append(f"SELECT '{name}' AS filter, {', '.join(HYBRID_COLS)} FROM ({O.hybrid_sql(5, 0.7, where)})")
    return " UNION ALL ".join(parts)


@register("hybrid_topk_facets", _facets_sql())
def q_hybrid_topk_facets(spark, sf_dir):
    """The questions within three parts of the documents, all from one store laid out by source and language."""
    store_, qvec = facet_store(spark, sf_dir), question_vectors(spark, sf_dir)
    parts = [store_.hybrid(questions(spark, sf_dir), qvec, 5, 0.7, **limits).select(F.lit(name).alias("filter"), *HYBRID_COLS)
             for name, limits in FACET_FILTERS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- sources and sinks --------------------------------------------------------------------

@register("csv_roundtrip", f"""{_C}
SELECT author, CAST(like_count AS BIGINT) AS like_count, text, video_id FROM c""")
def q_csv_roundtrip(spark, sf_dir):
    """Comments written as quoted CSV (multi-line texts) and read back."""
    c = comments(spark, sf_dir).select("author", F.lit(None).cast("string").alias("updated_at"), "like_count",
                                       "text", "video_id", F.lit(True).alias("public"))
    path = stages.stage_path(spark, "comments_csv")
    files.write_comment_csv(c, path)
    return files.read_comment_csv(spark, path).select("author", "like_count", "text", "video_id")


@register("csv_split_roundtrip", f"""{_C}
SELECT author, CAST(like_count AS BIGINT) AS like_count, text, video_id FROM c""")
def q_csv_split_roundtrip(spark, sf_dir):
    """The same through the reader of byte ranges."""
    c = comments(spark, sf_dir).select("author", F.lit(None).cast("string").alias("updated_at"), "like_count",
                                       "text", "video_id", F.lit(True).alias("public"))
    path = stages.stage_path(spark, "comments_csv")
    files.write_comment_csv(c, path)
    return csv_splits.read_large_csv(spark, path).select("author", "like_count", "text", "video_id")


@register("thread_flatten", """
SELECT role AS author, CAST(conv_id AS VARCHAR) AS updated_at, turn AS like_count, text,
       'conv' || CAST(conv_id AS VARCHAR) AS video_id, role = 'user' AS public FROM conversations""")
def q_thread_flatten(spark, sf_dir):
    """Conversations landed as nested comment-thread pages (JSON, at most 100
    items per page) and flattened back."""
    conv = table(spark, sf_dir, "conversations")
    item = F.struct(F.struct(
        (F.col("role") == "user").alias("isPublic"),
        F.struct(F.struct(F.col("role").alias("authorDisplayName"),
                          F.col("conv_id").cast("string").alias("publishedAt"),
                          F.col("turn").alias("likeCount"), F.col("text").alias("textOriginal"),
                          F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("videoId"))
                 .alias("snippet")).alias("topLevelComment")).alias("snippet"))
    page = F.floor(F.col("turn") / 100)
    pages = (conv.select("conv_id", page.alias("page"), "turn", item.alias("it"))
             .groupBy("conv_id", "page")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "it"))), lambda x: x["it"]).alias("items"))
             .select("items", F.lit(None).cast("string").alias("nextPageToken")))
    path = stages.stage_path(spark, "thread_pages")
    pages.write.mode("overwrite").json(path)
    return files.read_thread_pages(spark, path)


@register("source_union", """
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, source FROM documents""")
def q_source_union(spark, sf_dir):
    """Documents written partitioned by source, read back as the union of the
    per-source folders."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    path = stages.write_stage(d, stages.stage_path(spark, "by_source"), ["source"])
    return files.read_sources(spark, path).select("doc_id", "n_chars", "source")


@register("stage_roundtrip", f"""{_C}
SELECT comment_id, sentiment, topic_id, like_count FROM c""")
def q_stage_roundtrip(spark, sf_dir):
    """Typed stage written partitioned by sentiment and read back (in = out)."""
    c = comments(spark, sf_dir).select("comment_id", "sentiment", "topic_id", "like_count")
    return stages.stage(c, "comments_by_sentiment", ["sentiment"]).select(
        "comment_id", "sentiment", "topic_id", "like_count")


# --- routing dispatch and the answer log ---------------------------------------------------

def _dispatch_sql() -> str:
    rq = f"(SELECT item_id AS qid, text, {O.route('text')} AS route FROM benchmark)"
    parts = []
    for r, k in ask.RETRIEVAL_K.items():
        qs = f"(SELECT qid, text FROM {rq} WHERE route = '{r}')"
        vq = (f"(SELECT q.qid, e.embedding FROM {qs} q JOIN embeddings e ON e.vec_id = q.qid)")
        parts.append(f"SELECT qid, hybrid_score FROM ({O.hybrid_sql(k, 0.7, questions=qs, vquestions=vq)})")
    hits = " UNION ALL ".join(parts)
    return f"""WITH rq AS {rq}, h AS ({hits}),
a AS (SELECT qid, count(*) AS n, round(avg(hybrid_score), 3) AS confidence FROM h GROUP BY qid)
SELECT rq.qid, rq.route, coalesce(a.n, 0) AS evidence_count, coalesce(a.confidence, 0.0) AS confidence
FROM rq LEFT JOIN a USING (qid)"""


@register("route_dispatch", _dispatch_sql())
def q_route_dispatch(spark, sf_dir):
    qs = questions(spark, sf_dir)
    routed = qs.withColumn("route", routing.route(F.col("text")))
    index = text_index(spark, sf_dir)            # one index for all routes
    hits = ask.dispatch(routed, lambda q, k: hybrid(spark, sf_dir, k, 0.7, qs=q, index=index))
    counts = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"),
                                     F.round(F.avg("hybrid_score"), 3).alias("confidence"))
    return routed.join(counts, "qid", "left").select(
        "qid", "route", F.coalesce("n", F.lit(0)).cast("bigint").alias("evidence_count"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@register("topic_details")
def q_topic_details(spark, sf_dir):
    """Topic info with name, c-TF-IDF words and representative documents."""
    assigned = topics.cluster(text_vectors(spark, sf_dir))
    words = topics.ctfidf_words(assigned, "topic_id", "final_tokens", 10)
    return topics.topic_details(assigned, words, text_col="final_text")


# queries that register themselves with this catalog
from murmur.plans import asked, tagged  # noqa: E402,F401
