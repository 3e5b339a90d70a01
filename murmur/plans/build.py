"""The full build as a chain of stages, each written as a Parquet table in
the shared checkpoint folder.  The tables of a build are in a folder named by
its input and parameters; a stage whose table is complete is read back instead
of recomputed, so a failed build restarts from the last finished stage, and new
input or parameters are built anew."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import entities as E
from murmur.operators import corpus, explore, labels, topics, vectors
from murmur.operators.group_topics import GroupTopics
from murmur.sources import lexicon
from murmur.sources.stages import read_stage, write_stage, write_word_list


def _done(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fingerprint(raw: DataFrame, *parameters) -> str:
    """A key of the input's rows (in any order) and of the build's parameters."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns])
    n, total = raw.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).first()
    said = repr((raw.dtypes, n, str(total), parameters))
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def staged(spark: SparkSession, root: str, name: str, make, partition_by=None) -> DataFrame:
    path = os.path.join(root, name)
    if not _done(spark, path):
        write_stage(make(), path, partition_by)
    return read_stage(spark, path)


def run_build(spark: SparkSession, raw: DataFrame, root: str, top_n: int = 50, min_topic_size: int = 10,
              k: int | None = None, lexicon_path: str | None = None) -> dict[str, DataFrame]:
    """raw: (comment_id, text, video_id, ...) -> processed, word frequency,
    entities, labels, topics (with info, per sentiment too), vector table and
    summary stages."""
    terms = lexicon.read_lexicon(spark, lexicon_path)
    words = fingerprint(terms)
    root = os.path.join(root, fingerprint(raw, top_n, min_topic_size, k, words))
    processed = staged(spark, root, "processed", lambda: corpus.prepare(raw))
    freq = staged(spark, root, "word_frequency", lambda: corpus.rank_words(corpus.word_frequency(processed)))
    stop_df = freq.filter(F.col("rank") <= top_n).select("word")
    stop = [r["word"] for r in stop_df.collect()]           # bounded by top_n
    write_word_list(stop_df, os.path.join(root, "zipf_stopwords"))
    final = staged(spark, root, "final", lambda: corpus.with_final_tokens(processed, stop))

    def with_entities():
        c = F.col("clean_text")
        found = E.with_keywords(final.withColumn("regex_entities", E.regex_entities(c)), terms)
        found = found.withColumn("all_extracted_terms", E.all_terms(F.col("regex_entities"), F.col("cyber_keywords")))
        return E.with_gazetteer(found, E.gazetteer_table(spark), "comment_id")
    ner = staged(spark, root, "entities", with_entities)

    def with_labels():
        df = labels.with_model_input(ner, "clean_text")
        g, t = F.col("_g"), F.col("_t")
        p, i, e = labels.polarity(g, t), labels.irony(g, t), labels.emotion(g, t)
        return df.select("*", p["sentiment"].alias("sentiment"), p["sentiment_score"].alias("sentiment_score"),
                         i["irony_label"].alias("irony_label"), i["irony_score"].alias("irony_score"),
                         e["emotion_label"].alias("emotion_label"), e["emotion_score"].alias("emotion_score")
                         ).drop("_g", "_t")
    labelled = staged(spark, root, "labelled", with_labels)
    embedded = staged(spark, root, "embedded", lambda: vectors.embed(labelled, "final_tokens"))
    analysed = staged(spark, root, "final_analysis",
                      lambda: topics.cluster(embedded, "embedding", k=k, min_topic_size=min_topic_size,
                                             id_col="comment_id", model_path=os.path.join(root, "topic_model")))
    info = staged(spark, root, "topic_info", lambda: topics.topic_info(analysed))

    def with_sentiment_topics():
        model = GroupTopics.fit(embedded, "sentiment", id_col="comment_id", path=os.path.join(root, "sentiment_topic_models"))
        return model.assign(embedded, "sentiment", id_col="comment_id")
    by_sentiment = staged(spark, root, "topics_by_sentiment", with_sentiment_topics, partition_by=["sentiment"])
    sentiment_info = staged(spark, root, "topic_info_by_sentiment",
                            lambda: by_sentiment.groupBy("sentiment", "sentiment_topic_id").agg(F.count(F.lit(1)).alias("count")))
    store = staged(spark, root, "vector_store",
                   lambda: vectors.vector_table(analysed, "comment_id", "final_text"))
    summary = staged(spark, root, "summary", lambda: explore.corpus_summary(analysed.drop("embedding")))
    return {"processed": processed, "word_frequency": freq, "final": final, "entities": ner,
            "labelled": labelled, "final_analysis": analysed, "topic_info": info, "topics_by_sentiment": by_sentiment,
            "topic_info_by_sentiment": sentiment_info, "vector_store": store, "summary": summary}
