"""Text vectors, the vector table and approximate search."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.retrieval import SEM_DIGITS, cosine_top_k
from murmur.sources.stages import stage


def embed(df: DataFrame, tokens_col: str, dims: int = 256, out: str = "embedding") -> DataFrame:
    """Hashed term counts, L2-normalised, as ARRAY<FLOAT> (a stand-in for a
    sentence encoder; a user encoder can be applied with batch scoring)."""
    tf = HashingTF(inputCol=tokens_col, outputCol="_tf", numFeatures=dims).transform(df)
    norm = Normalizer(inputCol="_tf", outputCol="_n", p=2.0).transform(tf)
    return (norm.withColumn(out, vector_to_array(F.col("_n"), "float32"))
                .drop("_tf", "_n"))


def metadata(df: DataFrame) -> F.Column:
    """The 10-field metadata struct of a vector-table row; absent -> ''."""
    def f(name, src=None):
        src = src or name
        return (F.coalesce(F.col(src).cast("string"), F.lit("")) if src in df.columns
                else F.lit("")).alias(name)
    return F.struct(f("author"), f("updated_at"), f("like_count"), f("video_id"), f("sentiment"),
                    f("sentiment_score"), f("topic_id"),
                    (F.to_json(F.col("cyber_keywords")) if "cyber_keywords" in df.columns
                     else F.lit("")).alias("cyber_keywords"),
                    (F.to_json(F.col("all_extracted_terms")) if "all_extracted_terms" in df.columns
                     else F.lit("")).alias("all_extracted_terms"),
                    f("original_text", "text"))


def vector_table(df: DataFrame, id_col: str, text_col: str, vec_col: str = "embedding") -> DataFrame:
    """(comment_id, text, metadata, embedding); text nulls become ''."""
    return df.select(F.col(id_col).alias("comment_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                     metadata(df).alias("metadata"), F.col(vec_col).alias("embedding"))


def lsh_top_k(corpus: DataFrame, queries: DataFrame, k: int = 5, bucket_length: float = 0.5,
              tables: int = 8, id_col: str = "doc_id", qid: str = "qid", seed: int = 7) -> DataFrame:
    """Approximate top-k: random-projection LSH proposes candidate pairs (on unit
    vectors d^2 = 2 - 2 cos), which are ranked exactly by inner product.  A
    question with fewer than k candidates is searched exactly instead."""
    c = corpus.select(F.col(id_col).alias("_id"), array_to_vector("embedding").alias("_v"))
    q = queries.select(F.col(qid).alias("_q"), array_to_vector("embedding").alias("_v"))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket_length,
                                        numHashTables=tables, seed=seed).fit(c)
    pairs = model.approxSimilarityJoin(q, c, 4.0, distCol="_d")     # no two unit vectors are farther apart
    scored = pairs.select(F.col("datasetA._q").alias(qid), F.col("datasetB._id").alias(id_col),
                          F.round(1.0 - F.col("_d") * F.col("_d") / 2.0, SEM_DIGITS).alias("semantic_score"))
    w = Window.partitionBy(qid).orderBy(F.col("semantic_score").desc(), F.col(id_col))
    found = stage(scored.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k), "lsh")
    full = found.filter(F.col("rank") == k).select(qid)
    few = cosine_top_k(corpus, queries.join(full, qid, "left_anti"), k, id_col, qid=qid)
    return found.join(full, qid, "left_semi").unionByName(few)
