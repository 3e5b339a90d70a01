"""One store for all filters: texts, vectors and term counts in folders by filter columns.

A search within some values of these columns reads their folders only, on both sides.  Document
frequencies are stored by folder and add up, so the idf is that of the part that is searched, as if
an index had been built of this part alone; texts are split into terms once, when the store is
written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.retrieval import TfidfIndex, hybrid_search, lex_terms
from murmur.sources.stages import write_stage


class FacetStore:
    """Tables under one folder, each laid out by ``layout``:

    - rows: comment_id, text, embedding (null where there is none)
    - terms: comment_id, term, tf
    - frequencies: term, df (documents of the folder that have the term)

    The layout columns should have some thousand combinations at most, as each is a folder.  Values
    are kept as text; an empty one is the same as null.  Ids are unique.
    """

    SCHEMAS = {"rows": "comment_id long, text string, embedding array<double>", "terms": "comment_id long, term string, tf long",
               "frequencies": "term string, df long"}

    def __init__(self, spark: SparkSession, path: str, layout: list[str]):
        self.layout = layout
        self.rows, self.terms, self.frequencies = [self._read(spark, path, name, layout) for name in self.SCHEMAS]
        self._parts: dict[tuple, TfidfIndex] = {}

    @classmethod
    def _read(cls, spark: SparkSession, path: str, name: str, layout: list[str]) -> DataFrame:
        folders = "".join(f", `{c}` string" for c in layout)
        return spark.read.schema(cls.SCHEMAS[name] + folders).parquet(f"{path.rstrip('/')}/{name}")

    @classmethod
    def write(cls, df: DataFrame, path: str, layout: list[str]) -> FacetStore:
        """``df`` has comment_id, text, embedding and the layout columns; others are left out."""
        spark, path = df.sparkSession, path.rstrip("/")
        rows = df.select(F.col("comment_id").cast("long").alias("comment_id"), F.col("text").cast("string").alias("text"),
                         F.col("embedding").cast("array<double>").alias("embedding"),
                         *[F.col(f"`{c}`").cast("string").alias(c) for c in layout])

        def put(table: DataFrame, name: str) -> DataFrame:
            # rows of a folder meet, but a large folder is split among tasks at run time
            write_stage(table.hint("rebalance", *layout), f"{path}/{name}", layout)
            return cls._read(spark, path, name, layout)
        words = put(rows, "rows").select("comment_id", *layout, F.explode_outer(lex_terms(F.col("text"))).alias("term"))
        terms = put(words.filter(F.col("term").isNotNull()).groupBy("comment_id", *layout, "term")
                    .agg(F.count(F.lit(1)).alias("tf")), "terms")
        put(terms.groupBy(*layout, "term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
        return cls(spark, path, layout)

    def _limit(self, table: DataFrame, limits: dict) -> DataFrame:
        """Rows with one of the given values in each column (a value or a list; None for null)."""
        conditions = []
        for column, values in limits.items():
            if column not in self.layout:
                raise ValueError(f"{column} is no column of the layout {self.layout}")
            values = list(values) if isinstance(values, (list, tuple, set)) else [values]
            given = [str(v) for v in values if v not in (None, "")]
            some = F.col(f"`{column}`").isin(given)
            conditions.append(some | F.col(f"`{column}`").isNull() if len(given) < len(values) else some)
        return table.filter(reduce(lambda a, b: a & b, conditions)) if conditions else table

    def part(self, **limits) -> TfidfIndex:
        """The lexical index of a part, made of the stored counts; the same limits find it again."""
        key = tuple(sorted((c, repr(v)) for c, v in limits.items()))
        if key not in self._parts:
            n = self._limit(self.rows, limits).count()
            df = self._limit(self.frequencies, limits).groupBy("term").agg(F.sum("df").alias("df"))
            self._parts[key] = TfidfIndex.of_counts(self._limit(self.terms, limits).select("comment_id", "term", "tf"), df, n, "comment_id")
        return self._parts[key]

    def lexical(self, questions: DataFrame, k: int = 5, **limits) -> DataFrame:
        """(qid, comment_id, lexical_score, rank) within the limits; exact."""
        return self.part(**limits).top_k(questions, k)

    def hybrid(self, questions: DataFrame, question_vecs: DataFrame, k: int = 5, alpha: float = 0.7, **limits) -> DataFrame:
        """Hybrid hits within the limits, as ``hybrid_search`` over these rows alone gives them."""
        rows = self._limit(self.rows, limits)
        index = self.part(**limits)
        vectors = rows.filter(F.col("embedding").isNotNull()).select("comment_id", "embedding")
        return hybrid_search(rows.select("comment_id", "text"), vectors, questions, question_vecs, k, alpha, _ByComment(index))


class _ByComment:
    """An index by comment_id under the name of the id that ``hybrid_search`` expects."""

    def __init__(self, index: TfidfIndex):
        self.index = index

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        return self.index.top_k(queries, k).withColumnRenamed("comment_id", "doc_id")
