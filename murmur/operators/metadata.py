"""Questions on the comments' metadata, answered from one cube of counts.

The cube counts the comments for every combination of sentiment, topic and video, with "any" for
each of them, and is written once, in a folder for each level.  The filters that a question names are
a key of the cube, so that a table of questions is answered by a join, and the distributions are
read from the folder of one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.explore import request_label
from murmur.sources.stages import stage

DIMENSIONS = ("sentiment", "topic_id", "video_id")

# --- fixed values: the wording of the answers -------------------------------------------
NO_SENTIMENT = "Sentiment analysis is not available yet."
NO_TOPICS = "Topic modeling is not available yet."
SENTIMENT_PREFIX = "Sentiment distribution: "
TOPIC_PREFIX = "Top topic clusters: "
FILTER_PREFIX = "Filtered rows: "
EVALUATION_METHODS = ["retrieval relevance check", "faithfulness check", "no-answer / hallucination test",
                      "sentiment error analysis", "topic coherence review", "run log with parameters and metrics"]
# ----------------------------------------------------------------------------------------

EVALUATION_ANSWER = "Available evaluation methods:" + "".join(f"\n- {m}" for m in EVALUATION_METHODS)
TOPICS_SHOWN = 10


def level(*named: str) -> int:
    """Number of the level that names these dimensions: a bit for each."""
    return sum(1 << i for i, d in enumerate(DIMENSIONS) if d in named)


def count_cube(comments: DataFrame) -> DataFrame:
    """(sentiment, topic_id, video_id as text, null for any; n; level).

    Comments are counted by their own combination first, so the cube's rows are made of the
    combinations, not of the comments.  A comment without a value counts for "any" only; an absent
    column has no values; an empty table gives no row.
    """
    own = comments.select(*[F.col(d).cast("string").alias(d) if d in comments.columns else F.lit(None).cast("string").alias(d)
                            for d in DIMENSIONS])
    own = own.groupBy(*DIMENSIONS).agg(F.count(F.lit(1)).alias("n"))
    cells = own.cube(*DIMENSIONS).agg(F.sum("n").alias("n"), *[F.grouping(d).alias(f"any_{d}") for d in DIMENSIONS])
    for d in DIMENSIONS:
        cells = cells.filter((F.col(f"any_{d}") == 1) | F.col(d).isNotNull())
    number = sum((F.when(F.col(f"any_{d}") == 0, 1 << i).otherwise(0) for i, d in enumerate(DIMENSIONS)), F.lit(0))
    return cells.select(*DIMENSIONS, "n", number.cast("int").alias("level"))


class MetadataCube:
    """A written cube.  ``columns`` are the dimensions that the comments have."""

    def __init__(self, cells: DataFrame, columns: tuple[str, ...] = DIMENSIONS):
        self.cells, self.columns = cells, columns

    @classmethod
    def build(cls, comments: DataFrame) -> MetadataCube:
        cells = count_cube(comments)
        spark = comments.sparkSession
        written = stage(cells, "metadata-cube", ["level"]) if not cells.isEmpty() else spark.createDataFrame([], cells.schema)
        return cls(written, tuple(d for d in DIMENSIONS if d in comments.columns))

    def values(self, dimension: str) -> DataFrame:
        """(value, n) of one dimension: one folder is read."""
        return self.cells.filter(F.col("level") == level(dimension)).select(F.col(dimension).alias("value"), "n")

    def filters(self, questions: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
        """(qid, sentiment, topic_id, video_id): what each question names, null for any.

        The sentiment is the first of negative, positive, neutral that occurs.  The topic is the
        number after "topic".  The video is the word after "video", if comments of such a video exist;
        any other word there ("the video about ...") is no filter.
        """
        low = F.coalesce(F.lower(F.col(text)), F.lit(""))
        topic = F.regexp_extract(low, r"\btopic\s*#?\s*(-?[0-9]+)", 1)
        # leading zeros go, so that the number is written as the cube writes it
        number = F.when(topic != "", F.regexp_replace(topic, "^(-?)0+(?=[0-9])", "$1"))
        video = F.nullif(F.regexp_extract(F.col(text), r"(?i)\bvideo\s+([\w-]+)", 1), F.lit(""))
        named = questions.select(
            F.col(qid).alias(qid), request_label(F.col(text)).alias("sentiment"),
            number.alias("topic_id"), video.alias("_video"))
        known = self.values("video_id").select(F.col("value").alias("video_id"))
        return named.join(known, F.col("_video") == F.col("video_id"), "left").select(qid, *DIMENSIONS)

    def filtered_rows(self, questions: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
        """(qid, sentiment, topic_id, video_id, n): comments left by the filters that each question names.

        A filter on a dimension that the comments don't have is no filter.
        """
        named = self.filters(questions, qid, text)
        for d in DIMENSIONS:
            if d not in self.columns:
                named = named.withColumn(d, F.lit(None).cast("string"))
        cells = self.cells.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "n")
        same = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS]
        return named.join(cells, same, "left").select(qid, *DIMENSIONS, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))

    def distribution(self, dimension: str, top: int | None = None, quote: str = "'") -> DataFrame:
        """One row (answer) with the counts of the values, most frequent first, ties by value."""
        values = self.values(dimension)
        place = F.struct(-F.col("n"), F.col("value").try_cast("bigint"), F.col("value"))
        if top:
            values = values.orderBy(place).limit(top)
        shown = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "value", "n"))),
                            lambda v: F.concat(F.lit(quote), v["value"], F.lit(quote + ": "), v["n"].cast("string")))
        return values.agg(F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}")).alias("answer"))

    def answers(self, routed: DataFrame, qid: str = "qid", text: str = "text", route: str = "route") -> DataFrame:
        """(qid, answer) of the questions whose route needs no retrieval.

        Sentiment and topic questions get the distribution (one row a route), metadata questions
        the number of comments that their filters leave, evaluation questions the list of methods.
        """
        mood, themes = F.lit(NO_SENTIMENT).alias("answer"), F.lit(NO_TOPICS).alias("answer")
        spark = routed.sparkSession
        one = spark.range(1)
        sentiment = (self.distribution("sentiment").select(F.concat(F.lit(SENTIMENT_PREFIX), "answer").alias("answer"))
                     if "sentiment" in self.columns else one.select(mood))
        topic = (self.distribution("topic_id", TOPICS_SHOWN, "").select(F.concat(F.lit(TOPIC_PREFIX), "answer").alias("answer"))
                 if "topic_id" in self.columns else one.select(themes))
        fixed = (sentiment.withColumn("_route", F.lit("sentiment_agent"))
                 .unionByName(topic.withColumn("_route", F.lit("topic_agent")))
                 .unionByName(one.select(F.lit(EVALUATION_ANSWER).alias("answer"), F.lit("evaluation_agent").alias("_route"))))
        told = routed.join(F.broadcast(fixed), F.col(route) == F.col("_route")).select(qid, "answer")
        asked = routed.filter(F.col(route) == "metadata_agent")
        counted = self.filtered_rows(asked, qid, text).select(qid, F.concat(F.lit(FILTER_PREFIX), F.col("n").cast("string")).alias("answer"))
        return told.unionByName(counted)
