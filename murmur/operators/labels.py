"""Sentiment, emotion and irony labels: table-driven scorers (native
expressions), a trainable MLlib classifier, and batch scoring with a
user-supplied model (Arrow batches, model built once per task)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.text import guard_model_input, sentiment_label, tokens
from murmur.resources.words import EMOTION_WORDS, IRONY_CUES, POLARITY

LABEL_SCHEMA = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])


def _weight(t: Column, table=POLARITY) -> Column:
    words = [w for w, _ in table]
    mapping = F.create_map(*[F.lit(x) for kv in table for x in kv])
    return F.when(t.isin(words), F.element_at(mapping, t)).otherwise(F.lit(0.0))


def _member(words):
    return lambda t: t.isin(list(words))


def with_model_input(df: DataFrame, text_col: str) -> DataFrame:
    """Guarded input (``_g``: null when blank, else the whole text) and its
    tokens (``_t``), computed once for all scorers."""
    return (df.withColumn("_g", guard_model_input(F.col(text_col)))
              .withColumn("_t", tokens(F.col("_g"))))


def polarity(g: Column, toks: Column, table=POLARITY) -> Column:
    """struct(sentiment, sentiment_score): mean word weight over the tokens;
    sign gives the label, ten times the magnitude (capped at 1) the score.
    Blank text -> neutral with 0.0."""
    total = F.aggregate(F.transform(toks, lambda t: _weight(t, table)), F.lit(0.0), lambda a, b: a + b)
    mean = F.when(F.size(toks) > 0, total / F.size(toks)).otherwise(F.lit(0.0))
    label = F.when(mean > 0, "positive").when(mean < 0, "negative").otherwise("neutral")
    score = F.round(F.least(F.abs(mean) * 10, F.lit(1.0)), 6)
    return F.struct(F.when(g.isNull(), "neutral").otherwise(label).alias("sentiment"),
                    F.when(g.isNull(), 0.0).otherwise(score).alias("sentiment_score"))


def emotion(g: Column, toks: Column, table=EMOTION_WORDS) -> Column:
    """struct(emotion_label, emotion_score): emotion with the most cue words
    (ties alphabetical), score = its share of all cue hits (6 decimals);
    no hit or blank -> neutral with 0.0."""
    labs = sorted(table)
    counts = {lab: F.size(F.filter(toks, _member(table[lab]))) for lab in labs}
    best = F.array_min(F.array(*[F.struct((-counts[lab]).alias("neg"), F.lit(lab).alias("lab")) for lab in labs]))
    hits = counts[labs[0]]
    for lab in labs[1:]:
        hits = hits + counts[lab]
    has = g.isNotNull() & (F.coalesce(best["neg"], F.lit(0)) < 0)
    return F.struct(F.when(has, best["lab"]).otherwise("neutral").alias("emotion_label"),
                    F.when(has, F.round(-best["neg"] / hits, 6)).otherwise(0.0).alias("emotion_score"))


def irony(g: Column, toks: Column, cues=IRONY_CUES) -> Column:
    """struct(irony_label, irony_score): cue-word count c, score c / (c + 2),
    irony from two cues on; blank -> non_irony with 0.0."""
    c = F.size(F.filter(toks, _member(cues)))
    score = F.round(c / (c + F.lit(2.0)), 6)
    return F.struct(F.when(g.isNotNull() & (c >= 2), "irony").otherwise("non_irony").alias("irony_label"),
                    F.when(g.isNull(), 0.0).otherwise(score).alias("irony_score"))


# --- batch scoring with a user model ----------------------------------------------

def batch_score(df: DataFrame, text_col: str, model_factory: Callable[[], Callable[[list[str]], list[dict]]],
                default_label: str = "neutral", out: str = "prediction", label_map=None) -> DataFrame:
    """Score ``text_col`` with a model built once per task by
    ``model_factory()``; the model takes a list of texts and returns
    ``[{"label", "score"}]``.  Blank texts get ``default_label`` with 0.0 and
    are not sent to the model.  Whole texts are sent; a model with a fixed
    input size does its own windowing."""
    cols = df.columns
    guarded = "_guarded"
    schema = T.StructType(list(df.select(*cols).schema.fields) + [
        T.StructField(out + "_label", T.StringType()), T.StructField(out + "_score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for pdf in batches:
            texts = pdf[guarded]
            mask = texts.notna()
            labels = pd.Series(default_label, index=pdf.index, dtype=object)
            scores = pd.Series(0.0, index=pdf.index, dtype=float)
            if mask.any():
                preds = model(texts[mask].tolist())
                labels[mask] = [p["label"] for p in preds]
                scores[mask] = [float(p["score"]) for p in preds]
            res = pdf[cols].copy()
            res[out + "_label"] = labels
            res[out + "_score"] = scores
            yield res

    scored = df.withColumn(guarded, guard_model_input(F.col(text_col))).mapInPandas(run, schema)
    if label_map is not None:
        scored = scored.withColumn(out + "_label", label_map(F.col(out + "_label")))
    return scored


def toy_sentiment_model():
    """A stand-in model whose output is a formula of the text (so SQL can
    check the batch path): label by length parity, score by length mod 97."""
    def predict(texts: list[str]) -> list[dict]:
        return [{"label": "LABEL_POSITIVE" if len(t) % 2 == 0 else "LABEL_NEGATIVE",
                 "score": round((len(t) % 97) / 97.0, 6)} for t in texts]
    return predict


def map_sentiment(c: Column) -> Column:
    return sentiment_label(c)


# --- trainable classifier -------------------------------------------------------------

def classifier_pipeline(text_col: str = "text", label_col: str = "label", features: int = 1 << 18,
                        seed: int = 7) -> Pipeline:
    return Pipeline(stages=[
        StringIndexer(inputCol=label_col, outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[\p{L}\p{N}_]+", gaps=False),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_y", maxIter=50, regParam=0.01),
    ])


def classify(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    """Label = arg-max class, score = its probability."""
    labels = model.stages[0].labels
    # the label indexer is only needed for training; scoring runs the rest
    scored = PipelineModel(model.stages[1:]).transform(df)
    prob = vector_to_array(F.col("probability"))
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    return (scored.withColumn(out + "_label", lab).withColumn(out + "_score", F.array_max(prob))
                  .drop("_y", "_tok", "_tf", "_features", "rawPrediction", "probability", "prediction"))
