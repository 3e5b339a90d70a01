"""Language identification in two steps: the family first, then the language within it.

Linear support vector machines on hashed byte trigrams, one for each pair of families and one
for each pair of languages of the same family (one versus one).  Each pair is fitted in a task
of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.common import add_column, load, narrow, remainder, whole_text

# Families of languages by their ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
    "sinitic": "zh",
    "baltic": "lt lv",
    "celtic": "cy ga gd",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
SIZE = 2048
"""Hashed trigram counts in a document's vector."""
PER_LANGUAGE = 500
"""Documents of each language that are learned from: the bound of the sample."""
UNDETERMINED = "und"


def family_of(language: str) -> str:
    """A language without a known family is a family of its own."""
    return FAMILY_OF.get(language.lower().split("-")[0].split("_")[0], f"={language}")


def vectors(texts: list[str | None]) -> np.ndarray:
    """Rows of unit length: square roots of hashed trigram counts of the whole texts' bytes."""
    out = np.zeros((len(texts), SIZE), np.float32)
    for i, text in enumerate(texts):
        data = np.frombuffer(f" {text or ''} ".encode("utf-8", "replace").lower(), np.uint8).astype(np.uint32)
        if len(data) > 2:
            grams = data[:-2] | data[1:-1] << 8 | data[2:] << 16
            slots = (grams * np.uint32(2654435761)) >> np.uint32(32 - SIZE.bit_length() + 1)
            row = np.sqrt(np.bincount(slots, minlength=SIZE))
            out[i] = row / np.sqrt((row * row).sum())
    return out


def separate(rows: np.ndarray, sides: np.ndarray, cost: float = 4.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the offset) of a linear support vector machine with squared hinge loss.

    Dual coordinate descent; ``sides`` are +1 and -1.
    """
    rows = np.hstack([rows, np.ones((len(rows), 1), rows.dtype)]).astype(np.float64)
    weights, alpha = np.zeros(rows.shape[1]), np.zeros(len(rows))
    norms = np.einsum("ij,ij->i", rows, rows) + 0.5 / cost
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            slope = sides[i] * (rows[i] @ weights) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - slope / norms[i], 0.0)
            if new != alpha[i]:
                weights += (new - alpha[i]) * sides[i] * rows[i]
                alpha[i] = new
    return weights


@dataclass(frozen=True)
class Hierarchy:
    """Weights by (level, first name, second name); the level of languages is their family."""

    languages: tuple[str, ...]
    weights: dict[tuple[str, str, str], np.ndarray]

    def _choose(self, level: str, names: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The name with most pairs won, then with the largest margins; its share of belief."""
        won = np.zeros((len(rows), len(names)))
        belief = np.ones((len(rows), len(names)))
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            w = self.weights.get((level, a, b))
            margin = rows @ w[:-1] + w[-1] if w is not None else np.zeros(len(rows))
            sure = 1 / (1 + np.exp(-4 * margin))
            won[:, i] += (margin >= 0) + sure * 1e-3
            won[:, j] += (margin < 0) + (1 - sure) * 1e-3
            belief[:, i] = np.minimum(belief[:, i], sure)
            belief[:, j] = np.minimum(belief[:, j], 1 - sure)
        best = won.argmax(1)
        return best, belief[np.arange(len(rows)), best]

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        families = sorted({family_of(x) for x in self.languages})
        out, score = np.full(len(rows), UNDETERMINED, object), np.zeros(len(rows))
        if not families:
            return out, score
        family, sure = self._choose("", families, rows)
        for k, name in enumerate(families):
            mine = np.nonzero(family == k)[0]
            if not len(mine):
                continue
            names = [x for x in self.languages if family_of(x) == name]
            best, belief = self._choose(name, names, rows[mine])
            out[mine] = np.array(names, object)[best]
            score[mine] = sure[mine] * belief
        return out, score


def pairs_of(languages: list[str]) -> list[tuple[str, str, str]]:
    families = sorted({family_of(x) for x in languages})
    within = [(f, a, b) for f in families for a, b in combinations([x for x in languages if family_of(x) == f], 2)]
    return [("", a, b) for a, b in combinations(families, 2)] + within


def _fit_pair(key, rows: pd.DataFrame) -> pd.DataFrame:
    level, first, second = key
    rows = rows.sort_values(["lang", "text"], kind="stable")
    names = rows["lang"].map(family_of) if level == "" else rows["lang"]
    weights = separate(vectors(list(rows["text"])), np.where(names == first, 1.0, -1.0))
    return pd.DataFrame([[level, first, second, weights]], columns=["level", "first", "second", "weights"])


def sample(documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text): at most ``per_language`` texts with a letter of each language.

    Chosen by the hash of the id, so another order of the rows gives the same sample.  Ids are
    chosen first; the texts are fetched for them alone.
    """
    ids = documents.select("doc_id", "lang").filter(F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = ids.withColumn("place", place).filter(F.col("place") <= per_language).select("doc_id", "lang")
    # bounded by the number of languages times per_language
    texts = documents.select("doc_id", "text").filter(F.col("text").rlike(r"\p{L}"))
    return texts.join(F.broadcast(chosen), "doc_id").select("lang", "text")


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Hierarchy:
    """Learn from ``documents`` (doc_id, text, lang); a pair's rows, a bounded sample, are one group."""
    spark = documents.sparkSession
    rows = sample(documents, per_language)
    languages = sorted(r.lang for r in documents.filter(F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED))
                       .select("lang").distinct().collect())
    pairs = pairs_of(languages)
    if not pairs:
        return Hierarchy(tuple(languages), {})
    uses = [(x, *p) for p in pairs for x in languages if (family_of(x) if p[0] == "" else x) in p[1:]]
    uses = spark.createDataFrame(uses, "lang string, level string, first string, second string")
    fitted = (rows.join(F.broadcast(uses), "lang").groupBy("level", "first", "second")
              .applyInPandas(_fit_pair, "level string, first string, second string, weights array<double>"))
    weights = {(r.level, r["first"], r["second"]): np.array(r.weights) for r in fitted.collect()}
    return Hierarchy(tuple(languages), weights)


def identify(docs: DataFrame, model: Hierarchy, text: str = "text", to: str = "language") -> DataFrame:
    """Adds a struct (lang_pred, score) for each whole text.

    Defined results: ``und`` and 0 for null, empty and letterless texts, or if nothing was
    learned; with one language learned, that one and 1; ties go to the first name in order;
    repeated rows are equal; an empty table stays empty; other columns are carried along.
    """
    def make(texts: pa.Array) -> pa.Array:
        language, score = model.predict(vectors(texts.to_pylist()))
        return pa.StructArray.from_arrays([pa.array(language, pa.string()), pa.array(score, pa.float64())],
                                          names=["lang_pred", "score"])

    out = add_column(docs, to, "struct<lang_pred:string,score:double>", text, make)
    none = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return out.withColumn(to, F.when(whole_text(text).rlike(r"\p{L}"), F.col(to)).otherwise(none))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned outside the held-out fold."""
    docs = narrow(load(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string", "lang": "string"})
    model = fit(docs.filter(remainder("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "language.lang_pred", "language.score")
