"""Identifier, lexicon-keyword and gazetteer entity extraction."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.resources.words import GAZETTEER

# What an identifier looks like.
CVE_PATTERN = r"(?i)\bCVE-\d{4}-\d{4,7}\b"
IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
HASH_PATTERN = r"\b[a-fA-F0-9]{32,64}\b"
ENTITY_TOKEN = r"[\p{L}\p{N}_]+"
LEXICON_BLOCK_BYTES = 8 << 20
"""Lexicon terms that are broadcast at once; a larger lexicon takes more passes."""
FIRST_WORDS = 1000
"""First words of gazetteer phrases that n-grams are chosen by."""


def cves(c: Column) -> Column:
    """CVE ids, original case, duplicates kept."""
    return F.regexp_extract_all(c, F.lit(CVE_PATTERN), 0)


def ips(c: Column) -> Column:
    """IPv4-shaped strings (octets not range-checked)."""
    return F.regexp_extract_all(c, F.lit(IP_PATTERN), 0)


def hashes(c: Column) -> Column:
    """Hex strings of 32 to 64 characters."""
    return F.regexp_extract_all(c, F.lit(HASH_PATTERN), 0)


def regex_entities(c: Column) -> Column:
    return F.struct(cves(c).alias("cves"), ips(c).alias("ips"), hashes(c).alias("hashes"))


_automata: dict[str, object] = {}


def _matcher(key: str, shared):
    """The terms' automaton, made once in each worker."""
    if key not in _automata:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in shared.value:
            automaton.add_word(term, term)
        automaton.make_automaton()
        _automata.clear()
        _automata[key] = automaton
    return _automata[key]


def _keyword_pass(df: DataFrame, terms: list[str], text_col: str, out: str) -> DataFrame:
    key, shared = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(terms)
    kept = df.columns
    given = df.select("*", F.lower(F.col(text_col)).alias("\x00text"))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _matcher(key, shared).iter if terms else lambda text: ()
        for part in parts:
            found = [sorted({term for _, term in find(t.as_py() or "")}) for t in part.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], pa.array(found, pa.list_(pa.string()))],
                                             names=[*kept, out])

    return given.mapInArrow(batches, schema)


def with_keywords(df: DataFrame, lexicon: DataFrame, text_col: str = "clean_text", out: str = "cyber_keywords",
                  block_bytes: int = LEXICON_BLOCK_BYTES) -> DataFrame:
    """Adds the sorted distinct lexicon terms contained (as substrings) in the
    lower-cased text; rows without a hit, also null texts, get an empty array.

    Each text is read once for all terms of a block (multi-pattern search over
    Arrow batches), so the time hardly depends on the number of terms.  The
    lexicon (``term``) is measured and broadcast block by block; the result is
    the same for any size.
    """
    lexicon = lexicon.select(F.lower("term").alias("term")).filter("term <> ''").distinct()
    size = lexicon.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    found = []
    for b in range(blocks):
        part = lexicon.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b) if blocks > 1 else lexicon
        found.append(out if b == 0 else f"{out}\x00{b}")
        df = _keyword_pass(df, sorted(r["term"] for r in part.collect()), text_col, found[-1])
    if blocks == 1:
        return df
    return df.withColumn(out, F.array_sort(F.concat(*[F.col(f"`{c}`") for c in found]))).drop(*found[1:])


def all_terms(ents: Column, kw: Column) -> Column:
    """Union of identifiers and keywords, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.concat(ents["cves"], ents["ips"], ents["hashes"], kw)))


def gazetteer_table(spark, table=GAZETTEER) -> DataFrame:
    return spark.createDataFrame(list(table), "phrase string, label string")


def with_gazetteer(df: DataFrame, gazetteer: DataFrame, id_col: str, text_col: str = "clean_text",
                   out: str = "entities") -> DataFrame:
    """Adds ``{text, label}`` structs of the gazetteer phrases in the text.

    Token n-grams, of the lengths that the gazetteer has, are joined with its
    phrases.  The longest phrase counts at each start, and it is dropped if a
    phrase that starts before it reaches over its start.  Rows are told apart
    by ``id_col``; those without a phrase get an empty array.

    With up to ``FIRST_WORDS`` first words, only n-grams that begin with one are made; a gazetteer
    of up to ``LEXICON_BLOCK_BYTES`` is sent to the n-grams, which then don't move.
    """
    gazetteer = gazetteer.withColumn("k", F.size(F.split("phrase", " ")))
    lengths = sorted(r["k"] for r in gazetteer.select("k").distinct().collect())     # a few word counts
    first = gazetteer.select(F.split("phrase", " ")[0].alias("w")).filter("w is not null").distinct()
    words = [r["w"] for r in first.limit(FIRST_WORDS + 1).collect()]
    size = gazetteer.agg(F.sum(F.octet_length("phrase") + F.coalesce(F.octet_length("label"), F.lit(0)) + 24)).first()[0] or 0
    if size <= LEXICON_BLOCK_BYTES:
        gazetteer = F.broadcast(gazetteer)
    toks = F.col("_toks")

    def grams(k: int) -> Column:
        starts = F.when(F.size(toks) >= k, F.sequence(F.lit(1), F.size(toks) - (k - 1)))
        if len(words) <= FIRST_WORDS:
            starts = F.filter(starts, lambda i: F.element_at(toks, i).isin(words))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.struct(
            i.alias("i"), F.array_join(F.slice(toks, i, k), " ").alias("phrase")))

    rows = df.select(F.col(id_col).alias("_id"), entity_tokens(F.col(text_col)).alias("_toks"))
    rows = rows.select("_id", F.explode_outer(F.concat(*[grams(k) for k in lengths])).alias("g"))
    hits = rows.select("_id", "g.i", "g.phrase").join(gazetteer, "phrase")
    best = hits.groupBy("_id", "i").agg(F.max(F.struct("k", "phrase", "label")).alias("b"))
    reach = F.max(F.col("i") + F.col("b.k")).over(
        Window.partitionBy("_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    kept = best.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("reach") <= F.col("i")))
    lists = (kept.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct(
        "i", F.col("b.phrase").alias("text"), F.col("b.label").alias("label")))).alias("_e"))
        .select("_id", F.transform("_e", lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"))).alias(out)))
    none = F.array().cast("array<struct<text:string,label:string>>")
    return (df.join(lists, F.col(id_col) == F.col("_id"), "left").drop("_id")
              .withColumn(out, F.coalesce(F.col(out), none)))


def entity_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(ENTITY_TOKEN), 0)
