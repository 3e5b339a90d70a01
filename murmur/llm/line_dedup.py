"""Line dedup by an exact set-similarity join, in SQL functions alone.

A line is the set of its lower-cased words.  Words are ordered by rarity; two lines that are
similar enough must share a word among the first few of this order (prefix filter), their sizes
must be close (length filter), and the place of the first common word bounds how many more can
follow (positional filter).  Pairs that pass are compared exactly, one of each later line at
first, and the later line goes.

Rarity comes from counts of hashed words, a table of fixed size.  It decides the order only;
any order gives the same result.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.common import load, small_side, stage, whole_text
from murmur.operators.corpus import keep_where

SLOT_BITS = 18
"""The rarity table has 2**18 slots, whatever the corpus."""
HASH_BITS = 45
"""Bits of a word's hash behind its rank."""
LEAST_WORDS = 1
"""All lines with a word take part; a larger number keeps lines of fewer different words (headings, brackets)."""
OTHER_BLANKS = "\t\x0b\x0c\r"
"""Blanks besides the space, and the line's end, which parts lines."""


@dataclass(frozen=True)
class Limits:
    """Filters for a Jaccard similarity of ``share`` or more, in whole numbers."""

    share: Fraction

    def _ceil(self, value: Column, by: Fraction) -> Column:
        return F.floor((value * by.numerator + (by.denominator - 1)) / by.denominator).cast("int")

    def probe_length(self, n: Column) -> Column:
        """Prefix in which a line shares a word with every similar line that isn't larger."""
        return n - self._ceil(n, self.share) + 1

    def index_length(self, n: Column) -> Column:
        """Prefix in which it shares a word with every similar line that isn't smaller."""
        return n - self._ceil(n, 2 * self.share / (1 + self.share)) + 1

    def common(self, n: Column, m: Column) -> Column:
        """Words that similar lines of ``n`` and ``m`` words have in common, at least."""
        return self._ceil(n + m, self.share / (1 + self.share))

    def may_link(self, a: str, b: str) -> Column:
        """Length and parity filter for lines (n, parity, parity2): bits that differ are words that differ."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        one = F.col(f"{a}.parity").bitwiseXOR(F.col(f"{b}.parity"))
        two = F.col(f"{a}.parity2").bitwiseXOR(F.col(f"{b}.parity2"))
        differ = F.when(F.least(n, m) > FOLDED_WORDS, F.bit_count(one) + F.bit_count(two)).otherwise(
            F.bit_count(one.bitwiseXOR(two)))
        return (n * self.share.numerator <= m * self.share.denominator) & \
               (m * self.share.numerator <= n * self.share.denominator) & (differ <= n + m - 2 * self.common(n, m))

    def may_follow(self, a: str, b: str) -> Column:
        """Positional filter for lines joined on a word at ``place``, from 1: enough words come after it."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        return F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place")) + 1 >= self.common(n, m)

    def may_differ(self, n: Column) -> Column:
        """Whether a line can be similar to one with another set of words."""
        return n * self.share.denominator >= (n + 1) * self.share.numerator

    def linked(self, common: Column, n: Column, m: Column) -> Column:
        return common * self.share.denominator >= (n + m - common) * self.share.numerator


FOLDED_WORDS = 64
"""Lines of up to so many words have their 128 parity bits folded into 64."""


def _spaced(text: Column) -> Column:
    """The lower-cased text with spaces for all blanks but line ends: a split by one character needs no pattern."""
    low = F.lower(text)
    found = [low.contains(blank) for blank in OTHER_BLANKS]
    return F.when(reduce(or_, found), F.translate(low, OTHER_BLANKS, " " * len(OTHER_BLANKS))).otherwise(low)


def _slot(word_hash: Column) -> Column:
    return F.shiftrightunsigned(word_hash, 64 - SLOT_BITS).cast("int")


def rarity(docs: DataFrame, text: str = "text") -> Column:
    """An array of ranks, by slot of the word's hash: the rarer, the lower.

    All words of all texts are counted, into a table of fixed size.
    """
    spaced = F.replace(_spaced(F.col(text)), F.lit("\n"), F.lit(" "))
    words = docs.select(F.explode(F.split(spaced, " ")).alias("word"))
    counts = words.groupBy(_slot(F.xxhash64("word")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    ranks = ["0"] * (1 << SLOT_BITS)
    for rank, row in enumerate(sorted(counts.collect(), key=lambda r: (r.n, r.slot))):
        ranks[row.slot] = str(rank)
    # one literal: the split is folded when the query is planned
    return F.split(F.lit(" ".join(ranks)), " ").cast("array<int>")


def _hashes(line: Column) -> Column:
    """Hashes of the different words of a line of ``lines_of``; what lies between two spaces is no word."""
    hashes = F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))


def _ordered(hashes: Column, ranks: Column) -> Column:
    """The line's set of words as numbers in order of rarity: rank, then the low bits of the hash."""
    def number(h: Column) -> Column:
        rank = F.coalesce(F.get(ranks, _slot(h)), F.lit(0)).cast("bigint")
        return F.shiftleft(rank, HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))

    return F.sort_array(F.transform(hashes, number))


def lines_of(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, line, content): the lower-cased lines of each text, numbered from 0, that are long enough for so many words.

    Blanks are spaces in ``content``.
    """
    split = docs.select(F.col("doc_id"), F.posexplode(F.split(_spaced(F.col(text)), "\n")).alias("line", "content"))
    return split.filter(F.length(F.btrim("content")) > 2 * least_words - 2)


def _parity(words: Column, keep=None) -> Column:
    """A bit for each of 64 word slots, flipped by each word."""
    words = F.filter(words, keep) if keep else words
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda bits, w: bits.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), w.bitwiseAND(F.lit(63)).cast("int"))))


def described(docs: DataFrame, ranks: Column, limits: Limits, least_words: int = LEAST_WORDS) -> DataFrame:
    """Lines with enough words: (doc_id, line, n, signature, keys, parity, parity2, prefix).

    ``keys`` are hashes of neighbours among the least and the largest word hashes.  Two at either
    end, so that a word put in or taken out there leaves one of them.
    """
    rows = lines_of(docs, least_words=least_words).select("doc_id", "line", _hashes(F.col("content")).alias("hashes"))
    # a plain filter would be pushed below the hashes, which would then be made twice
    rows = keep_where(rows.withColumn("n", F.size("hashes")), F.col("n") >= least_words)
    rows = rows.select("doc_id", "line", "n", F.sort_array("hashes").alias("sorted"), _ordered(F.col("hashes"), ranks).alias("words"))
    ends = [F.xxhash64(F.get("sorted", at), F.get("sorted", at + 1))
            for at in (F.lit(0), F.lit(1), F.col("n") - 2, F.col("n") - 3)]
    words = F.col("words")
    half = _parity(words, lambda w: w.bitwiseAND(F.lit(64)) != 0)
    rows = rows.withColumn("parity2", F.when(F.col("n") > FOLDED_WORDS, half).otherwise(F.lit(0).cast("bigint")))
    prefix = F.transform(F.slice(words, 1, limits.probe_length(F.col("n"))),
                         lambda w: w.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    return rows.select(
        "doc_id", "line", "n", F.xxhash64("words").alias("signature"), F.array_distinct(F.array(*ends)).alias("keys"),
        _parity(words).bitwiseXOR(F.col("parity2")).alias("parity"), "parity2", prefix.alias("prefix"))


def _before(a: str, b: str) -> Column:
    """Whether line ``a`` comes before line ``b``."""
    return (F.col(f"{a}.doc_id") < F.col(f"{b}.doc_id")) | (
        (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.line") < F.col(f"{b}.line")))


def _at(a: str) -> Column:
    return F.struct(F.col(f"{a}.doc_id").alias("doc_id"), F.col(f"{a}.line").alias("line"))


def _exact(pairs: DataFrame, docs: DataFrame, limits: Limits, least_words: int) -> DataFrame:
    """The pairs (later, earlier), structs of doc_id and line, that are similar enough."""
    lines = pairs.select(F.explode(F.array("later", "earlier")).alias("at")).distinct()
    lines = stage(lines.select("at.doc_id", "at.line"), "compared-lines")
    some = docs.select("doc_id", "text").join(small_side(stage(lines.select("doc_id").distinct(), "compared-docs")),
                                              "doc_id", "left_semi")
    words = lines_of(some, least_words=least_words).join(lines, ["doc_id", "line"], "left_semi")
    words = stage(words.select(F.struct("doc_id", "line").alias("at"), _hashes(F.col("content")).alias("w")), "line-words")
    one = words.select(F.col("at").alias("later"), F.col("w").alias("x"))
    two = words.select(F.col("at").alias("earlier"), F.col("w").alias("y"))
    both = pairs.join(one, "later").join(two, "earlier")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(limits.linked(common, F.size("x"), F.size("y"))).select("later")


def _any_link(pairs: DataFrame, docs: DataFrame, limits: Limits, least_words: int) -> DataFrame:
    """(doc_id, line): the later lines of a written table (later, earlier, common) that have an earlier line similar enough.

    One link is enough: each line is compared with the candidate that shares most of its first
    words, and only those without a link by then with all of their other candidates.
    """
    order = Window.partitionBy("later").orderBy(F.desc("common"), "earlier")
    ranked = stage(pairs.select("later", "earlier", F.row_number().over(order).alias("at")), "ranked-pairs")
    best = stage(_exact(ranked.filter("at = 1").drop("at"), docs, limits, least_words), "best-links")
    others = stage(ranked.filter("at > 1").drop("at").join(best, "later", "left_anti"), "other-pairs")
    return best.union(_exact(others, docs, limits, least_words)).select("later.*")


def find_repeats(docs: DataFrame, share: Fraction = Fraction(4, 5), least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, line): the lines with a similar line before them, by document id and line number.

    1. Lines with equal sets of words are a class, and its first line stands for it.
    2. Each class is compared with the first lines that have one of its keys: this takes nearly
       all of large groups of near copies, in four pairs a line at most.
       Classes of so few words that only equal sets are similar enough are done by now.
    3. Classes that are left are joined with all earlier lines that pass the filters.
    """
    limits = Limits(share)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.filter(F.col("doc_id").isNotNull())
    lines = stage(described(docs, rarity(docs), limits, least_words), "lines")

    place = F.struct("doc_id", "line")
    several = lines.groupBy("signature").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    several = several.filter(F.col("first") < F.col("last")).select("signature", "first")
    copies = lines.select("doc_id", "line", "signature").join(several, "signature")
    copies = stage(copies.filter(F.struct("doc_id", "line") > F.col("first")).select("doc_id", "line").distinct(), "copies")
    classes = lines.filter(limits.may_differ(F.col("n"))).drop("signature").join(small_side(copies), ["doc_id", "line"], "left_anti")

    about = ["doc_id", "line", "n", "parity", "parity2"]
    keyed = classes.select(F.struct(*about).alias("a"), F.explode("keys").alias("key"))
    head = F.first("a").over(Window.partitionBy("key").orderBy("a.doc_id", "a.line"))
    near = keyed.withColumn("b", head).filter(_before("b", "a") & limits.may_link("a", "b"))
    near = stage(near.select(_at("a").alias("later"), _at("b").alias("earlier")).distinct(), "head-pairs")
    gone = stage(_exact(near, docs, limits, least_words).select("later.*").distinct().withColumn("gone", F.lit(True)), "gone")

    left = classes.join(small_side(gone), ["doc_id", "line"], "left")
    words = left.select(*about, F.col("gone").isNull().alias("left"), F.posexplode("prefix").alias("place", "word"))
    words = words.withColumn("place", F.col("place") + 1)
    larger, smaller = words.alias("a"), words.filter(F.col("place") <= limits.index_length(F.col("n"))).alias("b")
    order = (F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & _before("b", "a"))
    a_later = _before("b", "a")
    pairs = larger.join(smaller, "word").filter(
        order & limits.may_follow("a", "b") & F.when(a_later, F.col("a.left")).otherwise(F.col("b.left"))
        & limits.may_link("a", "b"))
    pairs = pairs.select(F.when(a_later, _at("a")).otherwise(_at("b")).alias("later"),
                         F.when(a_later, _at("b")).otherwise(_at("a")).alias("earlier"))
    pairs = pairs.groupBy("later", "earlier").agg(F.count(F.lit(1)).alias("common"))
    more = _any_link(stage(pairs, "line-pairs"), docs, limits, least_words)
    # the other lines of a class are copies of its first, so the classes' first lines complete them
    return copies.union(gone.select("doc_id", "line")).union(more).distinct()


def line_dedup(docs: DataFrame, share: Fraction = Fraction(4, 5), least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and n_lines and n_removed.

    A line goes if a line before it, in the order of doc_id and line number, has a Jaccard
    similarity of ``share`` or more between the sets of lower-cased words.  Lines of fewer than
    ``least_words`` different words always stay; with 1, all lines with a word take part.

    Defined results: null texts stay null and have no lines; empty texts have one; a text of one
    very long line is one set; rows with equal ids are the same document (their lines fall
    together by number); rows without an id are left as they are; an empty table gives no row; other
    columns are carried along, and those called n_lines and n_removed are replaced.
    """
    repeats = stage(find_repeats(docs, share, least_words), "repeats")
    removed = repeats.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("line").alias("_lines"))
    small = repeats.count() <= 2_000_000          # a number for each of them: 8 MB
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    rows = docs.select(F.struct(*kept).alias("row"), F.col("doc_id").cast("bigint").alias("id"),
                       F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(removed) if small else removed, F.col("id") == F.col("_doc"), "left")
    rows = rows.withColumn("lines", F.split("text", "\n"))
    left = F.array_join(F.filter("lines", lambda _, i: ~F.array_contains("_lines", i)), "\n")
    return rows.select("row.*", F.when(F.col("_lines").isNull(), F.col("text")).otherwise(left).alias("text"),
                       F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
                       F.coalesce(F.size("_lines"), F.lit(0)).alias("n_removed"))


def _digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                      F.col("n_removed").cast("long").alias("n_removed"),
                      F.char_length(whole_text()).cast("long").alias("n_chars_left"),
                      F.sha2(whole_text().cast("binary"), 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from all documents, and a digest of the text that is left."""
    return _digests(line_dedup(load(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_line_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op6_line_dedup``, with all lines that have a word."""
    return _digests(line_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"), least_words=1))
