"""N-gram Jaccard join by a token-group matrix.

Documents are sets of hashed word n-grams.  A set is cut into bundles: its n-grams fall by
their hash into so many ranges that two sets which are similar enough have equal bundles in
several ranges, whatever their differences are.  Bundles are the tokens of the matrix.

1. Documents with equal sets are one class, and go on as its least document.
2. Similar documents are partitioned into groups: a document joins the first document that
   has one of its bundles, if their exact similarity allows it, and so on transitively.
3. The matrix holds the union of each group's tokens, a row for each token and group.
4. A document's overlap with another group's union bounds its overlap with each member.  Only
   groups whose bound allows a link are opened, and their members are compared exactly.

So copies and near copies, however many, meet in one group and are compared with its first
document, not with each other; and text that many unlike documents share (licences, headers)
hardly ever fills a whole bundle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.common import load, narrow, small_side, stage
from murmur.llm.components import components

LARGEST_SET = 1 << 40
DEVIATIONS = 4
"""By so many standard deviations empty ranges exceed their mean hardly ever."""
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a fixed one-to-one function)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of ``size`` words.

    Words are split at ASCII white space after A-Z are lower-cased; fewer words than ``size``
    make one run, and no words make none.
    """
    words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    flat = np.empty(sum(map(len, words)), object)
    flat[:] = [w for ws in words for w in ws]
    hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for ws in words:
            h, n = hashes[at:at + len(ws)], len(ws)
            at += n
            width = min(size, n)
            if not n:
                out.append(np.zeros(0, np.uint64))
                continue
            total = np.full(n - width + 1, width, np.uint64)
            for k in range(width):
                total = mix(total * _ODD[0] + h[k:n - width + 1 + k])
            out.append(np.unique(total))
    return out


LANES = 16
"""64-bit numbers in the bitmap of a set or a group."""


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A set's tokens as bits; the bitmap of a group is the union of its members'."""
    bits = np.zeros(64 * LANES, np.uint8)
    bits[(tokens & np.uint64(64 * LANES - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def outside(bits: Column, union: Column) -> Column:
    """Bits of the first bitmap that the second lacks: at most the tokens of a set outside a union."""
    # written out lane by lane, so that it is compiled: this runs for every pair that shares a token
    lanes = [F.bit_count(bits[k].bitwiseAND(F.bitwise_not(union[k]))) for k in range(LANES)]
    return reduce(lambda n, k: n + k, lanes)


@dataclass(frozen=True)
class Bands:
    """Sizes of sets in bands, such that linked sets are in the same or in neighbouring bands.

    A scheme is a band as the larger set sees it: sets of that band and of the one below are
    cut into the scheme's number of ranges.  ``slack`` is the number of differing n-grams that
    a linked pair can have; ranges exceed it by ``spare``, the empty ranges that a set may
    have, and by one.
    """

    share: Fraction

    @cached_property
    def edges(self) -> list[int]:
        """The first size of each band."""
        edges = [1]
        while edges[-1] < LARGEST_SET:
            edges.append(int(edges[-1] / self.share) + 1)
        return edges

    def slack_of(self, total: int) -> int:
        """Differing n-grams of a linked pair whose sizes sum to ``total``, at most."""
        return int(total * (1 - self.share) / (1 + self.share))

    @cached_property
    def table(self) -> list[tuple[int, int, int]]:
        """(slack, spare, ranges) of each scheme; no ranges if linked sets must be equal."""
        rows = []
        for scheme in range(len(self.edges) - 1):
            slack = self.slack_of(2 * (self.edges[scheme + 1] - 1))
            spare = self.spare_of(slack, self.edges[max(0, scheme - 1)])
            rows.append((slack, spare, slack + 1 + spare if slack else 0))
        return rows

    @staticmethod
    def spare_of(slack: int, least: int) -> int:
        """Empty ranges that a set of ``least`` n-grams or more hardly ever exceeds.

        More spare ranges leave more of them empty, so the number is raised until it holds, or
        is half of the slack: then sets are too small for their ranges.
        """
        spare = 1
        while spare < max(1, slack // 2):
            mean = (slack + 1 + spare) * math.exp(-least / (slack + 1 + spare))
            wanted = math.ceil(mean + DEVIATIONS * math.sqrt(mean))
            if wanted <= spare:
                break
            spare = min(wanted, max(1, slack // 2))
        return spare

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def least_overlap(self, size: int, most: int) -> int:
        """Bundles that a set shares with one of ``most`` n-grams or fewer, if they link.

        The partner is of the set's band or below it, or else of the next; of either kind, the
        largest partner allows most differences.
        """
        band = self.band(size)
        found = []
        for scheme, partner in ((band, min(most, self.edges[band + 1] - 1)), (band + 1, min(most, int(size / self.share)))):
            _, spare, ranges = self.table[scheme]
            if ranges and (scheme == band or partner >= self.edges[scheme]):
                found.append(ranges - spare - self.slack_of(size + partner))
        return max(1, min(found, default=1))

    def bundles(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bundles, their schemes) of one sorted set."""
        keys, schemes = [], []
        if len(tokens):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ _ODD[3]), dtype=np.uint64)])
            for scheme in (self.band(len(tokens)), self.band(len(tokens)) + 1):
                _, spare, ranges = self.table[scheme]
                if not ranges:
                    continue
                step = (1 << 64) // ranges + 1
                cuts = np.array([k * step for k in range(ranges)], np.uint64)
                ends = np.append(np.searchsorted(tokens, cuts), len(tokens))
                full = ends[1:] > ends[:-1]
                if ranges - full.sum() > spare:
                    full[:] = True              # too many empty ranges: they count as bundles
                with np.errstate(over="ignore"):
                    place = np.arange(ranges, dtype=np.uint64) * _ODD[1] + np.uint64(scheme) * _ODD[2]
                    key = mix(mix(place) ^ mix((sums[ends[1:]] - sums[ends[:-1]]) + _ODD[0]))
                keys.append(key[full].view(np.int64))
                schemes.append(np.full(int(full.sum()), scheme, np.int16))
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int16)
        return np.concatenate(keys), np.concatenate(schemes)


def _lists(values: list[np.ndarray], dtype, kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([np.zeros(0, dtype), *values]).astype(dtype, copy=False)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _described(size: int, share: Fraction):
    """A batch function: (doc_id, text) to (doc_id, n, signature, bundles, bits)."""
    bands = Bands(share)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for part in parts:
            sets = shingle_sets(part.column("text").to_pylist(), size)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                _lists([bands.bundles(s)[0] for s in sets], np.int64, pa.int64()),
                _lists([bitmap(s) for s in sets], np.int64, pa.int64())],
                names=["doc_id", "n", "signature", "bundles", "bits"])

    return batches


def _tokens(size: int):
    """A batch function: (doc_id, text) to (doc_id, tokens)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [s.view(np.int64) for s in shingle_sets(part.column("text").to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(sets, np.int64, pa.int64())],
                                             names=["doc_id", "tokens"])

    return batches


def linked(common: Column, a: Column, b: Column, share: Fraction) -> Column:
    """Whether sets of ``a`` and ``b`` n-grams with ``common`` ones are similar enough, in whole numbers."""
    return common * share.denominator >= (a + b - common) * share.numerator


def may_link(n: Column, bits: Column, m: Column, others: Column, share: Fraction) -> Column:
    """Whether the sizes and the bitmaps of two sets allow a link: a bound, not a verdict."""
    p, q = share.numerator, share.denominator
    common = F.ceil((n + m) * p / F.lit(p + q))
    return ((n * q >= m * p) & (m * q >= n * p) & (outside(bits, others) <= n - common)
            & (outside(others, bits) <= m - common))


def verify(pairs: DataFrame, docs: DataFrame, size: int, share: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; only their texts are read again."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "compared")
    texts = docs.join(small_side(ids), "doc_id", "left_semi")
    sets = stage(texts.mapInArrow(_tokens(size), "doc_id long, tokens array<long>"), "sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    both = pairs.select("a", "b").join(two, "b").join(one, "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(linked(common, F.size("x"), F.size("y"), share)).select("a", "b")


def jaccard_join(documents: DataFrame, size: int = 5, share: Fraction = Fraction(4, 5)) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of each row of ``documents`` (doc_id, text).

    Documents link if the Jaccard similarity of their sets of ``size``-word shingles is ``share``
    or more; ``component_id`` is the least id reached by links, ``class_id`` the least id with
    an equal set.  Exact up to collisions of 64-bit hashes within a pair.

    Defined results: null, empty and wordless texts have no shingles and link with nothing; a
    text of fewer words than ``size`` has one shingle; repeated rows (equal ids) come out each,
    with equal components; one very long text is one set in a task; an empty table gives no
    row; other columns are not carried along.
    """
    docs = narrow(documents, {"doc_id": "long", "text": "string"})
    bands = Bands(share)
    about = stage(docs.mapInArrow(_described(size, share), "doc_id long, n long, signature binary, "
                                                                     "bundles array<long>, bits array<long>"), "bundles")
    some = about.filter("n > 0")
    classes = some.groupBy("signature").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes, "classes")

    # documents that aren't the first of their class (or repeat its id) go no further
    several = classes.filter("copies > 1")
    members = some.select("doc_id", "signature").join(several, "signature")
    rest = members.filter("doc_id <> class_id").select("doc_id").distinct()
    first = some.select("doc_id", "n", "bundles").join(small_side(stage(rest, "copies")), "doc_id", "left_anti")
    rows = first.select(F.explode("bundles").alias("token"), "doc_id")
    # one exchange: nearly all tokens are of one document and end here
    of_token = Window.partitionBy("token")
    met = rows.withColumn("head", F.min("doc_id").over(of_token)).withColumn("other", F.max("doc_id").over(of_token))
    shared = stage(met.filter("head <> other").drop("other").distinct(), "shared")
    seeds = shared.filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    sizes = some.groupBy("doc_id").agg(F.max(F.struct("n", "bits")).alias("set")).select("doc_id", "set.*")
    one = sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    seeds = seeds.join(one, "a").join(two, "b").filter(
        may_link(F.col("n_a"), F.col("bits_a"), F.col("n_b"), F.col("bits_b"), share)).select("a", "b")
    links = stage(verify(stage(seeds, "seeds"), docs, size, share), "seed-links")

    # groups are the components of the links so far; a document without links is its own group
    groups = stage(components(links), "groups")
    placed = (shared.select("token", "doc_id").join(groups, shared.doc_id == groups.node, "left")
              .select("token", "doc_id", F.coalesce("component", "doc_id").alias("grp")))
    contested = placed.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low <> high")
    placed = stage(placed.join(contested.select("token"), "token", "left_semi"), "contested")
    found = _open_groups(placed, sizes, bands)
    more = verify(stage(found, "opened"), docs, size, share)

    whole = components(links.union(more)).withColumnRenamed("node", "class_id")
    out = (about.select("doc_id", "n", "signature").join(classes, "signature", "left").join(whole, "class_id", "left"))
    own = F.col("n") == 0
    class_id = F.when(own, F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), class_id.alias("class_id"),
                      F.when(own, F.col("doc_id")).otherwise(F.coalesce("component", "class_id")).alias("component_id"))


def _open_groups(placed: DataFrame, sizes: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) of documents in different groups that the matrix doesn't rule out.

    ``placed`` has the tokens that several groups share: (token, doc_id, grp).  The document
    of the smaller group asks, the larger group answers.  Two bounds must allow a link: the
    bits that the document has outside the union of the group's n-grams, and its overlap with
    the union of the group's bundles.  Of opened groups, the members that the same bounds
    allow are compared.
    """
    p, q = bands.share.numerator, bands.share.denominator
    members = stage(placed.select("doc_id", "grp").distinct().join(sizes, "doc_id"), "members")
    lanes = [F.bit_or(F.col("bits")[k]).alias(f"lane{k}") for k in range(LANES)]
    unions = (members.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("fewest"),
                                         F.max("n").alias("most"), *lanes)
              .select("grp", "members", "fewest", "most", F.array(*[f"lane{k}" for k in range(LANES)]).alias("union")))
    unions = stage(unions, "unions")
    matrix = placed.select("token", "grp").distinct().join(unions, "grp")
    asking = placed.join(members.drop("grp"), "doc_id").join(unions.select("grp", "members"), "grp")
    # of n tokens at least share * n are common to a linked set
    spare = F.col("q.n") - F.ceil(F.col("q.n") * p / F.lit(q))
    asks = asking.alias("q").join(matrix.alias("g"), "token").filter(
        ((F.col("q.members") < F.col("g.members"))
         | ((F.col("q.members") == F.col("g.members")) & (F.col("q.grp") > F.col("g.grp"))))
        & (F.col("q.n") * q >= F.col("g.fewest") * p) & (F.col("g.most") * q >= F.col("q.n") * p)
        & (outside(F.col("q.bits"), F.col("g.union")) <= spare))
    least = F.pandas_udf(lambda n, most: pd.Series([bands.least_overlap(*x) for x in zip(n, most, strict=True)]), "long")
    opened = (asks.groupBy("q.doc_id", "g.grp").agg(F.count(F.lit(1)).alias("overlap"), F.first("q.n").alias("n"),
                                                    F.first("g.most").alias("most"))
              .filter(F.col("overlap") >= least("n", "most")))
    opened = stage(opened.select("doc_id", "grp"), "asks").join(members.drop("grp"), "doc_id")
    near = opened.alias("a").join(members.alias("b"), "grp").filter(
        may_link(F.col("a.n"), F.col("a.bits"), F.col("b.n"), F.col("b.bits"), bands.share))
    return near.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9 or more, all documents."""
    return jaccard_join(load(spark, sf_dir, "documents"), 3, Fraction(9, 10)).select(
        "doc_id", "n_shingles", "component_id", "class_id")
