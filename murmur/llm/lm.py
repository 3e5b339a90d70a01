"""Language-model scores from a log-frequency Bloom filter.

The filter holds the quantised counts of words and word pairs: an n-gram whose count is on
level L is inserted L times, as the events (n-gram, 1) to (n-gram, L).  A count is read back by
asking for level after level until one is missing.

Texts are read once, into blocks of word numbers.  The n-grams of the blocks are dealt by hash
into parts, whose number follows the tokens.  A part's task adds up its n-grams' training counts,
fills the part's filter and answers each block that asked; no task and no broadcast holds more
of the filter than one part of it.  Every n-gram of the training documents is held, at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import load, narrow, remainder, stage

BLOCK_BYTES = 8 << 20
"""Text in a block; a longer text is a block of its own."""
PART_TOKENS, LEAST_PARTS = 2_000_000, 64
"""Tokens for each part of the filter, which bound its n-grams of either order."""
LEAST = 1.0
"""The least count that the filter holds: none is left out."""
BASE = 1.5
"""Each level's counts are so many times those of the level before."""
EVENT_BITS, PROBES = 10, 7
PROBED = 1 << 16
"""Keys whose probes are made at a time."""
PAIR_WEIGHT = 0.3
END = np.uint64(0x9AE16A3B2F90404F)
"""The number of the token that ends each text."""
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
BLOCK = ("block long, doc_id array<long>, train array<boolean>, n array<int>, vocabulary array<long>, "
         "counts array<long>, tokens binary")
ASKED = "part int, block long, words binary, word_counts binary, pairs binary, pair_counts binary"
ANSWERS = ("part int, block long, words binary, exact binary, pairs binary, tokens long, distinct long, held double")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(_mix(first * _ODD[0]) + second * _ODD[1])


# --- reading -------------------------------------------------------------------------------


def _block(number: int, rows: list[tuple]) -> pa.RecordBatch:
    """One row: the documents' ids and lengths, and their words as places in a common vocabulary."""
    words = [(text or "").encode("utf-8", "replace").lower().split() for _, text, _ in rows]
    flat = np.empty(sum(map(len, words)) + len(rows), object)
    at, ends = 0, []
    for ws in words:
        flat[at:at + len(ws)] = ws
        at += len(ws) + 1
        flat[at - 1] = b""
        ends.append(at - 1)
    hashes = pd.util.hash_array(flat, categorize=False)
    hashes[ends] = END
    place, vocabulary = pd.factorize(hashes)
    n = np.diff(np.array([-1, *ends]))
    train = np.array([t for _, _, t in rows], bool)
    counts = np.bincount(place[np.repeat(train, n)], minlength=len(vocabulary))
    order = np.argsort(-np.bincount(place, minlength=len(vocabulary)), kind="stable")
    rank = np.empty(len(order), np.uint32)       # frequent words get small numbers, which pack well
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), pa.array([[d for d, _, _ in rows]], pa.list_(pa.int64())),
        pa.array([train.tolist()], pa.list_(pa.bool_())), _one_list(n.astype(np.int32)),
        _one_list(vocabulary[order].view(np.int64)), _one_list(counts[order].astype(np.int64)),
        pa.array([_packed(rank[place])], pa.binary())],
        names=["block", "doc_id", "train", "n", "vocabulary", "counts", "tokens"])


def _one_list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _packed(places: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers, packed."""
    planes = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    size = np.int64(len(places)).tobytes()
    return size + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, rows, size = TaskContext.get().partitionId() << 32, [], 0
    for part in parts:
        for row in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "train")), strict=True):
            if rows and size + len(row[1] or "") > BLOCK_BYTES:
                yield _block(number, rows)
                number, rows, size = number + 1, [], 0
            rows.append(row)
            size += len(row[1] or "") + 8
    if rows:
        yield _block(number, rows)


# --- the filter ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Filter:
    """Bits in segments; an n-gram's events are all in one segment."""

    bits: np.ndarray
    least: float

    @staticmethod
    def segments(events: int) -> int:
        """Segments of 2**20 bits for so many events."""
        return max(1, -(-events * EVENT_BITS >> 20))

    @staticmethod
    def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
        return (_mix(keys ^ _ODD[2]) >> np.uint64(32)).astype(np.int64) * segments >> 32

    @classmethod
    def filled(cls, keys: np.ndarray, counts: np.ndarray, least: float) -> Filter:
        """A filter of the keys with a count of at least ``least``."""
        some = counts >= least
        keys, levels = keys[some], level_of(counts[some], least)
        bits = np.zeros((cls.segments(int(levels.sum())), 1 << 20), np.uint8)
        segment = cls.segment_of(keys, len(bits))
        for level in range(1, int(levels.max(initial=0)) + 1):
            rest = np.flatnonzero(levels >= level)
            for i in range(0, len(rest), PROBED):
                at = rest[i:i + PROBED]
                bits[segment[at, None], cls.places(keys[at], level)] = 1
        return cls(np.packbits(bits, axis=1, bitorder="little"), least)

    @staticmethod
    def places(keys: np.ndarray, level: int) -> np.ndarray:
        """Bits of an event within its segment, a column for each probe."""
        h = _mix(keys + np.arange(level, level + 1, dtype=np.uint64) * _ODD[0])
        step = (h >> np.uint64(40)) | np.uint64(1)
        return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: probes go on while the next level's event is there."""
        if len(keys) > PROBED:
            return np.concatenate([self.levels(keys[i:i + PROBED]) for i in range(0, len(keys), PROBED)])
        out = np.zeros(len(keys), np.int64)
        segment = self.segment_of(keys, len(self.bits))
        left, level = np.arange(len(keys)), 0
        while len(left):
            level += 1
            at = self.places(keys[left], level)
            there = ((self.bits[segment[left, None], at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)
            left = left[there]
            out[left] = level
        return out


def level_of(count, least: float):
    """The level of a count, from 1 for the least that is held."""
    return np.floor(np.log(np.asarray(count, float) / least) / np.log(BASE) + 1e-9).astype(np.int64) + 1


def value_of(level: np.ndarray, least: float) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    return np.where(level > 0, least * BASE ** (level - 0.5), 0.0)


def build_filter(counts: DataFrame, least: float) -> Filter:
    """The filter of one part's (key, n), on the driver."""
    rows = counts.select("key", "n").toPandas()
    return Filter.filled(rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy(), least)


# --- the model -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    """A row of the blocks, opened."""

    vocabulary: np.ndarray
    places: np.ndarray
    n: np.ndarray
    train: np.ndarray

    @classmethod
    def of(cls, rows: pa.RecordBatch, i: int) -> Block:
        return cls(rows.column("vocabulary")[i].values.to_numpy().view(np.uint64), _unpacked(rows.column("tokens")[i].as_py()),
                   rows.column("n")[i].values.to_numpy().astype(np.int64), np.array(rows.column("train")[i].as_py(), bool))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, at, number): the different pairs, the tokens that end one, and its number.  No pair begins with an end."""
        inner = np.ones(len(self.places), bool)
        inner[np.cumsum(self.n) - 1] = False
        at = np.flatnonzero(inner) + 1
        keys, number = np.unique(_pair(self.vocabulary[self.places[at - 1]], self.vocabulary[self.places[at]]), return_inverse=True)
        return keys, at, number


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): the keys' order by part, and where each part ends in it."""
    part = ((_mix(keys ^ _ODD[1]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    return order, np.cumsum(np.bincount(part, minlength=parts))


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values``, cut at ``ends``."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int64)
    cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    return cut.cast(pa.binary())


def _asked(parts: int):
    """A batch function: each block's n-grams with their training counts, a row for each part."""
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in given:
            for i in range(rows.num_rows):
                block, number = Block.of(rows, i), rows.column("block")[i].as_py()
                keys, at, pair = block.pairs()
                counts = np.bincount(pair[np.repeat(block.train, block.n)[at]], minlength=len(keys))
                columns = [pa.array(np.arange(parts, dtype=np.int32)), pa.array(np.full(parts, number, np.int64))]
                for k, n in ((block.vocabulary, rows.column("counts")[i].values.to_numpy()), (keys, counts)):
                    order, ends = _dealt(k, parts)
                    columns += [_binaries(k[order], ends), _binaries(n[order].astype(np.uint32), ends)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ASKED.split(", ")])

    return batches


def _summed(rows: pa.Table, keys: str, counts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, number, ends): different keys and their total counts; each row's keys as numbers, and where rows end."""
    each = [np.frombuffer(x, np.uint64) for x in rows.column(keys).to_pylist()]
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column(counts).to_pylist()])
    different, number = np.unique(np.concatenate(each), return_inverse=True)
    total = np.bincount(number, n, len(different)).astype(np.int64)
    return different, total, number, np.cumsum([len(x) for x in each])


def _answers(rows: pa.Table) -> pa.Table:
    """A part's filter is filled and probed; a row without a block has the part's sums."""
    words, n, word, word_ends = _summed(rows, "words", "word_counts")
    pairs, n2, pair, pair_ends = _summed(rows, "pairs", "pair_counts")
    made = Filter.filled(np.concatenate([words, pairs]), np.concatenate([n, n2]), LEAST)
    seen, part = n[n > 0], rows.column("part")[0].as_py()
    size, names = rows.num_rows, [c.split()[0] for c in ANSWERS.split(", ")]
    out = [pa.array(np.full(size, part, np.int32)), rows.column("block").combine_chunks(),
           _binaries(made.levels(words).astype(np.uint8)[word], word_ends), _binaries(n[word], word_ends),
           _binaries(made.levels(pairs).astype(np.uint8)[pair], pair_ends)]
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    out = pa.Table.from_arrays([*out, *(pa.nulls(size, kind) for kind in kinds)], names=names)
    row = [part, None, None, None, None, int(seen.sum()), len(seen), float(value_of(level_of(seen, LEAST), LEAST).sum())]
    return pa.concat_tables([out, pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, out.schema, strict=True)],
                                                       schema=out.schema)])


@dataclass(frozen=True)
class Model:
    """The sums that make probabilities of the filter's counts."""

    parts: int
    tokens: int
    distinct: int
    held: float
    """Sum of the counts of words, as the filter gives them back."""

    def words(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words.  Words without a count share that of half a token."""
        total = self.tokens + 0.5
        return np.where(counts > 0, counts * (self.tokens / total / max(self.held, 1e-9)), 0.5 / total)

    def score(self, block: Block, word_levels: np.ndarray, pair_levels: np.ndarray) -> np.ndarray:
        """log10 probabilities of all tokens, from the filter's levels in the order of parts.

        After a word that the filter holds, the pair's relative frequency is mixed with the
        word's probability.
        """
        keys, at, number = block.pairs()
        counts, found = np.empty(len(block.vocabulary)), np.empty(len(keys))
        counts[_dealt(block.vocabulary, self.parts)[0]] = value_of(word_levels, LEAST)
        found[_dealt(keys, self.parts)[0]] = value_of(pair_levels, LEAST)
        p = self.words(counts)[block.places]
        first, found, alone = counts[block.places[at - 1]], found[number], p[at]
        relative = np.minimum(found / np.maximum(first, 1), 1.0)
        p[at] = np.where(first > 0, PAIR_WEIGHT * relative + (1 - PAIR_WEIGHT) * alone, alone)
        return np.log10(p)


def read(documents: DataFrame) -> DataFrame:
    """Blocks: a stage table of ``documents`` (doc_id, text, train)."""
    return stage(narrow(documents, {"doc_id": "long", "text": "string", "train": "boolean"}).mapInArrow(_blocks, BLOCK),
                 "blocks", compression="zstd")


def train(blocks: DataFrame) -> tuple[DataFrame, Model]:
    """(answers, model): what the filter of the training documents says to each block, and the sums.

    All statistics are over all training documents and all their words and pairs.  A block
    has an n-gram once, so an n-gram's part gets it from each block, not from each occurrence.
    """
    total = F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
    parts = max(LEAST_PARTS, -(-blocks.agg(total).first()[0] // PART_TOKENS))
    asked = blocks.select("block", "train", "n", "vocabulary", "counts", "tokens").mapInArrow(_asked(parts), ASKED)
    answers = stage(asked.groupBy("part").applyInArrow(_answers, ANSWERS), "answers", compression="zstd")
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct", "held")]).first()
    return answers, Model(parts, *sums)


def score(blocks: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document.

    ``base_score`` is of exact counts.  Each block is joined with the answers to it, whose
    number its size bounds.
    """
    by_block = (answers.filter(F.col("block").isNotNull()).groupBy("block")
                .agg(F.sort_array(F.collect_list(F.struct("part", "words", "exact", "pairs"))).alias("answers")))
    rows = blocks.drop("counts").join(by_block.select("block", *[F.col(f"answers.{c}").alias(f"{c}_by_part") for c in
                                                                 ("words", "exact", "pairs")]), "block")

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in given:
            for i in range(part.num_rows):
                block = Block.of(part, i)
                words, counts, pairs = (np.frombuffer(b"".join(part.column(f"{c}_by_part")[i].as_py()), kind) for c, kind in
                                        (("words", np.uint8), ("exact", np.int64), ("pairs", np.uint8)))
                exact = np.empty(len(counts), np.int64)
                exact[_dealt(block.vocabulary, model.parts)[0]] = counts
                starts = np.cumsum(block.n) - block.n
                base = np.log10((exact + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id")[i].values, pa.array(~block.train, pa.bool_()), pa.array(block.n),
                    pa.array(np.add.reduceat((exact > 0)[block.places].astype(np.int64), starts)),
                    pa.array(np.full(len(block.n), model.tokens, np.int64)),
                    pa.array(np.add.reduceat(base[block.places], starts)),
                    pa.array(np.add.reduceat(model.score(block, words, pairs), starts))], names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, n_tokens long, n_known long, "
                                    "train_tokens long, base_score double, score double")


def language_model_scores(documents: DataFrame) -> DataFrame:
    """Scores of all ``documents`` (doc_id, text, train), learned from those with ``train``.

    Defined results: null, empty and wordless texts are the end token alone; repeated rows are
    scored each and count each; without training documents every probability is that of a rare
    word; an empty table gives no row; other columns are not carried along.
    """
    blocks = read(documents)
    return score(blocks, *train(blocks))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned outside the held-out fold."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 5) != 1).alias("train"))
    return language_model_scores(docs)
