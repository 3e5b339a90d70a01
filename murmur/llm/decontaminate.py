"""Benchmark decontamination by suffix arrays of the training texts.

Training texts are read in shards.  A shard's suffix array sorts the word positions at which a
benchmark text could match, by the words that follow; every suffix of every benchmark text is
then looked up by binary search.  Neighbouring hits on one diagonal join into the longest
verbatim matches and their places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm.common import load, narrow

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
"""Words of lower-cased UTF-8 bytes: letters a-z, digits and everything beyond ASCII."""
WINDOW = 10
SHARD_BYTES = 8 << 20
"""Text in a shard; a single longer text is a shard of its own."""
BLOCK_BYTES = 16 << 20
"""Benchmark text that is broadcast at once; more of it takes more passes."""
RESULT = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>,longest:int>"


def words_of(text: str | None) -> list[bytes]:
    return WORD((text or "").encode("utf-8", "replace").lower())


@dataclass(frozen=True)
class TestSuffixes:
    """Suffixes of benchmark texts, cut to the window: words as numbers, from 1, big-endian."""

    numbers: dict[bytes, int]
    items: list[str]
    item: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    first: np.ndarray
    last: np.ndarray
    window: int

    @staticmethod
    def of(rows: list[tuple[str, str | None]], window: int = WINDOW) -> TestSuffixes:
        numbers: dict[bytes, int] = {}
        item, offset, length, keys = [], [], [], []
        for i, (_, text) in enumerate(rows):
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1)) if ids else ():
                part = ids[at:at + window]
                item.append(i)
                offset.append(at)
                length.append(len(part))
                keys.append(part + [0] * (window - len(part)))
        length = np.array(length, np.int64)
        keys = np.array(keys, ">u4").reshape(-1, window)
        tail = np.arange(window) >= length[:, None]
        return TestSuffixes(numbers, [name for name, _ in rows], np.array(item, np.int64), np.array(offset, np.int64),
                            length, _sortable(keys), _sortable(np.where(tail, 0xFFFFFFFF, keys)), window)


def _sortable(keys: np.ndarray) -> np.ndarray:
    keys = np.ascontiguousarray(keys, ">u4")
    return keys.view(f"S{4 * keys.shape[1]}").ravel()


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) - np.repeat(before - starts, sizes)


def suffix_array(ids: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffix keys and their positions; a suffix begins with ``least`` benchmark words at least."""
    known = np.concatenate([[False], ids > 0, [False]])
    turns = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = turns[::2], turns[1::2]
    enough = ends - starts >= least
    places = _ranges(starts[enough], ends[enough] - least + 1)
    padded = np.concatenate([ids, np.zeros(window, ids.dtype)])
    keys = _sortable(padded[places[:, None] + np.arange(window)])
    order = np.argsort(keys, kind="stable")
    return keys[order], places[order]


def search(texts: list[str | None], tests: TestSuffixes) -> list[dict]:
    """For each text: words, spans of words in matches, items matched, words of the longest match."""
    look, parts, sizes = tests.numbers.get, [], []
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter(map(look, words, repeat(0)), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))     # no match goes from one text into the next
        sizes.append(len(words))
    ids = np.concatenate([np.zeros(0, np.int64), *parts])
    out = [{"n_words": n, "spans": [], "items": [], "longest": 0} for n in sizes]
    if not len(tests.first):
        return out
    keys, places = suffix_array(ids, tests.window, int(tests.length.min()))
    low = np.searchsorted(keys, tests.first, "left")
    high = np.searchsorted(keys, tests.last, "right")
    test = np.repeat(np.arange(len(low)), high - low)
    at = places[_ranges(low, high)]
    if not len(at):
        return out
    starts = np.cumsum([0, *[n + 1 for n in sizes]])
    doc = np.searchsorted(starts, at, "right") - 1
    item, length = tests.item[test], tests.length[test]
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + length, -1)
    hit = np.concatenate([[False], np.cumsum(edges)[:-1] > 0, [False]])
    turns = np.flatnonzero(hit[1:] != hit[:-1])
    for begin, end in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        d = int(np.searchsorted(starts, begin, "right")) - 1
        out[d]["spans"].append({"start": begin - int(starts[d]), "end": end - int(starts[d])})
    for d, i in np.unique(np.stack([doc, item], 1), axis=0).tolist():
        out[d]["items"].append(tests.items[i])
    # windows that follow each other in text and item are one longer match
    diagonal = at - tests.offset[test]
    order = np.lexsort((at, diagonal, item))
    breaks = np.flatnonzero((np.diff(item[order]) != 0) | (np.diff(diagonal[order]) != 0) | (np.diff(at[order]) != 1))
    first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(order) - 1]])
    for a, n in zip(order[first].tolist(), (at[order[last]] - at[order[first]] + length[order[last]]).tolist(), strict=True):
        out[doc[a]]["longest"] = max(out[doc[a]]["longest"], n)
    return out


def _joined(a: dict | None, b: dict) -> dict:
    """The matches of two passes over the same text."""
    if a is None:
        return b
    spans: list[dict] = []
    for span in sorted(a["spans"] + b["spans"], key=lambda s: (s["start"], s["end"])):
        if spans and span["start"] <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], span["end"])
        else:
            spans.append(dict(span))
    return {"n_words": b["n_words"], "spans": spans, "items": a["items"] + b["items"],
            "longest": max(a["longest"], b["longest"])}


def _pass(df: DataFrame, shared, text: str, to: str) -> DataFrame:
    """One block of the benchmark against all texts; shards are read, searched and passed on."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != to], T.StructField(to, T._parse_datatype_string(RESULT))])
    kept = [f.name for f in schema.fields[:-1]]
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                      ("items", pa.list_(pa.string())), ("longest", pa.int32())])

    def searched(shard: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = iter(search([t for part in shard for t in part.column(text).to_pylist()], shared.value))
        for part in shard:
            before = part.column(to).to_pylist() if to in part.schema.names else [None] * part.num_rows
            result = [{**r, "items": sorted(r["items"])} for r in (_joined(b, next(found)) for b in before)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(result, kind)], names=[*kept, to])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = [], 0
        for part in parts:
            shard.append(part)
            size += part.nbytes
            if size >= SHARD_BYTES:
                yield from searched(shard)
                shard, size = [], 0
        if shard:
            yield from searched(shard)

    return df.mapInArrow(batches, schema)


def find_matches(docs: DataFrame, items: DataFrame, text: str = "text", to: str = "matches",
                 window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds the verbatim matches of each whole text with the benchmark ``items`` (item_id, text).

    The benchmark is measured first and broadcast in blocks of about ``block_bytes``, so any
    size takes bounded memory; each block is another narrow pass over the texts, and nothing is
    shuffled.  An item of fewer than ``window`` words is matched as a whole.

    Defined results: null, empty and wordless texts and items match nothing; items with the
    same text are all found, rows that repeat an item count once; repeated documents have equal
    matches; without items all matches are empty; other columns are carried along and one
    called ``to`` is replaced.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes) or 1
    df = docs.drop(to)
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] or "", r[1] or ""))
        df = _pass(df, spark.sparkContext.broadcast(TestSuffixes.of(rows, window)), text, to)
    return df.withColumn(to, F.col(to).withField("items", F.array_sort(F.array_distinct(F.col(f"{to}.items")))))


def n_hit(matches: str = "matches"):
    """Words inside any match."""
    return F.aggregate(F.col(f"{matches}.spans"), F.lit(0).cast("bigint"),
                       lambda n, s: n + (s["end"] - s["start"]).cast("bigint"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of all documents with all benchmark items."""
    docs = narrow(load(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string"})
    found = find_matches(docs, load(spark, sf_dir, "benchmark")).drop("text")
    return found.select(
        "doc_id", F.col("matches.n_words").alias("n_words"), n_hit().alias("n_hit"),
        F.size("matches.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("matches.items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"), F.col("matches.longest").alias("longest_match"))
