"""Removal of long byte strings that occur twice, by merged Burrows-Wheeler transforms.

1. Anchors.  Every window of ``width`` bytes has one anchor, the 32-byte gram with the least
   hash in it.  Equal windows have equal anchors at equal places, so windows are compared only
   with those of the same anchor; the windows of one anchor and the bytes that they span are a
   context.  An anchor that occurs once has no repeats, and equal contexts repeat each other.
2. Merging.  The contexts that are left are sorted in shards: a shard's suffixes over symbols
   of ``STEP`` bytes give its Burrows-Wheeler transform.  Transforms of two shards are merged
   by refining their interleave: each round reads the transforms in the current order and
   deals their entries out by symbol, which sorts suffixes by one more symbol, without
   comparing any.  Entries that still share a block after as many rounds as a window has
   symbols have a common prefix of a window's length: the repeated intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.common import load, narrow, small_side, stage

WIDTH = 400
"""Bytes of a string that may not occur twice."""
GRAM = 32
CHUNK_BYTES = 2 << 20
"""Text whose anchors are found at once; a longer text is cut, with a window's overlap."""


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_LEVELS = [int(x) | 1 for x in mix(np.arange(300, 320, dtype=np.uint64))]


def string_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of ``width`` bytes, put together from powers of two."""
    part, out, done, level = _BYTE[data], None, 0, 0
    while True:
        size = 1 << level
        if width & size:
            if out is None:
                out = part.copy()
            else:
                n = len(data) - done - size + 1
                out = out[:n] * np.uint64(_LEVELS[-1 - level])
                out += part[done:done + n]
            done += size
        if size * 2 > width:
            return mix(out)
        n = len(part) - size
        nearer = part[:n] * np.uint64(_LEVELS[level])
        nearer += part[size:size + n]
        part, level = nearer, level + 1


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:len(values) - (width - size)], values[width - size:]) if width > size else values


def anchors(data: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of each run of windows with the same anchor."""
    raw = np.frombuffer(data, np.uint8)
    grams = string_hashes(raw, GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(grams & ~np.uint64((1 << 24) - 1) | place, width - GRAM + 1)
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    turns = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return grams[at[turns]], turns, np.diff(np.append(turns, len(at)))


def pieces(data: bytes, width: int = WIDTH) -> Iterator[tuple[int, bytes]]:
    """(start, bytes) of pieces that have each window once."""
    for start in range(0, max(1, len(data) - width + 1), CHUNK_BYTES):
        yield start, data[start:start + CHUNK_BYTES + width - 1]


# --- merging transforms ----------------------------------------------------------------------

STEP = 50
"""Bytes of a symbol; a window has eight."""
SHARD_BYTES = 512 << 10
SET_BYTES = 1 << 20
"""Contexts that are sorted together: whole anchors, up to this size."""
HOT_BYTES = 4 << 20
"""Contexts of one anchor beyond which its windows are counted by Spark instead."""


def radix_order(codes: np.ndarray) -> np.ndarray:
    """The stable order of numbers below 2**32, by two passes over 16 bits."""
    order = np.argsort(codes.astype(np.uint16), kind="stable")
    if len(codes) and codes.max() >= 1 << 16:
        order = order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1, in the order of the keys."""
    return np.unique(keys, return_inverse=True)[1] + 1


class Transform:
    """The Burrows-Wheeler transform of strings of symbols, in the order of their suffixes.

    ``before`` is the symbol before each suffix (0: none), ``place`` the suffix's place in the
    text (-1 for the ends of the strings, which come first), ``ends`` their number.
    """

    def __init__(self, before: np.ndarray, place: np.ndarray, ends: int, block: np.ndarray):
        self.before, self.place, self.ends, self.block = before, place, ends, block

    @classmethod
    def of(cls, symbols: np.ndarray, following: np.ndarray, place: np.ndarray, rounds: int) -> Transform:
        """Sort one shard's suffixes by their first ``rounds`` symbols, doubling the prefix.

        ``following`` is the index of the next symbol of the same string, -1 at its end.
        """
        n = len(symbols)
        following = np.where(following < 0, n, following)
        rank, step, size = np.append(dense(symbols), 0), np.append(following, n), 1
        while size < rounds:
            rank = np.append(dense(rank[:n] * (n + 1) + rank[step[:n]]), 0)
            step = step[step]
            size *= 2
        order = radix_order(rank[:n])
        previous = np.full(n + 1, -1, np.int64)
        previous[following] = np.arange(n)           # of the ends, only the last is right
        last = np.flatnonzero(following == n)
        before = np.where(previous[:n] >= 0, symbols[previous[:n]], np.uint64(0))
        rank = rank[:n][order]
        return cls(np.concatenate([symbols[last], before[order]]),
                   np.concatenate([np.full(len(last), -1), place[order]]), len(last),
                   np.concatenate([np.arange(len(last)), len(last) - 1 + rank]))

    def merge(self, other: Transform, rounds: int) -> Transform:
        """Both transforms in one, by ``rounds`` refinements of their interleave.

        The interleave says of each place in the common order which of the two it comes from.
        Reading both transforms along it and dealing the places out by the symbol before them,
        in stable order, sorts by one symbol more.  Places are in one block as long as their
        suffixes agree in all symbols so far: a block's age is the common prefix.
        """
        code = np.unique(np.concatenate([self.before, other.before]), return_inverse=True)[1].astype(np.uint32)
        none = np.uint32(0)
        if not ((self.before == 0).any() or (other.before == 0).any()):
            code += np.uint32(1)
        codes = (code[:len(self.before)], code[len(self.before):])
        ends = np.concatenate([np.zeros(self.ends, bool), np.ones(other.ends, bool)])
        source = np.concatenate([np.zeros(len(codes[0]), bool), np.ones(len(codes[1]), bool)])
        block = np.zeros(len(source), np.int64)
        for _ in range(rounds):
            read = np.empty(len(source), np.uint32)
            read[~source], read[source] = codes
            inner = np.flatnonzero(read != none)
            inner = inner[radix_order(read[inner])]
            symbol, old = read[inner], block[inner]
            new = np.empty(len(inner), bool)
            new[:1] = True
            new[1:] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
            source = np.concatenate([ends, source[inner]])
            block = np.concatenate([np.arange(len(ends)), len(ends) - 1 + np.cumsum(new)])
        before, place = np.empty(len(source), np.uint64), np.empty(len(source), np.int64)
        before[~source], before[source] = self.before, other.before
        place[~source], place[source] = self.place, other.place
        return Transform(before, place, len(ends), block)

    def repeated(self) -> np.ndarray:
        """Places whose block has another place: suffixes with a common prefix of all rounds."""
        many = np.bincount(self.block)[self.block] > 1
        return self.place[many & (self.place >= 0)]


def repeated_windows(texts: list[bytes], width: int = WIDTH, step: int = STEP,
                     shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each text, a mark for each window that occurs twice among all of them.

    Symbols that occur once are taken out first: no window that holds one is repeated.  Parts
    that are left and are equal repeat each other; only one of them is sorted.
    """
    rounds = width // step
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    marks = [np.zeros(max(0, len(t) - width + 1), bool) for t in texts]
    if len(data) < width:
        return marks
    symbol = string_hashes(data, step) | np.uint64(1)           # 0 stands for no symbol
    order = np.argsort(symbol)
    same = symbol[order[1:]] == symbol[order[:-1]]
    again = np.zeros(len(symbol), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    alive = again[:len(data) - width + 1].copy()
    for k in range(1, rounds):
        alive &= again[k * step:k * step + len(alive)]
    parts: dict[bytes, list[tuple[int, int]]] = {}
    for i in range(len(texts)):
        mine = alive[start[i]:start[i] + len(marks[i])]
        if not mine.any():
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            parts.setdefault(texts[i][a:b - 1 + width], []).append((i, a))
    shards: list[Transform] = []
    symbols, following, place, owners, base, held = [], [], [], [], 0, 0

    def close() -> None:
        nonlocal symbols, following, place, held
        if symbols:
            shards.append(Transform.of(np.concatenate(symbols), np.concatenate(following), np.concatenate(place), rounds))
        symbols, following, place, held = [], [], [], 0

    for part, where in parts.items():
        i, a = where[0]
        n = len(part) - step + 1
        at = held + np.arange(n)
        symbols.append(symbol[start[i] + a:start[i] + a + n])
        following.append(np.where(np.arange(n) + step < n, at + step, -1))
        place.append(base + np.arange(n))
        owners.append((part, base))
        base, held = base + n, held + n
        if held >= shard_bytes:
            close()
    close()
    while len(shards) > 1:
        shards = [shards[k].merge(shards[k + 1], rounds) if k + 1 < len(shards) else shards[k]
                  for k in range(0, len(shards), 2)]
    found = np.zeros(base + 1, bool)
    if shards:
        found[shards[0].repeated()] = True
    for part, offset in owners:
        windows = len(part) - width + 1
        for i, a in parts[part]:
            marks[i][a:a + windows] |= True if len(parts[part]) > 1 else found[offset:offset + windows]
    return marks


# --- the corpus ------------------------------------------------------------------------------


def _runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text) to the runs of windows of each text: (doc_id, h, anchor, context, first, n)."""
    for part in parts:
        owner, out, context = [], [], []
        texts = part.column("text").to_pylist()
        for row, text in enumerate(texts):
            data = (text or "").encode("utf-8", "replace")
            if len(data) < WIDTH:
                continue
            for begin, piece in pieces(data):
                key, first, n = anchors(piece)
                out.append((key, first + begin, n))
                owner.append(np.full(len(key), row))
                context += [hashlib.blake2b(piece[a:a + k + WIDTH - 1], digest_size=8).digest()
                            for a, k in zip(first.tolist(), n.tolist(), strict=True)]
        if not out:
            continue
        take = pa.array(np.concatenate(owner))
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id").take(take), part.column("h").take(take),
            pa.array(np.concatenate([k for k, _, _ in out]).view(np.int64)),
            pa.array(np.frombuffer(b"".join(context), np.int64)),
            pa.array(np.concatenate([f for _, f, _ in out]).astype(np.int32)),
            pa.array(np.concatenate([n for _, _, n in out]).astype(np.int32))],
            names=["doc_id", "h", "anchor", "context", "first", "n"])


def _contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their lists of contexts to (anchor, context, data)."""
    for part in parts:
        rows = [(c["anchor"], c["context"], data[c["first"]:c["first"] + c["n"] + WIDTH - 1])
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True)
                for data in [text.encode("utf-8", "replace")] for c in wanted]
        for begin in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows[begin:begin + 4096], strict=True),
                                                                (pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["anchor", "context", "data"])


def _sorted_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, data) in order of anchors to the repeated windows: (anchor, context, begin, stop)."""
    def done(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (anchor, context, _), mark in zip(rows, repeated_windows([r[2] for r in rows]), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]])))
            out += [(anchor, context, a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          names=["anchor", "context", "begin", "stop"])

    rows, size = [], 0
    for part in parts:
        for row in zip(*(part.column(c).to_pylist() for c in ("anchor", "context", "data")), strict=True):
            if size >= SET_BYTES and row[0] != rows[-1][0]:
                yield done(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[2])
    if rows:
        yield done(rows)


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, data) to a digest of each window: (anchor, context, begin, digest)."""
    for part in parts:
        for anchor, context, data in zip(*(part.column(c).to_pylist() for c in ("anchor", "context", "data")), strict=True):
            digest = string_hashes(np.frombuffer(data, np.uint8), WIDTH).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(digest), anchor)), pa.array(np.full(len(digest), context)),
                pa.array(np.arange(len(digest), dtype=np.int32)), pa.array(digest)],
                names=["anchor", "context", "begin", "digest"])


def _attach(texts: DataFrame, rows: DataFrame, name: str, how: str) -> DataFrame:
    """``texts`` with the rows of each as a list: broadcast if a count of the rows bounds it."""
    lists = rows.groupBy("doc_id", "h").agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in ("doc_id", "h")]))
                                            .alias(name))
    return texts.join(F.broadcast(lists) if rows.count() <= 1_000_000 else lists, ["doc_id", "h"], how)


def find_repeats(texts: DataFrame) -> DataFrame:
    """(doc_id, h, start, stop): bytes of windows that occur twice, for ``texts`` (doc_id, h, text)."""
    runs = stage(texts.mapInArrow(_runs, "doc_id long, h long, anchor long, context long, first int, n int"), "runs")
    several = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("anchor")
    runs = stage(runs.join(several, "anchor"), "repeated-anchors")
    contexts = runs.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("copies"),
                                                     F.min(F.struct("doc_id", "h", "first", "n")).alias("one"))
    contexts = stage(contexts, "contexts")
    each = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("one.n") + (WIDTH - 1)).alias("size"))
    each = each.filter("kinds > 1")
    wanted = contexts.select("anchor", "context", "one.*").join(each, "anchor")
    cut = stage(_attach(texts, stage(wanted, "wanted"), "wanted", "inner").mapInArrow(
        _contexts, "anchor long, context long, data binary").join(each.select("anchor", "size"), "anchor"), "context-bytes")
    common = (cut.filter(F.col("size") <= HOT_BYTES).select("anchor", "context", "data")
              .repartition("anchor").sortWithinPartitions("anchor")
              .mapInArrow(_sorted_sets, "anchor long, context long, begin int, stop int"))
    # an anchor with too many contexts for a task: equal windows meet by their digests
    windows = (cut.filter(F.col("size") > HOT_BYTES).select("anchor", "context", "data")
               .mapInArrow(_digests, "anchor long, context long, begin int, digest long"))
    twice = windows.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    hot = windows.join(twice, ["anchor", "digest"]).select("anchor", "context", "begin", (F.col("begin") + 1).alias("stop"))
    copies = contexts.filter("copies > 1").select("anchor", "context", F.lit(0).alias("begin"), F.col("one.n").alias("stop"))
    marked = stage(common.union(hot).union(copies), "repeated-windows")
    return runs.join(marked, ["anchor", "context"]).select(
        "doc_id", "h", (F.col("first") + F.col("begin")).alias("start"),
        (F.col("first") + F.col("stop") + (WIDTH - 1)).alias("stop"))


def _cut(parts: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        left, spans = [], []
        for text, wanted in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
            data, at, rest, joined = (text or "").encode("utf-8", "replace"), 0, [], []
            for a, b in sorted((s["start"], s["stop"]) for s in wanted or ()):
                if joined and a <= joined[-1]["stop"]:
                    joined[-1]["stop"] = max(joined[-1]["stop"], b)
                else:
                    joined.append({"start": a, "stop": b})
            for s in joined:
                rest.append(data[at:s["start"]])
                at = s["stop"]
            left.append(b"".join([*rest, data[at:]]))
            spans.append(joined)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(spans, kind), pa.array(left, pa.binary())],
                                         names=[*kept, "spans", "kept"])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row of ``documents`` (doc_id, text).

    ``spans`` are the maximal runs of bytes that lie in a string of 400 bytes which also starts
    anywhere else, in the same document or another; ``kept`` are the other bytes.  All copies
    go, the first as well.  Exact up to collisions of 64-bit hashes among strings with equal
    anchors.

    Defined results: null texts are empty; texts of fewer than 400 bytes keep all; repeated
    rows, also with equal ids, are occurrences each; a cut may fall within a character, so
    ``kept`` is binary; a very long text is worked on in pieces; an empty table gives no row;
    other columns are not carried along.
    """
    docs = narrow(documents, {"doc_id": "long", "text": "string"}).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1 << 62)))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    spans = stage(find_repeats(texts).distinct(), "spans")
    whole = _attach(texts, _merged(spans), "spans", "left").select("doc_id", "text", "spans")
    whole = whole.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kept = ["doc_id", "n_bytes"]
    out = whole.mapInArrow(lambda parts: _cut(parts, kept),
                           "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-1 << 62)))


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of a text that overlap or touch as one, before they are sent to the texts."""
    order = Window.partitionBy("doc_id", "h").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    run = new.withColumn("run", F.sum("new").over(order))
    return stage(run.groupBy("doc_id", "h", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run"),
                 "merged-spans")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 400 bytes in all documents."""
    out = remove_repeats(load(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["stop"] - s["start"]).cast("bigint"))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
