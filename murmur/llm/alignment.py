"""Alignment of two tokenizers over the same bytes: groups of tokens that end together, and their links.

A byte range of a text gives a *fragment*: the tokens up to its first common end (open prefix, as
their group may have begun before), closed groups, and the tokens after the last common end (open
suffix).  Fragments of neighbouring ranges compose associatively, so ranges of a long text are
aligned by different tasks and composed in a tree by Spark.

Both vocabularies cut a text before a space between two other characters, so such units are encoded
alone and their alignments remembered.  A unit is longer than a range only if it holds no such space.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.common import load, prepare, stage

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 64 << 10
"""Byte range of a fragment; longer texts are aligned by several tasks."""
FAN = 16
"""Fragments composed at once."""
KNOWN_UNITS = 100_000
"""Units that a worker remembers before it begins anew; results don't depend on it."""
RUN = 64
"""Units that are encoded in one string."""
BLOCK_PAIRS = 2_000_000
"""Pairs of ids (summed over documents) that are counted together before the shuffle."""
BATCH_BYTES = 1 << 19
"""Text that is aligned at once."""
_UNIT = re.compile(r"(?<=\S) (?=\S)")


def byte_level() -> dict[str, int]:
    """Character -> byte of a byte-level vocabulary: printable bytes stand for themselves, others for 256 and on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Open(NamedTuple):
    """Ids of tokens whose group isn't known as a whole yet."""

    a: tuple[int, ...] = ()
    b: tuple[int, ...] = ()

    def __add__(self, other: Open) -> Open:  # type: ignore[override]
        return Open(self.a + other.a, self.b + other.b)


def _sums(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, rising; sum of the numbers of each)."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(numbers[order], first) if len(first) else numbers[:0]


class Closed(NamedTuple):
    """Whole groups: their text (each ends with a semicolon), counts, and id pairs with their numbers of links.

    Pairs are in arrays of different rising pairs; a pair may be in several of them.
    """

    text: tuple[bytes, ...] = ()
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    pairs: tuple[np.ndarray, ...] = ()
    times: tuple[np.ndarray, ...] = ()

    def __add__(self, other: Closed) -> Closed:  # type: ignore[override]
        return Closed(*(x + y for x, y in zip(self, other, strict=True)))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(different pairs, rising; links of each)."""
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.pairs) == 1:
            return self.pairs[0], self.times[0]
        return _sums(np.concatenate(self.pairs), np.concatenate(self.times))


class Fragment(NamedTuple):
    """A byte range: open prefix, closed groups, open suffix.  Without a common end all is prefix."""

    ok: bool = True
    cut: bool = False
    prefix: Open = Open()
    closed: Closed = Closed()
    suffix: Open = Open()

    def then(self, other: Fragment, close) -> Fragment:
        """The two ranges as one; ``close`` makes a closed group of what lies open between common ends."""
        ok = self.ok and other.ok
        if not self.cut:
            return other._replace(ok=ok, prefix=self.prefix + other.prefix)
        between = self.suffix + other.prefix
        if not other.cut:
            return self._replace(ok=ok, suffix=between)
        closed = self.closed + (close(between) if between != Open() else Closed()) + other.closed
        return Fragment(ok, True, self.prefix, closed, other.suffix)


def _links(a_ends, b_ends) -> tuple[np.ndarray, np.ndarray]:
    """(A, B) numbers of tokens whose byte ranges overlap; ranges begin where the token before ends."""
    a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    first = np.searchsorted(b_ends, a_starts, "right")
    n = np.searchsorted(b_starts, a_ends, "left") - first
    return np.repeat(np.arange(len(n)), n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Ragged:
    """Lists of numbers one after the other, in arrays that grow."""

    def __init__(self):
        self.flat, self.n = np.zeros(1 << 16, np.int64), 0
        self.starts, self.rows = np.zeros(1 << 12, np.int64), 0

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        end, rows = self.n + len(values), self.rows + len(lengths)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(end, len(self.flat) // 2), np.int64)])
        if rows >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(rows, len(self.starts) // 2), np.int64)])
        self.flat[self.n:end] = values
        self.starts[self.rows + 1:rows + 1] = self.n + np.cumsum(lengths)
        self.n, self.rows = end, rows


def _take(lists: _Ragged, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the rows' lists one after the other, lengths)."""
    starts = lists.starts[rows]
    lengths = lists.starts[rows + 1] - starts
    at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    return lists.flat[at], lengths


class Aligner:
    """Both tokenizers and the alignments of units seen lately; a worker keeps one for all its tasks."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        to_byte = byte_level()
        names = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        self.a_bytes = [b""] * (names[-1][1] + 1)
        for name, i in names:
            self.a_bytes[i] = bytes(to_byte[c] for c in name) if all(c in to_byte for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))
        rules = json.loads(a_json)
        split = rules.get("pre_tokenizer") or {}
        self.cuts = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                     and not rules.get("normalizer") and not any("▁" in p.lstrip("▁") for p in pieces))
        # a token's text with what follows it: within its group, or at the end of its side of the group
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.texts = [b"%d%s" % (i, c) for size, marks in ((n, (b",", b"|")), (m, (b",", b";"))) for c in marks for i in range(size)]
        self.text_sizes = np.array(list(map(len, self.texts)))
        self.b_count = m
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pairs, self.ends_a, self.ends_b, self.ids_a, self.ids_b = (_Ragged() for _ in range(5))
        self.text: list[bytes] = []
        self.figures, self.used = _Ragged(), _Ragged()

    # --- units ---

    def units(self, text: str) -> list[str]:
        return _UNIT.split(text) if self.cuts else [text]

    def learn(self, units: set[str]) -> None:
        """Align the units that aren't known (each with a space before it)."""
        new = [u for u in units if u not in self.known]
        if len(self.known) + len(new) > KNOWN_UNITS and self.known:
            self.forget_rare()
            new = [u for u in units if u not in self.known]
        for begin in range(0, len(new), 1 << 16):
            self._learn(new[begin:begin + (1 << 16)])

    def forget_rare(self) -> None:
        """Keep the units met most often, half as many as may be known at most."""
        used = self.used.flat[:self.used.n]
        least = max(2, int(np.sort(used)[-min(KNOWN_UNITS // 2, len(used))]) + 1)
        rows = np.flatnonzero(used >= least)
        kept = [(x, *_take(x, rows)) for x in (self.pairs, self.ends_a, self.ends_b, self.ids_a, self.ids_b, self.figures)]
        names, texts = list(self.known), self.text
        self.forget()
        now = (self.pairs, self.ends_a, self.ends_b, self.ids_a, self.ids_b, self.figures)
        for lists, (_, values, lengths) in zip(now, kept, strict=True):
            lists.extend(values, lengths)
        self.used.extend(np.ones(len(rows), np.int64), np.ones(len(rows), np.int64))
        self.text = [texts[i] for i in rows.tolist()]
        self.known = {names[i]: k for k, i in enumerate(rows.tolist())}

    def _learn(self, new: list[str]) -> None:
        """Units are encoded many at once; one by one if space is at an end, or a vocabulary doesn't give a run back."""
        joined = [u for u in new if self.cuts and not (u[0].isspace() or u[-1].isspace())]
        runs = [joined[i:i + RUN] for i in range(0, len(joined), RUN)]
        texts = [" ".join(run) for run in runs]
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        good = [b"".join(map(self.a_bytes.__getitem__, x)) == (" " + t).encode() == b"".join(map(self.b_bytes.__getitem__, y))
                for t, x, y in zip(texts, a, b, strict=True)]
        units = [u for run, ok in zip(runs, good, strict=True) if ok for u in run]
        if units:
            ends = np.cumsum(np.fromiter((1 + len(u.encode()) for u in units), np.int64, len(units)))
            sides = []
            for ids, sizes in ((a, self.a_sizes), (b, self.b_sizes)):
                flat = np.array(list(chain.from_iterable(x for x, ok in zip(ids, good, strict=True) if ok)), np.int64)
                sides += [flat, np.bincount(np.searchsorted(ends, np.cumsum(sizes[flat])), minlength=len(units))]
            self._add(units, *sides, np.ones(len(units), np.int64))
        units = [u for u in new if not self.cuts or u[0].isspace() or u[-1].isspace()]
        units += [u for run, ok in zip(runs, good, strict=True) if not ok for u in run]
        if units:
            a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
            b = self.b.encode(units, num_threads=1)
            ok = [b"".join(map(self.a_bytes.__getitem__, x)) == (" " + u).encode() == b"".join(map(self.b_bytes.__getitem__, y))
                  for u, x, y in zip(units, a, b, strict=True)]
            sides = []
            for ids in (a, b):
                kept = [x if fine else [] for x, fine in zip(ids, ok, strict=True)]
                sides += [np.array(list(chain.from_iterable(kept)), np.int64), np.array(list(map(len, kept)), np.int64)]
            self._add(units, *sides, np.array(ok, np.int64))

    def _add(self, new: list[str], ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, ok: np.ndarray) -> None:
        """Remember units: their tokens (none of a unit that isn't given back), groups and links."""
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        unit_a, unit_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        # groups' texts: tokens by group, A before B
        last_a, last_b = np.diff(of_a, append=-1) != 0, np.diff(of_b, append=-1) != 0
        n, m = len(self.a_bytes), self.b_count
        marked = np.concatenate([ids_a + n * last_a, 2 * n + ids_b + m * last_b])
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        marked = marked[order]
        whole = b"".join(map(self.texts.__getitem__, marked.tolist()))
        ends = np.concatenate([[0], np.cumsum(self.text_sizes[marked])])[np.cumsum(n_a + n_b)].tolist()
        self.text += [whole[s:e] for s, e in zip([0, *ends], ends, strict=False)]
        at_a, at_b = _links(ends_a, ends_b)
        links = np.bincount(unit_a[at_a], minlength=len(new))
        groups = np.bincount(unit_a[last_a], minlength=len(new))
        self.pairs.extend(ids_a[at_a] * m + ids_b[at_b], links)
        begin = np.concatenate([[0], ends_a])[np.cumsum(n_a) - n_a]
        self.ids_a.extend(ids_a, n_a)
        self.ids_b.extend(ids_b, n_b)
        self.ends_a.extend(ends_a - begin[unit_a], n_a)
        self.ends_b.extend(ends_b - begin[unit_b], n_b)
        self.used.extend(np.zeros(len(new), np.int64), np.ones(len(new), np.int64))
        self.figures.extend(np.stack([n_a, n_b, groups, links, ok], 1).ravel(), np.full(len(new), 5))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))

    # --- fragments ---

    def whole_units(self, texts: list[list[str]]) -> list[Fragment]:
        """Fragments of many runs of whole units; each begins and ends at a common end."""
        self.learn(set().union(*texts))
        figures = self.figures.flat[:self.figures.n].reshape(-1, 5)
        sizes = np.array(list(map(len, texts)))
        rows = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64, sizes.sum())
        self.used.flat[:self.used.n] += np.bincount(rows, minlength=self.used.n)
        doc = np.repeat(np.arange(len(texts)), sizes)
        sums = np.zeros((len(texts), 5), np.int64)
        for i in range(5):
            sums[:, i] = np.bincount(doc, figures[rows, i], len(texts))
        # units that repeat within a text are looked up once
        both, often = np.unique(doc << 32 | rows, return_counts=True)
        pairs, lengths = _take(self.pairs, both & 0xFFFFFFFF)
        keys, times = _sums(np.repeat(both >> 32, lengths) << 40 | pairs, np.repeat(often, lengths))
        bounds = np.searchsorted(keys, np.arange(len(texts) + 1) << 40).tolist()
        keys &= (1 << 40) - 1
        names = list(map(self.text.__getitem__, rows.tolist()))
        ends = np.cumsum(sizes).tolist()
        out = []
        for i, (n_a, n_b, groups, links, ok) in enumerate(sums.tolist()):
            s, e = bounds[i], bounds[i + 1]
            text = b"".join(names[ends[i] - sizes[i]:ends[i]])
            out.append(Fragment(ok == sizes[i], True, Open(), Closed((text,), n_a, n_b, groups, links, (keys[s:e],), (times[s:e],)), Open()))
        return out

    def part_of_unit(self, unit: str, low: int, high: int) -> Fragment:
        """The fragment of the tokens that end above ``low`` and not above ``high`` bytes of a unit (its space is one)."""
        self.learn({unit})
        row = self.known[unit]
        if not self.figures.flat[5 * row + 4]:
            return Fragment(ok=False)
        sides = []
        for ids, ends in ((self.ids_a, self.ends_a), (self.ids_b, self.ends_b)):
            s, e = ids.starts[row], ids.starts[row + 1]
            ends_of = ends.flat[s:e]
            some = (ends_of > low) & (ends_of <= high)
            sides.append((ids.flat[s:e][some], ends_of[some]))
        (a, a_ends), (b, b_ends) = sides
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if low == 0:
            common = np.concatenate([[0], common])       # a unit begins at a common end
        if not len(common):
            return Fragment(prefix=Open(tuple(a.tolist()), tuple(b.tolist())))
        in_a, in_b = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        pieces = [Open(tuple(a[in_a == g].tolist()), tuple(b[in_b == g].tolist())) for g in range(len(common) + 1)]
        closed = reduce(Closed.__add__, map(self.close, pieces[1:-1]), Closed())
        return Fragment(True, True, pieces[0], closed, pieces[-1])

    def close(self, group: Open) -> Closed:
        """One whole group."""
        a, b = np.array(group.a, np.int64), np.array(group.b, np.int64)
        at_a, at_b = _links(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]))
        pairs, times = np.unique(a[at_a] * self.b_count + b[at_b], return_counts=True)
        text = b"%s|%s;" % (b",".join(b"%d" % i for i in group.a), b",".join(b"%d" % i for i in group.b))
        return Closed((text,), len(a), len(b), 1, len(at_a), (pairs,), (times,))

    def ranges(self, text: str, chunk_bytes: int) -> list[tuple[str, int, int]]:
        """Byte ranges of a long text: (whole units that a range touches, its bounds within them).

        Ranges are ``chunk_bytes`` long wherever units allow; of the borders within one unit only
        the first is kept, so a unit is touched by two ranges at most.
        """
        units = self.units(text)
        ends = np.cumsum([1 + len(u.encode()) for u in units])
        starts = np.concatenate([[0], ends[:-1]])
        borders = np.arange(chunk_bytes, ends[-1], chunk_bytes)
        inside = np.searchsorted(ends, borders, "left")  # the unit that a border lies in or ends
        borders = borders[np.concatenate([[True], np.diff(inside) > 0])] if len(borders) else borders
        out = []
        for low, high in zip([0, *borders.tolist()], [*borders.tolist(), int(ends[-1])], strict=True):
            first, last = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high, "left"))
            base = int(starts[first])
            out.append((" ".join(units[first:last + 1]), low - base, high - base))
        return out

    def range_fragment(self, text: str, low: int, high: int) -> Fragment:
        """The fragment of one of ``ranges``."""
        units = self.units(text)
        end, parts, whole = 0, [], []
        for u in units:
            start, end = end, end + 1 + len(u.encode())
            if low <= start and end <= high:
                whole.append(u)
                continue
            if whole:
                parts += self.whole_units([whole])
                whole = []
            if low < end and start < high:
                parts.append(self.part_of_unit(u, max(low - start, 0), high - start))
        if whole:
            parts += self.whole_units([whole])
        return self.compose(parts)

    def compose(self, parts: list[Fragment]) -> Fragment:
        return reduce(lambda x, y: x.then(y, self.close), parts) if parts else Fragment()


# --- rows ---------------------------------------------------------------------------------------

class Tokenizers:
    """Contents of both vocabulary files, broadcast; files have a fixed size.

    A worker has one aligner, and keeps it for all queries with the same files.
    """

    _made: dict[str, Aligner] = {}

    def __init__(self, spark: SparkSession, a_path: str | None = None, b_path: str | None = None):
        import public_tokenizers

        with open(a_path or public_tokenizers.path(TOKENIZER_A), encoding="utf-8") as a, \
                open(b_path or public_tokenizers.path(TOKENIZER_B), "rb") as b:
            files = a.read(), b.read()
        self.shared = spark.sparkContext.broadcast(files)
        self.key = hashlib.sha256(files[0].encode() + files[1]).hexdigest()

    def get(self) -> Aligner:
        made = Tokenizers._made
        if self.key not in made:
            made.clear()
            made[self.key] = Aligner(*self.shared.value)
        return made[self.key]


RECORD = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "block long, pairs binary, times binary")
RANGE = "doc_id long, document string, chunk int, chunks int, text string, low long, high long"
FRAGMENT = ("doc_id long, document string, chunk int, ok boolean, cut boolean, prefix_a array<int>, prefix_b array<int>, "
            "suffix_a array<int>, suffix_b array<int>, n_a long, n_b long, n_groups long, n_links long, "
            "text binary, pairs array<long>, times array<long>")


def _names(kind: str) -> list[str]:
    return [c.split()[0] for c in kind.split(", ")]


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
          "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _batch(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [c.split() for c in kind.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)],
                                      names=[name for name, _ in fields])


def _bounded(part: pa.RecordBatch) -> Iterator[list[tuple]]:
    """The (id, text) rows of a batch, so many at once that their texts are of a bounded size (one at least)."""
    some, size = [], 0
    for begin in range(0, part.num_rows, 64):
        for row in zip(*(c.to_pylist() for c in part.slice(begin, 64).columns), strict=True):
            some.append(row)
            size += len(row[1] or "")
            if size >= BATCH_BYTES:
                yield some
                some, size = [], 0
    if some:
        yield some


class _Blocks:
    """Numbers for documents that stand together, one for ``BLOCK_PAIRS`` pairs."""

    def __init__(self):
        self.left = 0

    def next(self, pairs: int) -> int:
        if self.left <= 0:
            self.number, self.left = uuid.uuid4().int >> 65, BLOCK_PAIRS
        self.left -= pairs
        return self.number


def _record(doc_id, fragment: Fragment, blocks: _Blocks) -> tuple:
    """A document's row; pairs are differences of 32 bits (64 if needed), times as wide as needed."""
    if not fragment.ok or not fragment.closed.n_a:
        return doc_id, 0, 0, 0, 0, "", blocks.next(0), b"", b""
    closed = fragment.closed
    pairs, times = closed.links()
    steps = np.diff(pairs, prepend=0)
    steps = steps.astype(np.uint32 if steps.max(initial=0) < 1 << 32 else np.uint64)
    width = next(w for w in (np.uint8, np.uint16, np.uint32, np.uint64) if times.max(initial=0) <= np.iinfo(w).max)
    digest = hashlib.sha256(b"".join(closed.text)[:-1]).hexdigest()
    return (doc_id, closed.n_a, closed.n_b, closed.n_groups, closed.n_links, digest, blocks.next(len(pairs)),
            steps.tobytes(), len(pairs).to_bytes(4, "little") + times.astype(width).tobytes())


def _unpack(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = int.from_bytes(times[:4], "little")
    wide = np.frombuffer(times, f"u{(len(times) - 4) // n}", offset=4)
    return np.cumsum(np.frombuffer(pairs, f"u{len(pairs) // n}").astype(np.int64)), wide.astype(np.int64)


def align(docs: DataFrame, tokenizers: Tokenizers, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, block, pairs, times), written.

    Texts of up to ``chunk_bytes`` are one fragment.  Longer ones become rows of byte ranges, which
    Spark deals out, and whose fragments are composed ``FAN`` at a time, one grouping a level.
    """
    def cut_or_align(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, blocks = tokenizers.get(), _Blocks()
        for part in parts:
            for some in _bounded(part):
                short, rows = [], []
                for doc_id, text in some:
                    if len((text or "").encode()) < chunk_bytes:
                        short.append((doc_id, aligner.units(text) if text else []))
                        continue
                    ranges, document = aligner.ranges(text, chunk_bytes), uuid.uuid4().hex
                    rows += [(*[None] * len(_names(RECORD)), doc_id, document, i, len(ranges), *r) for i, r in enumerate(ranges)]
                none = (None,) * len(_names(RANGE))
                fragments = aligner.whole_units([units for _, units in short]) if short else []
                rows += [(*_record(doc_id, f, blocks), *none) for (doc_id, _), f in zip(short, fragments, strict=True)]
                yield _batch(kind, rows)

    kind = f"{RECORD}, {RANGE.replace('doc_id', 'long_id')}"
    given = docs.select(F.col("`doc_id`").cast("long"), F.col("`text`").cast("string"))
    both = stage(given.mapInArrow(cut_or_align, kind), "alignments", compression="zstd")
    records = both.filter("document is null").select(*_names(RECORD))
    long = both.filter("document is not null").select(F.col("long_id").alias("doc_id"), *_names(RANGE)[1:])
    ranges, most = long.agg(F.count(F.lit(1)), F.max("chunks")).first()
    if not ranges:
        return records

    def fragments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = tokenizers.get()
        for part in parts:
            for row in part.to_pylist():
                found = aligner.range_fragment(row["text"], row["low"], row["high"])
                yield _batch(FRAGMENT, [_fragment_row(row["doc_id"], row["document"], row["chunk"], found)])

    def compose(rows: pa.Table, last: bool) -> pa.Table:
        given = sorted(rows.to_pylist(), key=lambda r: r["chunk"])
        found = tokenizers.get().compose([_fragment_of(r) for r in given])
        doc_id, document, chunk = given[0]["doc_id"], given[0]["document"], given[0]["chunk"] // FAN
        batch = (_batch(RECORD, [_record(doc_id, found, _Blocks())]) if last
                 else _batch(FRAGMENT, [_fragment_row(doc_id, document, chunk, found)]))
        return pa.Table.from_batches([batch])

    tree = long.repartition(F.col("document"), F.col("chunk")).mapInArrow(fragments, FRAGMENT)
    while most > FAN:
        tree = tree.groupBy("document", F.floor(F.col("chunk") / FAN)).applyInArrow(lambda rows: compose(rows, False), FRAGMENT)
        most = -(-most // FAN)
    whole = tree.groupBy("document").applyInArrow(lambda rows: compose(rows, True), RECORD)
    return records.unionByName(stage(whole, "long-alignments", compression="zstd"))


def _fragment_row(doc_id, document: str, chunk: int, f: Fragment) -> tuple:
    pairs, times = f.closed.links()
    return (doc_id, document, chunk, f.ok, f.cut, *(list(ids) for ids in (*f.prefix, *f.suffix)),
            f.closed.n_a, f.closed.n_b, f.closed.n_groups, f.closed.n_links, b"".join(f.closed.text), pairs, times)


def _fragment_of(r: dict) -> Fragment:
    closed = Closed((r["text"],), r["n_a"], r["n_b"], r["n_groups"], r["n_links"],
                    (np.array(r["pairs"], np.int64),), (np.array(r["times"], np.int64),))
    return Fragment(r["ok"], r["cut"], Open(tuple(r["prefix_a"]), tuple(r["prefix_b"])), closed,
                    Open(tuple(r["suffix_a"]), tuple(r["suffix_b"])))


def _by_block(records: DataFrame) -> DataFrame:
    """(block, pair, n): in how many documents of a block an id pair is linked."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now, size = None, 0
        for part in parts:
            for block, pairs, times in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and (block != now or size >= 2 * BLOCK_PAIRS):
                    yield from summed(now, held)
                    held, size = [], 0
                now = block
                held.append(_unpack(pairs, times)[0])
                size += len(held[-1])
        if held:
            yield from summed(now, held)

    def summed(block: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        for s in range(0, len(pairs), 1 << 16):
            some = slice(s, s + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs[some]), block)), pa.array(pairs[some]), pa.array(n[some])],
                                             names=["block", "pair", "n"])

    return records.filter("length(pairs) > 0").select("block", "pairs", "times").mapInArrow(count, "block long, pair long, n long")


def pair_counts(by_block: DataFrame, b_count: int) -> DataFrame:
    """(pair, count, best): documents that hold an id pair linked; best: no pair of its A id has more.

    An A id has as many pairs as the other vocabulary has ids at most, so its window is bounded.
    """
    counted = by_block.groupBy("pair").agg(F.sum("n").alias("count"))
    a = F.floor(F.col("pair") / b_count)
    return counted.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(a)))


def link_figures(records: DataFrame, b_count: int) -> DataFrame:
    """The rows of ``align`` with n_best and count_sum, without block, pairs and times.

    Pairs go to Spark once a block, get their corpus-wide counts in a join, and come back to their block.
    """
    by_block = stage(_by_block(records), "pair-blocks", compression="zstd")
    counts = pair_counts(by_block, b_count)
    back = by_block.select("block", "pair").join(counts, "pair")
    kept = _names(RECORD)[:6]
    kind = ", ".join(RECORD.split(", ")[:6]) + ", n_best long, count_sum long"

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        pairs, at = np.unique(known.column("pair").to_numpy(), return_index=True)
        counts, best = known.column("count").to_numpy()[at], known.column("best").to_numpy()[at]
        n_best, count_sum = [], []
        packed = zip(rows.column("pairs").to_pylist(), rows.column("times").to_pylist(), strict=True)
        for of, times in (_unpack(*p) for p in packed):
            slot = np.searchsorted(pairs, of)
            n_best.append(int(times[best[slot]].sum()) if len(of) else 0)
            count_sum.append(int((times * counts[slot]).sum()) if len(of) else 0)
        return rows.select(kept).append_column("n_best", pa.array(n_best, pa.int64())).append_column(
            "count_sum", pa.array(count_sum, pa.int64()))

    return records.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(look_up, kind)


def cross_alignment(docs: DataFrame, tokenizers: Tokenizers, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs``.

    Defined results: null and empty texts, and texts that a vocabulary doesn't give back byte by byte
    (such as those with U+2581), have no tokens: zeros and an empty digest.  Every row is a document
    of its own: repeated rows give equal rows and count each; null ids are kept.  Very long texts
    are aligned by several tasks.  Ties for the highest count are all best.  An empty table gives an
    empty table; other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    out = link_figures(align(docs, tokenizers, chunk_bytes), tokenizers.get().b_count)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both public tokenizers over every document."""
    return cross_alignment(load(spark, sf_dir, "documents"), Tokenizers(spark))
