"""Byte-level BPE: text to token ids and back, by the ranks of a public vocabulary.

A piece of text is merged by a segment tree over its byte positions.  Each leaf holds the
rank of the pair that begins at that position (or the largest value); each inner node holds
the leftmost position of the least rank below it.  The root names the next merge; a merge
changes the ranks of two live neighbours at most, which are updated in logarithmic time.
"""

from __future__ import annotations

import base64
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import add_column, load

VOCABULARY = "byte_bpe_50k.tiktoken"
KNOWN_WORDS, KNOWN_PIECES = 700_000, 300_000
"""Entries in each generation of a worker's memories; results don't depend on them."""
# Fixed value: the public pattern for which a text may be cut before single spaces.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENCODE_ROWS = 512
LONG_PIECE = 64
"""Pieces of more bytes are merged one by one."""
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: least rank first, leftmost among equals, as long as a pair has a rank."""
    n = len(piece)
    if piece in ranks:
        return [ranks[piece]]
    if n == 0:
        return []
    end = list(range(1, n + 1))                 # where the token that begins here ends
    before = list(range(-1, n))                 # where the live token to the left begins
    bits = (n - 1).bit_length()
    width = 1 << bits
    # a node is (rank, position) in one number, so the least node is the leftmost least rank
    rank_of = ranks.get
    tree = [NEVER] * (2 * width)
    for i in range(n - 1):
        rank = rank_of(piece[i:i + 2])
        if rank is not None:
            tree[width + i] = rank << bits | i
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    def put(position: int, value: int) -> None:
        node = width + position
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            if other < value:
                value = other
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    while (least := tree[1]) < NEVER:
        at = least & (width - 1)
        middle = end[at]
        stop = end[at] = end[middle]
        put(middle, NEVER)
        rank = None
        if stop < n:
            before[stop] = at
            rank = rank_of(piece[at:end[stop]])
        put(at, NEVER if rank is None else rank << bits | at)
        if at:
            left = before[at]
            rank = rank_of(piece[left:stop])
            put(left, NEVER if rank is None else rank << bits | left)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:end[at]]])
        at = end[at]
    return ids


class Merger:
    """Many short pieces at once: a segment tree for each, side by side in arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves for the pairs of tokens that begin ``at``; a pair without a rank is never least."""
        keys = left << 32 | right
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[slot] == keys, self.values[slot] << 8 | at, NEVER)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as 32-bit numbers."""
        out = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.int32(rank).tobytes()
            elif len(piece) > LONG_PIECE:
                out[i] = np.array(merge(piece, self.ranks), np.int32).tobytes()
            elif piece:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, places in by_width.items():
            for begin in range(0, len(places), 1 << 14):
                part = places[begin:begin + (1 << 14)]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        token = np.concatenate([self.single[data], np.zeros((len(n), 1), np.int64)], 1)
        place = np.arange(width)
        following = np.broadcast_to(place + 1, (len(n), width)).copy()
        before = np.broadcast_to(np.arange(-1, width), (len(n), width + 1)).copy()
        tree = np.full((len(n), 2 * width), NEVER, np.int64)
        leaves = self._leaves(token[:, :-2], token[:, 1:-1], place[:-1])
        tree[:, width:-1] = np.where(place[1:] < n[:, None], leaves, NEVER)
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] < NEVER)
        while len(row):
            least = tree[row, 1]
            at, rank = least & 255, least >> 8
            middle = following[row, at]
            stop = following[row, middle]
            token[row, at] = rank
            following[row, at] = stop
            before[row, stop] = at
            left = before[row, at]
            tree[row, width + middle] = NEVER
            last = n[row]
            ahead = self._leaves(rank, token[row, stop], at)
            tree[row, width + at] = np.where(stop < last, ahead, NEVER)
            inner = left >= 0
            tree[row[inner], width + left[inner]] = self._leaves(
                token[row[inner], left[inner]], rank[inner], left[inner])
            for rows, leaf in ((row, middle), (row, at), (row[inner], left[inner])):
                node = (width + leaf) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            row = row[tree[row, 1] < NEVER]
        # live tokens are those reached from the first by ``following``
        live = np.zeros((len(n), width + 1), bool)
        at, row = np.zeros(len(n), np.int64), np.arange(len(n))
        while len(row):
            live[row, at] = True
            at = following[row, at]
            more = at < n[row]
            row, at = row[more], at[more]
        ends = (4 * np.cumsum(live.sum(1))).tolist()
        flat = token[live].astype(np.int32).tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Memory:
    """A bounded map of two generations, filled for many keys at once."""

    def __init__(self, make_all, size: int):
        self.make_all, self.size = make_all, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, keys: set[str]) -> dict[str, bytes]:
        """A map that has all of ``keys``."""
        unknown = keys - self.young.keys()
        if len(self.young) + len(unknown) > self.size:
            self.old, self.young = self.young, {}
            unknown = keys
        new = [k for k in unknown if k not in self.old]
        self.young.update((k, self.old[k]) for k in unknown if k in self.old)
        self.young.update(zip(new, self.make_all(new), strict=True))
        return self.young


class Encoder:
    """Ranks and bounded memories of words and pieces; a worker keeps one for all its tasks.

    Ids are held as 32-bit numbers in bytes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, words: int = KNOWN_WORDS, pieces: int = KNOWN_PIECES):
        import regex

        self.split = regex.compile(pattern).findall
        # the public pattern never joins a space to a character before it, if that is no space
        self.by_spaces = re.compile(r"\s ").search if pattern == SPACED_PATTERN else lambda text: True
        merger = Merger(ranks)
        self.pieces = Memory(lambda new: merger.merge([p.encode() for p in new]), pieces)
        self.words = Memory(self._learn_words, words)

    def _learn_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that follow a space: split together, as each begins at its space."""
        if not words:
            return []
        pieces = self.split(" " + " ".join(words))
        starts = [i for i, piece in enumerate(pieces) if piece[0] == " "]
        if len(starts) != len(words):           # empty words and the like
            return self._by_pieces([" " + w for w in words])
        known = self.pieces.of(set(pieces))
        ids = list(map(known.__getitem__, pieces))
        return [ids[a] if b - a == 1 else b"".join(ids[a:b])
                for a, b in zip(starts, [*starts[1:], len(pieces)], strict=True)]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        known = self.pieces.of(set().union(*split))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        whole = [bool(self.by_spaces(t)) for t in texts]
        words = [[] if w else t.split(" ")[1:] for t, w in zip(texts, whole, strict=True)]
        heads = self._by_pieces([t if w else t.split(" ", 1)[0] for t, w in zip(texts, whole, strict=True)])
        known = self.words.of(set().union(*words))
        return [b"".join([head, *map(known.__getitem__, rest)]) for head, rest in zip(heads, words, strict=True)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()


class Decoder:
    """The bytes of each id."""

    def __init__(self, ranks: dict[bytes, int], *_):
        self.tokens = {rank: token for token, rank in ranks.items()}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Vocabulary:
    """Ranks and pattern, broadcast once; a vocabulary file has a fixed size.

    ``known`` bounds the words and pieces that a worker remembers, where it shares an executor with other work.
    """

    _made: dict[tuple, Encoder | Decoder] = {}

    def __init__(self, spark: SparkSession, path: str | None = None, pattern: str | None = None,
                 known: tuple[int, int] = (KNOWN_WORDS, KNOWN_PIECES)):
        import public_tokenizers

        ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 single bytes")
        self.key = uuid.uuid4().hex
        self.shared = spark.sparkContext.broadcast((ranks, pattern or public_tokenizers.PATTERN, *known))

    def release(self) -> None:
        """Forget the worker's encoder and decoder; a worker that waits for other work would keep them."""
        Vocabulary._made.clear()

    def get(self, kind: type):
        """The worker's encoder or decoder of this vocabulary."""
        made = Vocabulary._made
        if (self.key, kind) not in made:
            for key in [k for k in made if k[0] != self.key]:
                del made[key]
            made[self.key, kind] = kind(*self.shared.value)
        return made[self.key, kind]


class _Encode:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __call__(self, texts: pa.Array) -> pa.Array:
        encoder, parts, ends = self.vocabulary.get(Encoder), [], [0]
        for begin in range(0, len(texts), ENCODE_ROWS):
            parts += encoder.encode_all([t or "" for t in texts[begin:begin + ENCODE_ROWS].to_pylist()])
        ends = np.cumsum([0, *[len(p) // 4 for p in parts]])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


class _Decode:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __call__(self, ids: pa.Array) -> pa.Array:
        decode = self.vocabulary.get(Decoder).decode
        return pa.array([decode(ids[i].values.to_pylist()) if ids[i].is_valid else b"" for i in range(len(ids))], pa.binary())


class _RoundTrip:
    """Ids and the bytes decoded from them, without sending the ids in between."""

    def __init__(self, vocabulary: Vocabulary, release: bool = False):
        self.encode, self.decode = _Encode(vocabulary), _Decode(vocabulary)
        if release:
            self.end = vocabulary.release

    def __call__(self, texts: pa.Array) -> pa.Array:
        ids = self.encode(texts)
        return pa.StructArray.from_arrays([ids, self.decode(ids)], names=["ids", "decoded"])


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text.

    Defined results: null and empty texts have no ids; repeated rows are encoded each; a text
    of one long run of letters costs n log n; an empty table gives an empty table; other
    columns are carried along, and one called as the result is replaced.
    """
    return add_column(docs, to, "array<int>", text, _Encode(vocabulary))


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes of each list of ids (null: no bytes); the exact inverse of ``encode``."""
    return add_column(tokens, to, "binary", ids, _Decode(vocabulary))


def digests(docs: DataFrame, vocabulary: Vocabulary, release: bool = False) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of each document.

    With ``release`` a worker forgets what it has learned at the end of each task.
    """
    tokens = add_column(docs.select("doc_id", "text"), "both", "struct<ids:array<int>,decoded:binary>", "text",
                        _RoundTrip(vocabulary, release))
    return tokens.select(
        "doc_id", F.size("both.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("both.ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("both.decoded", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document."""
    return digests(load(spark, sf_dir, "documents"), Vocabulary(spark))
