"""Slow, plain versions of what the queries return, to hold them against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def op1(rows, size=3, least=90):
    """rows: (doc_id, text).  -> {doc_id: (n_shingles, component_id)}"""
    sets = {}
    for d, t in rows:
        w = words(lower(t))
        sets[d] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in where[x] if e > d).items():
            if 100 * n >= least * (len(s) + len(sets[e]) - n):
                a, b = top(d), top(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def op2(rows, width=400):
    seen = Counter()
    data = {d: (t or "").encode() for d, t in rows}
    for b in data.values():
        seen.update(b[i:i + width] for i in range(len(b) - width + 1))
    out = {}
    for d, b in data.items():
        hit = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                hit[i:i + width] = b"\x01" * width
        spans = len(re.findall(rb"\x01+", bytes(hit)))
        kept = bytes(c for c, h in zip(b, hit) if not h)
        out[d] = (len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def op5(rows, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(lower(t))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[i:i + width])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for d, t in rows:
        w, hit, found = split(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i:i + n])):
                    found |= got
                    hit.update(range(i, i + n))
        ids = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def op9_base(rows):
    import math

    count = Counter()
    docs = {d: [*words(lower(t)), None] for d, t in rows}
    for d, w in docs.items():
        if remainder(d, 5) != 1:
            count.update(w)
    n, v = sum(count.values()), len(count)
    return {d: (remainder(d, 5) == 1, len(w), sum(count[x] > 0 for x in w), n,
                sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for d, w in docs.items()}


def op10_base(text):
    w = words(text)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


def op6(rows, least=1, p=4, q=5):
    """rows: (doc_id, text).  -> {doc_id: (lines, removed, what is left)}"""
    out, before, where = {}, [], defaultdict(list)
    for d, t in sorted(rows, key=lambda r: r[0]):
        lines, kept = (t.split("\n") if t is not None else []), []
        for line in lines:
            s = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)
            if len(s) >= least:
                counts = Counter(k for w in s for k in where[w])
                repeat = any(n * q >= (len(s) + len(before[k]) - n) * p for k, n in counts.items())
                if s not in where:
                    for w in s:
                        where[w].append(len(before))
                    before.append(s)
                    where[s] = []
                if repeat:
                    continue
            kept.append(line)
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out
