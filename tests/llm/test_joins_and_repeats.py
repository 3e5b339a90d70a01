import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from murmur.llm import decontaminate, jaccard_join, line_dedup, repeats
from murmur.llm.catalog import QUERIES
from murmur.llm.components import components
from tests.conftest import SF001
from tests.llm import brute

LONG = " ".join(f"w{i}" for i in range(300))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A b"), (6, "a B"), (7, "a b c d e f g"), (8, "a b c d e f g"),
       (9, "na " * 2000), (10, "na " * 2000), (11, LONG), (12, LONG.replace("w150 ", "")), (13, LONG + " x"),
       (14, LONG.replace("w1 ", "é ")), (15, "\x1c\x85"), (16, LONG), (16, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["n", "token", "component", "signature", "anchor", "h", "line", "lines", "matches", "row", "id"]
    return df.selectExpr("*", *[f"1 as {c}" for c in names]) if extra else df


def varied(seed, n=60):
    """Texts with chains of near copies, common passages and repeats."""
    rng = random.Random(seed)
    common = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(80)) for _ in range(3)]
    rows, last = [], []
    for i in range(n):
        kind = rng.random()
        if last and kind < 0.5:
            words = list(rng.choice(last))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(words) + 1)
                words[at:at + rng.randint(0, 1)] = [f"new{rng.randint(0, 99)}"] * rng.randint(0, 1)
        else:
            words = [f"{rng.choice('klmnop')}{rng.randint(0, 300)}" for _ in range(rng.choice([2, 9, 12, 30, 90]))]
        if kind > 0.8:
            words += rng.choice(common).split()
        last.append(words)
        text = " ".join(words)
        rows.append((i, text.replace(" k", "\nk")))
    return rows


def test_bundles_of_linked_sets_meet():
    bands = jaccard_join.Bands(Fraction(9, 10))
    rng = np.random.default_rng(0)
    tried = 0
    for _ in range(600):
        n = int(rng.choice([9, 10, 11, 19, 20, 40, 100, 400, 3000]))
        changes = int(rng.integers(0, n // 9 + 1))
        drop = int(rng.integers(0, changes + 1))
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 64, changes - drop, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 90 * (len(a) + len(b) - common) or len(a) == len(b) == common:
            continue
        tried += 1
        met = len(set(bands.bundles(a)[0].tolist()) & set(bands.bundles(b)[0].tolist()))
        assert met >= bands.least_overlap(len(a), len(b)) >= 1
        assert met >= bands.least_overlap(len(b), len(a) + 3)
    assert tried > 100


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size,share", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard_join(spark, size, share):
    for rows in (ODD, varied(1)):
        got = jaccard_join.jaccard_join(frame(spark, rows), size, share).collect()
        assert len(got) == len(rows)
        want = brute.op1(rows, size, int(100 * share))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert jaccard_join.jaccard_join(frame(spark, ODD).limit(0)).count() == 0


def test_op1(spark, docs):
    rows = QUERIES["op1_jaccard_join"](spark, SF001).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.op1(docs)


def test_merged_transforms_find_all_repeats():
    rng = random.Random(4)
    for _ in range(150):
        width, step = rng.choice([(8, 2), (12, 3), (16, 4), (8, 1)])
        pool = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(4)]
        texts = [b"".join(rng.choice(pool)[:rng.randint(1, 60)] for _ in range(rng.randint(0, 6)))
                 + bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))]
        seen = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
        want = [[seen[t[i:i + width]] > 1 for i in range(len(t) - width + 1)] for t in texts]
        got = repeats.repeated_windows(texts, width, step, shard_bytes=rng.choice([10, 50, 1000]))
        assert [g.tolist() for g in got] == want


def test_anchors_depend_on_the_window_alone():
    data = np.random.default_rng(1).integers(97, 100, 3000, dtype=np.uint8).tobytes()
    key, first, n = repeats.anchors(data)
    assert first[0] == 0 and (first[1:] == first[:-1] + n[:-1]).all() and n.sum() == len(data) - 399
    of = np.repeat(key, n)
    for start in (0, 17, 1203, 2600):
        assert repeats.anchors(data[start:start + 400])[0][0] == of[start]
    parts = list(repeats.pieces(b"x" * (repeats.CHUNK_BYTES + 500)))
    assert [len(p) for _, p in parts] == [repeats.CHUNK_BYTES + 399, 500]


@pytest.mark.parametrize("hot", [repeats.HOT_BYTES, 1000])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_BYTES", hot)
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    rows = [(i, base[rng.randrange(2000):][:rng.randrange(3000)] + str(rng.random()) * rng.randrange(30)
             + base[rng.randrange(2500):][:rng.randrange(700)]) for i in range(30)]
    rows += [(100, base), (101, "ab" * 600), (102, "ab" * 199), (103, None), (104, ""), (105, base[:399]), (106, base[500:900])]
    got = repeats.remove_repeats(frame(spark, rows)).collect()
    want = brute.op2(rows)
    assert len(got) == len(rows)
    for r in got:
        n, removed, spans, _ = want[r.doc_id]
        assert (r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans)) == (n, removed, spans), r.doc_id


def test_repeats_of_odd_rows(spark):
    got = repeats.remove_repeats(frame(spark, ODD)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ODD)
    for r in got:
        whole = r.doc_id in (9, 10, 11, 16)
        assert whole <= (len(r.kept) == 0)
    assert repeats.remove_repeats(frame(spark, ODD).limit(0)).count() == 0
    assert repeats.remove_repeats(spark.createDataFrame([(None, LONG)], "doc_id long, text string")).first().doc_id is None


def test_op2(spark, docs):
    rows = QUERIES["op2_suffix_dedup"](spark, SF001).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == brute.op2(docs)


def test_benchmark_matches(spark):
    words = [f"t{i}" for i in range(60)]
    items = [(1, " ".join(words[:30])), (2, "only five words in here"), (3, None), (4, ""), (5, "!!"), (6, " ".join(words[20:45])),
             (2, "only five words in here"), (7, " ".join(words[:30]))]
    rows = [(1, " ".join(words)), (2, "x ".join(words)), (3, "THEN, only Five-words in here; and"), (4, None), (5, ""),
            (6, " ".join(words[:15]) + " é " + " ".join(words[18:40])), (7, "only five words in"), (1, " ".join(words))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.op5(rows, items)
    for block in (1 << 24, 40):                  # in one block and in many
        got = decontaminate.find_matches(frame(spark, rows), bench, block_bytes=block)
        got = got.select("doc_id", "matches", decontaminate.n_hit().alias("hit")).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.matches.n_words, r.hit, len(r.matches["items"])) == want[r.doc_id][:3], (block, r)
    one = {r.doc_id: r.matches for r in got}
    assert one[1].longest == 30 and one[3].longest == 5 and [tuple(s) for s in one[3].spans] == [(1, 6)]
    nothing = decontaminate.find_matches(frame(spark, rows), bench.limit(0)).collect()
    assert len(nothing) == len(rows) and not any(r.matches["items"] for r in nothing)
    assert decontaminate.find_matches(frame(spark, rows).limit(0), bench).count() == 0


def test_op5(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    rows = QUERIES["op5_decontaminate"](spark, SF001).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in rows} == brute.op5(docs, items)


def test_lines(spark):
    rows = sorted({d: t for d, t in ODD}.items()) + [(100 + d, t) for d, t in varied(3, 50)]
    rows += [(300, "one two three four five six\nONE two three  four five SIX\nfoo\nfoo\none two three four five seven eight")]
    out = line_dedup.line_dedup(frame(spark, rows))
    assert "anchor" in out.columns
    want = brute.op6(rows)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text or "") for r in out.collect()}
    assert got == want
    assert line_dedup.line_dedup(frame(spark, rows).limit(0)).count() == 0
    same = spark.createDataFrame([(1, LONG), (1, LONG), (None, "x " + LONG)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(same).collect()} == {1: LONG, None: "x " + LONG}


def test_op6_is_native(spark):
    df = QUERIES["op6_line_dedup"](spark, SF001)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_op6(spark, docs):
    rows = QUERIES["op6_line_dedup"](spark, SF001).collect()
    want = brute.op6(docs)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_chars_left) for r in rows} == \
        {d: (a, b, len(t)) for d, (a, b, t) in want.items()}


def test_short_lines_take_part(spark, docs):
    from itertools import combinations

    short = [" ".join(c) for n in (1, 2, 3, 4, 5) for c in combinations("uvwxyz", n)]
    rows = [(1, "\n".join(short[::2])), (2, "\n".join(short)), (3, "All rights\treserved.\n \n\nreserved. ALL rights\n \n\n文"),
            (4, "文\n" + "ha " * 119 + "\n"), (5, "ha\n\x0b\n\x0b"), (6, None), (7, "")]
    want = brute.op6(rows, least=1)
    assert want[3][1:] == (1, "All rights\treserved.\n \n\n \n\n文") and want[4][1] == 1 and want[5][1] == 1
    got = line_dedup.line_dedup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text or "") for r in got} == want
    got = line_dedup.line_dedup(frame(spark, rows), least_words=5).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text or "") for r in got} == brute.op6(rows, least=5)
    want = brute.op6(docs, least=1)
    got = QUERIES["op6_line_dedup_all"](spark, SF001).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_chars_left) for r in got} == \
        {d: (a, b, len(t)) for d, (a, b, t) in want.items()}


def test_passages_of_over_fifty_words_go_from_400_bytes_on(spark):
    """Each passage is in two documents, between a byte in common and one that differs."""
    rows, want = [], {}
    for n in (51, 60, 66, 67, 80):
        passage = "|" + " ".join(f"{n}x{i:02}" for i in range(n)) + "|"
        for k in (1, 2):
            rows.append((10 * n + k, f"{k}{passage}{k}"))
            want[10 * n + k] = len(passage) if len(passage) >= 400 else 0
    assert set(want.values()) > {0} and len(set(want.values())) == 3
    out = repeats.remove_repeats(frame(spark, rows)).collect()
    assert {r.doc_id: sum(s["stop"] - s["start"] for s in r.spans) for r in out} == want


def test_near_copies_of_a_line_are_few_pairs(spark, monkeypatch):
    """Each copy has a least and a largest word hash of its own."""
    words = spark.range(20000).selectExpr("concat('q', id) AS word").orderBy(line_dedup.F.xxhash64("word"))
    words = [r.word for r in words.collect()]
    lines = [" ".join([words[i], *words[9970:10028], words[-1 - i]]) for i in range(40)]
    rows = [(i, line) for i, line in enumerate(lines)]
    exact, compared = line_dedup._exact, []

    def counted(pairs, *about):
        compared.append(pairs.count())
        return exact(pairs, *about)

    monkeypatch.setattr(line_dedup, "_exact", counted)
    got = line_dedup.line_dedup(frame(spark, rows)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: int(i > 0) for i in range(40)}
    assert sum(compared) <= 4 * len(rows), compared


def test_empty_ranges_are_no_tokens():
    bands, rng = jaccard_join.Bands(Fraction(4, 5)), np.random.default_rng(7)
    for size in (30, 100, 300, 800, 3000, 20000):
        sets = [np.unique(rng.integers(0, 1 << 64, size, np.uint64)) for _ in range(40)]
        bundles = np.concatenate([bands.bundles(x)[0] for x in sets])
        assert len(np.unique(bundles)) == len(bundles), size       # unlike sets have nothing in common
        for x in sets[:10]:
            for extra in (0, size // 4):                                # each is linked to its subset
                part = np.sort(rng.permutation(x)[:math.ceil(0.8 * (len(x)))]) if extra else x
                shared = np.intersect1d(bands.bundles(x)[0], bands.bundles(part)[0])
                assert len(shared) >= bands.least_overlap(len(part), len(x)) >= 1
