"""Cross-tokenizer alignment against the libraries on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from murmur.llm import alignment
from tests.conftest import SF001

ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "  two  spaces\tand\n\nlines  "), (6, "é ñ 日本語 😀 \x1c\x85 　x"),
       (7, "na " * 3000), (8, "x" * 9000), (9, "one two three"), (9, "one two three"), (10, "a▁b is not given back"),
       (11, "<|endoftext|> <s> </s> <unk> <0x41>"), (None, "no id"), (12, "ab\x00c é́ " * 40), (13, "日本語の長い文章" * 400)]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.TOKENIZER_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.TOKENIZER_B))


def brute(docs, libraries):
    """Rows by the contract, each text whole, pair by pair."""
    a, b = libraries
    to_byte = alignment.byte_level()
    found, holders = [], Counter()
    for doc_id, text in docs:
        whole, groups, links = (" " + (text or "")).encode(), [], []
        ta = [(i, bytes(to_byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        tb = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
              for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))] if text else []
        if not text or b"".join(t for _, t in ta) != whole or b"".join(t for _, t in tb) != whole:
            ta = tb = []
        at_a = at_b = i = j = 0
        while i < len(ta) or j < len(tb):
            ga, gb = [], []
            while not ga or at_a != at_b:
                if at_a <= at_b:
                    ga.append((ta[i][0], at_a, at_a := at_a + len(ta[i][1])))
                    i += 1
                else:
                    gb.append((tb[j][0], at_b, at_b := at_b + len(tb[j][1])))
                    j += 1
            groups.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if max(x[1], y[1]) < min(x[2], y[2])]
        holders.update(set(links))
        found.append((doc_id, len(ta), len(tb), groups, links))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    return sorted((str(d), na, nb, len(g), len(ls), sum(holders[p] == best[p[0]] for p in ls), sum(holders[p] for p in ls),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, ls in found)


def rows(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


@pytest.mark.parametrize("chunk_bytes", [1 << 16, 1000, 7])
def test_odd_rows_in_ranges_of_any_size(spark, libraries, monkeypatch, chunk_bytes):
    monkeypatch.setattr(alignment, "KNOWN_UNITS", 50)
    docs = ODD if chunk_bytes > 7 else [(d, (t or "")[:900] if t else t) for d, t in ODD]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("a.b", F.lit(1))
    assert rows(alignment.cross_alignment(df, alignment.Tokenizers(spark), chunk_bytes)) == brute(docs, libraries)
    assert rows(alignment.cross_alignment(df.limit(0), alignment.Tokenizers(spark), chunk_bytes)) == []


def test_fragments_compose_in_any_order(spark, libraries):
    aligner = alignment.Tokenizers(spark).get()
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("abcdeé ñ\n\t　日12!,'srtmld😀 ") for _ in range(rng.randint(1, 120)))
        whole = aligner.range_fragment(text, 0, 1 + len(text.encode()))
        parts = [aligner.range_fragment(*r) for r in aligner.ranges(text, rng.randint(1, 9))]
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i:i + 2] = [aligner.compose(parts[i:i + 2])]
        for got in (whole, parts[0]):
            assert got.ok == whole.ok and got.cut and got.prefix == alignment.Open()
            if whole.ok:
                assert got.suffix == alignment.Open() and b"".join(got.closed.text) == b"".join(whole.closed.text)
                assert got.closed[1:5] == whole.closed[1:5]
                assert all((x == y).all() for x, y in zip(got.closed.links(), whole.closed.links(), strict=True))


def test_op11(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert rows(alignment.op11_token_alignment(spark, SF001)) == brute(docs, libraries)
