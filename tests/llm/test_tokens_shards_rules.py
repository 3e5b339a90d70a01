import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from murmur.llm import bpe, quality_rules, sharding
from murmur.llm.bpe import Vocabulary, decode, encode, merge
from murmur.llm.catalog import QUERIES
from tests.conftest import SF001
from tests.llm import brute

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "one two three"), (6, "é ñ 日本 😀 \x1c\x85"),
       (7, "na " * 3000), (8, "x" * 20000), (9, "one two three"), (9, "one two three"),
       (10, "\n".join(["the same line of eight or more words again and again"] * 6)), (11, "A | b | c $$$ %%%")]


def odd(spark, extra=""):
    return spark.createDataFrame([(d, t, "s") for d, t in ODD], "doc_id long, text string, source string")


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_are_those_of_the_library():
    ranks, library = tiktoken_encoding()
    encoder = bpe.Encoder(ranks, library._pat_str)
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("abcdeé ñ\n\t\x1c\x85　日12३.!,'srtmld😀İ²½") for _ in range(rng.randint(0, 50)))
        assert encoder.encode(text) == library.encode_ordinary(text)
        assert bpe.Decoder(ranks, "").decode(encoder.encode(text)) == text.encode()
    long = "ab" * 4000 + "c" * 3001
    assert merge(long.encode(), ranks) == library.encode_ordinary(long)


def test_bpe_round_trip_of_odd_rows(spark):
    _, library = tiktoken_encoding()
    vocabulary = Vocabulary(spark)
    df = odd(spark).withColumnsRenamed({"source": "ids"}).selectExpr("*", "1 as decoded")
    rows = decode(encode(df, vocabulary), vocabulary).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert encode(odd(spark).limit(0), vocabulary).count() == 0


def test_op3(spark):
    _, library = tiktoken_encoding()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = QUERIES["op3_byte_bpe"](spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def held_to_the_law(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    n = len(rows)
    assert set(by) <= set(range(shards))
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    mix = Counter(r.source for r in rows)
    for s in by.values():
        for source, k in Counter(r.source for r in s).items():
            assert abs(k - mix[source] * len(s) / n) <= 2.5


def test_shards_hold_the_mixture(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "c", None, ""]), i) for i in range(3000)] + [(5, "hot", 5)] * 40
    df = spark.createDataFrame(rows, "doc_id long, source string, rank int").selectExpr("*", "'x' as shard", "2 as _bin")
    a = sharding.shard(df, 7, rows_per_bin=100).collect()
    assert len(a) == 3040 and "rank" in a[0].asDict()
    held_to_the_law(a, 7)
    again = sharding.shard(df.repartition(3), 7, rows_per_bin=100).collect()
    assert sorted(map(tuple, ((r.doc_id, r.shard, r.slot) for r in a if r.doc_id != 5))) == \
        sorted(map(tuple, ((r.doc_id, r.shard, r.slot) for r in again if r.doc_id != 5)))
    assert sharding.shard(df.limit(0), 7).count() == 0
    held_to_the_law(sharding.shard(df.limit(3), 7).collect(), 7)


def test_op7(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    df = QUERIES["op7_sharding"](spark, SF001)
    rows = df.collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"rows"}
    for r in rows:
        assert r["size"] == len(docs[r.doc_id].text.encode()) + 16
        assert r.text_crc32 == zlib.crc32(docs[r.doc_id].text.encode())
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(40)) <= 1


def test_rule_figures_of_odd_rows(spark):
    clash = odd(spark).selectExpr("*", "1 as words", "2 as n_words", "3 as windows")
    rows = quality_rules.quality_rules(clash).collect()
    assert len(rows) == len(ODD)
    texts = dict(ODD)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == \
            brute.op10_base(texts[r.doc_id])[:5], r.doc_id
    assert quality_rules.quality_rules(clash.limit(0)).count() == 0


def test_op10(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = QUERIES["op10_quality_rules"](spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:7] == brute.op10_base(docs[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_order_of_rules_never_changes_the_verdict(spark):
    made = quality_rules.figures(odd(spark), ["doc_id"])
    rules = quality_rules.default_rules()
    one = made.select("doc_id", quality_rules.cascade(made, rules).isNull().alias("kept")).collect()
    two = made.select("doc_id", quality_rules.cascade(made, rules, rules[::-1]).isNull().alias("kept")).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


@pytest.mark.parametrize("divisor", [3, 4, 5])
def test_folds(spark, divisor):
    from murmur.llm.common import remainder

    for r in spark.range(200).select("id", remainder("id", divisor).alias("f")).collect():
        assert r.f == brute.remainder(r.id, divisor)
