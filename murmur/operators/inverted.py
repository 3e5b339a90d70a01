"""Lexical top-k from an inverted index with impact bounds.

Documents are dealt to shards by a hash of the id, and to tiers by the length of their vectors,
because weights in long and short documents differ by so much that a common bound would say nothing.
A block has the postings of one term in one shard of one tier, and the directory has the largest
weight of each block.

A question's terms give an upper bound for each shard and tier.  Those that promise most are opened
first, and the k-th best score in them is a threshold: what can't reach it stays closed.  Within an
opened shard terms are added from the largest bound on, until no document can reach the threshold.
The result is that of a full scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.operators.retrieval import LEX_DIGITS, TfidfIndex, top_k
from murmur.sources.stages import read_stage, stage, stage_path, write_stage

SHARD_DOCS = 8192
"""Documents of a shard; the number of shards follows the corpus."""
SHARD_POSTINGS = 4 << 20
"""Postings of a shard of long documents: 64 MB, which a task turns at once."""
TIERS_PER_DOUBLING = 1
SLOTS = 32
"""Folders of the postings; a search reads the folders of its own terms."""
FIRST = 4
"""Shards of a question that make its threshold, at most one in a tier."""
QUESTIONS = 4096
"""Questions that meet a shard in one task."""
SLACK = 10.0 ** -LEX_DIGITS
"""Scores are compared rounded, so a document this far below the threshold may still tie with it."""
UNIT = ["tier", "shard"]
POSTINGS = "t long, tier int, shard int, upper double, ids array<long>, ws array<double>, slot int"
HITS = "qid long, id long, s double"


class ImpactIndex(TfidfIndex):
    """The vectors of ``TfidfIndex`` as postings by term.

    postings (slot, t, tier, shard, upper, ids, ws); ``directory`` is the same without the lists.
    No list is longer than a shard, so a term that all documents have is in no task as a whole.
    """

    def __init__(self, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None):
        """``path``: a shared folder to keep the index in, for ``open``; else it is a stage of this job."""
        super().__init__(corpus, id_col, text_col)
        spark = self.rows.sparkSession
        path = (path or stage_path(spark, "impact-index")).rstrip("/")
        size = self.rows.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
        shards = max(1, -(-size["docs"] // SHARD_DOCS), -(-size["postings"] // SHARD_POSTINGS))
        tier = F.floor(F.log2("norm") * TIERS_PER_DOUBLING).cast("int")
        shard = F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")
        units = self.rows.select(F.col(id_col).alias("id"), tier.alias("tier"), shard.alias("shard"), "terms", "w").groupBy(*UNIT)
        # whole documents move, and a shard is turned into postings in one task
        write_stage(units.applyInArrow(_turned, POSTINGS), f"{path}/postings", ["slot"])
        write_stage(read_stage(spark, f"{path}/postings", POSTINGS).select("t", *UNIT, "upper"), f"{path}/directory")
        write_stage(self.idf.select("t", "df", "idf"), f"{path}/idf")
        self._read(spark, path)

    def _read(self, spark: SparkSession, path: str) -> None:
        self.postings = read_stage(spark, f"{path}/postings", POSTINGS)
        self.directory, self.idf = read_stage(spark, f"{path}/directory"), read_stage(spark, f"{path}/idf")

    @classmethod
    def open(cls, spark: SparkSession, path: str, id_col: str = "doc_id") -> ImpactIndex:
        """An index written before; it answers questions without the corpus."""
        index = cls.__new__(cls)
        index.id_col = id_col
        index._read(spark, path.rstrip("/"))
        return index

    def plan_search(self, queries: DataFrame, k: int, qid: str = "qid", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """(asks, opened): the blocks (qid, t, qw, tier, shard, bound) of the questions' terms, and those to open."""
        vectors = stage(self.query_vectors(queries, qid, text_col).select(
            F.col(qid).cast("long").alias("qid"), F.xxhash64("term").alias("t"), "qw"), "question-terms")
        asks = vectors.join(self.directory, "t").withColumn("bound", F.col("qw") * F.col("upper"))
        asks = stage(asks.drop("upper"), "question-blocks")
        units = asks.groupBy("qid", *UNIT).agg(F.sum("bound").alias("most"))
        in_tier = Window.partitionBy("qid", "tier").orderBy(F.desc("most"), "shard")
        best = units.withColumn("r", F.row_number().over(in_tier)).filter("r = 1").drop("r")
        first = top_k(best, FIRST, "qid", "most", "tier").select("qid", *UNIT, F.lit(0.0).alias("least"))
        # written, like the question terms: of a size that is known, so they are sent to the postings
        first = stage(asks.join(first, ["qid", *UNIT]), "first-blocks")
        seen = top_k(self._scores(first, k), k, "qid", "s", "id")
        threshold = seen.filter(F.col("rank") == k).select("qid", (F.col("s") - SLACK).alias("least"))
        units = units.join(threshold, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        opened = asks.join(units.filter(F.col("most") >= F.col("least")).drop("most"), ["qid", *UNIT])
        return asks, stage(opened, "opened-blocks")

    def _scores(self, opened: DataFrame, k: int) -> DataFrame:
        """(qid, id, s): the best k of each question in each of its opened shards (ties beyond k included)."""
        slots = [r[0] for r in opened.select(slot_of("t").alias("slot")).distinct().collect()]     # SLOTS at most
        blocks = -(-opened.select("qid").distinct().count() // QUESTIONS) or 1
        asked = opened.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
        lists = self.postings.filter(F.col("slot").isin(slots)).select("t", *UNIT, "ids", "ws")
        lists = lists.join(asked.select("t", *UNIT, F.col("block").alias("part")).distinct(), ["t", *UNIT])

        def meet(key, questions: pa.Table, lists: pa.Table) -> pa.Table:
            return _meet(questions, lists, k)

        return asked.groupBy(*UNIT, "block").cogroup(lists.groupBy(*UNIT, "part")).applyInArrow(meet, HITS)

    def top_k(self, queries: DataFrame, k: int = 5, qid: str = "qid", text_col: str = "text") -> DataFrame:
        """(qid, id, lexical_score, rank); exact, scores above 0 only."""
        _, opened = self.plan_search(queries, k, qid, text_col)
        scores = self._scores(opened, k).select(
            F.col("qid").alias(qid), F.col("id").alias(self.id_col), F.round("s", LEX_DIGITS).alias("lexical_score"))
        return top_k(scores.filter(F.col("lexical_score") > 0), k, qid, "lexical_score", self.id_col)


def slot_of(term: str):
    return F.pmod(term, F.lit(SLOTS)).cast("int")


def _turned(unit: pa.Table) -> pa.Table:
    """The documents of one tier of one shard as postings, in order of slot and term."""
    docs, lists, weights = (_column(unit, c) for c in ("id", "terms", "w"))
    starts = lists.offsets.to_numpy()
    terms = lists.values.to_numpy()[starts[0]:starts[-1]]
    ws = weights.values.to_numpy()[weights.offsets[0].as_py():weights.offsets[-1].as_py()]
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(starts))
    order = np.lexsort((terms, np.mod(terms, SLOTS)))
    terms, ws = terms[order], ws[order]
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
    ends = pa.array(np.append(first, len(terms)).astype(np.int32))
    t, n = terms[first], len(first)
    columns = {"t": t, "tier": np.full(n, unit.column("tier")[0].as_py(), np.int32), "shard": np.full(n, unit.column("shard")[0].as_py(), np.int32),
               "upper": np.maximum.reduceat(ws, first) if n else np.zeros(0), "ids": pa.ListArray.from_arrays(ends, docs.take(pa.array(doc[order]))),
               "ws": pa.ListArray.from_arrays(ends, pa.array(ws)), "slot": np.mod(t, SLOTS).astype(np.int32)}
    return pa.table(columns)


def _column(table: pa.Table, name: str):
    return table.column(name).combine_chunks() if table.num_rows else pa.array([], table.schema.field(name).type)


def _meet(questions: pa.Table, lists: pa.Table, k: int) -> pa.Table:
    """Scores of one shard's documents for its questions."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if questions.num_rows and lists.num_rows:
        terms, ids = _column(lists, "t").to_numpy(), _column(lists, "ids")
        starts = ids.offsets.to_numpy()
        docs, local = np.unique(ids.values.to_numpy()[starts[0]:starts[-1]], return_inverse=True)
        weights = _column(lists, "ws").values.to_numpy()
        starts = starts - starts[0]
        place = {t: i for i, t in enumerate(terms.tolist())}
        qid, bound = _column(questions, "qid").to_numpy(), _column(questions, "bound").to_numpy()
        order = np.lexsort((-bound, qid))
        qid, bound = qid[order], bound[order]
        least, factor = _column(questions, "least").to_numpy()[order], _column(questions, "qw").to_numpy()[order]
        row = np.array([place[t] for t in _column(questions, "t").to_numpy()[order].tolist()])
        ends = np.flatnonzero(np.diff(qid, append=qid[-1] - 1)) + 1
        for s, e in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            scores, left = np.zeros(len(docs)), float(bound[s:e].sum())
            while s < e:
                # terms in runs of falling bounds; documents found by none of them need the others' bounds
                m = min(e, s + 8)
                sizes = starts[row[s:m] + 1] - starts[row[s:m]]
                at = np.repeat(starts[row[s:m]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                scores += np.bincount(local[at], weights[at] * np.repeat(factor[s:m], sizes), len(docs))
                left -= float(bound[s:m].sum())
                if scores.max() + left < least[s] - SLACK:
                    scores[:] = 0
                    break
                s = m
            floor = SLACK / 4
            if len(scores) > k:
                floor = max(floor, float(np.partition(scores, -k)[-k]) - SLACK)
            best = np.flatnonzero(scores >= floor)
            out.append((np.full(len(best), qid[e - 1]), docs[best], scores[best]))
    kinds = (pa.int64(), pa.int64(), pa.float64())
    columns = list(zip(*out, strict=True)) or [[np.zeros(0)]] * 3
    return pa.Table.from_arrays([pa.array(np.concatenate(c).astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds, strict=True)],
                                names=["qid", "id", "s"])
