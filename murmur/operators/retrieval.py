"""Top-k retrieval for whole tables of questions: TF-IDF (lexical), exact
inner product on unit vectors (semantic) and their hybrid merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.sources.stages import stage

# Terms as the default sparse vectoriser sees them: lower case, runs of two or
# more word characters.
LEX_PATTERN = r"[\p{L}\p{N}_]{2,}"
LEX_DIGITS = 6       # lexical scores are compared at 6 decimals
SEM_DIGITS = 5       # float32 dot products are compared at 5 decimals
BLOCK_BYTES = 16 << 20
"""Questions that are sent to the tasks at once; more of them take more passes."""
SCORE_BYTES = 8 << 20
"""Scores that a task holds at once (some copies are made of them)."""
ENTRIES = 1 << 20
"""List entries (terms of documents, or their meetings with questions' terms) that a task handles at once."""
FREQUENT = 1 << 20
"""Terms whose idf is sent to the tasks at most (16 MB); the rarer ones are joined."""


def lex_terms(c):
    return F.regexp_extract_all(F.lower(c), F.lit(LEX_PATTERN), 0)


def top_k(df: DataFrame, k: int, part: str, score: str, tie: str, rank: str = "rank") -> DataFrame:
    """Rows with rank <= k per ``part``, ordered by score desc then ``tie``.
    Plans as WindowGroupLimit (partial before the shuffle, final after)."""
    w = Window.partitionBy(part).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(w).cast("int")).filter(F.col(rank) <= k)


# --- TF-IDF -------------------------------------------------------------------

def _term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    terms = (df.select(F.col(id_col), F.explode_outer(lex_terms(F.col(text_col))).alias("term"))
               .filter(F.col("term").isNotNull()))
    return terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


class _Best:
    """The k best rows of each question so far, by score (rounded), then id."""

    def __init__(self, n: int, k: int, digits: int):
        self.k, self.digits = k, digits
        self.ids = np.zeros((n, 0), np.int64)
        self.scores = np.zeros((n, 0))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: questions x rows; minus infinity for rows that aren't hits."""
        scores = np.concatenate([self.scores, np.round(scores, self.digits)], 1)
        ids = np.concatenate([self.ids, np.broadcast_to(ids, (len(scores), len(ids)))], 1)
        if scores.shape[1] > self.k:
            # no row below the k-th score can stay; ties with it are settled by id
            least = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1:self.k]
            width = int((scores >= least).sum(1).max())
            if width < scores.shape[1]:
                some = np.argpartition(np.where(scores >= least, 0, 1), width - 1, axis=1)[:, :width]
                scores, ids = np.take_along_axis(scores, some, 1), np.take_along_axis(ids, some, 1)
            order = np.lexsort((ids, -scores), axis=1)[:, :self.k]
            scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        self.ids, self.scores = ids, scores

    def rows(self, qids: np.ndarray, names: list[str]) -> pa.RecordBatch:
        q, r = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(self.ids[q, r]), pa.array(self.scores[q, r])],
                                          names=names)


def _blocks(questions: DataFrame, size_of, block_bytes: int):
    """The questions in lists of bounded size, one at a time on the driver."""
    size = questions.agg(F.coalesce(F.sum(size_of), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        part = questions if n == 1 else questions.filter(F.pmod(F.xxhash64(questions.columns[0]), F.lit(n)) == b)
        yield part.collect()


def _search(corpus: DataFrame, blocks, score_batch, k: int, digits: int, qid: str, id_col: str, score: str) -> DataFrame:
    """Top-k of all blocks of questions: each partition of the corpus gives k
    rows per question, and a window merges them.  No pair table is made."""
    out = corpus.sparkSession.createDataFrame([], f"{qid} bigint, {id_col} bigint, {score} double")
    for prepared in blocks:
        if prepared is None:
            continue
        shared = corpus.sparkSession.sparkContext.broadcast(prepared)

        def run(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            best = _Best(len(block["qid"]), k, digits)
            for part in parts:
                step = max(1, SCORE_BYTES // (8 * len(block["qid"]) + 1))
                for begin in range(0, part.num_rows, step):
                    best.add(*score_batch(block, part.slice(begin, step)))
            yield best.rows(block["qid"], [qid, id_col, score])

        out = out.unionByName(corpus.mapInArrow(run, f"{qid} bigint, {id_col} bigint, {score} double"))
    return top_k(out, k, qid, score, id_col)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of an Arrow list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _by_id(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each id: the texts of an id that comes more than once are joined by a line break, which is in no term."""
    several = corpus.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(id_col).alias("_id"))
    several = stage(several, "repeated-ids")
    if several.isEmpty():
        return corpus
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    joined = corpus.join(several, same, "left_semi").groupBy(id_col).agg(F.concat_ws("\n", F.collect_list(text_col)).alias(text_col))
    return corpus.join(several, same, "left_anti").unionByName(joined)


def _cuts(ends: np.ndarray, most: int) -> list[int]:
    """Row boundaries, from 0, with ``most`` list entries between two of them, or one row that has more."""
    cuts, rows = [0], len(ends) - 1
    while cuts[-1] < rows:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + most, "right")) - 1))
    return cuts


def _list_array(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _counted(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms, tfs): the different hashed terms of each document in order, with their counts; in one narrow
    pass.  Documents without a term have no row."""
    hashes = F.coalesce(F.transform(lex_terms(F.col(text_col)), lambda t: F.xxhash64(t)), F.array().cast("array<long>"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values, ends = _lists(part.column(1))
            cuts = _cuts(ends, ENTRIES)
            for a, b in zip(cuts, cuts[1:], strict=False):
                terms, doc = values[ends[a]:ends[b]], np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
                order = np.lexsort((terms, doc))
                terms, doc = terms[order], doc[order]
                new = np.ones(len(terms), bool)
                new[1:] = (terms[1:] != terms[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                sizes = np.bincount(doc[first], minlength=b - a)
                tfs = np.diff(first, append=len(terms)).astype(np.int32)
                ids = part.column(0).slice(a, b - a).filter(pa.array(sizes > 0))
                sizes = sizes[sizes > 0]
                yield pa.RecordBatch.from_arrays([ids, _list_array(terms[first], sizes), _list_array(tfs, sizes)],
                                                 names=[id_col, "terms", "tfs"])

    return corpus.select(id_col, hashes.alias("t")).mapInArrow(run, f"{id_col} bigint, terms array<bigint>, tfs array<int>")


def _place(known: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms are in the sorted ``known``, and whether they are there."""
    if not len(known):
        return np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    return at, known[at] == terms


class TfidfIndex:
    """TF-IDF vectors as a stored table, built once: one row ``(id, terms, norm, w)``
    per document, with hashed terms and L2-normalised weights, and the idf table
    ``(t, df, idf)``, ``idf = ln((1 + n) / (1 + df)) + 1``.

    Counting and weighing don't move the documents: the idf of the ``FREQUENT`` most frequent terms, which
    are nearly all occurrences, is sent to the tasks; only rarer terms are joined.

    A search reads the rows once per block of questions: their dot products with
    the questions are taken batch by batch, each partition keeps its k best rows
    per question, and only those are shuffled.
    """

    def __init__(self, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        corpus = corpus.select(F.col(id_col).cast("long").alias(id_col), text_col)
        self.id_col = id_col
        counts = stage(_counted(_by_id(corpus, id_col, text_col), id_col, text_col), "term-counts")
        df = counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
        self._set_idf(df, corpus.select(id_col).count())
        self.rows = stage(self._weighed(counts), "tfidf")

    @classmethod
    def of_counts(cls, tf: DataFrame, df: DataFrame, n: int, id_col: str = "doc_id") -> TfidfIndex:
        """From counts at hand: (id, term, tf), (term, df) and the number of documents."""
        index = cls.__new__(cls)
        index.id_col = id_col
        t = F.xxhash64("term").alias("t")
        index._set_idf(df.groupBy(t).agg(F.sum("df").alias("df")), n)
        pairs = tf.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(t, F.col("tf").cast("int").alias("tf")))).alias("v"))
        counts = stage(pairs.select(id_col, F.col("v.t").alias("terms"), F.col("v.tf").alias("tfs")), "term-counts")
        index.rows = stage(index._weighed(counts), "tfidf")
        return index

    def _set_idf(self, df: DataFrame, n: int) -> None:
        self.idf = stage(df.select("t", "df", (F.log((F.lit(1.0) + n) / (F.col("df") + 1.0)) + 1.0).alias("idf")), "idf")

    def _frequent(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """(terms in order, idf) of frequent terms, ``FREQUENT`` at most, and whether these are all."""
        level = F.floor(F.log2("df"))
        sizes = sorted(self.idf.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)     # 64 rows at most
        kept = np.cumsum([r["n"] for r in sizes]) <= FREQUENT
        least = min((r["l"] for r, k in zip(sizes, kept, strict=True) if k), default=64)
        table = self.idf.filter(level >= least).select("t", "idf").toArrow()
        terms, idf = table.column("t").to_numpy(), table.column("idf").to_numpy()
        order = np.argsort(terms)
        return terms[order], idf[order], bool(kept.all())

    def _weighed(self, counts: DataFrame) -> DataFrame:
        """(id, terms, norm, w) of (id, terms, tfs), the terms of a row in order."""
        id_col, (known, idf, whole) = self.id_col, self._frequent()
        shared = counts.sparkSession.sparkContext.broadcast((known, idf))
        rest = F.array().cast("array<double>")
        if whole:
            given = counts.withColumn("rest", rest)
        else:
            def rare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in parts:
                    terms, ends = _lists(part.column(1))
                    doc, terms = np.repeat(np.arange(part.num_rows), np.diff(ends)), terms[ends[0]:ends[-1]]
                    other = np.flatnonzero(~_place(shared.value[0], terms)[1])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[other])), pa.array(terms[other])], names=["_id", "t"])

            single = counts.select(id_col, "terms").mapInArrow(rare, "_id bigint, t bigint").join(self.idf.select("t", "idf"), "t")
            of_id = single.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("t", "idf"))).alias("r"))
            given = (counts.join(of_id, F.col(id_col).eqNullSafe(F.col("_id")), "left")
                     .select(id_col, "terms", "tfs", F.coalesce("r.idf", rest).alias("rest")))

        def weigh(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, idf = shared.value
            for part in parts:
                (terms, ends), (tfs, tf_ends), (rest, rest_ends) = [_lists(part.column(i)) for i in (1, 2, 3)]
                terms, tfs, rest = terms[ends[0]:ends[-1]], tfs[tf_ends[0]:tf_ends[-1]], rest[rest_ends[0]:rest_ends[-1]]
                at, held = _place(known, terms)
                raw = np.empty(len(terms))
                raw[held] = idf[at[held]]
                raw[~held] = rest                       # both in the order of rows and terms
                raw *= tfs
                sizes = np.diff(ends)
                norm = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), raw * raw, len(sizes)))
                yield pa.RecordBatch.from_arrays([part.column(0), _list_array(terms, sizes), pa.array(norm),
                                                  _list_array(raw / np.repeat(norm, sizes), sizes)], names=[id_col, "terms", "norm", "w"])

        return given.mapInArrow(weigh, f"{id_col} bigint, terms array<bigint>, norm double, w array<double>")

    @property
    def weights(self) -> DataFrame:
        """(id, term hash, w): the normalised document vectors."""
        return self.rows.select(self.id_col, F.explode(F.arrays_zip("terms", "w")).alias("x")).select(
            self.id_col, F.col("x.terms").alias("term"), F.col("x.w").alias("w"))

    def query_vectors(self, queries: DataFrame, qid: str = "qid", text_col: str = "text") -> DataFrame:
        """(qid, term, qw); terms that the corpus doesn't have drop out."""
        raw = _term_counts(queries, qid, text_col).withColumn("t", F.xxhash64("term")).join(self.idf, "t").select(
            qid, "term", (F.col("tf") * F.col("idf")).alias("raw"))
        norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(qid)))
        return raw.withColumn("qw", F.col("raw") / norm).drop("raw")

    def top_k(self, queries: DataFrame, k: int = 5, qid: str = "qid", text_col: str = "text",
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """(qid, id, lexical_score, rank); exact, scores above 0 only."""
        vectors = (self.query_vectors(queries, qid, text_col).groupBy(F.col(qid).cast("long").alias(qid))
                   .agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "qw")).alias("v")))

        def prepared():
            for rows in _blocks(vectors, F.size("v") * 16 + 8, block_bytes):
                if not rows:
                    continue
                terms = np.array([x["t"] for r in rows for x in r["v"]], np.int64)
                order = np.argsort(terms, kind="stable")
                yield {"qid": np.array([r[qid] for r in rows], np.int64), "terms": terms[order],
                       "q": np.repeat(np.arange(len(rows)), [len(r["v"]) for r in rows])[order],
                       "w": np.array([x["qw"] for r in rows for x in r["v"]])[order]}

        return _search(self.rows.select(self.id_col, "terms", "w"), prepared(), _lexical, k, LEX_DIGITS, qid, self.id_col, "lexical_score")


def _lexical(block: dict, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Dot products of a batch of documents with the questions; -inf without a common term."""
    ids = part.column(0).to_numpy()
    terms, ends = _lists(part.column(1))
    weights, _ = _lists(part.column(2))
    out = np.zeros((len(block["qid"]), len(ids)))
    first, times = _meetings(block["terms"], terms[ends[0]:ends[-1]])
    met = np.concatenate([[0], np.cumsum(times)])[ends - ends[0]]
    cuts = _cuts(met, ENTRIES)
    for a, b in zip(cuts, cuts[1:], strict=False):
        # a common term meets many questions, so it is their number that is bounded
        low, high = ends[a] - ends[0], ends[b] - ends[0]
        n, doc = times[low:high], np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
        at = np.repeat(first[low:high] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = block["q"][at] * (b - a) + np.repeat(doc, n)
        products = np.repeat(weights[ends[a]:ends[b]], n) * block["w"][at]
        out[:, a:b] = np.bincount(cell, products, out.shape[0] * (b - a)).reshape(-1, b - a)
    return ids, np.where(np.round(out, LEX_DIGITS) > 0, out, -np.inf)


def _meetings(asked: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each term begins in the sorted terms of the questions, and how often it is there."""
    first = np.searchsorted(asked, terms, "left")
    return first, np.searchsorted(asked, terms, "right") - first


# --- exact inner-product search ---------------------------------------------------

def _semantic(block: dict, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    values, ends = _lists(part.column(1))
    rows = values[ends[0]:ends[-1]].reshape(part.num_rows, -1).astype(np.float64)
    return part.column(0).to_numpy(), block["vectors"] @ rows.T


def cosine_top_k(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "doc_id",
                 vec_col: str = "embedding", qid: str = "qid", qvec: str = "embedding",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact top-k by inner product (= cosine on unit vectors): exactly k rows
    per question, ties of the rounded score by id.

    Questions are sent in blocks of bounded size, each a distributed pass over
    the corpus; scores are matrix products of bounded size.
    """
    pick = queries.select(F.col(qid).cast("long").alias("q"), F.col(qvec).alias("v")).filter(F.col("v").isNotNull())

    def prepared():
        for rows in _blocks(pick, F.size("v") * 8 + 8, block_bytes):
            if rows:
                yield {"qid": np.array([r["q"] for r in rows], np.int64),
                       "vectors": np.array([r["v"] for r in rows], np.float64)}

    rows = corpus.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>")).filter(
        F.col(vec_col).isNotNull())
    return _search(rows, prepared(), _semantic, k, SEM_DIGITS, qid, id_col, "semantic_score")


# --- hybrid ---------------------------------------------------------------------------

def dedup_by_text(hits: DataFrame, qid: str, id_col: str, text_col: str, score: str) -> DataFrame:
    """One hit per (question, text): best score, then lowest id."""
    w = Window.partitionBy(qid, text_col).orderBy(F.col(score).desc(), F.col(id_col))
    return hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def hybrid_merge(sem: DataFrame, lex: DataFrame, k: int = 5, alpha: float = 0.7,
                 qid: str = "qid", id_col: str = "comment_id", text_col: str = "text") -> DataFrame:
    """Full outer merge of the two hit lists on (question, raw text), compared by
    a 256-bit digest; a side that did not return the text scores 0.0;
    hybrid = a*sem + (1-a)*lex."""
    digest = F.sha2(F.col(text_col).cast("binary"), 256)
    s = dedup_by_text(sem.withColumn("_key", digest), qid, id_col, "_key", "semantic_score") \
        .select(qid, "_key", F.col(id_col).alias("_sid"), F.col(text_col).alias("_stext"), "semantic_score")
    lx = dedup_by_text(lex.withColumn("_key", digest), qid, id_col, "_key", "lexical_score") \
        .select(qid, "_key", F.col(id_col).alias("_lid"), F.col(text_col).alias("_ltext"), "lexical_score")
    merged = s.join(lx, [qid, "_key"], "full_outer").select(
        qid, F.coalesce("_stext", "_ltext").alias(text_col),
        F.coalesce("_sid", "_lid").alias(id_col),
        F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"),
        F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"))
    merged = merged.withColumn(
        "hybrid_score",
        F.round(F.lit(alpha) * F.col("semantic_score") + F.lit(1.0 - alpha) * F.col("lexical_score"),
                LEX_DIGITS))
    return top_k(merged, k, qid, "hybrid_score", id_col)


def hybrid_search(corpus_text: DataFrame, corpus_vecs: DataFrame, questions: DataFrame,
                  question_vecs: DataFrame, k: int = 5, alpha: float = 0.7,
                  index: TfidfIndex | None = None) -> DataFrame:
    """Hybrid top-k for a table of questions.

    corpus_text (comment_id, text), corpus_vecs (comment_id, embedding),
    questions (qid, text), question_vecs (qid, embedding).  Each side returns
    2k hits per question; these are written, so that their size is known and the
    join that gives them their text sends them to the corpus and doesn't shuffle
    it; then they are merged on the text.
    """
    index = index or TfidfIndex(corpus_text.withColumnRenamed("comment_id", "doc_id"), "doc_id", "text")
    lex = index.top_k(questions, 2 * k).select("qid", F.col("doc_id").alias("comment_id"), "lexical_score")
    sem = (cosine_top_k(corpus_vecs.withColumnRenamed("comment_id", "doc_id"), question_vecs, 2 * k)
           .select("qid", F.col("doc_id").alias("comment_id"), "semantic_score"))
    lex = stage(lex, "lexical-hits").join(corpus_text, "comment_id")
    sem = stage(sem, "semantic-hits").join(corpus_text, "comment_id")
    return hybrid_merge(sem, lex, k, alpha)
