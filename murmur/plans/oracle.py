"""DuckDB SQL fragments that restate the Spark expressions, for the oracle
check.  They are built from the same word tables as the Spark side, so a
difference in results points at a difference in semantics, not in data."""

from __future__ import annotations

from murmur.functions.text import CLEAN_STEPS, EMOJI_GUARD, TOKEN_PATTERN, WS
from murmur.operators.evaluate import STRIP_CHARS, SUPPORTED
from murmur.resources.words import (EMOJI_NAMES, EMOTION_WORDS, IRONY_CUES, LANGUAGE_PROFILES,
                                    LEMMA_PAIRS, POLARITY, ROUTE_RULES, SECURITY_KEEP_PATTERN,
                                    STOPWORDS_EN)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def demojize(expr: str) -> str:
    out = expr
    for emoji, name in sorted(EMOJI_NAMES, key=lambda p: -len(p[0])):
        out = f"replace({out}, {q(emoji)}, {q(name)})"
    return f"(CASE WHEN regexp_matches({expr}, {q(EMOJI_GUARD)}) THEN {out} ELSE {expr} END)"


def _replace(expr: str, pattern: str, repl: str) -> str:
    pattern = pattern.replace("(?s)", "(?s)")
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def clean_ctes(src: str, text_col: str = "text", out: str = "clean_text", prefix: str = "cl") -> str:
    """Three CTEs ``{prefix}1..3``; the last holds all source columns plus
    ``out``.  The run-shortening step has no backreference in RE2, so it is a
    list filter over characters."""
    pre = demojize(text_col)
    steps = CLEAN_STEPS
    run_idx = next(i for i, (p, _) in enumerate(steps) if "\\1" in p)
    for p, r in steps[:run_idx]:
        pre = _replace(pre, p, r)
    post = "array_to_string(list_filter(_l, lambda x, i: NOT (i > 2 AND x = _l[i-1] AND x = _l[i-2])), '')"
    for p, r in steps[run_idx + 1:]:
        post = _replace(post, p, r)
    post = f"trim({post}, ' ')"
    return (f"{prefix}1 AS (SELECT *, {pre} AS _t FROM {src}),\n"
            f"{prefix}2 AS (SELECT * EXCLUDE (_t), string_split(_t, '') AS _l FROM {prefix}1),\n"
            f"{prefix}3 AS (SELECT * EXCLUDE (_l), {post} AS {out} FROM {prefix}2)")


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {q(TOKEN_PATTERN)})"


def language(expr: str) -> str:
    toks = tokens(expr)
    langs = sorted(LANGUAGE_PROFILES)
    counts = {lang: f"len(list_filter({toks}, lambda t: t IN {in_list(LANGUAGE_PROFILES[lang])}))"
              for lang in langs}
    best = "greatest(" + ", ".join(counts[x] for x in langs) + ")"
    whens = " ".join(f"WHEN {counts[x]} = {best} THEN {q(x)}" for x in langs)
    return f"(CASE WHEN {best} = 0 THEN 'unknown' {whens} END)"


def lemmas(expr: str) -> str:
    keep = (f"regexp_full_match(t, {q('(' + SECURITY_KEEP_PATTERN + ')')}) OR "
            f"(NOT (t IN {in_list(STOPWORDS_EN)}) AND length(t) > 2 AND regexp_full_match(t, '\\pL+'))")
    case = "CASE t " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in LEMMA_PAIRS) + " ELSE t END"
    return f"list_transform(list_filter({tokens(expr)}, lambda t: {keep}), lambda t: {case})"


def prepared_ctes(src: str = "documents", id_col: str = "doc_id") -> str:
    """CTEs up to ``en``: English rows with clean_text and lemmas."""
    return (clean_ctes(src) + ",\n"
            f"lg AS (SELECT *, {language('clean_text')} AS language FROM cl3),\n"
            f"en AS (SELECT *, {lemmas('clean_text')} AS lemmas FROM lg WHERE language = 'en')")


def word_frequency_ctes() -> str:
    return (prepared_ctes() + ",\n"
            "wf AS (SELECT word, count(*) AS frequency FROM "
            "(SELECT unnest(lemmas) AS word FROM en) GROUP BY word)")


LEX_SQL_PATTERN = r"[\pL\pN_]{2,}"


def tfidf_ctes(corpus: str, queries: str, p: str = "lx") -> str:
    """CTEs ending in ``{p}_sc(qid, id, lexical_score)``; ``corpus`` has
    (id, text), ``queries`` has (qid, text)."""
    pat = q(LEX_SQL_PATTERN)
    return f"""{p}_dt AS (SELECT id, unnest(regexp_extract_all(lower(text), {pat})) AS term FROM {corpus}),
{p}_tf AS (SELECT id, term, count(*) AS tf FROM {p}_dt GROUP BY id, term),
{p}_n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {corpus}),
{p}_idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM {p}_tf, {p}_n GROUP BY term, n),
{p}_dw AS (SELECT id, term, tf * idf AS raw FROM {p}_tf JOIN {p}_idf USING (term)),
{p}_nm AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM {p}_dw GROUP BY id),
{p}_qt AS (SELECT qid, unnest(regexp_extract_all(lower(text), {pat})) AS term FROM {queries}),
{p}_qtf AS (SELECT qid, term, count(*) AS tf FROM {p}_qt GROUP BY qid, term),
{p}_qw0 AS (SELECT qid, term, idf, tf * idf AS raw FROM {p}_qtf JOIN {p}_idf USING (term)),
{p}_qw AS (SELECT qid, term, idf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY qid)) AS qw FROM {p}_qw0),
{p}_dot AS (SELECT q.qid, t.id, sum(t.tf * q.idf * q.qw) AS dot FROM {p}_tf t JOIN {p}_qw q USING (term)
            GROUP BY q.qid, t.id),
{p}_sc AS (SELECT qid, id, round(dot / norm, 6) AS lexical_score FROM {p}_dot JOIN {p}_nm USING (id)
           WHERE round(dot / norm, 6) > 0)"""


def cosine_ctes(corpus: str, queries: str, p: str = "sm") -> str:
    """CTEs ending in ``{p}_sc(qid, id, semantic_score)``; ``corpus`` has
    (id, embedding), ``queries`` has (qid, embedding)."""
    return f"""{p}_sc AS (SELECT qv.qid, cv.id,
    round(list_dot_product(CAST(cv.embedding AS DOUBLE[]), CAST(qv.embedding AS DOUBLE[])), 5) AS semantic_score
    FROM {corpus} cv, {queries} qv)"""


def store_ctes(corpus: str, queries: str, dims: int, p: str = "vs") -> str:
    """CTEs ending in ``{p}_sc(qid, id, semantic_score)`` of hashed, weighted, normalised term counts;
    ``corpus`` has (id, text), ``queries`` has (qid, text)."""
    def terms(key: str, src: str) -> str:
        term = f"unnest(regexp_extract_all(lower(coalesce(text, '')), {q(LEX_SQL_PATTERN)}))"
        return (f"SELECT {key}, b, count(*) AS tf FROM (SELECT {key}, ('0x' || left(md5(term), 8))::BIGINT % {dims} AS b "
                f"FROM (SELECT {key}, {term} AS term FROM {src})) GROUP BY {key}, b")

    def unit(key: str, name: str) -> str:
        return (f"SELECT {key}, b, CAST(CAST(raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS w "
                f"FROM (SELECT {key}, b, tf * idf AS raw FROM {name} JOIN {p}_idf USING (b))")

    return f"""{p}_dt AS ({terms("id", corpus)}),
{p}_idf AS (SELECT b, ln((1.0 + n) / (1.0 + coalesce(held, 0))) + 1.0 AS idf FROM (SELECT unnest(range({dims})) AS b)
    LEFT JOIN (SELECT b, count(*) AS held FROM {p}_dt GROUP BY b) USING (b), (SELECT CAST(count(*) AS DOUBLE) AS n FROM {corpus})),
{p}_dw AS ({unit("id", f"{p}_dt")}),
{p}_qt AS ({terms("qid", queries)}),
{p}_qw AS ({unit("qid", f"{p}_qt")}),
{p}_dot AS (SELECT qid, id, sum(d.w * z.w) AS dot FROM {p}_dw d JOIN {p}_qw z USING (b) GROUP BY qid, id),
{p}_sc AS (SELECT qid, id, round(coalesce(dot, 0), 5) AS semantic_score FROM (SELECT qid FROM {queries}) CROSS JOIN (SELECT id FROM {corpus})
    LEFT JOIN {p}_dot USING (qid, id))"""


def ranked(src: str, part: str, score: str, tie: str, k: int) -> str:
    return (f"(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY {score} DESC, {tie})"
            f" AS INTEGER) AS rank FROM {src}) WHERE rank <= {k})")


DOC_CORPUS = "(SELECT doc_id AS id, text FROM documents)"
QUESTIONS = "(SELECT item_id AS qid, text FROM benchmark)"
VEC_CORPUS = "(SELECT d.doc_id AS id, e.embedding FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"
VEC_QUESTIONS = "(SELECT b.item_id AS qid, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"


def hybrid_sql(k: int, alpha: float, doc_filter: str = "TRUE", questions: str = QUESTIONS,
               vquestions: str = VEC_QUESTIONS) -> str:
    corpus = f"(SELECT doc_id AS id, text FROM documents WHERE {doc_filter})"
    vcorpus = ("(SELECT d.doc_id AS id, e.embedding FROM embeddings e JOIN documents d "
               f"ON e.vec_id = d.doc_id WHERE {doc_filter})")
    return f"""WITH {tfidf_ctes(corpus, questions)},
{cosine_ctes(vcorpus, vquestions)},
lex AS (SELECT r.qid, r.id, d.text, r.lexical_score FROM {ranked('lx_sc', 'qid', 'lexical_score', 'id', 2 * k)} r
        JOIN documents d ON d.doc_id = r.id),
sem AS (SELECT r.qid, r.id, d.text, r.semantic_score FROM {ranked('sm_sc', 'qid', 'semantic_score', 'id', 2 * k)} r
        JOIN documents d ON d.doc_id = r.id),
lex1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY lexical_score DESC, id) AS r1
         FROM lex) WHERE r1 = 1),
sem1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY semantic_score DESC, id) AS r1
         FROM sem) WHERE r1 = 1),
mg AS (SELECT coalesce(s.qid, l.qid) AS qid, coalesce(s.id, l.id) AS comment_id,
              coalesce(s.semantic_score, 0.0) AS semantic_score, coalesce(l.lexical_score, 0.0) AS lexical_score
       FROM sem1 s FULL OUTER JOIN lex1 l ON s.qid = l.qid AND s.text = l.text),
hy AS (SELECT *, round({alpha} * semantic_score + {1.0 - alpha} * lexical_score, 6) AS hybrid_score FROM mg)
SELECT qid, comment_id, semantic_score, lexical_score, hybrid_score, rank
FROM {ranked('hy', 'qid', 'hybrid_score', 'comment_id', k)}"""


def keywords(expr: str, terms: list[str]) -> str:
    arr = ", ".join(f"CASE WHEN contains(lower({expr}), {q(t)}) THEN {q(t)} END" for t in sorted(set(terms)))
    return f"list_filter([{arr}], lambda x: x IS NOT NULL)"


def gazetteer_ctes(src: str, table) -> str:
    """CTEs ``gz0``/``gz1`` with (doc_id, toks, best) over ``src``'s clean_text."""
    sets = {1: [], 2: [], 3: []}
    for phrase, _ in table:
        sets[len(phrase.split())].append(phrase)
    cases = " ".join(
        f"WHEN i + {k - 1} <= len(toks) AND array_to_string(toks[i:i + {k - 1}], ' ') IN {in_list(sets[k])} THEN {k}"
        for k in (3, 2, 1) if sets[k])
    return (f"gz0 AS (SELECT doc_id, regexp_extract_all(lower(clean_text), '[\\pL\\pN_]+') AS toks FROM {src}),\n"
            f"gz1 AS (SELECT doc_id, toks, list_transform(range(1, len(toks) + 1), "
            f"lambda i: CASE {cases} ELSE 0 END) AS best FROM gz0)")


def gazetteer_select(table) -> str:
    label = "CASE p " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in table) + " END"
    phrase = "array_to_string(toks[i:i + best[i] - 1], ' ')"
    label = label.replace("CASE p ", f"CASE {phrase} ")
    keep = "best[i] > 0 AND NOT ((i > 1 AND best[i - 1] >= 2) OR (i > 2 AND best[i - 2] >= 3))"
    return (f"list_transform(list_filter(range(1, len(toks) + 1), lambda i: {keep}), "
            f"lambda i: {{'text': {phrase}, 'label': {label}}})")


def terms(expr: str) -> str:
    words = f"regexp_split_to_array(lower(coalesce({expr}, '')), {q('[' + WS + ']+')})"
    return (f"list_distinct(list_filter(list_transform({words}, lambda w: trim(w, {q(STRIP_CHARS)})), "
            f"lambda w: length(w) > 3))")


def faithfulness(answer: str, source: str) -> tuple[str, str]:
    a, s = terms(answer), terms(source)
    ratio = f"(CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {s})) / len({a}) END)"
    return (f"round({ratio}, 3)",
            f"CASE WHEN {ratio} >= {SUPPORTED} THEN 'supported' ELSE 'weakly_supported' END")


def word_count(expr: str) -> str:
    return (f"CAST(len(list_filter(regexp_split_to_array(coalesce({expr}, ''), {q('[' + WS + ']+')}), "
            f"lambda w: w <> '')) AS BIGINT)")


def route(expr: str) -> str:
    low = f"lower(coalesce({expr}, ''))"
    whens = " ".join(f"WHEN regexp_matches({low}, {q(p)}) THEN {q(n)}" for n, p in ROUTE_RULES)
    return f"(CASE {whens} ELSE 'rag_agent' END)"


def guard(expr: str) -> str:
    blank = f"regexp_replace(coalesce({expr}, ''), {q('^[' + WS + ']+|[' + WS + ']+$')}, '', 'g') = ''"
    return f"(CASE WHEN {blank} THEN NULL ELSE {expr} END)"


def polarity(g: str, toks: str) -> tuple[str, str]:
    w = "CASE t " + " ".join(f"WHEN {q(a)} THEN {b}" for a, b in POLARITY) + " ELSE 0.0 END"
    mean = (f"(CASE WHEN len({toks}) > 0 THEN list_sum(list_transform({toks}, lambda t: CAST({w} AS DOUBLE)))"
            f" / len({toks}) ELSE 0.0 END)")
    label = (f"CASE WHEN {g} IS NULL THEN 'neutral' WHEN {mean} > 0 THEN 'positive' WHEN {mean} < 0 THEN 'negative'"
             f" ELSE 'neutral' END")
    score = f"CASE WHEN {g} IS NULL THEN 0.0 ELSE round(least(abs({mean}) * 10, 1.0), 6) END"
    return label, score


def emotion(g: str, toks: str) -> tuple[str, str]:
    labs = sorted(EMOTION_WORDS)
    cnt = {lab: f"len(list_filter({toks}, lambda t: t IN {in_list(EMOTION_WORDS[lab])}))" for lab in labs}
    best = "greatest(" + ", ".join(cnt[x] for x in labs) + ")"
    total = "(" + " + ".join(cnt[x] for x in labs) + ")"
    whens = " ".join(f"WHEN {cnt[x]} = {best} THEN {q(x)}" for x in labs)
    label = f"CASE WHEN {g} IS NULL OR {best} = 0 THEN 'neutral' {whens} END"
    score = f"CASE WHEN {g} IS NULL OR {best} = 0 THEN 0.0 ELSE round({best} / {total}, 6) END"
    return label, score


def irony(g: str, toks: str) -> tuple[str, str]:
    c = f"len(list_filter({toks}, lambda t: t IN {in_list(IRONY_CUES)}))"
    label = f"CASE WHEN {g} IS NOT NULL AND {c} >= 2 THEN 'irony' ELSE 'non_irony' END"
    score = f"CASE WHEN {g} IS NULL THEN 0.0 ELSE round({c} / ({c} + 2.0), 6) END"
    return label, score
