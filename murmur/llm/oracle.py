"""SQL that DuckDB can run for the queries that it can express.  Patterns are written out anew."""

GAP = r"[\x20\x09-\x0D]"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _removed(text: str, pattern: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')))"


_TEXT_10 = "coalesce(text, '')"

OP10 = fr"""
WITH d AS (SELECT doc_id, {_TEXT_10} AS text,
    list_filter(regexp_split_to_array({_TEXT_10}, '{GAP}+'), lambda w: w <> '') AS words,
    list_filter(string_split({_TEXT_10}, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, i - coalesce(before, i - 8))) AS n
    FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM rep) GROUP BY doc_id),
f AS (SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST({_removed("text", "[#*$%&|<>]")} AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    {_removed("text", r"\pL+")} AS letters, {_removed("text", r"\p{Lu}+")} AS upper_case,
    {_removed("text", "[!?]+")} AS loud
    FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > 2 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words
         OR word_chars > 15 * n_words OR 2 * upper_case > letters OR 10 * loud > 3 * n_words
         OR 10 * letters < 6 * word_chars) AS kept
FROM b"""


def _words_5(text: str) -> str:
    return fr"regexp_extract_all({LOWER.format(f"coalesce({text}, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP5 = f"""
WITH it AS (SELECT DISTINCT item_id, {_words_5("text")} AS words FROM benchmark),
iw AS (SELECT item_id, i AS o, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS k
    FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM it WHERE len(words) > 0)),
d AS (SELECT doc_id, {_words_5("text")} AS words FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS k
    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
          FROM d, (SELECT DISTINCT n FROM iw) WHERE len(words) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, i, o, n FROM dw JOIN iw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id),
run AS (SELECT doc_id, item_id, n, i - o AS diagonal,
        i - row_number() OVER (PARTITION BY doc_id, item_id, i - o ORDER BY i) AS island FROM hit),
m AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, count(*) + n - 1 AS c FROM run
    GROUP BY doc_id, item_id, n, diagonal, island) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS INTEGER) AS longest_match
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN m USING (doc_id)"""

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '{GAP}+'),
    lambda w: w <> '') AS words FROM documents),
s AS (SELECT doc_id, k FROM (
        SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS k
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3))
    UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM d WHERE len(words) IN (1, 2)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = za.n AND c = zb.n AS same FROM p JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b
    WHERE 100 * c >= 90 * (za.n + zb.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles,
    least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id,
    least(d.doc_id, coalesce((SELECT min(b) FROM l WHERE l.a = d.doc_id AND same), d.doc_id)) AS class_id
FROM d LEFT JOIN z USING (doc_id)"""

ORACLE = {"op1_jaccard_join": OP1, "op5_decontaminate": OP5, "op10_quality_rules": OP10}
