"""What an independent SQL engine should answer for the queries that SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
_alphabet = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_quarter = "CAST('0x' || x[{at} + 1:{at} + 5] AS BIGINT)"
_base32 = " || ".join(f"{_alphabet}[({_quarter.format(at=5 * i)} >> {s}) % 32 + 1]" for i in range(8) for s in (15, 10, 5, 0))

WARC = f"""
SELECT page_id, octet_length(encode(h)) AS payload_bytes, {_base32} AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, url
FROM (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first
      FROM (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h FROM pages))"""

_words = f"list_filter(regexp_split_to_array({{}}, '{SPACE}'), lambda x: x <> '')"


def quality(limits: dict[int, float], line: float, chars: float) -> str:
    """Repetition coverage: a word lies in a later copy of an n-gram if one starts at it or at
    one of the n - 1 words before it."""
    gram = lambda n: " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER w" for k in range(1, n))])
    grams = "".join(f""",
g{n} AS (SELECT doc_id, coalesce(sum(length(word)) FILTER (WHERE hit), 0) / greatest(sum(length(word)), 1) AS share FROM (
    SELECT doc_id, word, max(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit
    FROM (SELECT doc_id, pos, word, gram IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY pos) > 1 AS later
          FROM (SELECT doc_id, pos, word, {gram(n)} AS gram FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)))) GROUP BY doc_id)""" for n in limits)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_words.format("coalesce(text, '')")} AS ws FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM d),
r AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n_repeat_words FROM (
    SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit
    FROM (SELECT doc_id, pos, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice
          FROM (SELECT doc_id, pos, {gram(3)} AS gram FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)))) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, sum(length(line)) AS chars, count(*) FILTER (WHERE nth > 1) AS dup, coalesce(sum(length(line)) FILTER (WHERE nth > 1), 0) AS dup_chars
    FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) GROUP BY doc_id){grams},
m AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(l.dup / l.n, 0) AS dup_line_share, coalesce(l.dup_chars / greatest(l.chars, 1), 0) AS dup_line_chars_share,
    {", ".join(f"coalesce(g{n}.share, 0) AS dup_{n}gram_share" for n in limits)}
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id) {" ".join(f"LEFT JOIN g{n} USING (doc_id)" for n in limits)})
SELECT *, NOT base_failed AND dup_line_share <= {line} AND dup_line_chars_share <= {chars}
  AND {" AND ".join(f"dup_{n}gram_share <= {limit}" for n, limit in limits.items())} AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)"""


_lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words.format(_lower)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: md5(array_to_string(ws[i:i + 4], ' ')))) AS shingle
    FROM d WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.size + nb.size - shared)),
r AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT e.a, r.seen FROM r JOIN e ON e.b = r.doc_id)
SELECT doc_id, coalesce(size, 0) AS n_shingles, least AS component_id, doc_id = least AS kept
FROM (SELECT doc_id, min(seen) AS least FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""


_upper, _lower_letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_crc_units = ("flatten(list_transform(range(0, octet_length(encode(s))), lambda i: "
              "[CAST('0x' || hex(encode(s))[2 * i + 1:2 * i + 2] AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))")
VARIANTS = f"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), {_upper}, {_lower_letters}) AS run FROM documents),
c AS (SELECT run, id || ':' || run AS s, count(*) AS c FROM r WHERE length(run) >= 7 GROUP BY id, run),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, {_crc_units}), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) AS h FROM c),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, c FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS shorter FROM x),
pairs AS (
  SELECT cut.word AS a, w.word AS b FROM cut JOIN w ON w.word = cut.shorter
  UNION ALL SELECT w.word, cut.word FROM cut JOIN w ON w.word = cut.shorter
  UNION ALL SELECT p.word, q.word FROM (SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM x) p
    JOIN (SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM x) q ON p.i = q.i AND p.head = q.head AND p.tail = q.tail AND p.word <> q.word),
k AS (SELECT a, count(*) AS n_near, min({{'rank': -w.n, 'word': b}}) AS best FROM pairs JOIN w ON w.word = b GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.rank >= 10 * w.n THEN best.word END AS form, CASE WHEN -best.rank >= 10 * w.n THEN -best.rank END AS form_n
  FROM w LEFT JOIN k ON k.a = w.word),
t AS (SELECT word, word AS here, 0 AS depth FROM f UNION ALL SELECT t.word, f.form, depth + 1 FROM t JOIN f ON f.word = t.here WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(here, depth) AS root FROM t GROUP BY word) USING (word)"""

_terms = f"unnest(regexp_extract_all(translate(text, {_upper}, {_lower_letters}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
RANKED = f"""
WITH t AS (SELECT doc_id, {_terms} AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, {_terms} AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
c AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 10"""
