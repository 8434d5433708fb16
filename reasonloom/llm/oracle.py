"""DuckDB SQL for the operators that SQL can express, written from their rules.

Everything is compared with everything here: no cascade, no seeds, no bands. The n-gram join
chooses its bands for a recall of 0.9999; the SQL below finds all pairs.
"""

from __future__ import annotations

from reasonloom.llm import licenses

QUALITY = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, (words[i], words[i + 1], words[i + 2]) AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base)
), counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM counted WHERE n > 1) GROUP BY doc_id
), measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(text, '[^\p{L}\p{M}]+', '', 'g')) AS n_letters,
    length(regexp_replace(text, '[^\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}'
      || '\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]+', '', 'g')) AS n_unspaced,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*(?:[-*•‣]|\d+[.)])[ \t]'))) AS n_bullets
  FROM base LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (
    10 * n_symbols > n_words OR word_chars < 2 * n_words
    OR (word_chars > 14 * n_words AND 2 * n_unspaced < word_chars)
    OR (n_dup_lines > 3 AND 2 * n_dup_lines > n_lines) OR 10 * n_bullets > 9 * n_lines
    OR 10 * n_letters < 6 * word_chars) AS kept
FROM judged
"""

DECONTAMINATION = r"""
WITH doc_words AS (
  SELECT doc_id, words, len(words) AS n FROM (
    SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'),
                               lambda x: x <> '') AS words FROM documents)
), items AS (
  SELECT item_id, words, len(words) AS n FROM (
    SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'),
                                lambda x: x <> '') AS words FROM benchmark)
  WHERE len(words) >= 8
), windows AS (
  SELECT item_id, s, words[s + 1:s + 13] AS w
  FROM (SELECT item_id, words, unnest(range(0, greatest(n - 13, 0) + 1)) AS s FROM items)
), named AS (SELECT item_id, s, len(w) AS size FROM windows),
d AS (SELECT doc_id, n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM doc_words),
b AS (SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS q FROM items),
hits AS (SELECT doc_id, n, item_id, p - q AS diagonal, q FROM d JOIN b USING (word)),
likely AS (SELECT doc_id, item_id, diagonal FROM hits GROUP BY ALL HAVING count(*) >= 8),
matched AS (
  SELECT h.doc_id, h.item_id, h.diagonal + w.s AS first_word, count(*) AS matched,
    any_value(w.size) AS size
  FROM hits h JOIN likely USING (doc_id, item_id, diagonal)
  JOIN named w ON w.item_id = h.item_id AND h.q >= w.s AND h.q < w.s + w.size
  WHERE h.diagonal + w.s >= 0 AND h.diagonal + w.s + w.size <= h.n
  GROUP BY h.doc_id, h.item_id, h.diagonal, w.s
)
SELECT doc_id, item_id, CAST(min(first_word) AS BIGINT) AS first_word,
  CAST(max(matched) AS BIGINT) AS matched
FROM matched WHERE matched >= CASE WHEN size < 13 THEN size ELSE 11 END GROUP BY doc_id, item_id
"""

NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
), grams AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(
    range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g
  FROM words WHERE len(w) > 0
), keyed AS (SELECT doc_id, md5(array_to_string(g, '|')) AS k, g FROM grams),
sets AS (
  SELECT k, count(*) AS copies, min(doc_id) AS least, any_value(g) AS g FROM keyed GROUP BY k
), one AS (SELECT k, len(g) AS size, unnest(g) AS gram FROM sets),
pairs AS (
  SELECT a.k AS a, b.k AS b FROM one a JOIN one b ON a.gram = b.gram AND a.k <> b.k
  GROUP BY a.k, b.k, a.size, b.size HAVING count(*) / (a.size + b.size - count(*)) >= 0.8
), reached AS (
  SELECT k AS a, k AS b FROM sets
  UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON p.a = r.b
), classes AS (
  SELECT r.a AS k, min(s.least) AS class_id, CAST(sum(s.copies) AS BIGINT) AS class_size
  FROM reached r JOIN sets s ON s.k = r.b GROUP BY r.a
), links AS (SELECT p.a AS k, sum(s.copies) AS n FROM pairs p JOIN sets s ON s.k = p.b GROUP BY p.a)
SELECT doc_id, class_id, CAST(s.copies - 1 + coalesce(l.n, 0) AS BIGINT) AS n_links, class_size
FROM keyed JOIN sets s USING (k) JOIN classes USING (k) LEFT JOIN links l USING (k)
UNION ALL
SELECT doc_id, doc_id, 0, 1 FROM words WHERE len(w) = 0
"""

COLLOCATIONS = r"""
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
counts AS (
  SELECT lang, size, phrase, count(*) AS n FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2),
      lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM words, (SELECT unnest([1, 2, 3, 4]) AS size) s WHERE len(w) >= size)
  GROUP BY ALL HAVING count(*) >= 30
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2
), inner_parts AS (
  SELECT lang, n, unnest(list_transform(range(1, size - m + 2),
    lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM candidates, (SELECT unnest([2, 3]) AS m) s WHERE m < size
), covers AS (SELECT lang, phrase, max(n) AS longer FROM inner_parts GROUP BY ALL),
cuts AS (
  SELECT c.*, unnest(range(1, size)) AS k FROM candidates c
  LEFT JOIN covers v USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * n
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.n AS a, k, x.n AS l, y.n AS r,
    CAST((2000000::HUGEINT * c.n) // (x.n + y.n) AS BIGINT) AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
), links AS (
  SELECT e.lang, e.phrase, f.phrase AS next
  FROM candidates e JOIN counts v ON v.lang = e.lang AND v.n = e.n
    AND v.phrase = array_to_string(e.w[2:4], ' ')
  JOIN candidates f ON f.lang = e.lang AND f.n = e.n AND f.size = 4
    AND array_to_string(f.w[1:3], ' ') = v.phrase
  WHERE e.size = 4
), walk AS (
  SELECT lang, phrase AS head, phrase, 1 AS place FROM links
  WHERE (lang, phrase) NOT IN (SELECT (lang, next) FROM links)
  UNION ALL
  SELECT w.lang, w.head, l.next, w.place + 1 FROM walk w JOIN links l
  ON l.lang = w.lang AND l.phrase = w.phrase
), paths AS (
  SELECT lang, phrase, max(place) OVER (PARTITION BY lang, head) + 3 AS path_words FROM walk
)
SELECT lang, rank, phrase, a, l, r, n, score,
  CAST(coalesce(path_words, size) AS BIGINT) AS path_words
FROM ranked JOIN totals USING (lang) LEFT JOIN paths USING (lang, phrase) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op3_ngram_join": NGRAM_JOIN,
    "op5_quality_rules": QUALITY,
    "op6_decontamination": DECONTAMINATION,
    "op9_license_scan": licenses.oracle_sql(),
    "op13_collocations": COLLOCATIONS,
}
