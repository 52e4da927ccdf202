"""The query of personal data in SQL: the same patterns, co-occurrence and disclosure, by other means."""

_KIND = """SELECT doc_id, {k} AS k, text, i, m[i] AS m, sum(length(b[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop
  FROM (SELECT doc_id, text, m, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS b FROM d))"""
#: The contract's patterns as they are.
_PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(_KIND.format(k=k, p=p) for k, p in enumerate(_PATTERNS))}),
num AS (SELECT *, stop - length(m) AS start, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM raw),
luhn AS (SELECT *, list_sum(list_transform(range(0, length(digits)), lambda j: CASE WHEN j % 2 = 0 THEN digits[length(digits) - j]::INT WHEN digits[length(digits) - j]::INT > 4 THEN 2 * digits[length(digits) - j]::INT - 9 ELSE 2 * digits[length(digits) - j]::INT END)) AS total FROM num),
base AS (SELECT doc_id, text, k, start::INT AS start, stop::INT AS stop, m FROM luhn WHERE CASE k WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0
  WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND total % 10 = 0 ELSE length(digits) BETWEEN 10 AND 15 END),
line AS (SELECT doc_id, l, row_number() OVER () AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)),
total AS (SELECT count(*)::DOUBLE AS total FROM line),
df AS (SELECT word, count(*) AS df FROM (SELECT line, unnest(list_distinct(regexp_split_to_array(l, '[^\\p{{L}}]+'))) AS word FROM line) GROUP BY word),
blank AS (SELECT doc_id, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || repeat(' ', coalesce(length(m[i]), 0))), '') AS text
  FROM (SELECT doc_id, regexp_extract_all(text, '{_PATTERNS[0]}') AS m, regexp_split_to_array(text, '{_PATTERNS[0]}') AS b FROM d WHERE doc_id IN (SELECT doc_id FROM base))),
has AS (SELECT DISTINCT doc_id, k || ':' || m AS entity, length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) + 1 AS pos FROM base),
said AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(ls[pos], '\\p{{L}}{{4,}}'))) AS word, pos
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM blank))),
n AS (SELECT entity, count(*) AS n FROM has GROUP BY entity),
pair AS (SELECT entity, word, count(*) AS both_ FROM has JOIN said USING (doc_id, pos) GROUP BY ALL),
tell AS (SELECT entity, word FROM pair JOIN n USING (entity) LEFT JOIN df USING (word), total
  WHERE log2(both_ * total / (n * greatest(coalesce(df, 0), both_))) >= 0.9 * log2(greatest(total, n + 1) / n)),
word AS (SELECT doc_id, w[i] AS word, sum(length(b[i]) + length(w[i])) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\\p{{L}}{{4,}}') AS w, regexp_split_to_array(text, '\\p{{L}}{{4,}}') AS b FROM blank))),
span AS (SELECT doc_id, start, k, stop FROM base
  UNION SELECT doc_id, (stop - length(word))::INT, 4, stop::INT FROM word WHERE (doc_id, word) IN (SELECT doc_id, word FROM has JOIN tell USING (entity))),
text AS (SELECT doc_id, string_agg(['email', 'ip', 'card', 'phone', 'term'][k + 1] || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans,
  string_agg(['email', 'ip', 'card', 'phone', 'term'][k + 1] || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 4) AS base,
  count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN text USING (doc_id)
"""
