"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = r"""
WITH l AS (
  SELECT doc_id, u.k - 1 AS number, list_distinct(regexp_extract_all(u.line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'k': i, 'line': x})) AS u FROM documents)),
w AS (SELECT doc_id, number, unnest(words) AS w FROM l),
f AS (SELECT w, count(*) AS f FROM w GROUP BY w),
s AS (SELECT doc_id, number, list(w ORDER BY f, w) AS words FROM w JOIN f USING (w) GROUP BY doc_id, number),
d AS (
  SELECT words, len(words) AS n, min({'doc': doc_id, 'number': number}) AS head FROM s GROUP BY words),
e AS (SELECT head, n, words, unnest(words[1:n - ((4 * n + 4) // 5) + 1]) AS w FROM d),
near AS (
  SELECT DISTINCT b.head AS head
  FROM e a JOIN e b ON a.w = b.w AND a.head < b.head AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  WHERE 9 * len(list_intersect(a.words, b.words)) >= 4 * (a.n + b.n)),
g AS (
  SELECT s.doc_id, s.number,
    d.head <> {'doc': s.doc_id, 'number': s.number} OR d.head IN (SELECT head FROM near) AS gone
  FROM s JOIN d ON s.words = d.words)
SELECT l.doc_id, count(g.gone) AS n_lines, count(*) FILTER (WHERE g.gone) AS n_removed,
  coalesce(string_agg(CASE WHEN g.gone THEN CAST(l.number AS VARCHAR) END, ',' ORDER BY l.number), '') AS removed_lines
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.number = g.number GROUP BY l.doc_id
"""

OP4 = r"""
WITH rules(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
m AS (
  SELECT p.*, r_host || r_path AS r, r_verdict AS v,
    row_number() OVER (PARTITION BY rid ORDER BY length(r_host) + length(r_path) DESC NULLS LAST, length(r_host) DESC) AS k
  FROM p LEFT JOIN rules
    ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, r AS rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, CAST(len({_WORDS}) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind
  FROM d GROUP BY source),
w AS (SELECT *, CASE kind WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
    CAST(coalesce(sum(source_size * 3) OVER o, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(weight) OVER o, 0) AS BIGINT) AS weight_before
  FROM w
  WINDOW o AS (ORDER BY source_size * 3.0 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, CAST(total - cap_before AS DOUBLE) / CAST(all_weight - weight_before AS DOUBLE) AS level FROM r),
f AS (SELECT max(level) FILTER (WHERE source_size * 3 >= weight * level) AS level FROM l),
g AS (
  SELECT source, source_size, kind,
    CASE WHEN source_size * 3 < weight * f.level THEN CAST(source_size * 3 AS DOUBLE) ELSE weight * f.level END AS target
  FROM l, f),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.kind, CAST(round(g.target) AS BIGINT) AS goal,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
t AS (
  SELECT *,
    greatest(least(goal - start, size), 0) + greatest(least(goal - source_size - start, size), 0)
      + greatest(least(goal - 2 * source_size - start, size), 0) AS taken,
    coalesce(CAST(start AS DOUBLE) / nullif(target, 0), 0) AS share,
    CASE kind WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a,
    CASE kind WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS slope
  FROM p)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN
    round(least(coalesce(2.0::DOUBLE * share / nullif(a + sqrt(greatest(a * a + 2 * slope * share, 0)), 0), 0), 1.0::DOUBLE), 6) END AS position
FROM t
"""

OP9 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
p AS (
  SELECT rid, pos, words[pos] AS a, words[pos + 1] AS b, words[pos + 2] AS c
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS pos FROM d WHERE len(words) >= 3)),
t AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM p),
w AS (SELECT DISTINCT rid, unnest([pos, pos + 1, pos + 2]) AS pos FROM t WHERE n > 1),
rep AS (SELECT rid, count(*) AS n FROM w GROUP BY rid),
l AS (
  SELECT rid, count(*) AS n, count(DISTINCT line) AS k
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n - l.k, 0) AS BIGINT) AS n_dup_lines, coalesce(l.n, 0) AS n_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (rid) LEFT JOIN rep USING (rid)),
r AS (
  SELECT *, coalesce(n_symbols::DOUBLE / nullif(word_chars, 0)::DOUBLE, 0) AS sr, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0)::DOUBLE, 0) AS dr,
    coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0)::DOUBLE, 0) AS rr, coalesce(word_chars::DOUBLE / nullif(n_words, 0)::DOUBLE, 0) AS ml
  FROM m),
q AS (
  SELECT lang, source, quantile_disc(sr, [0.25, 0.75]) AS qs, quantile_disc(dr, [0.25, 0.75]) AS qd,
    quantile_disc(rr, [0.25, 0.75]) AS qr, quantile_disc(ml, [0.25, 0.75]) AS qm
  FROM r GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND sr <= qs[2] + greatest(3 * (qs[2] - qs[1]), 0.05::DOUBLE) AND dr <= qd[2] + greatest(3 * (qd[2] - qd[1]), 0.5::DOUBLE)
    AND rr <= qr[2] + greatest(3 * (qr[2] - qr[1]), 0.3::DOUBLE) AND ml <= qm[2] + greatest(3 * (qm[2] - qm[1]), 4.0::DOUBLE)
    AND ml >= qm[1] - greatest(3 * (qm[2] - qm[1]), 4.0::DOUBLE) AS kept
FROM r JOIN q ON r.lang IS NOT DISTINCT FROM q.lang AND r.source IS NOT DISTINCT FROM q.source
"""

ORACLE_SQL = {"op1_line_dedup": OP1, "op9_quality": OP9, "op4_url_filters": OP4, "op5_mixing": OP5}
