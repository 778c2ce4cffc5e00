"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import fill_middle, mixing, ngram_join, quality

SPACES = r"[\x20\x09-\x0D]+"

OP2 = rf"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {ngram_join.SHINGLE} THEN array_to_string(w, ' ')
         ELSE array_to_string(w[i:i + {ngram_join.SHINGLE - 1}], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {ngram_join.SHINGLE} + 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT p.a, p.b, p.both = x.n AND p.both = y.n AS same FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
  WHERE p.both >= {ngram_join.THRESHOLD} * (x.n + y.n - p.both) - 1e-9),
reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen)
SELECT d.doc_id, (SELECT min(seen) FROM reach r WHERE r.doc_id = d.doc_id) AS class_id,
       1 + (SELECT count(*) FROM links l WHERE l.a = d.doc_id AND l.same) AS n_copies,
       (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
FROM documents d
"""

OP4 = rf"""
WITH RECURSIVE
docs AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '')) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
src AS (
  SELECT source, source_size, {mixing.MAX_EPOCHS}.0 * source_size AS stop,
         [{', '.join(f'{x}.0' for x in mixing.WEIGHTS)}][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS INTEGER)] AS weight
  FROM sums),
level AS (
  SELECT 0 AS round, (SELECT {mixing.TOTAL_SHARE} * sum(source_size) / sum(weight) FROM src) AS lv
  UNION ALL
  SELECT round + 1, (SELECT ({mixing.TOTAL_SHARE} * sum(source_size) - sum(CASE WHEN weight * l.lv > stop THEN stop ELSE 0 END))
                            / sum(CASE WHEN weight * l.lv > stop THEN 0 ELSE weight END) FROM src)
  FROM level l WHERE round < 100),
goal AS (
  SELECT source, source_size, least(stop, weight * (SELECT max(lv) FROM level)) AS target FROM src),
cut AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM goal),
ties AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM docs GROUP BY source, h),
taken AS (
  SELECT t.source, t.h, c.passes + CASE
           WHEN t.upto <= c.target - c.passes * c.source_size THEN 1
           WHEN t.upto - t.words <= c.target - c.passes * c.source_size
                AND t.upto - (c.target - c.passes * c.source_size) < (c.target - c.passes * c.source_size) - (t.upto - t.words) THEN 1
           ELSE 0 END AS copies
  FROM ties t JOIN cut c ON t.source IS NOT DISTINCT FROM c.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, c.source_size, c.target, CAST(k.copies * d.size AS BIGINT) AS taken
FROM docs d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source
JOIN taken k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""

OP9 = rf"""
WITH
base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         row_number() OVER () AS r
  FROM documents),
grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY r),
measured AS (
  SELECT b.doc_id, b.source, CAST(len(b.w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(b.t, '{SPACES}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(b.t) - length(regexp_replace(b.t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(b.l) - len(list_distinct(b.l)) AS BIGINT) AS n_dup_lines, len(b.l) AS n_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM base b LEFT JOIN covered c ON c.r = b.r),
ruled AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed,
         n_symbols > {quality.MAX_SYMBOL_SHARE} * n_words OR n_dup_lines > {quality.MAX_DUP_LINE_SHARE} * n_lines AS soft_failed
  FROM measured),
hosts AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR soft_failed)::DOUBLE AS failed FROM ruled GROUP BY source),
moments AS (
  SELECT sum(failed) / sum(n) AS m, sum(failed * failed / n) / sum(n) AS s, count(*) / sum(n) AS kn FROM hosts),
spread AS (SELECT m, s - m * m - m * (1 - m) * kn AS v FROM moments),
prior AS (
  SELECT m, CASE WHEN v <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, m * (1 - m) / v - 1)) END AS strength FROM spread),
rates AS (
  SELECT source, (failed + m * strength) / (n + strength) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate < {quality.HOST_REJECT} AND NOT (soft_failed AND rate >= {quality.HOST_TRUST}) AS kept
FROM ruled r JOIN rates h ON r.source IS NOT DISTINCT FROM h.source
"""

TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11 = rf"""
WITH
docs AS (SELECT * FROM (SELECT doc_id, {TERMS} AS w FROM documents) WHERE len(w) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM docs),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs) GROUP BY 1, 2),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term),
lengths AS (SELECT doc_id, 100 - 90 + (90 * len(w) * big_n) // big_l AS m FROM docs, total),
items AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark)),
scores AS (
  SELECT item_id, c.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM items JOIN counts c USING (term) JOIN weights USING (term) JOIN lengths l ON l.doc_id = c.doc_id GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP12 = rf"""
WITH
cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, w, len(w) AS n, {', '.join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM cut),
placed AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fill_middle.CUT_PCT} THEN 'plain'
              WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST_PCT} THEN 'spm' ELSE 'psm' END AS form, w FROM drawn),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS head, array_to_string(w[a + 1:b], '') AS mid,
         array_to_string(w[b + 1:n], '') AS tail FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(head) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid
                        ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

ORACLE_SQL = {"op11_lexical_search": OP11, "op12_fill_in_middle": OP12, "op2_ngram_join": OP2, "op4_mix_sources": OP4, "op9_host_quality": OP9}
