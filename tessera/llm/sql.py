"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS queue,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         CASE rank % 3 WHEN 0 THEN 4.0::DOUBLE / 3.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w0,
         CASE rank % 3 WHEN 0 THEN -2.0::DOUBLE / 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS k,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget, (2 * source_size)::DOUBLE AS cap
  FROM by_source),
filling AS (
  SELECT *, cap / weight AS ratio,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS used,
         sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM weighed),
full_ones AS (SELECT *, budget - used >= ratio * left_weight AS is_full FROM filling),
levels AS (
  SELECT *, (budget - sum(CASE WHEN is_full THEN cap ELSE 0.0::DOUBLE END) OVER ())
            / nullif(sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE weight END) OVER (), 0.0::DOUBLE) AS level
  FROM full_ones),
targets AS (SELECT source, source_size, w0, k, CASE WHEN is_full THEN cap ELSE level * weight END AS target FROM levels),
queued AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.w0, t.k,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.queue, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
took AS (
  SELECT *, least(size, greatest(floor(target)::BIGINT - start, 0))::BIGINT AS first_pass,
         least(size, greatest(floor(target)::BIGINT - (start + source_size), 0))::BIGINT AS second_pass
  FROM queued),
placed AS (
  SELECT *, least((start + CASE WHEN first_pass > 0 THEN 0 ELSE source_size END + size / 2) / nullif(target, 0.0::DOUBLE), 1.0::DOUBLE) AS c FROM took)
SELECT doc_id, size, source_size, target, (first_pass + second_pass)::BIGINT AS taken,
       CASE WHEN first_pass + second_pass > 0 THEN round(coalesce(2 * c / nullif(w0 + sqrt(w0 * w0 + 2 * k * c), 0.0::DOUBLE), 0.0::DOUBLE), 6) END AS position
FROM placed
"""

OP2 = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] FOR i IN range(1, len(w) - 1)])
                           WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END AS s
  FROM texts),
tokens AS (SELECT rid, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT x, y FROM (SELECT a.rid AS x, b.rid AS y, a.n AS n, b.n AS m, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.rid < b.rid GROUP BY ALL)
  WHERE 100 * c >= 90 * (n + m - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT rid, rid FROM sets UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT a.doc_id, len(a.s)::BIGINT AS n_shingles, min(b.doc_id) AS component_id
FROM reach r JOIN sets a ON a.rid = r.x JOIN sets b ON b.rid = r.y GROUP BY a.rid, a.doc_id, a.s
"""

OP7 = r"""
WITH texts AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts WHERE len(w) >= 13)),
least_of AS (SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM windows JOIN least_of USING (win) WHERE first_doc < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(removed.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

OP8 = r"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
digests AS (
  SELECT page_id, body, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 10 * (j // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (j % 8))) & 31)::INTEGER, 1) FOR j IN range(0, 32)], '') AS payload_digest
  FROM payloads),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_page FROM digests)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM firsts
"""

OP11 = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
counted AS (
  SELECT lang, len(g) AS m, array_to_string(g, ' ') AS phrase, count(*)::BIGINT AS f
  FROM (SELECT lang, w[i : i + m - 1] AS g FROM places, range(1, 6) AS s(m) WHERE i + m - 1 <= len(w))
  GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM counted WHERE m >= 2),
cuts AS (
  SELECT s.lang, s.phrase, s.f AS a, k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * s.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM split s, range(1, 5) AS c(k)
  JOIN counted l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1 : k], ' ')
  JOIN counted r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[k + 1 : ], ' ')
  JOIN totals t ON t.lang = s.lang
  WHERE k < s.m),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[j : j + n - 1], ' ') AS phrase, max(f) AS longer FROM split, range(2, 5) AS a(n), range(1, 5) AS b(j) WHERE n < m AND j + n - 1 <= m GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
"""

_ROUNDS = "".join(
    f"""a{i} AS MATERIALIZED (
  SELECT vec_id, v, arg_min(j, (d, j)) AS j, min(d) AS d
  FROM (SELECT vec_id, v, j, list_sum([(v[x] - c[x]) * (v[x] - c[x]) FOR x IN range(1, 65)])::BIGINT AS d FROM vectors, c{i}) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (
  SELECT j, CASE WHEN count(s) = 0 THEN any_value(c) ELSE list((s - ((s % n) + n) % n) // n ORDER BY x) END AS c
  FROM c{i} LEFT JOIN (SELECT j, x, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(v) AS e, unnest(range(1, 65)) AS x FROM a{i}) GROUP BY ALL) USING (j) GROUP BY j),
"""
    for i in range(10)
)

OP12 = f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(1024 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, v AS c FROM vectors QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= 8),
{_ROUNDS}last AS (
  SELECT vec_id, arg_min(j, (d, j)) AS j, min(d) AS d
  FROM (SELECT vec_id, v, j, list_sum([(v[x] - c[x]) * (v[x] - c[x]) FOR x IN range(1, 65)])::BIGINT AS d FROM vectors, c10) GROUP BY vec_id, v)
SELECT vec_id, j::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN c10 USING (j)
"""

ORACLE_SQL = {"op1_mixing": OP1, "op2_jaccard": OP2, "op7_substring": OP7, "op8_warc": OP8, "op11_collocation": OP11, "op12_clustering": OP12}
