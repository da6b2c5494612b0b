"""DuckDB SQL for the corpus queries that SQL can express."""

OP2 = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(v) AS v FROM good WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN good d ON d.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP4 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS said
  FROM w, unnest(range(1, len(words) - 48)) AS t(i)
), owner AS (
  SELECT said, min(doc_id) AS first_doc FROM windows GROUP BY said
), gone AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT doc_id, i FROM windows JOIN owner USING (said) WHERE first_doc < doc_id) AS x, unnest(range(i, i + 50)) AS t(p)
), kept AS (
  SELECT w.doc_id, string_agg(words[p], ' ' ORDER BY p) AS said, count(*) AS n
  FROM w, unnest(range(1, len(words) + 1)) AS t(p)
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.p = t.p)
  GROUP BY w.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(said, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP5 = r"""
WITH pages_ AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2)), '') AS host,
         DATE '2023-01-01' + CAST(('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6))::INT % 900 AS INT) AS fetch_day
  FROM pages
), names AS (
  SELECT DISTINCT domain FROM (SELECT host AS domain FROM pages_ WHERE host IS NOT NULL
    UNION ALL SELECT regexp_replace(host, '^[^.]+\.', '') FROM pages_ WHERE host IS NOT NULL)
), mixed AS (
  SELECT domain, i, list_transform(range(4), lambda k: ('0x' || substr(md5(domain), CAST(1 + 4 * k AS INT), 4))::INT) AS d
  FROM names, unnest(range(3)) AS t(i)
), entries AS (
  SELECT domain, DATE '2023-01-01' + CAST(d[i + 1] % 730 AS INT) AS day, CAST((d[4] + i) % 3 + 1 AS INT) AS rank
  FROM mixed WHERE d[4] % 4 >= i
), daily AS (
  SELECT domain, day, min(rank) AS rank FROM entries GROUP BY domain, day
), spans AS (
  SELECT domain, ['block', 'allow', 'remove'][rank] AS action, day AS valid_from, lead(day) OVER (PARTITION BY domain ORDER BY day) AS valid_to FROM daily
), asked AS (
  SELECT DISTINCT host, fetch_day, depth, array_to_string(string_split(host, '.')[depth:], '.') AS domain
  FROM pages_, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(depth) WHERE host IS NOT NULL
), active AS (
  SELECT a.host, a.fetch_day, a.domain, action, valid_from, row_number() OVER (PARTITION BY a.host, a.fetch_day ORDER BY depth) AS r
  FROM asked a JOIN spans s ON a.domain = s.domain AND action <> 'remove' AND a.fetch_day >= valid_from AND (valid_to IS NULL OR a.fetch_day < valid_to)
)
SELECT p.page_id, p.host, CAST(p.fetch_day AS VARCHAR) AS fetch_day, a.domain, a.action, CAST(a.valid_from AS VARCHAR) AS valid_from
FROM pages_ p LEFT JOIN active a ON p.host = a.host AND p.fetch_day = a.fetch_day AND r = 1
"""

OP6 = """
WITH own AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest FROM pages
), firsts AS (
  SELECT digest, max(page_id) AS first_id FROM own GROUP BY digest
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([3, 2, 1, 0],
         lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(digest, CAST(1 + 5 * k AS INT), 5))::INT >> (5 * j)) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM own JOIN firsts USING (digest)
"""



def _assigned(name: str, book: str) -> str:
    """Each part's nearest entry of a codebook table (p, e, x), ties to the lower e."""
    return f"""
{name} AS MATERIALIZED (
  SELECT r, p, x, near.d AS d, near.e AS e FROM (
    SELECT r, t.p, any_value(t.x) AS x,
           min({{'d': CAST(list_sum(list_transform(range(1, len(t.x) + 1), lambda i: (t.x[i] - b.x[i]) * (t.x[i] - b.x[i]))) AS BIGINT), 'e': b.e}}) AS near
    FROM parts t JOIN {book} b ON t.p = b.p GROUP BY r, t.p))"""


def _updated(name: str, book: str, assigned: str) -> str:
    """The codebook after a round: means of the parts that chose an entry, rounded down; unused entries stay."""
    return f"""
{name} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
    SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS x FROM (
      SELECT p, e, i, CAST(sum(x[i]) AS DOUBLE) AS total, count(*) AS n FROM {assigned}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY p, e, i)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""


OP11 = f"""
WITH good AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), wide AS (
  SELECT CAST(ceil(max(len(v)) / 16) AS BIGINT) AS w FROM good
), parts AS MATERIALIZED (
  SELECT r, vec_id, p, list_transform(range(1, w + 1), lambda k: coalesce(v[p * w + k], 0)) AS x FROM good, wide, unnest(range(16)) AS t(p)
), book0 AS MATERIALIZED (
  SELECT p, e - 1 AS e, x FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e, x FROM parts
    WHERE r IN (SELECT min(r) FROM good JOIN (SELECT vec_id, min(v) AS v FROM good WHERE vec_id IS NOT NULL GROUP BY vec_id) USING (vec_id, v) GROUP BY vec_id))
  WHERE e <= 64
),{_assigned("near0", "book0")},{_updated("book1", "book0", "near0")},{_assigned("near1", "book1")},{_updated("book2", "book1", "near1")},{_assigned("near2", "book2")},
coded AS (
  SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY p, e, i)) FROM book2, unnest(range(1, len(x) + 1)) AS t(i)) AS codebooks_sha256
FROM good JOIN coded USING (r)
"""

OP12 = r"""
WITH said AS (
  SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS f
  FROM texts JOIN firsts USING (text) LEFT JOIN said USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), bits AS (
  SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda l: CASE l WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS failed FROM flags
), played AS (
  SELECT part, good, toxic, failed, filter_order, step, substr(filter_order, step, 1) AS own,
         coalesce(list_min(list_transform(failed, lambda l: instr(filter_order, l))), 6) AS first
  FROM bits, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counts AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
         count(*) FILTER (first < step AND list_contains(failed, own)) AS redundant, count(*) FILTER (failed = [own]) AS unique_fails,
         count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM played GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counts
"""

#: The tables' pages mark their article, so there the main text is that element's blocks.
OP13 = r"""
WITH own AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1) AS body FROM pages
), cut AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(body, '</?(p|h1)>', chr(1), 'g'), '</?b>|<br>', ' ', 'g'), chr(1)) AS blocks FROM own
), plain AS (
  SELECT page_id, url, list_filter(list_transform(blocks, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM cut
)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10) || chr(10)), '') AS text,
       CAST(length(coalesce(array_to_string(blocks, chr(10) || chr(10)), '')) AS BIGINT) AS n_chars FROM plain
"""

SQL = {"op2_maxscore": OP2, "op4_rlz": OP4, "op5_urlfilter": OP5, "op6_warc": OP6, "op11_vectorcodes": OP11, "op12_filteraudit": OP12, "op13_htmltext": OP13}
