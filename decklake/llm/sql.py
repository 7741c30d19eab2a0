"""SQL (DuckDB's) that gives the rows of the queries it can express."""

WORDS = r"[^\x20\x09-\x0D]+"

OP8 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

OP9 = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS tag, strlen(coalesce(html, '')) AS bytes,
         CAST('0x' || substr(md5(concat_ws('|', url, page_id)), 1, 8) AS BIGINT) AS h
  FROM pages
), r AS (
  SELECT page_id * 2 AS record_id, url, 'response' AS kind, page_id * 10 AS captured, tag AS etag, tag, bytes FROM p
  UNION ALL
  SELECT page_id * 2 + 1, url, 'revisit', page_id * 10 + 5 + h % 4000, CASE WHEN h % 8 = 0 THEN md5(tag || '*') ELSE tag END, tag, bytes FROM p
), b AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM r
), c AS (
  SELECT *,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www\d?\.', '')
      || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
      || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
           lambda f: f <> '' AND NOT regexp_matches(f, '^(?:utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&'), ''), '') AS canonical
  FROM b
), l AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS)
    OVER (PARTITION BY canonical ORDER BY captured, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM c
), m AS (
  SELECT l.*, CASE WHEN l.kind = 'revisit' THEN l.before END AS refers_to, f.etag AS found_etag, f.bytes AS found_bytes
  FROM l LEFT JOIN r f ON l.kind = 'revisit' AND f.record_id = l.before
), s AS (
  SELECT *, CASE WHEN kind <> 'revisit' THEN NULL WHEN refers_to IS NULL THEN 'missing' WHEN etag = found_etag THEN 'resolved' ELSE 'mismatch' END AS status FROM m
)
SELECT record_id, canonical, kind, captured, refers_to, status,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || found_bytes || chr(10)
    || 'content-type: text/html' || chr(10) || 'date: ' || captured || chr(10) || 'etag: ' || etag END AS merged_headers
FROM s
"""

OP1 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source
), w AS (
  SELECT *, CASE rk % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s
), o AS (
  SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER b, 0) AS capped, coalesce(sum(weight) OVER b, 0) AS heavier, CAST(sum(source_size) OVER () AS DOUBLE) AS words, sum(weight) OVER () AS weights
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (words - capped) / (weights - heavier) AS lev FROM o
), f AS (
  SELECT *, (SELECT arg_min(lev, ratio) FROM l WHERE lev <= ratio) AS level FROM l
), t AS (
  SELECT *, CASE WHEN level IS NULL THEN cap ELSE least(cap, greatest(level, 0) * weight) END AS target FROM f
), h AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rk, t.weight, CAST('0x' || substr(md5(concat_ws('|', 0, d.doc_id, d.size)), 1, 15) AS BIGINT) AS h, CAST(ceil(t.n / 2000.0) AS BIGINT) AS buckets
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY rk ORDER BY h % buckets, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, CAST(round(target) AS BIGINT) AS cut FROM h
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(start + size, cut) - start) + greatest(0, least(start + source_size + size, cut) - start - source_size) + greatest(0, least(start + 2 * source_size + size, cut) - start - 2 * source_size) AS BIGINT) AS taken,
  CAST((size > 0 AND start + size / 2 < target)::INT + (size > 0 AND start + source_size + size / 2 < target)::INT + (size > 0 AND start + 2 * source_size + size / 2 < target)::INT AS INT) AS copies,
  CASE WHEN target > 0 AND size > 0 AND start < cut THEN
    round(least(1.0, 2 * (start / target * weight) / (weight * lo + sqrt(weight * lo * (weight * lo) + 2 * (weight * hi - weight * lo) * (start / target * weight)))), 9) ELSE 1.0 END::DOUBLE AS position
FROM (SELECT *, CASE WHEN rk % 2 = 0 THEN 1.5 ELSE 0.5 END::DOUBLE AS lo, CASE WHEN rk % 2 = 0 THEN 0.5 ELSE 1.5 END::DOUBLE AS hi FROM c)
"""

OP12 = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), f AS (
  SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM d
), m AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), n(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM n p, n q, n r, n s, n t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), st AS (
  SELECT filter_order, CAST(k AS INT) AS step, filter_order[k:k] AS own, filter_order[1:k - 1] AS before FROM o, range(1, 6) AS g(k)
), g AS (
  SELECT m.part, filter_order, step, own, n, good, toxic, contains(fails, own) AS hit, len(regexp_replace(fails, '[' || before || '.]', '', 'g')) < len(fails) AS gone, fails = own AS alone
  FROM m, st
), r AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM g GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


def _op13(rounds: int = 6) -> str:
    """Rounds of plain k-means: the nearest of all entries, then floors of means."""
    ctes = [r"""
v AS MATERIALIZED (
  SELECT vec_id, label, p, list_transform(embedding[p * (len(embedding) // 8) + 1 : (p + 1) * (len(embedding) // 8)], lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS x
  FROM embeddings, range(8) AS g(p)
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS y FROM v QUALIFY k < 16
)"""]
    for n in range(rounds + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min((e, k)) AS best FROM (
    SELECT vec_id, label, v.p, x, k, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS BIGINT) AS e FROM v JOIN b{n} b ON v.p = b.p) GROUP BY vec_id, p
)""")
        if n < rounds:
            ctes.append(f"""b{n + 1} AS MATERIALIZED (
  SELECT b.p, b.k, coalesce(m.y, b.y) AS y FROM b{n} b LEFT JOIN (
    SELECT p, k, list(c ORDER BY i) AS y FROM (
      SELECT p, best[2] AS k, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS c FROM a{n}, range(1, 1000) AS g(i) WHERE i <= len(x) GROUP BY p, best[2], i) GROUP BY p, k) m
  ON b.p = m.p AND b.k = m.k
)""")
    return "WITH " + ", ".join(ctes) + f""", r AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lpad(to_hex(best[2]), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, k)) FROM b{rounds}) AS codebooks_sha256 FROM r
"""


OP13 = _op13()

ORACLES = {"op1_mixing": OP1, "op8_exact_dedup": OP8, "op9_warc_revisits": OP9, "op12_filter_audit": OP12, "op13_vector_codes": OP13}
