"""SQL that computes operators' results another way (DuckDB)."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
bk AS (SELECT id, w, unnest(range(1, greatest(2, len(w) - 11))) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS s FROM bk),
dk AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS k FROM d),
dw AS (SELECT rid, k, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM dk, (SELECT DISTINCT n FROM bw) WHERE k + n - 1 <= len(w)),
h AS (SELECT rid, k, dw.n, id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM h) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

URL_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/]*')")} AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM r),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, q, v)),
f AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v FROM p JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id),
o AS (SELECT page_id, host, path, rule, v, CASE WHEN rule IS NOT NULL THEN NULL
  WHEN regexp_matches(host || path, '^([^/]*\\.)?spam-farm\\.') THEN 'spam-farm host'
  WHEN regexp_matches(host || path, '^([^/]*\\.)?(ads|adserver)\\.') THEN 'advert host'
  WHEN regexp_matches(host || path, '/(ads|adserver|doubleclick)/') THEN 'advert path'
  WHEN regexp_matches(host || path, '/(pixel|track)\\.gif$|/beacon/') THEN 'tracking pixel'
  WHEN regexp_matches(host || path, '\\.(exe|msi|apk)$') THEN 'executable'
  WHEN regexp_matches(host || path, '/wp-login\\.php$|/wp-admin/') THEN 'login page' END AS own_rule
  FROM p LEFT JOIN f USING (page_id))
SELECT page_id, host, path, rule, own_rule, CASE WHEN rule IS NOT NULL THEN v WHEN own_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM o
"""
