"""SQL (DuckDB's) for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from .common import LOWER, UPPER
from .mixing import SYMBOLS, WEIGHTS
from .suffix_dedup import LENGTH, PASSAGE_WORDS
from .url_filter import RULES

_WORDS = r"[^\x20\x09-\x0D]+"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _rest(url: str) -> str:
    return f"substr({url}, strpos({url}, '://') + 3)"


def _host(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN {_lower(f"regexp_extract({_rest(url)}, '^([^/?#]*)', 1)")} ELSE '' END"


def _path(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"


def _address(url: str) -> str:
    query = rf"regexp_extract({_rest(url)}, '^[^/?#]*[^?#]*(\?[^#]*)?', 1)"
    return f"CASE WHEN ({_host(url)}) <> '' THEN {_lower(f"substr({url}, 1, strpos({url}, '://') - 1)")} || '://' || ({_host(url)}) || ({_path(url)}) || {query} END"


def _ruled(table: str, key: str) -> str:
    return f"SELECT x.{key}, r.rule, r.v FROM {table} x JOIN rules r ON (x.host = r.domain OR ends_with(x.host, '.' || r.domain)) AND starts_with(x.path, r.path) QUALIFY row_number() OVER (PARTITION BY x.{key} ORDER BY length(r.rule) DESC, r.v, r.rule) = 1"


def _no_dots(path: str) -> str:
    kept = f"list_reduce(list_transform(string_split({path}, '/')[2:], lambda x: [x]), lambda kept, x: CASE WHEN x[1] = '..' THEN kept[:len(kept) - 1] WHEN x[1] = '.' THEN kept ELSE kept || x END, []::VARCHAR[])"
    return rf"CASE WHEN regexp_matches({path}, '/\.\.?(/|$)') THEN '/' || array_to_string({kept} || CASE WHEN regexp_matches({path}, '/\.\.?$') THEN [''] ELSE []::VARCHAR[] END, '/') ELSE {path} END"


def _resolved(url: str, to: str) -> str:
    own, path = f"regexp_extract({to}, '^([^?#]*)', 1)", f"({_path(url)})"
    joined = f"CASE WHEN starts_with({own}, '/') THEN {own} ELSE '/' || regexp_extract({path}, '(?s)^/(.*/)', 1) || {own} END"
    full = f"CASE WHEN {own} = '' THEN {path} ELSE {_no_dots(f'({joined})')} END"
    return rf"CASE WHEN starts_with({to}, '//') THEN regexp_extract({url}, '(?s)^(.*?:)//', 1) || {to} WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {to} ELSE regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1) || ({full}) || regexp_extract({to}, '(?s)^[^?#]*(.*)', 1) END"


URL_FILTER = rf"""
WITH RECURSIVE rules(domain, path, v, rule) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}', '{h}{p}')" for h, p, v in RULES)}),
base AS (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, {_address("url")} AS node FROM pages),
tags AS (
  SELECT url, regexp_extract(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?i)\brel\s*=\s*["'']?canonical\b') AND regexp_matches(x, '(?i)\bhref\s*=\s*["'']?[^"''\s>]'))[1], '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target FROM pages
  UNION ALL
  SELECT url, regexp_extract(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') AND regexp_matches(x, '(?i)\burl\s*=\s*[^"''\s>]'))[1], '(?i)\burl\s*=\s*([^"''\s>]+)', 1) FROM pages),
decoded AS (SELECT url, replace(target, '&amp;', '&') AS target FROM tags WHERE target <> ''),
links AS (SELECT url, {_resolved("url", "target")} AS target FROM decoded),
edges AS (SELECT {_address("url")} AS a, {_address("target")} AS b FROM links),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
member AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
nodes AS (SELECT node, component, {_host("node")} AS host, {_path("node")} AS path FROM member),
node_rule AS ({_ruled("nodes", "node")}),
spread AS (SELECT component, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS s FROM nodes LEFT JOIN node_rule USING (node) GROUP BY component),
page_rule AS ({_ruled("base", "page_id")})
SELECT b.page_id, b.host, b.path, p.rule, coalesce(p.v, s.s, 'allow') AS verdict, coalesce(m.component, b.node) AS component
FROM base b LEFT JOIN page_rule p USING (page_id) LEFT JOIN member m ON b.node = m.node LEFT JOIN spread s ON m.component = s.component"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_lower("text")}, '{_WORDS}'), []) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
member AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN member ON node = doc_id"""

MIXING = rf"""
WITH items AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size,
    -ln(((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT)::DOUBLE + 0.5) / {float(2**52)!r})
    / CASE WHEN length(text) > 0 THEN greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(text) - length(translate(text, '{SYMBOLS}', ''))) / length(text)) ELSE 1.0::DOUBLE END AS key
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS w FROM items GROUP BY source),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS c, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget FROM per),
filled AS (
  SELECT *, row_number() OVER o AS k,
    (budget - coalesce(sum(c) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped WINDOW o AS (ORDER BY c / w, source NULLS LAST)),
best AS (SELECT min_by(level, k) AS l FROM filled WHERE c / w > level),
targets AS (SELECT source, source_size, CASE WHEN c <= w * coalesce(l, c / w) THEN c ELSE w * l END AS target FROM filled, best),
placed AS (
  SELECT i.doc_id, i.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
    coalesce(sum(i.size) OVER (PARTITION BY i.source ORDER BY i.key, i.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + i.size / 2.0::DOUBLE AS middle
  FROM items i JOIN targets t ON i.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((epochs + (middle < target - epochs * source_size)::BIGINT) * size)::BIGINT AS taken FROM placed"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to,
  CASE WHEN page_id = last THEN true END AS verified
FROM p JOIN g USING (h)"""

PASSAGES = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, coalesce(regexp_extract_all(text, '{_WORDS}'), []) AS w FROM documents),
hexed AS (SELECT r, hex(b) AS h, octet_length(b)::BIGINT AS n FROM texts),
strings AS (
  SELECT 'bytes' AS kind, r, s, md5_number(substr(h, 2 * s + 1, {2 * LENGTH})) AS k FROM (SELECT r, h, unnest(range(n - {LENGTH - 1})) AS s FROM hexed)
  UNION ALL
  SELECT 'words', r, s, md5_number(array_to_string(w[s + 1:s + {PASSAGE_WORDS}], ' ')) FROM (SELECT r, w, unnest(range(len(w) - {PASSAGE_WORDS - 1})) AS s FROM texts)),
twice AS (SELECT kind, k FROM strings GROUP BY kind, k HAVING count(*) > 1),
hits AS (SELECT kind, r, s, s + CASE kind WHEN 'bytes' THEN {LENGTH} ELSE {PASSAGE_WORDS} END AS e FROM strings SEMI JOIN twice USING (kind, k)),
marked AS (SELECT *, coalesce(s > lag(e) OVER (PARTITION BY kind, r ORDER BY s), true)::INTEGER AS new FROM hits),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY kind, r ORDER BY s) AS g FROM marked),
spans AS (SELECT kind, r, min(s) AS s, max(e) AS e FROM numbered GROUP BY kind, r, g),
of_text AS (SELECT kind, r, sum(e - s)::BIGINT AS gone, count(*) AS n_spans, [0] || list(e ORDER BY s) AS starts, list(s ORDER BY s) AS ends FROM spans GROUP BY kind, r)
SELECT doc_id, n AS n_bytes, coalesce(x.gone, 0)::BIGINT AS n_removed, coalesce(x.n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN x.r IS NULL THEN b ELSE unhex(array_to_string(list_transform(list_zip(x.starts, x.ends || [n]), lambda z: substr(h, 2 * z[1] + 1, 2 * (z[2] - z[1]))), '')) END) AS kept_sha256,
  coalesce(y.gone, 0)::BIGINT AS n_repeated_words
FROM texts JOIN hexed USING (r) LEFT JOIN (FROM of_text WHERE kind = 'bytes') x USING (r) LEFT JOIN (FROM of_text WHERE kind = 'words') y USING (r)"""

ORACLE: dict[str, str] = {"op1_url_filter": URL_FILTER, "op4_minhash": NEAR_DUPLICATES, "op6_mixing": MIXING, "op9_warc": WARC, "op10_suffix_dedup": PASSAGES}
