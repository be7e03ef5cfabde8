"""DuckDB SQL with the results of the registered audit queries."""

from __future__ import annotations

from ..functions import tables
from . import cases

MAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"
#: Comments, scripts and style sheets, tags with their quoted values, text, and any < that is left.
_Q = r"""(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[a-z/!?](?:"[^"]*"|'[^']*'|[^'">])*>|[^<]+|<""".replace("'", "''")
_SCHEME = "regexp_extract(url, '^([^:/?#]+):', 1)"
_NETLOC = "regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
_FRAGMENT = "regexp_extract(url, '#(.*)$', 1)"
_HOST = f"lower({_NETLOC})"
_KEY = "regexp_replace(url, '#.*$', '')"

_FETCHES = f"""fetches AS (
  SELECT {_KEY} AS url, page_id, CAST(length(html) AS BIGINT) AS size,
         CASE WHEN page_id % 20 = 7 THEN 404 WHEN page_id % 8 IN (3, 4, 5) THEN 301 WHEN page_id % 20 = 13 THEN 204 WHEN page_id % 50 = 49 THEN 500 ELSE 200 END AS status,
         CASE WHEN page_id % 10 = 0 THEN 'application/xhtml+xml; charset=utf-8' WHEN page_id % 10 = 1 THEN 'text/plain' WHEN page_id % 10 = 2 THEN 'application/pdf' ELSE 'text/html; charset=UTF-8' END AS content_type
  FROM pages)"""

_TOKENS = f"""token AS (
  SELECT page_id, url, html, unnest(t) AS body, generate_subscripts(t, 1) - 1 AS seq
  FROM (SELECT page_id, url, html, regexp_extract_all(html, '{_Q}', 0) AS t FROM pages)),
tag AS (
  SELECT page_id, url, seq, lower(regexp_extract(body, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, regexp_extract(body, '^<[a-zA-Z][^>]*>') AS body
  FROM token WHERE regexp_matches(body, '^<[a-zA-Z]'))"""

_ENTITIES = "replace(replace(replace({0}, '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')"

_LINKS = f"""{_TOKENS},
wanted(tag, attr) AS (VALUES {", ".join(f"('{t}', '{a}')" for t, a in tables.pairs(tables.LINK_TAGS) if t != "*")}),
pair AS (
  SELECT page_id, url, seq, tag, unnest(regexp_extract_all(body, '([a-zA-Z:-]+)\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]+)', 0)) AS p FROM tag),
link AS (
  SELECT page_id, url AS parent_url, seq, p.tag, w.attr, {_ENTITIES.format("trim(regexp_extract(p, '=\\s*(.*)$', 1), '\"')")} AS raw_url
  FROM pair p JOIN wanted w ON p.tag = w.tag AND lower(regexp_extract(p, '^([a-zA-Z:-]+)', 1)) = w.attr)"""

# all links of the given pages are absolute paths
_JOINED = f"""{_LINKS},
occurrence AS (SELECT *, regexp_extract(parent_url, '^([a-z]+://[^/?#]*)', 1) || raw_url AS url FROM link WHERE raw_url <> ''),
target AS (SELECT DISTINCT {_KEY} AS cache_url FROM occurrence),
result AS (SELECT cache_url, CASE WHEN length(cache_url) % 3 <> 0 THEN 200 ELSE 404 END AS status FROM target)"""

_TITLE = _ENTITIES.format("regexp_extract(html, '(?is)<title[^>]*>(.{0,256}?)</title\\s*>', 1)")
_RECORDS = f"""{_FETCHES},
record AS (
  SELECT p.page_id AS seq, {_KEY.replace("url", "p.url")} AS url, lag({_KEY.replace("url", "p.url")}) OVER (PARTITION BY {_HOST.replace("url", "p.url")} ORDER BY p.page_id) AS parent_url,
         {_HOST.replace("url", "p.url")} AS host, coalesce(nullif(trim(regexp_replace({_TITLE.replace("html", "p.html")}, '\\s+', ' ', 'g')), ''), '') AS label,
         status, status < 400 AS valid, content_type, size,
         (CASE WHEN status = 204 THEN 1 ELSE 0 END) + (CASE WHEN size > 20000 THEN 1 ELSE 0 END) AS n_warnings,
         concat_ws(chr(10), CASE WHEN status = 204 THEN 'No content' END, CASE WHEN size > 20000 THEN 'Content is too large' END) AS warning
  FROM pages p JOIN fetches f USING (page_id))"""
_NODES = f"""{_RECORDS}, first AS (SELECT * FROM record WHERE valid QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1),
node AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS id FROM first)"""
_LABEL = "trim(regexp_replace(label, '[^-A-Za-z0-9_.,:/ ]', ' ', 'g'))"

_ROBOTS = """body AS (SELECT origin, length(origin) % 4 AS n FROM (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin FROM pages))"""

SQL: dict[str, str] = {
    "e1_page_links": f"WITH {_LINKS} SELECT page_id, CAST(seq AS BIGINT) AS seq, tag, attr, raw_url FROM link WHERE raw_url <> ''",
    "e7_link_names": r"""
WITH piece AS (
  SELECT page_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS seq
  FROM (SELECT page_id, string_split(regexp_replace(html, '(?i)<(a\s)', chr(1) || '<\1', 'g'), chr(1)) AS p FROM pages))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY seq) - 1 AS BIGINT) AS seq, 'a' AS tag,
       trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_extract(left(regexp_extract(piece, '(?is)<a\s[^>]*>(.*)$', 1), 256), '(?is)^(.*?)</a\s*>', 1), '(?s)<.*?>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), '\s+', ' ', 'g')) AS name
FROM piece WHERE regexp_matches(piece, '(?i)^<a\s[^>]*href')""",
    "e8_page_titles": f"SELECT page_id, coalesce(nullif(trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')), ''), nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), ''), url) AS title FROM pages",
    "e12_tag_places": f"""
WITH {_TOKENS},
placed AS (SELECT page_id, seq, body, coalesce(sum(length(body)) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at, html FROM token),
b AS (SELECT page_id, seq, body, left(html, CAST(start_at AS BIGINT)) AS before FROM placed WHERE regexp_matches(body, '^<[a-zA-Z]'))
SELECT page_id, CAST(seq AS BIGINT) AS seq, lower(regexp_extract(body, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag,
       CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS BIGINT) AS line, CAST(length(string_split(before, chr(10))[-1]) + 1 AS BIGINT) AS col FROM b""",
    "e13_content_regex": """
SELECT doc_id, regexp_extract(text, '[0-9]{4,}') AS match, CAST(length(p) - length(replace(p, chr(10), '')) AS BIGINT) AS line
FROM (SELECT doc_id, text, left(text, instr(text, regexp_extract(text, '[0-9]{4,}')) - 1) AS p FROM documents WHERE regexp_matches(text, '[0-9]{4,}'))""",
    "u1_url_parts": f"SELECT page_id, {_SCHEME} AS scheme, {_HOST} AS host, CAST(CASE {_SCHEME} WHEN 'http' THEN 80 WHEN 'https' THEN 443 END AS BIGINT) AS port, {_PATH} AS path, {_QUERY} AS query, {_FRAGMENT} AS fragment FROM pages",
    "u2_normalised_links": f"WITH {_JOINED}, n AS (SELECT page_id, seq, regexp_extract(url, '^[a-z]+://[^/]*') || replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(url_encode(regexp_replace(url, '^[a-z]+://[^/]*', '')), '%2F', '/'), '%2C', ','), '%3A', ':'), '%3B', ';'), '%3D', '='), '%40', '@'), '%26', '&'), '%2B', '+'), '%24', '$'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')') AS url FROM occurrence) SELECT page_id, CAST(seq AS BIGINT) AS seq, url, {_KEY} AS cache_url FROM n",
    "u7_query_params": f"""
WITH q AS (SELECT page_id, regexp_extract_all({_QUERY}, '[^&;]+[&;]?') AS parts FROM pages),
e AS (SELECT page_id, unnest(parts) AS x, generate_subscripts(parts, 1) - 1 AS pos FROM q)
SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_extract(x, '^([^=&;]*)', 1) AS key, CASE WHEN contains(x, '=') THEN regexp_extract(x, '=([^&;]*)', 1) END AS value, regexp_extract(x, '([&;])$', 1) AS sep FROM e""",
    "u18_url_classes": f"""
SELECT page_id, 'http' AS class, {_SCHEME} || '://' || {_NETLOC} || '/robots.txt' AS robots_url, regexp_matches(url, '(?i)^[-.a-z]+:') AS absolute,
       regexp_replace(regexp_replace({_KEY}, '/index\\.html?$', '/'), '/$', '') AS content_key,
       '^https?://(www\\.)?' || regexp_replace(regexp_replace({_HOST}, '^www\\.', ''), '([^A-Za-z0-9_/])', '\\\\\\1', 'g') || regexp_replace(coalesce(nullif(regexp_replace({_PATH}, '[^/]*$', ''), ''), '/'), '([^A-Za-z0-9_/])', '\\\\\\1', 'g') AS pattern,
       CASE WHEN regexp_matches(url, '^https?://www\\.') THEN 'http://' ELSE '' END || regexp_replace(url, '^https?://', '') AS guessed,
       {_HOST} LIKE '%.example.org' OR {_HOST} = 'example.com' AS listed FROM pages""",
    "u23_duplicate_urls": f"""
WITH named AS (
  SELECT url FROM pages UNION SELECT regexp_replace({_KEY}, '/$', '') || '/index.html' FROM pages WHERE page_id % 2 = 0 UNION SELECT regexp_replace({_KEY}, '/$', '') || '/#top' FROM pages WHERE page_id % 3 = 0),
k AS (SELECT DISTINCT url, regexp_replace(regexp_replace({_KEY}, '/index\\.html?$', '/'), '/$', '') AS k FROM named),
f AS (SELECT url, k, first_value(url) OVER (PARTITION BY k ORDER BY length(url), url) AS same_as FROM k)
SELECT url, same_as FROM f WHERE url <> same_as AND contains(url, same_as)""",
    "x5_ip_numbers": """
WITH e AS (SELECT event_id, event_id % 256 AS b, (event_id // 256) % 256 AS c, user_id % 300 AS d FROM events),
n AS (SELECT *, d <= 255 AS valid, CASE WHEN d <= 255 THEN CAST(10 AS BIGINT) * 16777216 + b * 65536 + c * 256 + d END AS number FROM e)
SELECT event_id, '10.' || b || '.' || c || '.' || d AS ip, valid, number, coalesce(valid AND (b < 64 OR (b = 128 AND c = 3) OR (b = 200 AND c = 0 AND d = 7)), FALSE) AS listed FROM n""",
    "f2_url_warnings": """
SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'url-whitespace' WHEN page_id % 11 = 0 THEN 'url-too-long' WHEN page_id % 13 = 0 THEN 'url-obfuscated-ip' ELSE '' END AS tags, CAST(NULL AS VARCHAR) AS error FROM pages""",
    "f7_fetch_rules": f"""
WITH {_FETCHES}
SELECT page_id, status < 400 AS valid, CAST(status AS VARCHAR) AS result, concat_ws(',', CASE WHEN size > 20000 THEN 'url-content-too-large' END, CASE WHEN status = 204 THEN 'http-empty-content' END) AS tags,
       status < 400 AND size <= 1048576 AND content_type <> 'application/pdf' AS recurse, string_split(content_type, ';')[1] AS mime, CASE WHEN contains(content_type, 'charset') THEN 'utf-8' END AS charset,
       CASE string_split(content_type, ';')[1] WHEN 'text/html' THEN 'html' WHEN 'application/xhtml+xml' THEN 'html' WHEN 'application/pdf' THEN 'pdf' END AS parser FROM fetches""",
    "f13_mail_syntax": f"""
WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '{MAIL}')) AS address FROM documents),
p AS (SELECT doc_id, address, string_split(address, '@')[1] AS l, string_split(address, '@')[2] AS d FROM a)
SELECT doc_id, address, CASE WHEN length(address) > 256 THEN 'too-long' WHEN length(l) > 64 THEN 'local-too-long' WHEN length(d) > 255 THEN 'domain-too-long' WHEN l LIKE '.%' THEN 'leading-dot' WHEN l LIKE '%.' THEN 'trailing-dot' WHEN contains(l, '..') THEN 'double-dot'
  WHEN NOT regexp_matches(d, '^(?i)(([a-z0-9][-a-z0-9]{{0,61}}|[a-z])(\\.([a-z0-9][-a-z0-9]{{0,61}}|[a-z]))*\\.?)$') THEN 'domain' WHEN d LIKE '%.' OR regexp_matches(d, '(^|\\.)[0-9]+$') THEN 'tld' END AS error_code FROM p""",
    "j1_link_results": f"WITH {_JOINED} SELECT o.parent_url, CAST(o.seq AS BIGINT) AS seq, r.cache_url, r.status < 400 AS valid, CAST(r.status AS VARCHAR) AS result FROM occurrence o JOIN result r ON {_KEY.replace('url', 'o.url')} = r.cache_url",
    "j2_broken_by_host": f"WITH {_JOINED} SELECT {_HOST.replace('url', 'o.url')} AS host, count(*) AS n_links, CAST(sum(CASE WHEN status >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS n_broken FROM occurrence o JOIN result r ON {_KEY.replace('url', 'o.url')} = r.cache_url GROUP BY 1",
    "j3_scope": """
SELECT url, CASE WHEN regexp_matches(url, '^https?://blog\\.') OR regexp_matches(url, '\\.net(/|$)') THEN TRUE WHEN regexp_matches(url, '^https://') OR NOT contains(url, '.html') THEN FALSE ELSE TRUE END AS is_extern,
       CASE WHEN regexp_matches(url, '^https?://blog\\.') THEN TRUE WHEN regexp_matches(url, '\\.net(/|$)') OR regexp_matches(url, '^https://') THEN FALSE WHEN NOT contains(url, '.html') THEN TRUE ELSE TRUE END AS is_strict FROM pages""".replace("\\\\", "\\"),
    "j4_robots": f"""
SELECT url, CASE length(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) % 4 WHEN 3 THEN FALSE WHEN 1 THEN NOT ({_PATH} LIKE '/de%') WHEN 2 THEN NOT ({_PATH} LIKE '/en%') ELSE TRUE END AS allowed FROM pages""",
    "r2_crawl_delays": f"""
WITH {_ROBOTS}
SELECT origin, CAST(CASE WHEN n = 2 THEN 3 END AS BIGINT) AS crawl_delay, CASE WHEN n = 2 THEN '/s.xml' END AS sitemap, CAST(CASE WHEN n = 2 THEN 9 END AS BIGINT) AS line,
       CASE n WHEN 1 THEN 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /de' || chr(10) || 'Allow: /'
              WHEN 2 THEN 'User-agent: weftbot' || chr(10) || 'Crawl-delay: 3' || chr(10) || 'Disallow: /en' || chr(10) || 'Allow: /' || chr(10) || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /' END AS text FROM body""",
    "j6_broken_anchors": f"SELECT page_id, {_FRAGMENT} AS fragment, 'n' || page_id AS available FROM pages WHERE {_FRAGMENT} <> '' AND page_id % 2 = 1",
    "j7_redirects": f"""
WITH RECURSIVE {_FETCHES},
hop AS (SELECT {_KEY.replace('url', 'a.url')} AS from_url, min({_KEY.replace('url', 'b.url')}) AS to_url FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 WHERE a.page_id % 8 IN (3, 4, 5) AND a.page_id % 20 <> 7 GROUP BY 1),
chain AS (SELECT from_url, to_url, 1 AS hops FROM hop UNION ALL SELECT c.from_url, h.to_url, c.hops + 1 FROM chain c JOIN hop h ON c.to_url = h.from_url WHERE c.hops < 10)
SELECT c.from_url, c.to_url AS final_url, CAST(c.hops AS BIGINT) AS hops, CAST(f.status AS BIGINT) AS status FROM chain c LEFT JOIN hop h ON c.to_url = h.from_url LEFT JOIN fetches f ON f.url = c.to_url WHERE h.from_url IS NULL""",
    "j9_graph": f"WITH {_NODES} SELECT p.id AS source_id, r.id AS target_id, r.label FROM node r JOIN node p ON r.parent_url = p.url",
    "k6_dot": f"""
WITH {_NODES}
SELECT CAST(0 AS BIGINT) AS part, CAST(NULL AS BIGINT) AS id, 'digraph G {{' AS value UNION ALL SELECT 3, NULL, '}}'
UNION ALL SELECT 1, id, '  n' || id || ' [label="' || {_LABEL} || '"];' FROM node
UNION ALL SELECT 2, r.id, '  n' || p.id || ' -> n' || r.id || ' [label="' || {_LABEL.replace('label', 'r.label')} || '"];' FROM node r JOIN node p ON r.parent_url = p.url""",
    "j11_locations": "SELECT user_id, (user_id % 256) || '.1.2.3' AS ip, 'country' || ((user_id % 256) % 7) AS country, 'city' || (user_id % 256) AS city FROM (SELECT DISTINCT user_id FROM events)",
    "j14_mail_hosts": """
WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@([A-Za-z0-9.]+)', 1)) AS domain FROM documents)
SELECT domain, CASE WHEN length(domain) % 2 = 0 THEN 'mx.' || domain WHEN length(domain) % 3 = 0 THEN domain ELSE '' END AS hosts,
       CASE WHEN length(domain) % 2 = 0 THEN 'ok' WHEN length(domain) % 3 = 0 THEN 'mail-no-mx-host' ELSE 'error' END AS verdict FROM d""",
    "j16_crawl_levels": f"""
WITH RECURSIVE {_RECORDS},
reached AS (SELECT url, 0 AS level FROM record WHERE parent_url IS NULL UNION SELECT r.url, x.level + 1 FROM reached x JOIN record p ON p.url = x.url AND p.valid JOIN record r ON r.parent_url = p.url WHERE x.level < (SELECT count(DISTINCT url) FROM record))
SELECT url, CAST(min(level) AS BIGINT) AS level FROM reached GROUP BY url""",
    "g1_statistics": f"""
WITH {_RECORDS}
SELECT count(*) AS number, CAST(sum(CASE WHEN valid THEN 0 ELSE 1 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN valid THEN 0 ELSE 1 END) AS BIGINT) AS errors_printed, CAST(sum(n_warnings) AS BIGINT) AS warnings, CAST(sum(n_warnings) AS BIGINT) AS warnings_printed,
       min(length(url)) AS min_url, max(length(url)) AS max_url, round(avg(length(url)), 6) AS avg_url, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT url) AS results FROM record""",
    "g2_content_kinds": f"""
WITH {_RECORDS}, kind(kind) AS (VALUES ('image'), ('text'), ('video'), ('audio'), ('application'), ('mail'), ('other'))
SELECT kind, count(r.seq) AS n FROM kind LEFT JOIN record r ON string_split(r.content_type, '/')[1] = kind GROUP BY kind""",
    "g5_failure_streak": """
WITH last AS (SELECT user_id, max(struct_pack(ts := ts, e := event_id)) AS place FROM events WHERE event_type <> 'error' GROUP BY user_id)
SELECT e.user_id, count(*) AS failures FROM events e LEFT JOIN last l USING (user_id) WHERE event_type = 'error' AND (l.place IS NULL OR struct_pack(ts := e.ts, e := e.event_id) > l.place) GROUP BY e.user_id""",
    "k1_csv_report": f"""
WITH {_RECORDS}
SELECT url AS urlname, parent_url AS parentname, CAST(status AS VARCHAR) AS result, nullif(warning, '') AS warningstring, 'checked' AS infostring, CASE WHEN valid THEN 1 ELSE 0 END AS valid, url, nullif(label, '') AS name, size FROM record""",
    "k7_sitemap": f"""
WITH {_RECORDS}, biggest AS (SELECT host FROM record GROUP BY host ORDER BY count(*) DESC, host DESC LIMIT 1)
SELECT 'https://' || host || {_PATH} AS loc, strftime(make_timestamp(max(seq) * 60000000), '%Y-%m-%dT%H:%M:%S.%fZ') AS lastmod, 'daily' AS changefreq, '0.50' AS priority FROM record JOIN biggest USING (host)
WHERE valid AND string_split(content_type, ';')[1] IN ('text/html', 'application/xhtml+xml') AND {_PATH} LIKE '/_%' GROUP BY 1
UNION ALL SELECT 'https://' || host || '/', '1969-12-31T23:59:00.000000Z', 'daily', '1.00' FROM biggest""",
    "w3_schedule": f"SELECT page_id, {_HOST} AS host, CAST((row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) - 1) * 100 AS BIGINT) AS due_ms FROM pages",
    "t1_stream_dedup": "SELECT DISTINCT user_id FROM events",
    "t3_stream_stats": "SELECT event_type, count(*) AS number, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type",
}
SQL["t2_stream_streak"] = SQL["g5_failure_streak"]
SQL |= {
    "s2_url_list": f"SELECT {_HOST} AS host, CAST(row_number() OVER (PARTITION BY {_HOST} ORDER BY url) + 2 AS BIGINT) AS line, url AS raw_url FROM pages",
    "s3_seed_words": f"SELECT url AS raw_url FROM pages UNION ALL SELECT {_SCHEME} || '://' || {_NETLOC} || '/robots.txt' FROM pages",
    "s4_css_links": f"SELECT page_id, CAST(1 AS BIGINT) AS line, {_PATH} AS raw_url FROM pages UNION ALL SELECT page_id, 2, 'y' || page_id FROM pages",
    "s5_sitemaps": """
SELECT page_id, url AS raw_url, CAST(NULL AS VARCHAR) AS warning FROM pages WHERE page_id % 6 <> 3
UNION ALL SELECT page_id, NULL, CASE page_id % 6 WHEN 2 THEN 'xml-parse-error: not well-formed at line 2' WHEN 3 THEN 'xml-parse-error: not well-formed at line 1' WHEN 4 THEN 'xml-parse-error: not well-formed at line 3' ELSE 'xml-parse-error: not well-formed at line 2' END
FROM pages WHERE page_id % 6 > 1""",
    "s8_binary_urls": f"SELECT page_id, {_SCHEME} || '://' || {_NETLOC} || '/robots.txt' AS raw_url FROM pages",
    "s9_markdown_links": "SELECT page_id, CAST(0 AS BIGINT) AS n, url AS raw_url FROM pages UNION ALL SELECT page_id, 1, '/p' || page_id FROM pages",
    "s13_directory": f"SELECT '/' || {_HOST} || '/' AS parent_url, page_id || '.html' AS raw_url FROM pages",
    "s14_ftp_listing": "SELECT CASE page_id % 3 WHEN 0 THEN 'f' ELSE 'd' END || page_id AS name, page_id % 3 = 1 AS trycwd, page_id % 3 = 0 AS tryretr FROM pages WHERE page_id % 3 < 2",
    "s16_header_links": "SELECT url, '/n' || page_id AS raw_url, 'Link: header next' AS name FROM pages UNION ALL SELECT url, url, 'Refresh: header' FROM pages",
    "s18_sniffed_types": f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CASE WHEN html ILIKE '<!DOCTYPE html%' THEN 'text/html' ELSE 'text/plain' END WHEN {_PATH} LIKE '%.html' THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM pages",
    "e9_anchors": "SELECT page_id, 'n' || page_id AS anchor FROM pages",
    "e10_meta_robots": "SELECT page_id, page_id % 3 = 0 AS strict, page_id % 3 < 2 AS trimmed FROM pages",
    "e11_forms": "SELECT page_id, CAST(1 AS BIGINT) AS form, '/login' AS action, 'User=' || page_id || '&pw=' AS fields FROM pages",
    "x11_text_functions": """
SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS limited, trim(string_split(text, chr(10))[1]) AS first_line,
       CAST(length(left(text, 200)) - length(replace(left(text, 200), chr(10), '')) + 1 AS BIGINT) AS line, md5(regexp_replace(text, '[\\x01-\\x1F\\x7F]', '', 'g')) AS plain,
       CASE WHEN n < 1024 THEN n || 'B' WHEN n < 10240 THEN (n // 1024) || 'KB' WHEN n < 1048576 THEN printf('%.2fKB', n / 1024) WHEN n < 10485760 THEN printf('%.2fMB', n / 1048576) ELSE printf('%.1fMB', n / 1048576) END AS size,
       CASE WHEN n_chars >= 3600 THEN printf('%02d:', n_chars // 3600) ELSE '' END || printf('%02d:%02d', (n_chars // 60) % 60, n_chars % 60) AS duration,
       md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS xml, md5('''' || replace(text, '''', '''''') || '''') AS literal
FROM (SELECT *, n_chars * 100 AS n FROM documents)""",
    "x22_mail_addresses": f"SELECT doc_id, 'mailto:' || array_to_string(list_sort([a, 'z@example.org']), ',') AS key FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{MAIL}')) AS a FROM documents)",
    "j8_alias_results": SQL["j7_redirects"].replace("SELECT c.from_url, c.to_url AS final_url, CAST(c.hops AS BIGINT) AS hops, CAST(f.status AS BIGINT) AS status FROM chain", "SELECT url AS cache_url, CAST(min(status) AS BIGINT) AS status FROM fetches WHERE status <> 301 GROUP BY 1 UNION ALL SELECT DISTINCT c.from_url, CAST(f.status AS BIGINT) FROM chain").replace("WHERE h.from_url IS NULL", "WHERE h.from_url IS NULL AND f.status <> 301 AND c.from_url NOT IN (SELECT url FROM fetches WHERE status <> 301)"),
    "j15_resolved_hosts": f"SELECT DISTINCT {_HOST} AS host, length({_HOST}) % 2 = 0 AS valid FROM pages",
    "k4_text_report": f"WITH {_RECORDS} SELECT concat_ws(chr(10), 'url           ' || url, 'label         ' || nullif(label, ''), 'result        ' || status) AS value FROM record",
    "w2_host_audit": f"SELECT {_HOST} AS host, arg_min(page_id, url) AS page_id FROM pages GROUP BY 1",
}
_XML = lambda c: f"replace(replace({c}, '&', '&amp;'), '<', '&lt;')"
_XML_ALL = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_TEXT = lambda c: f"coalesce('''' || replace(nullif({c}, ''), '''', '''''') || '''', 'NULL')"
_HOPS = """hop AS (SELECT {a} AS from_url, min({to}) AS to_url FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 WHERE a.page_id % 8 IN (3, 4, 5) AND a.page_id % 20 <> 7 GROUP BY 1),
chain AS (SELECT from_url, to_url, 1 AS hops FROM hop UNION ALL SELECT c.from_url, h.to_url, c.hops + 1 FROM chain c JOIN hop h ON c.to_url = h.from_url WHERE c.hops < 10),
ending AS (SELECT c.from_url, c.to_url AS url FROM chain c LEFT JOIN hop h ON c.to_url = h.from_url WHERE h.from_url IS NULL)"""
_TO = _KEY.replace("url", "b.url")
_ENDS = _HOPS.format(a=_KEY.replace("url", "a.url"), to=_TO)
_SPOILT_ENDS = _HOPS.format(a=_KEY.replace("url", "a.url"), to=f"CASE WHEN length({_TO}) % 7 = 0 THEN regexp_replace({_TO}, '^https?:', 'ftp:') ELSE {_TO} END")
_STREAK = """
SELECT e.user_id, count(*) AS n FROM (SELECT * FROM events WHERE event_id % 2 = {0}) e LEFT JOIN (
  SELECT user_id, max(struct_pack(ts := ts, e := event_id)) AS place FROM events WHERE event_type <> 'error' AND event_id % 2 = {0} GROUP BY user_id) l USING (user_id)
WHERE event_type = 'error' AND (l.place IS NULL OR struct_pack(ts := e.ts, e := e.event_id) > l.place) GROUP BY e.user_id"""
SQL |= {
    "e14_page_charsets": """SELECT page_id, CASE WHEN page_id % 3 <> 0 AND contains(html, '<meta charset="utf-8">') THEN 'utf-8' END AS charset FROM pages""",
    "u4_ascii_hosts": f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'xn--bcher-kva.example' WHEN 1 THEN 'xn--e1afmkfd.org' WHEN 3 THEN {_HOST} END AS host FROM pages",
    "j16_site_crawl": rf"""
WITH RECURSIVE {_RECORDS}, {_ENDS},
through AS (SELECT u.url, coalesce(e.url, u.url) AS p FROM (SELECT url FROM record UNION SELECT from_url FROM ending) u LEFT JOIN ending e ON e.from_url = u.url),
state AS (SELECT url, CASE WHEN regexp_matches(url, '^https?://blog\.') THEN 'filtered' WHEN {_PATH} LIKE '/de%' THEN 'denied' WHEN regexp_matches(url, '^[a-z]+://[^/]*\.net(/|$)') THEN 'extern' ELSE 'checked' END AS state FROM (SELECT url FROM record UNION SELECT url FROM through)),
reached AS (
  SELECT url, 0 AS level FROM record WHERE parent_url IS NULL
  UNION SELECT l.url, x.level + 1 FROM reached x JOIN state s ON s.url = x.url AND s.state = 'checked' JOIN through t ON t.url = x.url JOIN record p ON p.url = t.p AND p.valid JOIN record l ON l.parent_url = t.p WHERE x.level < (SELECT count(DISTINCT url) FROM record))
SELECT r.url, CAST(min(r.level) AS BIGINT) AS level, min(s.state) AS state FROM reached r JOIN state s ON s.url = r.url GROUP BY r.url""",
    "l1_url_budget": f"""
WITH {_RECORDS}, found AS (
  SELECT url, seq, 0 AS level FROM record WHERE parent_url IS NULL UNION ALL SELECT r.url, r.seq, 1 FROM record r JOIN record p ON r.parent_url = p.url AND p.parent_url IS NULL)
SELECT url, CAST(level AS BIGINT) AS level FROM (SELECT url, min(level) AS level, arg_min(seq, (level, seq)) AS seq FROM found GROUP BY url) ORDER BY level, seq, url LIMIT 40""",
    "e1_planted_links": f"""
WITH {_LINKS},
added(i, tag, attr, raw_url) AS (VALUES {", ".join(f"({i}, " + ", ".join(cases._literal(x) for x in v.split(" ", 2)) + ")" for i, (_, values) in enumerate(cases.TABLES["e1_link_cases"][1]) for v in values)})
SELECT page_id, tag, attr, raw_url FROM link WHERE raw_url <> '' UNION ALL SELECT page_id, tag, attr, raw_url FROM pages JOIN added ON i = page_id % {len(cases.TABLES["e1_link_cases"][1])}""",
    "u2_spoilt_urls": "SELECT page_id, url FROM pages",
    "l1_budget_occurrences": f"""
WITH {_JOINED}, o AS (SELECT page_id, seq, {_KEY} AS url FROM occurrence),
first AS (SELECT url, min((page_id, seq)) AS place FROM o GROUP BY url),
cut AS (SELECT place FROM first QUALIFY row_number() OVER (ORDER BY place) = 100)
SELECT page_id, CAST(seq AS BIGINT) AS seq, url FROM o WHERE coalesce((page_id, seq) <= (SELECT place FROM cut), TRUE)""",
    "j1_hot_links": f"""
WITH {_JOINED}, o AS (SELECT parent_url, CAST(seq AS BIGINT) AS seq, {_KEY} AS cache_url FROM occurrence UNION ALL SELECT url, -1, 'http://every/page' FROM pages)
SELECT *, length(cache_url) % 3 <> 0 AS valid, CASE WHEN length(cache_url) % 3 <> 0 THEN '200' ELSE '404' END AS result FROM o""",
    "j3_rule_table": rf"""
WITH own AS (
  SELECT CASE WHEN length(host) % 3 = 0 THEN 0 ELSE 1 END AS intern, seq, '^https?://(www\.)?' || regexp_replace(regexp_replace(host, '^www\.', ''), '([^A-Za-z0-9_/])', '\\\1', 'g') || '/' AS pattern, FALSE AS negate, length(host) % 2 = 0 AS strict
  FROM (SELECT {_HOST} AS host, min(page_id) AS seq FROM pages GROUP BY 1) WHERE length(host) % 5 > 0),
rule AS (SELECT * FROM own UNION ALL SELECT 1, 1::BIGINT << 40, '\.html', TRUE, TRUE UNION ALL SELECT 1, (1::BIGINT << 40) + 1, '/de/|/fr/', FALSE, FALSE),
best AS (SELECT p.url, arg_min((r.intern, r.strict), (r.intern, r.seq)) AS b FROM (SELECT DISTINCT url FROM pages) p JOIN rule r ON regexp_matches(p.url, r.pattern) <> r.negate GROUP BY p.url)
SELECT p.url, coalesce(b[1] = 0, TRUE) AS is_extern, coalesce(b[2], TRUE) AS is_strict FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN best ON best.url = p.url""",
    "j12_network_table": """
WITH e AS (SELECT event_id, user_id, event_id % 256 AS b, (event_id // 256) % 256 AS c, user_id % 300 AS d FROM events),
narrow AS (SELECT DISTINCT b, c FROM e WHERE event_id % 7 = 0), wide AS (SELECT DISTINCT user_id % 256 AS b FROM e WHERE user_id % 2 = 0)
SELECT event_id, '10.' || e.b || '.' || e.c || '.' || d AS ip,
       CASE WHEN d > 255 THEN NULL WHEN n.b IS NOT NULL THEN '10.' || e.b || '.' || e.c || '.0/255.255.255.0' WHEN w.b IS NOT NULL THEN '10.' || e.b || '.0.0/16' END AS network
FROM e LEFT JOIN narrow n ON n.b = e.b AND n.c = e.c LEFT JOIN wide w ON w.b = e.b""",
    "u22_domain_table": rf"""
WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages),
d AS (SELECT host AS domain FROM h WHERE length(host) % 3 = 0 UNION SELECT regexp_extract(host, '^[^.]*(\..*)$', 1) FROM h WHERE length(host) % 2 = 0)
SELECT host, arg_max(domain, length(domain)) AS domain FROM h LEFT JOIN d ON domain = host OR (domain LIKE '.%' AND ends_with(host, domain)) GROUP BY host""",
    "g4_volume": f"WITH {_RECORDS} SELECT CAST(sum(size) AS BIGINT) AS bytes, TRUE AS same, TRUE AS near FROM record",
    "s8_binary_files": f"SELECT DISTINCT {_SCHEME} || '://' || {_NETLOC} || '/robots.txt' AS raw_url FROM pages",
    "s13_file_tree": f"SELECT DISTINCT 'host%3D' || {_HOST} || '/' AS raw_url, 'host=' || {_HOST} || '/' AS name FROM pages",
    "p2_content_rules": """
SELECT page_id, CASE WHEN contains(html, '<article') AND regexp_matches(html, '[0-9]{4}') THEN 'year' ELSE '' END AS tags,
       CASE WHEN contains(html, '<script') THEN 'scripts: ' || (len(string_split(html, '<script')) - 1) ELSE '' END AS info FROM pages""",
    "j3_seed_scope": r"""
SELECT url, NOT (url LIKE '%.html' OR regexp_matches(url, '^https?://(www\.)?example\.com/a/') OR regexp_matches(url, '^https?://(www\.)?blog\.example\.org/')) AS is_extern, FALSE AS is_strict FROM pages""",
    "j6_anchor_cases": "SELECT page_id, CASE WHEN page_id % 4 = 2 THEN 'n' || (page_id + 1) ELSE 'missing' END AS fragment, 'a,b%20c,n' || page_id AS available FROM pages WHERE page_id % 4 > 1",
    "j7_redirect_infos": rf"""
WITH RECURSIVE {_SPOILT_ENDS}
SELECT from_url, 'Redirected to ' || url AS info, CASE WHEN url LIKE 'ftp:%' THEN 'Redirection to ' || url || ' has another scheme' END AS error,
       CASE WHEN regexp_matches(url, '^https?://blog\.') OR regexp_matches(url, '\.net(/|$)') THEN TRUE WHEN regexp_matches(url, '^https://') OR NOT contains(url, '.html') THEN FALSE ELSE TRUE END AS is_extern FROM ending""",
    "d2_all_links": f"""
WITH {_ROBOTS},
place AS (SELECT page_id, url, page_id % 8 AS k, {_PATH} AS path, CASE page_id % 8 WHEN 7 THEN 'itms-services://h/?a=1&url=http://i/' || page_id WHEN 5 THEN 'http://h/' || page_id || '.md' ELSE 'http://h/' || page_id END AS address FROM pages)
SELECT address AS url, source, CAST(CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 2 END AS BIGINT) AS line, raw_url FROM (
  SELECT k, address, ['html', 'css', 'text', 'sitemap', 'chromium', 'markdown', 'listing', 'itms'][k + 1] AS source,
         unnest(CASE WHEN k < 2 THEN [path] WHEN k < 6 THEN [url] WHEN k = 6 THEN ['f' || page_id, 'd' || page_id || '/'] ELSE ['http://i/' || page_id] END) AS raw_url FROM place) WHERE raw_url <> ''
UNION ALL SELECT address, 'header', NULL, '/l' || page_id FROM place WHERE page_id % 5 = 0
UNION ALL SELECT origin, 'robots', 9, '/s.xml' FROM body WHERE n = 2
UNION ALL SELECT NULL, 'bookmark', NULL, url FROM pages WHERE page_id % 6 = 0""",
    "s6_sitemap_children": "SELECT 'http://h/' || page_id || '.xml' AS url, url AS raw_url FROM pages WHERE page_id % 3 > 0",
    "s10_bookmarks": "SELECT url, 'n' || page_id AS name FROM pages WHERE page_id % 5 <> 4 UNION ALL SELECT 't' || page_id, 'top' FROM pages WHERE page_id % 5 <> 4 UNION ALL SELECT CAST(page_id AS VARCHAR), 'no JSON' FROM pages WHERE page_id % 5 = 4",
    "s11_bookmark_tables": "SELECT url, CASE WHEN page_id % 4 = 0 THEN url ELSE 't' || page_id END AS name FROM pages WHERE page_id % 2 = 0 AND page_id % 5 <> 0 AND page_id % 7 <> 0",
    "f17_missing_slashes": "SELECT page_id, CASE WHEN page_id % 3 <> 0 AND page_id % 2 = 0 THEN 'file-missing-slash' END AS tag FROM pages",
    "p1_enabled_rules": f"WITH {_FETCHES} SELECT page_id, CASE WHEN size > 20000 THEN 'url-content-too-large' ELSE '' END AS tags, CASE WHEN content_type LIKE 'text/%' THEN string_split(content_type, ';')[1] ELSE '' END AS info FROM fetches",
    "p3_first_scan": """
SELECT url, 'markdown' AS scan, '/m' || page_id AS raw_url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 'list', 'http://a/' || page_id FROM pages WHERE page_id % 2 = 1
UNION ALL SELECT url, 'list', '[x](/m' || page_id || ')' FROM pages WHERE page_id % 2 = 1""",
    "k3_xml_report": f"""
WITH {_RECORDS}
SELECT url, '<urldata><url>' || {_XML('url')} || '</url>' || coalesce('<name>' || {_XML("nullif(label, '')")} || '</name>', '') || coalesce('<parent>' || {_XML('parent_url')} || '</parent>', '') || '<size>' || size || '</size><level>0</level><infos><info>checked</info></infos>'
  || CASE WHEN n_warnings > 0 THEN '<warnings>' || CASE WHEN status = 204 THEN '<warning tag="http-empty-content">No content</warning>' ELSE '' END || CASE WHEN size > 20000 THEN '<warning tag="url-content-too-large">Content is too large</warning>' ELSE '' END || '</warnings>' ELSE '' END
  || '<valid result="' || status || '">' || CASE WHEN valid THEN 1 ELSE 0 END || '</valid></urldata>' AS value FROM record""",
    "k5_html_report": f"WITH {_RECORDS} SELECT '<table><tr><td>url</td><td>' || {_XML_ALL('url')} || '</td></tr><tr><td>label</td><td>' || {_XML_ALL('label')} || '</td></tr><tr><td>result</td><td>' || status || '</td></tr></table>' AS value FROM record",
    "k2_inserts": f"WITH {_RECORDS} SELECT 'insert into links(url,label,valid,size) values (' || {_TEXT('url')} || ',' || {_TEXT('label')} || ',' || CASE WHEN valid THEN 1 ELSE 0 END || ',' || size || ');' AS value FROM record",
    "k6_gml": f"""
WITH {_NODES}
SELECT CAST(0 AS BIGINT) AS part, CAST(NULL AS BIGINT) AS id, 'graph [ directed 1' AS value UNION ALL SELECT 3, NULL, ']'
UNION ALL SELECT 1, id, '  node [ id ' || id || ' label "' || {_LABEL} || '" ]' FROM node
UNION ALL SELECT 2, r.id, '  edge [ source ' || p.id || ' target ' || r.id || ' label "' || {_LABEL.replace('label', 'r.label')} || '" ]' FROM node r JOIN node p ON r.parent_url = p.url""",
    "k6_graphxml": f"""
WITH {_NODES}
SELECT CAST(0 AS BIGINT) AS part, CAST(NULL AS BIGINT) AS id, '<GraphXML><graph isDirected="true">' AS value UNION ALL SELECT 3, NULL, '</graph></GraphXML>'
UNION ALL SELECT 1, id, '  <node name="' || id || '"><label>' || {_XML_ALL('label')} || '</label></node>' FROM node
UNION ALL SELECT 2, r.id, '  <edge source="' || p.id || '" target="' || r.id || '"/>' FROM node r JOIN node p ON r.parent_url = p.url""",
    "k8_failure_table": f"""
WITH a AS ({_STREAK.format(0)}), b AS ({_STREAK.format(1)}), v AS (SELECT DISTINCT user_id FROM events WHERE event_type <> 'error' AND event_id % 2 = 1),
m AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS now FROM a FULL JOIN b ON a.user_id = b.user_id)
SELECT m.user_id, CAST(CASE WHEN v.user_id IS NOT NULL THEN now ELSE before + now END AS BIGINT) AS failures FROM m LEFT JOIN v ON v.user_id = m.user_id WHERE CASE WHEN v.user_id IS NOT NULL THEN now ELSE before + now END > 0""",
}
SQL |= cases.SQL
