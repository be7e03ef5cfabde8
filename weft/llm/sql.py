"""DuckDB SQL for the queries of this subpackage that SQL can express.

op3's SQL looks at every sentence, and at every window of words that begins with
a word of a template.
"""

from __future__ import annotations

import math
import string

from . import divergence, licenses, quality

_UPPER = string.ascii_uppercase


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP3 = rf"""
WITH phrase(words, label) AS (VALUES {", ".join(f"({_list(p.split())}, '{v}')" for p, v in licenses.PHRASES.items())}),
template(label, words) AS (VALUES {", ".join(f"('{v}', {_list(sorted(set(licenses._plain(t))))})" for v, t in licenses.TEMPLATES)}),
doc AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_SPLIT}'), lambda x: x <> '') AS words
  FROM documents),
place AS (
  SELECT doc_id, i - 1 AS place, label
  FROM (SELECT doc_id, words AS w, unnest(range(1, len(words) + 1)) AS i FROM doc) x, phrase p
  WHERE x.w[i] = p.words[1] AND x.w[i : i + len(p.words) - 1] = p.words),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_distinct(list(label)) AS labels
  FROM place GROUP BY doc_id),
block AS (
  SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(translate(b, '{_UPPER}', '{_UPPER.lower()}'), '{_SPLIT}'), lambda x: x <> '')) AS held
  FROM (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?])[ \t\r\x0B\f]+', '\1' || chr(10), 'g'), chr(10))) AS b FROM doc)),
wide(label, words, need, width) AS (VALUES {", ".join(f"('{v}', {_list(sorted(set(t)))}, {math.ceil(c * len(set(t)) - 1e-9)}, {licenses.width(t, c)})" for c, listed in ((licenses.CONTAINMENT, licenses.TEMPLATES), (licenses.NOTICE_CONTAINMENT, licenses.NOTICES)) for v, t in ((v, licenses._plain(x)) for v, x in listed))}),
likely AS (SELECT doc_id, d.words AS w, label, t.words AS held, need, width FROM doc d, wide t WHERE len(list_intersect(d.words, t.words)) >= need),
start AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM likely),
hit AS (
  SELECT doc_id, label, len(list_intersect(held, words)) / len(words) AS share FROM block, template WHERE len(list_intersect(held, words)) >= ceil({licenses.CONTAINMENT} * len(words) - 1e-9)
  UNION ALL SELECT doc_id, label, len(list_intersect(w[i : i + width - 1], held)) / len(held) FROM start WHERE list_contains(held, w[i]) AND len(list_intersect(w[i : i + width - 1], held)) >= need),
found AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(share) AS containment FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END AS score
FROM doc d LEFT JOIN base b USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

_BLANK = r"[ \t\n\x0B\f\r]"

OP7 = rf"""
WITH doc AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, hash3, count(*) OVER (PARTITION BY doc_id, hash3) AS n
  FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS hash3
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc))),
rep AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM win WHERE n > 1) GROUP BY doc_id),
feature AS (
  SELECT d.doc_id, d.source, t, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{_BLANK}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM doc d LEFT JOIN rep USING (doc_id)),
line AS (
  SELECT DISTINCT doc_id, source, line FROM (
    SELECT doc_id, source, trim(unnest(string_split(regexp_replace(regexp_replace(lower(t), '[ \t\x0B\f\r]+', ' ', 'g'), '[0-9]+', '0', 'g'), chr(10)))) AS line
    FROM doc) WHERE line <> ''),
frequent AS (SELECT source, line FROM line GROUP BY source, line HAVING count(*) > {quality.MAX_DOCS}),
left_over AS (
  SELECT doc_id, sum(length(l.line)) AS line_chars, coalesce(sum(CASE WHEN f.line IS NOT NULL THEN length(l.line) END), 0) AS removed_chars
  FROM line l LEFT JOIN frequent f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND coalesce(line_chars, 0) - coalesce(removed_chars, 0) >= {quality.MIN_LEFT} * coalesce(line_chars, 0) AS kept
FROM feature LEFT JOIN left_over USING (doc_id)
"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_WEIGHT = f"1 + CAST({{n}} + 1 AS HUGEINT) * {divergence.SCALE} // ({{total}} + v)"

OP12 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') AS terms
  FROM documents),
place AS (SELECT d, lang, source, unnest(terms) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS lang_n FROM place GROUP BY lang, term HAVING count(DISTINCT d) >= {divergence.LEAST_DOCS}),
size AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.lang_n), 0) AS lang_total FROM (SELECT DISTINCT lang FROM doc) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
held AS (SELECT p.lang, p.source, p.term, count(*) AS n FROM place p JOIN kept k ON p.lang = k.lang AND p.term = k.term GROUP BY 1, 2, 3),
grp AS (
  SELECT g.lang, g.source, coalesce(sum(h.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source GROUP BY 1, 2),
weight AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, {_WEIGHT.format(n="coalesce(h.n, 0)", total="g.total")} AS p, {_WEIGHT.format(n="k.lang_n", total="s.lang_total")} AS q
  FROM grp g JOIN size s ON s.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN weight x ON x.lang = a.lang AND x.source = a.source LEFT JOIN weight y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 4
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM weight WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {divergence.TOP}
"""


def _nearest(centroids: str) -> str:
    """Each vector's nearest centroid of a table (c, x); ties to the smaller number."""
    distance = "list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"SELECT v.row, v.vec_id, v.x, min(struct_pack(d := CAST({distance} AS BIGINT), c := m.c)) AS near FROM vec v, {centroids} m GROUP BY 1, 2, 3"


def _next(centroids: str, assigned: str) -> str:
    """Floors of the means by component; centroids without vectors stay."""
    mean = f"SELECT c, i, (s - ((s % n) + n) % n) // n AS m FROM (SELECT near.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT near, x, unnest(range(1, 65)) AS i FROM {assigned}) GROUP BY 1, 2)"
    return f"SELECT k.c, coalesce(list_sort(list({{'i': i, 'm': CAST(m AS BIGINT)}}) FILTER (m IS NOT NULL)).list_transform(lambda z: z.m), any_value(k.x)) AS x FROM {centroids} k LEFT JOIN ({mean}) n ON n.c = k.c GROUP BY k.c"


OP13 = f"""
WITH vec AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda z: CAST(floor(64 * CAST(z AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda z: z IS NOT NULL AND isfinite(z))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, x FROM vec ORDER BY 1, 2 LIMIT 16)),
a0 AS MATERIALIZED ({_nearest("c0")}), c1 AS MATERIALIZED ({_next("c0", "a0")}),
a1 AS MATERIALIZED ({_nearest("c1")}), c2 AS MATERIALIZED ({_next("c1", "a1")}),
a2 AS MATERIALIZED ({_nearest("c2")}), c3 AS MATERIALIZED ({_next("c2", "a2")}),
a3 AS MATERIALIZED ({_nearest("c3")})
SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c3.x, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.c = a3.near.c
"""

SQL = {"op3_license_scan": OP3, "op7_quality_rules": OP7, "op12_source_divergence": OP12, "op13_centroid_clustering": OP13}
