"""DuckDB texts for those queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_url_filters"] = r"""
WITH parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT host, path, arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule, arg_max(verdict, length(rhost) * 1000 + length(rpath)) AS verdict
    FROM (SELECT DISTINCT host, path FROM hosts) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT h.page_id, h.host, h.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM hosts h LEFT JOIN best b ON h.host = b.host AND h.path = b.path
"""

ORACLES["op8_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT item_id, least(n, 10) AS len, array_to_string(w[i:i + least(n, 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - least(n, 10) + 2)) AS i FROM iw)),
lens AS (SELECT DISTINCT len FROM win),
spots AS (SELECT doc_id, i, len, array_to_string(w[i:i + len - 1], ' ') AS g FROM (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM dw, lens)),
hit AS (SELECT DISTINCT a.doc_id, a.i, a.len, win.item_id FROM spots a JOIN win ON a.g = win.g AND a.len = win.len),
hitpos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw d LEFT JOIN hitpos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def _spans(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: pieces between matches and matches, summed up."""
    p = pattern.replace("'", "''")
    return f"""
{kind}_m AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, g, p FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS m,
    regexp_extract_all(text, '{p}', {group}) AS g, regexp_split_to_array(text, '{p}') AS p FROM docs)),
{kind}_s AS (SELECT doc_id, '{kind}' AS kind, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
    length(m[i]) AS n FROM {kind}_m WHERE length(g[i]) >= {least})"""


ORACLES["op10_secret_scans"] = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),""" + ",".join((
    _spans("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    _spans("access", r"AKIA[A-Z0-9]+", 0, 18), _spans("hex", r"[0-9a-f]{16,}", 0, 16))) + r""",
found AS (SELECT *, 0 AS k FROM assign_s UNION ALL SELECT *, 1 FROM access_s UNION ALL SELECT *, 2 FROM hex_s),
listed AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans FROM found GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN listed l USING (doc_id)
"""

ORACLES["op2_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM d GROUP BY source),
run AS (SELECT *, CAST(sum(s) OVER () - coalesce(sum(3 * s) OVER o, 0) AS BIGINT) AS l, CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS lw, CAST(3 * s AS DOUBLE) / w AS r
    FROM src WINDOW o AS (ORDER BY CAST(3 * s AS DOUBLE) / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT l, lw FROM run WHERE NOT l * w > 3 * s * lw ORDER BY r, encode(source) NULLS LAST LIMIT 1),
tgt AS (SELECT source, s AS source_size, CASE WHEN run.l * w > 3 * s * run.lw THEN CAST(3 * s AS DOUBLE) ELSE CAST(lev.l * w AS DOUBLE) / CAST(lev.lw AS DOUBLE) END AS target FROM run, lev),
q AS (SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY CAST('0x' || substr(h, 1, 6) AS BIGINT) % 4096, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d)
SELECT q.doc_id, q.source, q.size, t.source_size, t.target, CAST(greatest(0, least(q.size, floor(t.target) - start)) + greatest(0, least(q.size, floor(t.target) - start - source_size))
    + greatest(0, least(q.size, floor(t.target) - start - 2 * source_size)) AS BIGINT) AS taken
FROM q JOIN tgt t ON q.source IS NOT DISTINCT FROM t.source
"""

ORACLES["op9_sharding"] = r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size FROM documents),
x AS (SELECT *, list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS b FROM d),
c AS (SELECT doc_id, size, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[xor(c, v) % 256 + 1])), 4294967295) AS text_crc32 FROM x, tab),
p AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e, CAST(sum(size) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS n FROM c),
s AS (SELECT *, CAST((2 * e - size) * 24 // (2 * total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""


def _tree(name: str, leaves: str) -> str:
    """CTEs of a tree per ``src`` over ``leaves`` (src, i, d, n): all nodes, and each node's siblings."""
    return f"""
{name} AS (SELECT src, 0 AS lvl, CAST(i AS BIGINT) AS i, d, CAST(n AS BIGINT) AS n FROM {leaves}
    UNION ALL SELECT src, lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY src, lvl, i // 3),
{name}_s AS (SELECT a.src, a.lvl, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS b, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS a
    FROM {name} a JOIN {name} b ON a.src = b.src AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.src, a.lvl, a.i)"""


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

ORACLES["op11_merkle_manifest"] = (r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
x AS (SELECT *, list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS bytes FROM documents),
d AS (SELECT doc_id, coalesce('=' || source, '-') AS src, row_number() OVER () AS rid, """ + _LEAF.format(text="text") + r""" AS leaf,
    CASE WHEN xor(list_reduce(bytes, lambda c, v: xor(c >> 8, t[xor(c, v) % 256 + 1])), 4294967295) % 2 = 0 THEN """ + _LEAF.format(text="replace(text, chr(10), '')") + r""" END AS given FROM x, tab),
p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d, count(*) OVER (PARTITION BY src) AS n FROM d),"""
+ _tree("low", "p") + r""",
subs AS (SELECT '' AS src, low.src AS name, row_number() OVER (ORDER BY encode(low.src)) - 1 AS i, low.d, count(*) OVER () AS n FROM low WHERE n = 1),"""
+ _tree("top", "subs") + r""",
walk AS (SELECT rid, src, i, 0 AS lvl, coalesce(given, leaf) AS acc, '' AS sibs FROM p
    UNION ALL SELECT rid, src, w.i // 3, lvl + 1, sha256(s.b || acc || s.a), sibs || s.b || s.a FROM walk w JOIN low_s s USING (src, lvl, i)),
mid AS (SELECT rid, arg_max(acc, lvl) AS acc, arg_max(sibs, lvl) AS sibs FROM walk GROUP BY rid),
climb AS (SELECT p.rid, subs.i, 0 AS lvl, mid.acc, mid.sibs FROM p JOIN mid USING (rid) JOIN subs ON p.src = subs.name
    UNION ALL SELECT rid, c.i // 3, c.lvl + 1, sha256(s.b || acc || s.a), sibs || s.b || s.a FROM climb c JOIN top_s s ON c.lvl = s.lvl AND c.i = s.i),
fin AS (SELECT rid, arg_max(acc, lvl) AS acc, arg_max(sibs, lvl) AS sibs FROM climb GROUP BY rid)
SELECT p.doc_id, p.leaf, subs.d AS subroot, (SELECT d FROM top WHERE n = 1) AS root, sha256(fin.sibs) AS proof_sha256, fin.acc AS folded_root, fin.acc = (SELECT d FROM top WHERE n = 1) AS verified
FROM p JOIN subs ON p.src = subs.name JOIN fin USING (rid)
""")
