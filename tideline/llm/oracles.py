"""The operators that SQL can express, as DuckDB's SQL over whole tables."""

from __future__ import annotations

from tideline.llm import license_scan, url_filter

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def license_sql() -> str:
    known = [(True, p.split(), label) for p, label in license_scan.BASE.items()] + [(False, p.split(), label) for label, ps in license_scan.TEMPLATES.items() for p in ps]
    rows = ", ".join(f"({i}, {str(b).lower()}, '{label}', {len(w)}, {j}, '{x}', '{y}')" for i, (b, w, label) in enumerate(known) for j, (x, y) in enumerate(zip(w, w[1:])))
    return rf"""
WITH RECURSIVE tp AS (SELECT * FROM (VALUES {rows}) AS v(t, is_base, label, t_words, tpos, ta, tb)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d),
h AS (SELECT rid, t, is_base, label, t_words, tpos, i - 1 AS pos, i - 1 - tpos AS diagonal FROM (SELECT rid, i, w[i] AS a, w[i + 1] AS b FROM g) JOIN tp ON a = ta AND b = tb),
dg AS (SELECT rid, t, is_base, label, t_words, diagonal, count(DISTINCT tpos) AS votes FROM h GROUP BY rid, t, is_base, label, t_words, diagonal),
st AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, t ORDER BY diagonal) <= {license_scan.NEAR} THEN 0 ELSE 1 END AS starts FROM dg WHERE NOT is_base),
pt AS (SELECT rid, t, diagonal, sum(starts) OVER (PARTITION BY rid, t ORDER BY diagonal) AS part FROM st),
hp AS (SELECT h.rid, h.t, h.label, h.t_words, part, tpos, pos FROM h JOIN pt ON h.rid = pt.rid AND h.t = pt.t AND h.diagonal = pt.diagonal),
sp AS (SELECT rid, t, label, t_words, part, count(DISTINCT tpos) / any_value(t_words - 1) AS share, min(pos) AS f, max(pos) + 1 AS l FROM hp GROUP BY rid, t, label, t_words, part),
ok AS (SELECT *, l - f + 1 <= {license_scan.STRETCH} * t_words AS short FROM sp WHERE share >= {license_scan.COVERAGE}),
lg AS (SELECT hp.* FROM hp JOIN ok ON hp.rid = ok.rid AND hp.t = ok.t AND hp.part = ok.part AND NOT short),
wi AS (SELECT a.rid, a.t, a.label, a.part, a.pos AS f, count(DISTINCT b.tpos) / any_value(a.t_words - 1) AS share, max(b.pos) + 1 AS l FROM (SELECT DISTINCT rid, t, label, t_words, part, pos FROM lg) a
 JOIN lg b ON a.rid = b.rid AND a.t = b.t AND a.part = b.part AND b.pos >= a.pos AND b.pos + 2 - a.pos <= floor({license_scan.STRETCH} * a.t_words) GROUP BY 1, 2, 3, 4, 5 HAVING share >= {license_scan.COVERAGE}),
ap AS (SELECT rid, t, part, f, l FROM (SELECT * FROM wi QUALIFY row_number() OVER (PARTITION BY rid, t, part ORDER BY f) = 1)
 UNION ALL SELECT rid, t, part, f, l FROM (SELECT wi.rid, wi.t, wi.part, wi.f, wi.l FROM ap JOIN wi ON ap.rid = wi.rid AND ap.t = wi.t AND ap.part = wi.part AND wi.f > ap.l QUALIFY row_number() OVER (PARTITION BY wi.rid, wi.t, wi.part ORDER BY wi.f) = 1)),
fd AS (SELECT rid, label, diagonal AS start, 1.0::DOUBLE AS share, 0 AS n FROM dg WHERE is_base AND votes = t_words - 1
 UNION ALL SELECT rid, label, NULL, share, 1 FROM ok WHERE short UNION ALL SELECT rid, label, NULL, max(share), 0 FROM wi GROUP BY rid, t, label, part UNION ALL SELECT ap.rid, ok.label, NULL, 0.0, 1 FROM ap JOIN ok ON ap.rid = ok.rid AND ap.t = ok.t AND ap.part = ok.part),
pr AS (SELECT rid, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (start IS NOT NULL), '') AS base_labels,
 string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score, sum(n)::BIGINT AS n_spans FROM fd GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN pr ON d.rid = pr.rid"""


def url_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in rules) + " END"

    def parts(url: str, name: str) -> str:
        rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
        return f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), {LOWER}) AS {name}h, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS {name}p, regexp_extract({rest}, '^[^/?#]*([^#]*)', 1) AS {name}q"

    sp = r" \t\n\f\r"
    q = lambda x: "'" + x.replace("'", "''") + "'"
    rest = rf"""(?:=[{sp}]*"[^"]*"|=[{sp}]*'[^']*'|[^>])*"""
    text = "|".join(rf"<{e}(?:[{sp}/]{rest})?>.*?(?:</{e}[{sp}/>]|\z)" for e in url_filter.TEXT_ELEMENTS)
    markup = rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|{text}|<[a-z]{rest}(?:>|\z)"
    attributes = rf"""(?s)[^{sp}/>=]+(?:[{sp}]*=[{sp}]*(?:"[^"]*"|'[^']*'|[^{sp}>]*))?"""
    later = rf"""(?is)^[{sp}]*[0-9.]+[{sp}]*[;,{sp}][;,{sp}]*(?:url[{sp}]*=[{sp}]*)?(?:"([^"]*)|'([^']*)|([^"'].*))"""
    clean = lambda x: rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]+', '', 'g')"

    def value(name: str) -> str:
        """First attribute of this name; its entities are decoded part by part."""
        mine = f"list_filter(regexp_extract_all(regexp_replace(t, '^<[A-Za-z]+', ''), {q(attributes)}), lambda x: regexp_matches(x, {q(rf'(?i)^{name}[{sp}]*(?:=|\z)')}))[1]"
        written = rf"""(?s)^[^=]*=[{sp}]*(?:"([^"]*)"|'([^']*)'|([^"'].*|["'].*))"""
        whole = " || ".join(f"regexp_extract({mine}, {q(written)}, {i})" for i in (1, 2, 3))
        number = "CASE WHEN regexp_matches(p, '^&#[xX]') THEN ('0x' || p[4:-2])::BIGINT ELSE p[3:-2]::BIGINT END"
        named = " ".join(f"WHEN p = '&{k};' THEN {q(v)}" for k, v in url_filter.ENTITIES.items())
        one = f"CASE WHEN NOT starts_with(p, '&') OR p = '&' THEN p {named} WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr(({number})::INT) ELSE p END"
        parts = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|" + "|".join(url_filter.ENTITIES) + ");|[^&]+|&"
        return f"CASE WHEN {mine} IS NOT NULL THEN array_to_string(list_transform(regexp_extract_all({whole}, {q(parts)}), lambda p: {one}), '') END"

    def resolved(source: str, key: str, base: str, name: str) -> str:
        """Links l of a table, as absolute urls by its column base: table <name>ab with key and target."""
        return rf"""{name}li AS (SELECT {key}, l, regexp_extract({base}, '(?s)^(.*?)://', 1) AS sc, regexp_extract({base}, '(?s)^.*?://([^/?#]*)', 1) AS ho, regexp_extract({base}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS pa, regexp_extract({base}, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS qu,
 regexp_extract({base}, '(?s)^.*?://[^/?#]*(/[^?#]*/|/)', 1) AS fo FROM {source} WHERE l <> ''),
{name}fu AS (SELECT {key}, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(l, '//') THEN sc || ':' || l WHEN starts_with(l, '#') THEN sc || '://' || ho || qu
 WHEN starts_with(l, '?') THEN sc || '://' || ho || pa || l WHEN starts_with(l, '/') THEN sc || '://' || ho || l ELSE sc || '://' || ho || coalesce(nullif(fo, ''), '/') || l END AS fu FROM {name}li),
{name}fp AS (SELECT {key}, fu, regexp_extract(fu, '(?s)^(.*?://[^/?#]*)', 1) AS f1, regexp_extract(fu, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS f2, regexp_extract(fu, '(?s)^.*?://[^/?#]*[^?#]*(.*)$', 1) AS f3 FROM {name}fu WHERE fu IS NOT NULL),
{name}ab AS (SELECT {key}, CASE WHEN NOT contains(f2, '/.') THEN fu ELSE f1 || array_to_string(list_reduce(list_prepend([''], list_transform(string_split(CASE WHEN regexp_matches(f2, '/\.\.?$') THEN f2 || '/' ELSE f2 END, '/')[2:], lambda x: [x])),
 lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' AND len(a) > 1 THEN a[:len(a) - 1] WHEN x[1] = '..' THEN a ELSE list_concat(a, x) END), '/') || f3 END AS target FROM {name}fp)"""

    return rf"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS rid, page_id, url, list_filter(regexp_extract_all(html, {q(markup)}), lambda x: regexp_matches(x, {q(f'(?i)^<(?:link|meta|base)[{sp}/]')}) AND ends_with(x, '>')) AS tags FROM pages),
tg AS (SELECT rid, url, k, lower(t[2:2]) AS kind, {value('rel')} AS rel, {value('href')} AS href, {value('http-equiv')} AS equiv, {value('content')} AS content FROM (SELECT rid, url, unnest(tags) AS t, generate_subscripts(tags, 1) AS k FROM src WHERE strpos(url, '://') > 0)),
dl AS (SELECT rid, url, k, {clean("CASE WHEN kind = 'l' AND list_contains(regexp_split_to_array(lower(rel), " + q(f"[{sp}]+") + "), 'canonical') THEN href WHEN kind = 'm' AND lower(trim(equiv)) = 'refresh' THEN " + " || ".join(f"regexp_extract(content, {q(later)}, {i})" for i in (1, 2, 3)) + " END")} AS l FROM tg),
bs AS (SELECT rid, first({clean('href')} ORDER BY k) AS bl FROM tg WHERE kind = 'b' AND href IS NOT NULL GROUP BY rid),
b0 AS (SELECT rid, url AS b_url, bl AS l FROM bs JOIN src USING (rid)),
{resolved('b0', 'rid', 'b_url', 'b')},
se AS (SELECT DISTINCT url AS page, coalesce(bab.target, url) AS url, l FROM dl LEFT JOIN bab USING (rid) WHERE l <> ''),
{resolved('se', 'page', 'url', '')},
pa AS (SELECT page_id, url, {parts("url", "u")} FROM src),
ow AS (SELECT page_id, url, coalesce(uh, '') AS host, coalesce(up, '') AS path, CASE WHEN uh <> '' THEN uh || uq END AS node,
 CASE WHEN uh <> '' THEN regexp_replace(uh, '^(?:www|m)\.', '') || regexp_replace(regexp_replace(up, '/+$', ''), '\.html?$', '') || CASE WHEN length(uq) > length(up) + 1 THEN substr(uq, length(up) + 1) ELSE '' END END AS c FROM pa),
ju AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS said FROM ow),
ta AS (SELECT page AS url, {parts("target", "t")} FROM ab WHERE target IS NOT NULL),
ed AS (SELECT node AS u, c AS v FROM ow WHERE node IS NOT NULL UNION SELECT node, th || tq FROM ow JOIN ta ON ow.url = ta.url WHERE node IS NOT NULL AND th <> ''),
bo AS (SELECT u, v FROM ed WHERE v IS NOT NULL AND u <> v UNION SELECT v, u FROM ed WHERE v IS NOT NULL AND u <> v),
re AS (SELECT u, u AS v FROM bo UNION SELECT re.u, bo.v FROM re JOIN bo ON re.v = bo.u),
lb AS (SELECT u AS node, min(v) AS label FROM re GROUP BY 1),
no AS (SELECT label, regexp_extract(node, '^([^/?#]*)', 1) AS host, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS path FROM lb),
vo AS (SELECT label FROM (SELECT label, {case(lambda v, h, p: v)} AS said FROM no) WHERE said IS NOT NULL GROUP BY 1 HAVING bool_or(said = 'block') AND NOT bool_or(said = 'allow')),
bl AS (SELECT node FROM lb JOIN vo ON lb.label = vo.label)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bl.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, said IS NULL AND bl.node IS NOT NULL AS propagated FROM ju LEFT JOIN bl ON ju.node = bl.node"""


ORACLE_SQL = {"op3_license_scans": license_sql(), "op6_url_filters": url_sql()}


def _lloyd(rounds: int = 10, k: int = 8, dims: int = 64) -> str:
    """Plain rounds of all distances, without bounds; floor(a / b) of integers as (a - mod) / b."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, q FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    near = "SELECT v.vec_id, v.q, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{0} c"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min({{'d': d, 'c': c}}) AS m FROM ({near.format(i)}) GROUP BY vec_id)")
        if i < rounds:
            parts.append(f"n{i} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS q FROM (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(q) AS x, generate_subscripts(q, 1) AS p FROM a{i}) GROUP BY c, p) GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN n{i} ON n{i}.c = c{i}.c)")
    last = f"SELECT vec_id, m.c::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = m.c"
    return f"WITH {', '.join(parts)} {last}"


ORACLE_SQL["op12_centroid_clustering"] = _lloyd()
