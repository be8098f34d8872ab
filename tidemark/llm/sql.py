"""DuckDB SQL for the operators that SQL can express, written for the parameters of their queries.

``OP3`` spells out the four rules and walks redirect components with a recursive CTE; ``OP7`` is the
water level and the hashed copies; ``OP10`` is the exact similarity join (a pair at 0.8 or more
shares one of the rarest fifth of either set, so candidates meet there and are then counted in full).
"""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_HOST = _LOWER.format("coalesce(regexp_extract(CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) END, '^([^/?#]*)', 1), '')")
_PATH = "coalesce(regexp_extract(CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) END, '^[^/?#]*([^?#]*)', 1), '')"
_RULE = """CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END"""
_SAID = "CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IN ('net/', 'example.com/de/') THEN 'block' END"
_KEY = "CASE WHEN regexp_extract({0}, '^([^/?#]*://)', 1) = '' THEN {0} ELSE regexp_extract({0}, '^([^/?#]*://)', 1) || " + _HOST + " || regexp_extract({0}, '^[^/?#]*://[^/?#]*([^#]*)', 1) END"

_WS = "\\x20\\t\\n\\r\\f"
_TEXT = ("script", "style", "title", "textarea", "template", "iframe", "noembed", "noframes", "xmp")
_HIDDEN = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(f"<{t}[{_WS}/>].*?(?:</{t}[{_WS}/>]|\\z)" for t in _TEXT)
_TAG = f"""<[A-Za-z][^>=]*(?:=[{_WS}]*(?:"[^"]*"|''[^'']*'')?[^>=]*)*>"""
_ATTRIBUTES = f"""([^{_WS}"''<>/=]+)[{_WS}]*=[{_WS}]*("[^"]*"|''[^'']*''|[^{_WS}"''>]+)"""


def _attribute(tag: str, name: str) -> str:
    value = f"regexp_extract_all({tag}, '{_ATTRIBUTES}', 2)[nullif(coalesce(list_position(list_transform(regexp_extract_all({tag}, '{_ATTRIBUTES}', 1), lambda n: lower(n)), '{name}'), 0), 0)]"
    return f"regexp_replace({value}, '^[\"''](.*)[\"'']$', '\\1', 's')"


def _resolved(base: str, t: str) -> str:
    root, path, own, tail = (f"regexp_extract({x}, '{p}', 1)" for x, p in ((base, "^([^/?#]*://[^/?#]*)"), (base, "^[^/?#]*://[^/?#]*([^?#]*)"), (t, "^([^?#]*)"), (t, "^[^?#]*(.*)$")))
    under = f"(CASE WHEN {path} = '' THEN '/' ELSE regexp_replace({path}, '[^/]*$', '') END || {own})"
    return f"""CASE WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {t} WHEN {root} = '' THEN NULL WHEN starts_with({t}, '//') THEN regexp_extract({base}, '^([^/?#]*:)//', 1) || {t}
        WHEN starts_with({t}, '/') THEN {root} || {_NO_DOTS.format(own)} || {tail} WHEN starts_with({t}, '?') THEN {root} || {path} || {t} WHEN starts_with({t}, '#') OR {t} = '' THEN {base}
        ELSE {root} || {_NO_DOTS.format(under)} || {tail} END"""


_NO_DOTS = """(list_reduce(str_split({0}, '/')[2:], lambda held, x: CASE x WHEN '.' THEN held WHEN '..' THEN regexp_replace(held, '/[^/]*$', '') ELSE held || '/' || x END, '')
        || CASE WHEN str_split({0}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END)"""

OP3 = f"""
WITH RECURSIVE pages_tags AS (
    SELECT url AS a, list_filter(regexp_extract_all(regexp_replace(html, '{_HIDDEN}', ' ', 'g'), '{_TAG}'), lambda t: regexp_matches(t, '(?i)^<(?:link|meta|base)[{_WS}/]')) AS tags
    FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
firsts AS (SELECT a, tags, list_filter(list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^<base[{_WS}/]')), lambda t: trim(replace({_attribute("t", "href")}, '&amp;', '&'))), lambda h: h IS NOT NULL)[1] AS f FROM pages_tags),
based AS (SELECT a, CASE WHEN coalesce(f, '') = '' THEN a ELSE coalesce({_resolved("a", "f")}, a) END AS base, unnest(tags) AS tag FROM firsts),
named AS (
    SELECT a, base, trim(replace(CASE WHEN regexp_matches(tag, '(?i)^<link[{_WS}/]') AND list_contains(regexp_split_to_array(lower({_attribute("tag", "rel")}), '[{_WS}]+'), 'canonical') THEN {_attribute("tag", "href")}
        WHEN regexp_matches(tag, '(?i)^<meta[{_WS}/]') AND lower({_attribute("tag", "http-equiv")}) = 'refresh' THEN regexp_extract({_attribute("tag", "content")}, '(?i)\\burl[{_WS}]*=[{_WS}]*[''"]?([^"''>{_WS}]+)', 1) END, '&amp;', '&')) AS t FROM based),
full_url AS (SELECT a, {_resolved("base", "t")} AS b FROM named WHERE t <> ''),
edges AS (SELECT DISTINCT {_KEY.format("a")} AS a, {_KEY.format("b")} AS b FROM full_url WHERE b IS NOT NULL),
links AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, other) AS (SELECT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
member AS (SELECT node, min(other) AS component FROM reach GROUP BY 1),
ruled AS (SELECT *, {_RULE} AS rule FROM (SELECT *, {_HOST.format("node")} AS host, {_PATH.format("node")} AS path FROM member)),
decided AS (SELECT component, coalesce(bool_or(said = 'block'), false) AND NOT coalesce(bool_or(said = 'allow'), false) AS by_alias FROM (SELECT *, {_SAID} AS said FROM ruled) GROUP BY 1),
own AS (SELECT *, {_RULE} AS rule FROM (SELECT page_id, url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM pages))
SELECT page_id, host, path, rule, coalesce({_SAID}, CASE WHEN by_alias THEN 'block' END, 'allow') AS verdict, component
FROM own LEFT JOIN (SELECT node, component, by_alias FROM member JOIN decided USING (component)) s ON s.node = {_KEY.format("url")}
"""

OP7 = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM sources),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER below, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
    FROM weighed WINDOW below AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(weight * max(level) OVER (), most) AS target FROM levels),
rated AS (SELECT d.doc_id, d.size, d.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copied AS (SELECT *, (floor(rate) + (('0x' || substr(md5('mix-1/' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate))::INTEGER)::INTEGER AS copies FROM rated)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, source FROM copied
"""

OP10 = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
cut AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS s FROM worded),
sets AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM cut WHERE len(s) > 0 GROUP BY s),
parts AS (SELECT rep, n, unnest(s) AS g FROM sets),
often AS (SELECT g, count(*) AS df FROM parts GROUP BY 1),
rare AS (SELECT rep, n, g FROM parts JOIN often USING (g)
    QUALIFY row_number() OVER (PARTITION BY rep ORDER BY df, g) <= n - ceil(n * 80 / 100.0) + 1),
meet AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM rare x JOIN rare y ON x.g = y.g AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
counted AS (SELECT a, b, x.n AS na, y.n AS nb, len(list_intersect(x.s, y.s)) AS same FROM meet JOIN sets x ON x.rep = a JOIN sets y ON y.rep = b),
one_way AS (SELECT a, b FROM counted WHERE 100 * same >= 80 * (na + nb - same)),
links AS (SELECT a, b FROM one_way UNION SELECT b, a FROM one_way),
reach(node, other) AS (SELECT rep, rep FROM sets UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
classes AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)
SELECT doc_id, len(cut.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM cut LEFT JOIN sets ON sets.s = cut.s LEFT JOIN classes ON node = rep
"""
