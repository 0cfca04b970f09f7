"""SQL, in DuckDB's dialect, of the queries that SQL expresses."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _host(url: str) -> str:
    return "coalesce(" + _LOWER.format(f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)") + ", '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _alias(url: str) -> str:
    bare = f"regexp_replace({url}, '(?s)#.*$', '')"
    kept = f"""array_to_string(list_filter(string_split(regexp_extract({bare}, '(?s)^.*?://[^?]*\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)')), '&')"""
    return f"""CASE WHEN instr({url}, '://') > 0 THEN regexp_replace({_host(url)}, '^www\\.', '') || regexp_replace({_path(url)}, '/+$', '') || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"""


def _without_dots(path: str) -> str:
    step = "CASE WHEN x = ['.'] THEN done WHEN x = ['..'] THEN list_slice(done, 1, greatest(len(done) - 1, 1)) ELSE list_concat(done, x) END"
    return f"array_to_string(list_reduce(list_transform(string_split({path}, '/'), lambda s: [s]), lambda done, x: {step}, CAST([] AS VARCHAR[])), '/')"


def _resolved(link: str) -> str:
    x, host, own = f"trim(replace({link}, '&amp;', '&'))", _host("url"), _path("url")
    to, tail = f"regexp_extract({x}, '(?s)^([^?#]*)', 1)", f"regexp_extract({x}, '(?s)^[^?#]*(.*)$', 1)"
    folder = f"regexp_replace(CASE WHEN {own} = '' THEN '/' ELSE {own} END, '(?s)[^/]*$', '')"
    return f"""CASE WHEN instr(url, '://') = 0 THEN CASE WHEN instr({x}, '://') > 0 THEN {x} END WHEN regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {x}
      WHEN {x} = '' OR starts_with({x}, '#') OR regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with({x}, '//') THEN 'http:' || {x}
      WHEN starts_with({x}, '?') THEN 'http://' || {host} || {own} || {x} WHEN starts_with({x}, '/') THEN 'http://' || {host} || {_without_dots(to)} || {tail}
      ELSE 'http://' || {host} || {_without_dots(f"{folder} || {to}")} || {tail} END"""


def _rule(host: str, path: str, rules: list[tuple[str, str]], what: int) -> str:
    """The longest rule that fits (what 1) or its verdict (what 0)."""
    out = "CASE"
    for r in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1]), reverse=True):
        h, _, p = r[1].partition("/")
        out += f" WHEN ({host} = '{h}' OR suffix({host}, '.{h}')) AND starts_with({path}, '/{p}') THEN '{r[what]}'"
    return out + " END"


def url_filter(rules: list[tuple[str, str]]) -> str:
    """Aliases are closed by recursion over the edges, so that components are those of the reachable URLs."""
    canonical = """regexp_extract(regexp_extract(html, '(?is)(<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>)', 1), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)"""
    refresh = """regexp_extract(regexp_extract(html, '(?is)(<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>)', 1), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)"""
    return f"""WITH RECURSIVE p AS (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, {_alias("url")} AS alias FROM pages),
    links AS (SELECT url, {_resolved(canonical)} AS link FROM pages UNION ALL SELECT url, {_resolved(refresh)} FROM pages),
    e AS (SELECT DISTINCT {_alias("url")} AS a, {_alias("link")} AS b, link FROM links WHERE link IS NOT NULL),
    edges AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
    reach(node, other) AS (SELECT DISTINCT a, a FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.other),
    roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
    said AS (SELECT alias, {_rule("host", "path", rules, 0)} AS v FROM p UNION ALL SELECT b, {_rule(_host("link"), _path("link"), rules, 0)} FROM e WHERE a <> b),
    by_class AS (SELECT coalesce(root, alias) AS class, min(v) AS v FROM said LEFT JOIN roots ON node = alias WHERE alias IS NOT NULL AND v IS NOT NULL GROUP BY ALL)
    SELECT page_id, host, path, {_rule("host", "path", rules, 1)} AS rule, coalesce({_rule("host", "path", rules, 0)}, by_class.v, 'allow') AS verdict
    FROM p LEFT JOIN roots ON node = alias LEFT JOIN by_class ON class = coalesce(root, alias)"""


def contamination(window: int = 13, share: int = 20) -> str:
    return f"""WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
    bw AS (SELECT DISTINCT item, least({window}, len(w)) AS size, array_to_string(list_slice(w, i + 1, i + least({window}, len(w))), ' ') AS k FROM b, unnest(range(0, len(w) - least({window}, len(w)) + 1)) AS u(i) WHERE len(w) > 0),
    d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), sizes AS (SELECT DISTINCT size FROM bw),
    dw AS (SELECT doc_id, size, i, array_to_string(list_slice(w, i + 1, i + size), ' ') AS k FROM d, sizes, unnest(range(0, len(w) - size + 1)) AS u(i) WHERE len(w) >= size),
    m AS (SELECT doc_id, i, dw.size AS size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.k = bw.k),
    hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, unnest(range(0, size)) AS u(j) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND {share} * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bit = "list_reduce(list_concat([xor(c, b)], range(0, 8)), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, b: {bit}), 4294967295)"


def conversation_repair() -> str:
    """The cheapest edits row by row in a recursion; a state is its cost in twelve digits followed by its script."""
    put = lambda x, cost, letter: f"printf('%012d', CAST(left({x}, 12) AS BIGINT) + {cost}) || substr({x}, 13) || {letter}"
    u = f"least(u, {put('e', 3, chr(39) + 'I' + chr(39))}, {put('s', 3, chr(39) + 'I' + chr(39))}, {put('a', 3, chr(39) + 'I' + chr(39))})"
    a = f"least(a, {put(f'({u})', 3, chr(39) + 'J' + chr(39))})"
    gone = lambda x: put(x, 4, "'D'")
    become = lambda x, initial, letter: put(x, f"(tr + CASE WHEN ini = '{initial}' THEN 0 ELSE 3 END)", f"CASE WHEN ini = '{initial}' THEN 'K' ELSE '{letter}' END")
    null_ = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    return f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(null_('conv_id') + " || ':' || " + null_('turn'))} % 20 AS k FROM conversations),
    x AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE k <> 0),
    f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
      regexp_extract(text, '(?s)([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS tip, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) || left(role, 1) AS joint FROM x),
    g AS (SELECT *, tip = '' AS blank, tip <> '' AND seen AS dup, tip <> '' AND NOT seen AND tip NOT IN ('.', '!', '?') AS cut FROM f),
    n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
      count(*) FILTER (joint NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
    r(conv_id, i, e, s, u, a) AS (SELECT conv_id, CAST(0 AS BIGINT), repeat('0', 12), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM n
      UNION ALL SELECT conv_id, i, {gone('e')}, least({gone('s')}, CASE WHEN may AND ini = 's' THEN {put('e', 'tr', chr(39) + 'K' + chr(39))} END), least({gone('u1')}, CASE WHEN may THEN {become('least(e, s, a1)', 'u', 'R')} END),
        least({gone('a1')}, CASE WHEN may THEN {become('u1', 'a', 'S')} END)
        FROM (SELECT r.conv_id, g.i, e, s, ini, NOT (blank OR dup) AS may, CASE WHEN cut THEN 3 ELSE 0 END AS tr, {u} AS u1, {a} AS a1 FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i + 1)),
    best AS (SELECT n.*, least(e, {a}) AS b FROM r JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.n = r.i),
    steps AS (SELECT conv_id, unnest(st) AS step, unnest(range(1, len(st) + 1)) AS i FROM (SELECT conv_id, list_append(regexp_extract_all(substr(b, 13), '[IJ]*[DKRS]'), regexp_extract(substr(b, 13), '[IJ]*$')) AS st FROM best)),
    lines AS (SELECT steps.conv_id, steps.i, replace(replace(translate(step, 'DKRS', ''), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) || CASE right(step, 1) WHEN 'K' THEN role || ':' || text || chr(10) WHEN 'R' THEN 'user:' || text || chr(10) WHEN 'S' THEN 'assistant:' || text || chr(10) ELSE '' END AS line
      FROM steps LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM steps.conv_id AND g.i = steps.i),
    texts AS (SELECT conv_id, string_agg(line, '' ORDER BY i) AS t FROM lines GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(b, 12) AS BIGINT), 0) AS cost,
      coalesce(translate(substr(b, 13), 'JS', 'IR'), '') AS audit, sha256(coalesce(left(t, -1), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM c.conv_id"""
