"""SQL that checks the training-data queries where SQL can express them."""

from __future__ import annotations

from . import secret_scan, url_rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

#: Shingle sets, links by counts of common shingles, and what each row reaches over links.
OP6 = rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}',
'{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM t),
n AS MATERIALIZED (SELECT r, doc_id, len(sh) AS n FROM s),
e AS MATERIALIZED (SELECT r, hash(x) AS h, x FROM (SELECT r, unnest(sh) AS x FROM s WHERE doc_id IS NOT NULL)),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.x = b.x AND a.r < b.r GROUP BY ALL),
l0 AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS MATERIALIZED (SELECT a, b FROM l0 UNION ALL SELECT b, a FROM l0),
g(r, o) AS (SELECT r, r FROM n UNION SELECT g.r, l.b FROM g JOIN l ON l.a = g.o),
m AS (SELECT g.r, min(n.doc_id) AS component_id FROM g JOIN n ON n.r = g.o GROUP BY g.r),
d AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN component_id END AS component_id,
coalesce(n_links, 0) AS n_links FROM n JOIN m USING (r) LEFT JOIN d USING (r)
"""


def _found(name: str, pattern: str, kind: int, keep: str = "true", end: str = "len(m[i])", value: str = "m") -> str:
    """CTE: (r, spans) of a pattern's matches; text between matches and matches alternate, so their lengths give the places."""
    place = "list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)"
    span = f"{{'s': CAST({place} AS BIGINT), 'k': {kind}, 'e': CAST({place} + {end} AS BIGINT)}}"
    return f"""{name}0 AS (SELECT r, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS m, {value} AS
v FROM t WHERE regexp_matches(t, '{pattern}')),
{name} AS MATERIALIZED (SELECT r, list_transform(list_filter(range(1, len(m) + 1), lambda i: {keep}), lambda i: {span}) AS
{name} FROM {name}0)"""


def _op7() -> str:
    assign, access, hexes, ident, endpoint = (p.replace("'", "''")
        for p in (secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX, secret_scan.WEAK_ID, secret_scan.WEAK_ENDPOINT))
    # A secret-like string begins a run of its characters; the whole run must have the three kinds.
    body = "^[A-Za-z0-9+/_-]{24,}={0,2}"
    like = (f"regexp_matches(m[i], '{body}') AND regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[a-z]') AND "
        f"regexp_matches(m[i], '[A-Z]')")
    parts = [
        _found("fa", assign, 0, f"len(v[i]) >= {secret_scan.MIN_VALUE}", value=f"regexp_extract_all(t, '{assign}', 2)"),
        _found("fb", access, 1, f"len(m[i]) >= {secret_scan.MIN_ACCESS}"),
            _found("fc", hexes, 2, f"len(m[i]) >= {secret_scan.MIN_HEX}"),
        _found("fd", ident, 3), _found("fe", "[A-Za-z0-9+/_=-]+", 4, like, f"len(regexp_extract(m[i], '{body}'))"),
            _found("ff", endpoint, 5),
    ]
    none = "[]::STRUCT(s BIGINT, k INTEGER, e BIGINT)[]"
    lists = ", ".join(f"coalesce({c}, {none}) AS {c}" for c in ("fa", "fb", "fc", "fd", "fe", "ff"))
    joins = " ".join(f"LEFT JOIN {c} USING (r)" for c in ("fa", "fb", "fc", "fd", "fe", "ff"))
    over = lambda a, b: f"({a}.s < {b}.e AND {b}.s < {a}.e)"
    near = lambda a, b: f"({a}.s < {b}.e + {secret_scan.SCOPE} AND {b}.s < {a}.e + {secret_scan.SCOPE})"
    some = lambda xs, x, test: f"len(list_filter({xs}, lambda {x}: {test})) > 0"
    fresh = lambda c: f"list_filter({c}, lambda w: NOT {some('base', 'b', over('w', 'b'))})"
    kinds = ", ".join(f"'{k}'" for k in secret_scan.KINDS)
    listed = lambda xs: f"array_to_string(list_transform({xs}, lambda x: [{kinds}][x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), {', '.join(parts)},
a AS (SELECT r, doc_id, {lists} FROM t {joins}), b AS (SELECT *, list_sort(fa || fb || fc) AS base FROM a),
c AS (SELECT *, {fresh('fd')} AS ids, {fresh('fe')} AS secrets, {fresh('ff')} AS ends FROM b),
d AS (SELECT *, list_filter(secrets, lambda w: {some('(fb || ids)', 'i', near('w', 'i'))} AND NOT
{some('ids', 'i', over('w', 'i'))}) AS told FROM c),
e AS (SELECT *, list_filter(ends, lambda w: {some('(fb || ids)', 'i', near('w', 'i'))} AND
{some('(fa || fc || told)', 's', near('w', 's'))}) AS places,
  list_filter(ids, lambda w: {some('(fa || fc || told)', 's', near('w', 's'))}) AS named FROM d),
f AS (SELECT *, list_sort(base || named || told || places) AS spans0 FROM e)
SELECT doc_id, CAST(len(fa) AS BIGINT) AS n_assign, CAST(len(fb) AS BIGINT) AS n_access, CAST(len(fc) AS BIGINT) AS n_hex,
sha256({listed('base')}) AS base_sha256, {listed('spans0')} AS spans, CAST(len(spans0) - len(base) AS BIGINT) AS n_linked FROM f
"""


def _op10() -> str:
    rules = sorted(url_rules.RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{s}'" for s, h, p in rules) + " END"
    parts = lambda text, cut: f"list_filter(string_split({text}, '{cut}'), lambda x: x <> '')"
    tagged = lambda tag, xs: f"list_transform({xs}, lambda x: '{tag}:' || x)"
    one = lambda text: f"list_filter([{text}], lambda x: x <> '')"
    asked = r"regexp_extract(u, '(?s)\?([^#]*)', 1)"
    lists = [
        tagged("scheme", one(r"regexp_extract(u, '(?s)\A([A-Za-z][A-Za-z0-9+.-]*)://', 1)")), tagged("label", parts("host", ".")),
        tagged("site", one(r"regexp_extract(host, '([^.]+\.[^.]+)\z', 1)")),
        tagged("segment", f"list_transform({parts('path', '/')}, lambda s: regexp_replace(s, '[0-9]+', '#', 'g'))"),
        tagged("key", f"list_transform({parts(asked, '&')}, lambda s: split_part(s, '=', 1))"),
    ]
    sets = []
    for n in range(1, url_rules.MAX_TOKENS + 1):
        tables = "k t1" + "".join(f" JOIN k t{i} ON t{i}.r = t1.r AND t{i}.x > t{i - 1}.x" for i in range(2, n + 1))
        tokens = ", ".join(f"t{i}.x" for i in range(1, n + 1))
        sets.append(f"SELECT [{tokens}] AS tokens, count(*) AS freq, sum(t1.hit) AS hits FROM {tables} GROUP BY ALL")
    return rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS u, translate(coalesce(regexp_extract(url,
'(?s)\A.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS MATERIALIZED (SELECT *, {rule} AS rule, {said} AS said, list_distinct({' || '.join(lists)}) AS tokens FROM u),
k AS MATERIALIZED (SELECT r, unnest(tokens) AS x, CASE WHEN said = 'block' THEN 1 ELSE 0 END AS hit FROM p WHERE rule IS NOT NULL),
q AS (SELECT count(*) AS total FROM p WHERE rule IS NOT NULL), z AS ({' UNION ALL '.join(sets)}),
a AS MATERIALIZED (SELECT tokens, hits::DOUBLE / freq AS confidence, hits::DOUBLE / total AS support FROM z, q WHERE hits >=
greatest(1.0::DOUBLE, {url_rules.MIN_SUPPORT}::DOUBLE * total) AND hits::DOUBLE / freq >= {url_rules.MIN_CONFIDENCE}::DOUBLE),
b AS MATERIALIZED (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a s WHERE len(s.tokens) < len(a.tokens) AND s.confidence >=
a.confidence AND list_has_all(a.tokens, s.tokens))),
h AS (SELECT r, confidence, array_to_string(b.tokens, ' ') AS mined, row_number() OVER (PARTITION BY r ORDER BY confidence DESC,
support DESC, array_to_string(b.tokens, ' ')) AS place FROM p JOIN b ON list_has_all(p.tokens, b.tokens) WHERE rule IS NULL)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN mined IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, mined,
confidence FROM p LEFT JOIN h ON h.r = p.r AND h.place = 1
"""


OP7, OP10 = _op7(), _op10()


#: White space of Python's ``str.split``.
_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def op5(vocabulary: list[str], start: str) -> str:
    """Greedy longest match over every distinct word: the longest piece at each of its places, then followed from the first."""
    rows = ", ".join("('" + p.replace("'", "''") + "')" for p in vocabulary)
    longest = max(map(len, vocabulary))
    return rf"""
WITH RECURSIVE vc(p) AS (VALUES {rows}), t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents),
o AS MATERIALIZED (SELECT r, unnest(w) AS w FROM t), d AS MATERIALIZED (SELECT DISTINCT w, '{start}' || w AS s FROM o),
a AS (SELECT w, s, unnest(range(1, len(s) + 1)) AS i FROM d), b AS (SELECT w, s, i, unnest(range(1, least({longest}, len(s) - i + 1)
+ 1)) AS k FROM a),
f AS (SELECT w, i, max(k) AS k FROM b JOIN vc ON vc.p = substr(s, i, k) GROUP BY ALL),
e AS MATERIALIZED (SELECT a.w, a.i, coalesce(f.k, 1) AS k, CASE WHEN f.k IS NULL THEN strlen(substr(a.s, a.i, 1)) ELSE 1 END AS c
FROM a LEFT JOIN f USING (w, i)),
g(w, i, n) AS (SELECT w, 1::BIGINT, 0::BIGINT FROM d UNION ALL SELECT g.w, g.i + e.k, g.n + e.c FROM g JOIN e ON e.w = g.w AND e.i =
g.i),
h AS MATERIALIZED (SELECT w, max(n) AS n FROM g GROUP BY w), c AS (SELECT r, sum(n) AS n FROM o JOIN h USING (w) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(t) AS BIGINT) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens FROM
t LEFT JOIN c USING (r)
"""


def _area(name: str, height: int, width: int) -> str:
    """CTEs: {name}(r, i, j, v), the mean of the area each cell of a small image covers, rounded to six digits."""
    share = lambda i, n, size, at: f"greatest(0, least({at} + 1, ({i} + 1) * ({size} / {n}.0::DOUBLE)) - greatest({at}, {i} * ({size} / {n}.0::DOUBLE)))"
    columns = ", ".join(f"({x}, {j}, {max(0.0, min(x + 1, (j + 1) * 64 / width) - max(x, j * 64 / width))!r}::DOUBLE)" for x in range(64) for j in range(width) if min(x + 1, (j + 1) * 64 / width) > max(x, j * 64 / width))
    return f"""{name}x(x, j, wx) AS (VALUES {columns}),
{name}y AS (SELECT r, any_value(hh) AS hh, y, j, sum(b * wx) AS v FROM px JOIN {name}x USING (x) GROUP BY r, y, j),
{name} AS MATERIALIZED (SELECT r, i, j, sum(v * {share('i', height, 'hh', 'y')}) * ({height * width}.0::DOUBLE / (any_value(hh) * 64)) AS v FROM {name}y, range(0, {height}) AS t(i) GROUP BY r, i, j)"""


def op8() -> str:
    """Payload, check sums, stored form, thumbnail features and tiles from the bytes of every text."""
    import numpy as np

    from . import media

    heads = " ".join(f"WHEN {h} THEN from_hex('{media.to_npy(np.zeros((h, 64), np.uint8))[:-64 * h].hex()}')" for h in range(1, 65))
    table = []
    for n in range(256):
        c = n
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    crc = f"xor(list_reduce(tail, lambda c, b: xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS MATERIALIZED (SELECT r, doc_id, len(x) // 2 AS n, greatest(1, (len(x) + 127) // 128) AS hh, rpad(x, CAST(128 * greatest(1, (len(x) + 127) // 128) AS INTEGER), '0') AS x FROM t),
px AS MATERIALIZED (SELECT r, hh, y, x, CAST('0x' || substr(s, 2 * x + 1, 2) AS INTEGER) AS b FROM (SELECT r, hh, y, substr(p.x, 128 * y + 1, 128) AS s FROM p, LATERAL (SELECT unnest(range(0, p.hh)) AS y)), range(0, 64) AS g(x)),
{_area('dh', 8, 9)}, {_area('mn', 4, 4)},
db AS (SELECT r, list(CASE WHEN round(a.v, 6) < round(b.v, 6) THEN 1 ELSE 0 END ORDER BY a.i, a.j) AS bits FROM dh a JOIN dh b USING (r, i) WHERE b.j = a.j + 1 GROUP BY r),
dx AS (SELECT r, array_to_string(list_transform(range(0, 16), lambda k: lower(hex(bits[4 * k + 1] * 8 + bits[4 * k + 2] * 4 + bits[4 * k + 3] * 2 + bits[4 * k + 4]))), '') AS dhash FROM db),
mx AS (SELECT r, array_to_string(list(lpad(lower(hex(CAST(round_even(v, 0) AS BIGINT))), 2, '0') ORDER BY i, j), '') AS small FROM mn GROUP BY r),
tb AS (SELECT r, list(b::BIGINT ORDER BY y, x) AS tail FROM px WHERE y = hh - 1 GROUP BY r),
tl AS (SELECT r, k, least(64, hh - 64 * k) AS th, substr(x, CAST(8192 * k + 1 AS BIGINT), 8192) AS s FROM p, LATERAL (SELECT unnest(range(0, (p.hh + 63) // 64)) AS k)),
th AS (SELECT r, count(*) AS n_tiles, string_agg(hex(CASE th {heads} END) || s, '' ORDER BY k) AS s FROM tl GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(hh * 64 AS BIGINT) AS payload_bytes, sha256(from_hex(p.x)) AS payload_sha256, {crc} AS tail_crc32,
  CAST(octet_length(encode('P5' || chr(10) || '64 ' || hh || chr(10) || '255' || chr(10))) + hh * 64 AS BIGINT) AS media_bytes,
  sha256(from_hex(hex(encode('P5' || chr(10) || '64 ' || hh || chr(10) || '255' || chr(10))) || p.x)) AS media_sha256,
  'dhash=' || dhash || ';mean4x4=' || small AS feature, n_tiles, sha256(from_hex(th.s)) AS tiles_sha256
FROM p JOIN dx USING (r) JOIN mx USING (r) JOIN tb USING (r) JOIN th USING (r)
"""
