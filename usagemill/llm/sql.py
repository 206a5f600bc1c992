"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import licenses, secrets

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(" + _LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op1_suffix_dedup(length: int = 100) -> str:
    return f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
 p AS (SELECT doc_id, unnest(range(0, octet_length(b) - {length - 1})) AS pos, b FROM d WHERE octet_length(b) >= {length}),
 w AS (SELECT doc_id, pos, hex(array_slice(b, pos + 1, pos + {length})) AS win FROM p),
 later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM w) WHERE n > 1),
 marked AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER o + {length} THEN 0 ELSE 1 END AS fresh FROM later WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
 spans AS (SELECT doc_id, s, min(pos) AS a, max(pos) + {length} AS z FROM (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM marked) GROUP BY doc_id, s),
 cuts AS (SELECT doc_id, list(struct_pack(a := a, z := z) ORDER BY a) AS c, sum(z - a)::BIGINT AS gone, count(*) AS n FROM spans GROUP BY doc_id)
 SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
   sha256(CASE WHEN c IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(0, len(c) + 1), lambda i: hex(array_slice(b, CASE WHEN i = 0 THEN 1 ELSE c[i].z + 1 END, CASE WHEN i = len(c) THEN octet_length(b) ELSE c[i + 1].a END))), '')) END) AS kept_sha256
 FROM d LEFT JOIN cuts USING (doc_id)"""


def op3_warc_revisits() -> str:
    return """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
 d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(t), 1 + (i // 4) * 5, 5))::INTEGER >> (5 * (3 - i % 4))::INTEGER) & 31), 1)), '') AS payload_digest FROM p),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact FROM f"""


def op8_licenses() -> str:
    rows = ", ".join(f"({k}, {_quoted(a)}, {_quoted(b)})" for k, (a, b) in enumerate(licenses.TEMPLATES))
    grams = "CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END"
    return rf"""WITH t AS (SELECT k, license, {grams} AS g FROM (SELECT k, license, {_WORDS.format('said')} AS w FROM (VALUES {rows}) v(k, license, said))),
 s AS (SELECT doc_id, string_split_regex(text, '\r?\n') || list_filter(string_split_regex(text, '\r?\n[ \t]*\r?\n'), lambda x: contains(x, chr(10))) AS parts FROM documents),
 e AS (SELECT doc_id, unnest(range(0, len(parts))) AS segment, unnest(parts) AS line FROM s),
 g AS (SELECT doc_id, segment, {grams} AS own FROM (SELECT doc_id, segment, {_WORDS.format('line')} AS w FROM e)),
 m AS (SELECT doc_id, segment, k, license, 2.0 * len(list_intersect(own, t.g)) / (len(own) + len(t.g)) AS dice FROM g JOIN t ON len(own) BETWEEN len(t.g) * 0.6 AND len(t.g) * 1.6 WHERE len(own) > 0),
 f AS (SELECT * FROM m WHERE dice >= {licenses.LEAST}),
 b AS (SELECT doc_id, first(license ORDER BY dice DESC, segment, k) AS license, round(max(dice), 6) AS dice, count(DISTINCT segment) AS n_segments, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM f GROUP BY doc_id)
 SELECT d.doc_id, b.license, coalesce(b.dice, 0.0)::DOUBLE AS dice, coalesce(b.n_segments, 0)::BIGINT AS n_segments, coalesce(b.licenses, '') AS licenses FROM documents d LEFT JOIN b USING (doc_id)"""


def _found(kind: int, pattern: str, group: int, least: int) -> str:
    p = _quoted(pattern)
    at = "list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {kind} AS kind, ({at})::BIGINT AS start, ({at} + length(hits[k]))::BIGINT AS stop FROM (SELECT doc_id, gaps, hits, parts, unnest(range(1, len(hits) + 1)) AS k
 FROM (SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS parts FROM documents WHERE regexp_matches(text, {p}))) WHERE length(parts[k]) >= {least}"""


def op9_secrets() -> str:
    names = [x[0] for x in (*secrets.BASE, *secrets.WEAK)]
    every = " UNION ALL ".join([_found(k, x[1], x[3], x[4]) for k, x in enumerate(secrets.BASE)] + [_found(len(secrets.BASE) + k, x[2], x[3], x[4]) for k, x in enumerate(secrets.WEAK)])
    label = f"({'[' + ', '.join(map(_quoted, names)) + ']'})[kind + 1] || ':' || start || ':' || stop"
    return f"""WITH a AS ({every}),
 l AS (SELECT * FROM a x WHERE kind < 3 OR EXISTS (SELECT 1 FROM a y WHERE y.doc_id = x.doc_id AND abs(y.start - x.start) <= {secrets.SCOPE} AND CASE WHEN x.kind IN (3, 5) THEN y.kind IN (0, 2, 4) ELSE y.kind IN (1, 3, 5) END)),
 s AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, string_agg({label}, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg({label}, ',' ORDER BY start, kind, stop) AS spans FROM l GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN s USING (doc_id)"""


def op10_decontaminate(width: int = 13, share: int = 20) -> str:
    text = _WORDS.format("coalesce(text, '')")
    return f"""WITH i AS (SELECT item_id, {text} AS w FROM benchmark), d AS (SELECT doc_id, {text} AS w FROM documents),
 wins AS (SELECT DISTINCT item_id, unnest(list_transform(range(0, greatest(1, len(w) - {width - 1})), lambda k: array_to_string(w[k + 1:k + {width}], ' '))) AS win, least(len(w), {width}) AS n FROM i WHERE len(w) > 0),
 sizes AS (SELECT DISTINCT n FROM wins),
 grams AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS pos, unnest(list_transform(range(0, len(w) - n + 1), lambda k: array_to_string(w[k + 1:k + n], ' '))) AS win FROM d, sizes WHERE len(w) >= n),
 hits AS (SELECT doc_id, pos, item_id, g.n FROM grams g JOIN wins v ON g.win = v.win AND g.n = v.n),
 hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT doc_id, pos, n FROM hits)) GROUP BY doc_id),
 items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {share} * coalesce(n_hit, 0) >= len(w) AS contaminated
 FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def oracles() -> dict[str, str]:
    return {f.__name__: f() for f in (op1_suffix_dedup, op3_warc_revisits, op8_licenses, op9_secrets, op10_decontaminate)}
