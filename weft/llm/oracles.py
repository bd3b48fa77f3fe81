"""SQL (DuckDB) for the rows of queries that SQL can express. Near copies by all pairs that share a shingle: for small tables."""

from __future__ import annotations

from weft.llm import repeats, secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_JOIN = rf"""WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.r AS a, b.r AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT r AS a, r AS b FROM words UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
lowest AS (SELECT reach.a AS r, min(words.doc_id) AS component_id FROM reach JOIN words ON words.r = reach.b GROUP BY reach.a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN lowest ON lowest.r = sets.r"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(k: int, rule: secrets.Rule) -> str:
    """Every match of a rule: its start by the lengths of what lies before, its length, and the length that must be long enough."""
    p = _quoted(rule.pattern)
    before = "coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT r, {k} AS k, {_quoted(rule.kind)} AS kind, {rule.least} AS least, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': {before}, 'n': length(m[i]), 'c': length(g[i])}})) AS x
FROM (SELECT r, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {rule.group}) AS g, string_split_regex(t, {p}) AS p FROM texts WHERE regexp_matches(t, {p}))"""


SECRETS = f"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_spans(k, rule) for k, rule in enumerate(secrets.RULES))}),
spans AS (SELECT r, k, kind, CAST(x.s AS BIGINT) AS s, kind || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT) AS span FROM found WHERE x.c >= least),
summed AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
string_agg(span, ',' ORDER BY s, k) FILTER (k < {len(secrets.BASE)}) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN summed USING (r)"""

_BLANK = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ENDS = "[" + "".join("\\" + c if c in "-]^\\" else c for c in ".!?") + "]"

#: Documents of one id have one text here, so that the text's key decides nothing.
REPEATS = rf"""WITH lines AS (SELECT doc_id, line, i, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))),
cut AS (SELECT doc_id, i, pos, parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM (SELECT doc_id, i, pos, regexp_extract_all(line, '.*?{_ENDS}+(?:[{_BLANK}]|$)|.+$', 0, 's') AS parts FROM lines)),
placed AS (SELECT doc_id, i, j, pos + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, part FROM cut),
named AS (SELECT doc_id, i, j, pos + length(part) - length(regexp_replace(part, '^[{_BLANK}]+', '')) AS s, pos + length(regexp_replace(part, '[{_BLANK}]+$', '')) AS e, regexp_extract_all(part, '[^{_BLANK}]+') AS w, part FROM placed),
plain AS (SELECT *, lower(trim(array_to_string(w, ' '), {_quoted(repeats._EDGE).replace(chr(9), "' || chr(9) || '").replace(chr(13), "' || chr(13) || '").replace(chr(11), "' || chr(11) || '").replace(chr(12), "' || chr(12) || '")})) AS p FROM named),
units AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS unit, count(*) OVER (PARTITION BY doc_id, i) AS of_line, s, e, len(w) AS words, p FROM plain WHERE p <> ''),
rows_ AS (SELECT doc_id, unit, CASE WHEN of_line = 1 THEN 1 ELSE 0 END AS units, s, e, words, p FROM units
UNION ALL SELECT doc_id, min(unit), count(*), min(s), max(e), sum(words), string_agg(p, chr(10) ORDER BY unit) FROM units GROUP BY doc_id, i HAVING count(*) > 1),
again AS (SELECT *, first(doc_id) OVER w AS kept_doc_id, first(s) OVER w AS kept_start, row_number() OVER w AS rank FROM rows_ WINDOW w AS (PARTITION BY p ORDER BY doc_id, s)),
marked AS (SELECT *, max(CASE WHEN units > 0 THEN unit + units END) OVER (PARTITION BY doc_id ORDER BY unit, units DESC ROWS UNBOUNDED PRECEDING) AS line FROM again WHERE doc_id <> kept_doc_id OR s <> kept_start),
runs AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM marked WHERE units < 2),
summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS run_words FROM runs)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(s AS INTEGER) AS start_char, CAST(e AS INTEGER) AS end_char, CAST(words AS INTEGER) AS n_words, CAST(run_words AS BIGINT) AS run_words, kept_doc_id, CAST(kept_start AS INTEGER) AS kept_start
FROM summed WHERE run_words >= {repeats.MIN_WORDS} OR line > unit"""


#: Failures by their definition, and each of the 600 steps by a pass over the (part, failures) counts.
FILTER_AUDIT = r"""WITH RECURSIVE texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
failing AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
 100 * length(regexp_replace(texts.t, '[^A-Z]', '', 'g')) > 2 * length(texts.t) AS c, regexp_matches(texts.t, '[#$%&*|]') AS d, coalesce(texts.doc_id > least, least IS NOT NULL) AS e
 FROM texts JOIN firsts ON firsts.t = texts.t LEFT JOIN marks ON marks.doc_id = texts.doc_id),
masks AS (SELECT part, good, toxic, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS f, count(*) AS n FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT '' AS o, 0 AS used UNION ALL SELECT o || x, used + bit FROM orders JOIN letters ON used & bit = 0 WHERE length(o) < 5),
steps AS (SELECT o.o AS filter_order, CAST(length(p.o) + 1 AS INT) AS step, p.used AS applied, bit, x FROM orders o JOIN orders p ON length(o.o) = 5 AND length(p.o) < 5 AND starts_with(o.o, p.o) JOIN letters ON x = substr(o.o, length(p.o) + 1, 1)),
told AS (SELECT part, filter_order, step, x, sum(CASE WHEN f & (applied | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN f & applied = 0 AND f & bit > 0 THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN f & applied > 0 AND f & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f = bit THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN f & applied = 0 AND f & bit > 0 AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN f & applied = 0 AND f & bit > 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
 FROM masks CROSS JOIN steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM told"""

#: CRC-32 by its table, byte by byte, for each distinct feature.
RESAMPLING = r"""WITH tab AS (SELECT list(crc ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), list_transform(range(8), lambda k: CAST(0 AS UBIGINT))), lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS crc FROM range(256) t(i))),
texts AS (SELECT row_number() OVER () AS r, doc_id, 0 AS b, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, 1, text FROM benchmark),
words AS (SELECT r, b, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feats AS (SELECT r, b, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS x FROM words),
seen AS (SELECT r, b, x, count(*) AS n FROM feats GROUP BY ALL),
bytes AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM seen)),
hashed AS (SELECT x, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length(h), 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1 AS UBIGINT))),
 lambda c, v: xor(c >> 8, tab[CAST(xor(c, v) & 255 AS INT) + 1])), CAST(4294967295 AS UBIGINT)) % 10000 AS INT) AS k FROM bytes, tab),
counts AS (SELECT k, sum(CASE WHEN b = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN b = 1 THEN n ELSE 0 END) AS t FROM seen JOIN hashed USING (x) GROUP BY k),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gains AS (SELECT k, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM counts, totals),
sums AS (SELECT r, sum(n * g) AS weight FROM seen JOIN hashed USING (x) JOIN gains USING (k) WHERE b = 0 GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS score FROM words LEFT JOIN sums USING (r) WHERE b = 0),
placed AS (SELECT *, n_words >= 20 AS enough, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features DESC, weight DESC) AS i, count(*) OVER (PARTITION BY n_words >= 20) AS many FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN enough AND i <= 5 * many // 100 THEN i END AS rank FROM placed"""
