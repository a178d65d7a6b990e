"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from plumbline.llm.licences import TEMPLATES, THRESHOLD

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licences() -> str:
    rows = ",\n".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())
    words = f"string_split(trim(regexp_replace(translate({{}}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    pairs = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return f"""
WITH t(licence, body) AS (VALUES {rows}),
tw AS (SELECT licence, {words.format("body")} AS w FROM t),
tb AS (SELECT licence, {pairs} AS b FROM tw),
paragraphs AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS unit FROM documents),
units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents
  UNION ALL SELECT doc_id, unit FROM paragraphs WHERE contains(trim(unit, ' '), chr(10))),
w AS (SELECT doc_id, {words.format("unit")} AS w FROM units),
b AS (SELECT doc_id, {pairs} AS b FROM w WHERE len(w) >= 2),
s AS (SELECT doc_id, licence, 2.0::DOUBLE * len(list_intersect(b.b, tb.b)) / (len(b.b) + len(tb.b)) AS score FROM b, tb)
SELECT doc_id, licence, round(max(score), 9) AS score, count(*) AS n_units FROM s WHERE score >= {THRESHOLD}
GROUP BY doc_id, licence"""


def _urls() -> str:
    bad = "(coalesce(quality = 0, false) OR coalesce(toxic = 1, false))"
    return f"""
WITH u AS (SELECT page_id, url, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS r
           FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*\\?([^#]*)', 1) AS q FROM u),
raw AS (
  SELECT page_id, url, path, 'h:' AS k, unnest(string_split(host, '.')) AS t FROM parts
  UNION ALL SELECT page_id, url, path, 'p:',
    unnest(regexp_split_to_array(translate(path, '{UPPER}', '{LOWER}'), '[^a-z0-9]+')) FROM parts
  UNION ALL SELECT page_id, url, path, 'q:', regexp_extract(unnest(string_split(q, '&')), '^[^=]*') FROM parts),
tok AS (SELECT DISTINCT page_id, url, path, k || t AS t FROM raw WHERE t <> '' AND NOT regexp_full_match(t, '[0-9]+')),
marked AS (SELECT doc_id, max({bad}) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
lab AS (SELECT page_id, url, bad FROM parts JOIN marked
        ON try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[./]|$)', 1), '') AS BIGINT) = doc_id),
n AS (SELECT count(*) AS n, greatest(5, ceil(0.002 * count(*)))::BIGINT AS least FROM lab),
lt AS (SELECT tok.page_id, tok.url, bad, t FROM tok JOIN lab USING (page_id, url)),
sets AS (
  SELECT page_id, url, bad, [t] AS s FROM lt
  UNION ALL SELECT a.page_id, a.url, a.bad, [a.t, b.t] FROM lt a JOIN lt b
    ON a.page_id = b.page_id AND a.url = b.url AND a.t < b.t
  UNION ALL SELECT a.page_id, a.url, a.bad, [a.t, b.t, c.t] FROM lt a JOIN lt b
    ON a.page_id = b.page_id AND a.url = b.url AND a.t < b.t
    JOIN lt c ON a.page_id = c.page_id AND a.url = c.url AND b.t < c.t),
rules AS (SELECT s, count(*) FILTER (bad) AS support, count(*) FILTER (bad)::DOUBLE / count(*) AS confidence FROM sets, n
          GROUP BY s, least HAVING count(*) FILTER (bad) >= least AND count(*) FILTER (bad)::DOUBLE / count(*) >= 0.5),
have AS (SELECT page_id, url, list(t) AS ts FROM tok GROUP BY ALL),
best AS (SELECT page_id, url, max(struct_pack(confidence := confidence, support := support,
                mined_rule := array_to_string(s, ' '))) AS best
         FROM have JOIN rules ON list_has_all(ts, s) GROUP BY ALL),
fixed AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT f.page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN best.best IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  best.best.mined_rule AS mined_rule, best.best.confidence AS confidence, best.best.support AS support
FROM fixed f LEFT JOIN best ON f.page_id IS NOT DISTINCT FROM best.page_id AND f.url = best.url"""


def _repetition() -> str:
    """The base counts and the method's shares from whole window lists; shares are weighed by bytes, as in the operator."""
    limits = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
    spans = "\nUNION ALL ".join(
        f"SELECT doc_id, {n} AS n, {limit} AS most, pos, array_to_string(w[pos:pos + {n - 1}], ' ') AS g FROM "
        f"(SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS pos FROM w)" for n, limit in {3: 9.0, **limits}.items())
    return f"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+'), []) AS w, coalesce(text, '') AS text
           FROM documents),
g AS ({spans}),
m AS (SELECT doc_id, n, most, pos, count(*) OVER (PARTITION BY doc_id, n, g) > 1 AS twice,
             row_number() OVER (PARTITION BY doc_id, n, g ORDER BY pos) > 1 AS later FROM g),
c AS (SELECT DISTINCT doc_id, n, most, pos + unnest(range(0, n)) AS place FROM m WHERE CASE WHEN n = 3 THEN twice ELSE later END),
cov AS (SELECT doc_id, n, most, count(*) AS words, sum(octet_length(encode(w[place]))) AS bytes FROM c JOIN w USING (doc_id)
        GROUP BY ALL),
agg AS (SELECT doc_id, coalesce(sum(words) FILTER (n = 3), 0) AS n_repeat_words,
               coalesce(max(bytes / most) FILTER (n > 3), 0) AS worst FROM cov GROUP BY doc_id),
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) > 1 AS dup, length(line) AS chars FROM
      (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place
       FROM w) WHERE regexp_matches(line, '[^ \\t\\n\\v\\f\\r]')),
ls AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, count(*) AS n, sum(chars) AS chars,
              coalesce(sum(chars) FILTER (dup), 0) AS dup_chars FROM l GROUP BY doc_id),
b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             octet_length(encode(array_to_string(w, ''))) AS word_bytes,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
j AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(worst, 0) AS worst, coalesce(n, 1) AS n, coalesce(chars, 1) AS chars, coalesce(dup_chars, 0) AS dup_chars
      FROM b LEFT JOIN agg USING (doc_id) LEFT JOIN ls USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND worst / greatest(1, word_bytes) <= 1 AND n_dup_lines <= 0.5 * n AND dup_chars <= 0.4 * chars AS kept
FROM f"""


def _archives() -> str:
    return """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN f.first IS NOT NULL AND f.first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS DISTINCT FROM page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""

def _importance() -> str:
    """Words by pattern; the CRC-32 of each distinct word byte by byte over a table that a rule gives."""
    return f"""
WITH bits AS (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
texts AS (SELECT true AS source, row_number() OVER () AS row, doc_id, text FROM documents
          UNION ALL SELECT false, 0, null, text FROM benchmark),
w AS (SELECT source, row, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM texts),
one AS (SELECT source, row, unnest(w) AS word FROM w),
kinds AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM one)),
hashed AS (SELECT word, xor(list_reduce([4294967295::UBIGINT] || [('0x' || h[2 * i + 1:2 * i + 2])::UBIGINT for i in range(len(h) // 2)],
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket FROM kinds, tab),
c AS (SELECT bucket, count(*) FILTER (source) AS s, count(*) FILTER (NOT source) AS t FROM one JOIN hashed USING (word) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM c),
g AS (SELECT bucket, floor(1000 * ln((c.t + 1)::DOUBLE * (total.s + 10000) / ((c.s + 1)::DOUBLE * (total.t + 10000)))) AS gain FROM c, total),
f AS (SELECT row, count(*) AS n, sum(gain) AS gain FROM one JOIN hashed USING (word) JOIN g USING (bucket) WHERE source GROUP BY row),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN floor(gain / n) ELSE 0 END::BIGINT AS weight,
             ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
      FROM w LEFT JOIN f USING (row) WHERE source),
s AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
             10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS most FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= most THEN place END AS rank FROM r"""


SQL = {"op12_importance": _importance(), "op6_archives": _archives(), "op1_url_rules": _urls(), "op7_repetition": _repetition(), "op10_licences": _licences()}
