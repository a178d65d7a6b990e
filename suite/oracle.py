"""SQL equivalents of the registered queries, for an independent engine on the same tables.

Statistics are restated from the raw tables; the decisions are restated on top
of them as SQL.
"""

from __future__ import annotations

from plumbline.functions import vocab

SQL: dict[str, str] = {}

# --- inputs -------------------------------------------------------------------

INT, NUM, TEXT, STAMP, OTHER = "int", "num", "text", "stamp", "other"

COLUMNS = {
    "region": [("r_regionkey", INT), ("r_name", TEXT)],
    "nation": [("n_nationkey", INT), ("n_name", TEXT), ("n_regionkey", INT)],
    "customer": [("c_custkey", INT), ("c_name", TEXT), ("c_nationkey", INT), ("c_acctbal", NUM), ("c_mktsegment", TEXT)],
    "supplier": [("s_suppkey", INT), ("s_name", TEXT), ("s_nationkey", INT), ("s_acctbal", NUM)],
    "part": [("p_partkey", INT), ("p_name", TEXT), ("p_brand", TEXT), ("p_type", TEXT), ("p_size", INT),
             ("p_retailprice", NUM)],
    "orders": [("o_orderkey", INT), ("o_custkey", INT), ("o_orderstatus", TEXT), ("o_totalprice", NUM),
               ("o_orderdate", STAMP), ("o_orderpriority", TEXT)],
    "lineitem": [("l_orderkey", INT), ("l_partkey", INT), ("l_suppkey", INT), ("l_linenumber", INT),
                 ("l_quantity", NUM), ("l_extendedprice", NUM), ("l_discount", NUM), ("l_tax", NUM),
                 ("l_returnflag", TEXT), ("l_linestatus", TEXT), ("l_shipdate", STAMP)],
    "events": [("event_id", INT), ("ts", STAMP), ("user_id", INT), ("event_type", TEXT), ("value", NUM), ("props", TEXT)],
    "documents": [("doc_id", INT), ("text", TEXT), ("lang", TEXT), ("source", TEXT), ("n_chars", INT)],
    "embeddings": [("vec_id", INT), ("embedding", OTHER), ("label", INT)],
    "pages": [("page_id", INT), ("url", TEXT), ("html", TEXT)],
    "benchmark": [("item_id", INT), ("text", TEXT)],
    "labels": [("doc_id", INT), ("quality", INT), ("toxic", INT)],
    "conversations": [("conv_id", INT), ("turn", INT), ("role", TEXT), ("text", TEXT)],
}

_LINES = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_orderkey % 13 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount, l_tax,
  CASE WHEN l_partkey % 17 <> 0 THEN l_returnflag END AS l_returnflag, l_linestatus, l_shipdate FROM lineitem"""
DIRTY_LINES = f"{_LINES} UNION ALL {_LINES} WHERE l_orderkey % 20 = 0"
_EVENTS = """SELECT hour(ts)::INTEGER AS hour, user_id, CASE WHEN event_id % 19 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 11 <> 0 THEN value END AS value, ts FROM events"""
DIRTY_EVENTS = f"{_EVENTS} UNION ALL {_EVENTS} WHERE event_id % 25 = 0"
DIRTY_EVENT_COLUMNS = [("hour", INT), ("user_id", INT), ("event_type", TEXT), ("value", NUM), ("ts", STAMP)]
REPEATED_ORDERS = "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 20 = 0"
PRICED = """SELECT *, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 + l_tax) AS gross,
  l_extendedprice * 2 AS twice FROM lineitem"""
PRICED_COLUMNS = COLUMNS["lineitem"] + [("net", NUM), ("gross", NUM), ("twice", NUM)]
LABELLED = """SELECT doc_id, lang, source, n_chars, quality, toxic
  FROM labels JOIN (SELECT doc_id, lang, source, n_chars FROM documents) USING (doc_id)"""
LABELLED_COLUMNS = [("doc_id", INT), ("lang", TEXT), ("source", TEXT), ("n_chars", INT), ("quality", INT), ("toxic", INT)]


def _without(columns, *names):
    return [c for c in columns if c[0] not in names]


# --- statistics ---------------------------------------------------------------


def facts(src: str, columns, by: str | None = None, name: str = "facts") -> str:
    """CTEs ending in ``name``: one row per column (and slice) of the relation ``src``."""
    key = "slice, " if by else ""
    first = f"{by} AS slice, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    rows = []
    for i, (c, kind) in enumerate(columns):
        counts = (
            f"{i}::INTEGER AS ordinal, '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS n_null, "
            f"count({c}) AS n, count(DISTINCT {c}) AS nunique")
        if kind in (INT, NUM):
            stats = (
                f"'numeric' AS role, true AS is_numeric, avg({c}::DOUBLE) AS mean, stddev_samp({c}::DOUBLE) AS std, "
                f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, (max({c}) - min({c}))::DOUBLE AS span, "
                f"coalesce(bool_and({c} % 1 = 0), false) AS all_whole, quantile_cont({c}::DOUBLE, 0.25) AS q1, "
                f"quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q3")
        else:
            role = {TEXT: "categorical", STAMP: "datetime", OTHER: "unsupported"}[kind]
            none = ", ".join(f"NULL::DOUBLE AS {k}" for k in ("mean", "std", "min", "max", "span"))
            stats = (
                f"'{role}' AS role, false AS is_numeric, {none}, false AS all_whole, NULL::DOUBLE AS q1, "
                "NULL::DOUBLE AS median, NULL::DOUBLE AS q3")
        rows.append(f"SELECT {first}{counts}, {stats} FROM {src}{group}")
    outside = []
    for i, (c, kind) in enumerate(columns):
        if kind in (INT, NUM):
            same = f" AND f.slice = s.{by}" if by else ""
            outside.append(
                f"SELECT {'f.slice, ' if by else ''}{i} AS ordinal, "
                f"count(CASE WHEN s.{c} < f.lower OR s.{c} > f.upper THEN 1 END) AS outliers "
                f"FROM {src} s JOIN {name}_1 f ON f.ordinal = {i}{same} WHERE f.lower IS NOT NULL"
                f"{' GROUP BY f.slice' if by else ' HAVING count(*) > 0'}")
    union = " UNION ALL ".join
    none = f"SELECT {'NULL AS slice, ' if by else ''}NULL::INTEGER AS ordinal, NULL::BIGINT AS outliers WHERE false"
    return (
        f"{name}_0 AS ({union(rows)}), "
        f"{name}_1 AS (SELECT *, CASE WHEN nunique > 2 THEN q1 - 1.5 * (q3 - q1) END AS lower, "
        f"CASE WHEN nunique > 2 THEN q3 + 1.5 * (q3 - q1) END AS upper FROM {name}_0), "
        f"{name}_2 AS ({union(outside) if outside else none}), "
        f"{name} AS (SELECT f.*, o.outliers FROM {name}_1 f LEFT JOIN {name}_2 o USING ({key}ordinal))")


def r4(*names: str) -> str:
    return ", ".join(f"round({n}, 4) AS {n}" for n in names)


def each(tables, make, tag: str = "table_name") -> str:
    """UNION ALL of one statement per table, tagged with its name."""
    return " UNION ALL ".join(f"SELECT *, '{t}' AS {tag} FROM ({make(t)})" for t in tables)


def _clean_r(expr: str) -> str:
    return f"CASE WHEN NOT isnan({expr}) THEN {expr} END"


def pairs_sql(src: str, columns, by: str | None = None) -> str:
    """(slice?, i, j, a, b, n, r) for all numeric pairs of a relation."""
    nums = [(i, c) for i, (c, k) in enumerate(columns) if k in (INT, NUM)]
    first, group = (f"{by} AS slice, ", f" GROUP BY {by}") if by else ("", "")
    rows = []
    for x, (i, a) in enumerate(nums):
        for j, b in nums[x + 1 :]:
            r = f"corr({a}::DOUBLE, {b}::DOUBLE)"
            rows.append(
                f"SELECT {first}{i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, "
                f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, {_clean_r(r)} AS r FROM {src}{group}")
    return " UNION ALL ".join(rows)


SQL["table_shape_all"] = " UNION ALL ".join(
    f"SELECT count(*) AS \"rows\", {len(cols)}::BIGINT AS columns, '{t}' AS table_name FROM {t}"
    for t, cols in COLUMNS.items())

SQL["null_profile"] = f"""WITH src AS ({DIRTY_LINES}), {facts('src', COLUMNS['lineitem'])}
SELECT "column", n_null, round(n_null / "rows" * 100, 2) AS null_pct FROM facts WHERE n_null > 0"""

_SUMMARY = f"\"column\", n, nunique, {r4('mean', 'median', 'std', 'min', 'max')}"
SQL["numeric_summary"] = f"""WITH {facts('lineitem', COLUMNS['lineitem'])}
SELECT {_SUMMARY} FROM facts WHERE role = 'numeric'"""

SQL["numeric_summary_by_slice"] = f"""WITH {facts('lineitem', _without(COLUMNS['lineitem'], 'l_returnflag'), 'l_returnflag')}
SELECT slice, {_SUMMARY} FROM facts WHERE role = 'numeric'"""

SQL["column_facts"] = f"""WITH src AS ({DIRTY_LINES}), {facts('src', COLUMNS['lineitem'])}
SELECT ordinal, "column", role, is_numeric, "rows", n_null, n, nunique, all_whole, outliers,
  {r4('mean', 'std', 'min', 'max', 'span', 'q1', 'median', 'q3', 'lower', 'upper')} FROM facts"""

_FENCES = "\"column\", outliers, round(lower, 4) AS lower_bound, round(upper, 4) AS upper_bound"
SQL["iqr_outliers"] = f"""WITH {facts('events', COLUMNS['events'])}
SELECT {_FENCES} FROM facts WHERE role = 'numeric' AND nunique > 2"""

SQL["iqr_outliers_by_type"] = f"""WITH {facts('events', _without(COLUMNS['events'], 'event_type', 'props'), 'event_type')}
SELECT slice, {_FENCES} FROM facts WHERE role = 'numeric' AND nunique > 2"""

SQL["uniqueness_ratio"] = each(
    ("customer", "documents"),
    lambda t: f"WITH {facts(t, COLUMNS[t])} SELECT \"column\", nunique, round(nunique / \"rows\", 4) AS uniqueness FROM facts")


def _counts(src: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM {src} "
        f"WHERE {c} IS NOT NULL GROUP BY {c}" for i, c in columns)


def _texts(table: str):
    return [(i, c) for i, (c, k) in enumerate(COLUMNS[table]) if k == TEXT]


def top_sql(src: str, columns, top: int = vocab.TOP_VALUES) -> str:
    return f"""SELECT "column", value, n, rk::INTEGER AS rk, nunique, nunique > {top} AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY n DESC, value) AS rk,
    count(*) OVER (PARTITION BY ordinal) AS nunique FROM ({_counts(src, columns)})) WHERE rk <= {top}"""


SQL["top_values"] = each(("part", "orders", "events"), lambda t: top_sql(t, _texts(t)))

_DUP = """SELECT {key}sum(n)::BIGINT AS "rows", (sum(n) - count(*))::BIGINT AS duplicates, count(*) AS distinct_rows
FROM (SELECT count(*) AS n{extra} FROM ({src}) GROUP BY {cols}){group}"""


def dup_sql(src: str, columns, by: str | None = None) -> str:
    return _DUP.format(
        key="slice, " if by else "", extra=f", {by} AS slice" if by else "", src=src,
        cols=", ".join(c for c, _ in columns), group=" GROUP BY slice" if by else "")


SQL["duplicate_rows"] = dup_sql(REPEATED_ORDERS, COLUMNS["orders"])
SQL["duplicate_rows_by_slice"] = dup_sql(REPEATED_ORDERS, COLUMNS["orders"], "o_orderstatus")

SQL["corr_pairs"] = f"SELECT a, b, n, round(r, 4) AS r FROM ({pairs_sql('lineitem', COLUMNS['lineitem'])})"
SQL["corr_pairs_nulls"] = f"""WITH src AS (SELECT *, 7.0::DOUBLE AS fixed FROM ({DIRTY_LINES}))
SELECT a, b, n, CASE WHEN b <> 'fixed' THEN round(r, 4) END AS r
FROM ({pairs_sql('src', COLUMNS['lineitem'] + [('fixed', NUM)])})"""
SQL["corr_pairs_by_slice"] = f"""SELECT slice, a, b, n, round(r, 4) AS r
FROM ({pairs_sql('lineitem', COLUMNS['lineitem'], 'l_returnflag')})"""
_LINE_PAIRS = f"SELECT a, b, round(r, 4) AS r FROM ({pairs_sql('lineitem', COLUMNS['lineitem'])})"
SQL["correlation_matrix"] = f"""WITH half AS ({_LINE_PAIRS}) SELECT a, b, r FROM half UNION ALL SELECT b, a, r FROM half
UNION ALL SELECT c, c, 1.0::DOUBLE FROM (SELECT a AS c FROM half UNION SELECT b FROM half)"""
SQL["top_corr_pairs"] = f"""WITH src AS ({PRICED})
SELECT a, b, round(r, 4) AS r FROM ({pairs_sql('src', PRICED_COLUMNS)}) WHERE r IS NOT NULL
ORDER BY round(abs(r), 9) DESC, i, j LIMIT {vocab.MAX_SCATTERS}"""
SQL["strong_corr_pairs"] = f"""WITH src AS ({PRICED})
SELECT a, b, round(r4, 2) AS r FROM (SELECT *, round(r, 4) AS r4 FROM ({pairs_sql('src', PRICED_COLUMNS)}))
WHERE abs(r4) >= {vocab.STRONG_PAIR_R} ORDER BY abs(round(r4, 2)) DESC, i, j LIMIT {vocab.STRONG_PAIR_LIMIT}"""

_DATE_TEXT = (
    ("iso", "yyyy-M-d", "strftime(o_orderdate, '%Y-%m-%d')", "%Y-%m-%d"),
    ("us", "M/d/yyyy", "strftime(o_orderdate, '%m/%d/%Y')", "%m/%d/%Y"),
    ("dashed", "d-MMM-yyyy", "strftime(o_orderdate, '%d-%b-%Y')", "%d-%b-%Y"),
    ("stamped", "yyyy/M/d H:m:s", "strftime(o_orderdate, '%Y/%m/%d %H:%M:%S')", "%Y/%m/%d %H:%M:%S"),
)
SQL["datetime_profile"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS "column", '{fmt}' AS format, strftime(min(t), '%Y-%m-%d') AS min_date,
  strftime(max(t), '%Y-%m-%d') AS max_date, count(DISTINCT year(t)) AS distinct_years,
  count(DISTINCT month(t)) AS distinct_months, count(DISTINCT day(t)) AS distinct_days
FROM (SELECT {expr} AS t FROM orders)"""
    for name, fmt, expr in [(n, f, f"strptime({text}, '{p}')") for n, f, text, p in _DATE_TEXT]
    + [("o_orderdate", "native", "o_orderdate")])


# Each listed format as DuckDB writes it, in the order in which they are tried.
_WRITTEN = (
    ("yyyy-M-d", "%Y-%-m-%-d"), ("yyyy/M/d", "%Y/%-m/%-d"), ("yyyy-M-d H:m:s", "%Y-%-m-%-d %-H:%-M:%-S"),
    ("yyyy/M/d H:m:s", "%Y/%-m/%-d %-H:%-M:%-S"), ("M/d/yyyy", "%-m/%-d/%Y"), ("d/M/yyyy", "%-d/%-m/%Y"),
    ("M-d-yyyy", "%-m-%-d-%Y"), ("d-M-yyyy", "%-d-%-m-%Y"), ("M/d/yyyy H:m:s", "%-m/%-d/%Y %-H:%-M:%-S"),
    ("d/M/yyyy H:m:s", "%-d/%-m/%Y %-H:%-M:%-S"), ("d-MMM-yyyy", "%-d-%b-%Y"), ("MMM d, yyyy", "%b %-d, %Y"), ("yyyyMMdd", "%Y%m%d"),
)
_RANGE = ("strftime(min(t), '%Y-%m-%d') AS min_date, strftime(max(t), '%Y-%m-%d') AS max_date, count(DISTINCT year(t)) AS distinct_years, "
          "count(DISTINCT month(t)) AS distinct_months, count(DISTINCT day(t)) AS distinct_days")
SQL["datetime_formats"] = "WITH o AS (SELECT *, o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS s FROM orders) " + " UNION ALL ".join(
    f"""SELECT 'd{i:02}' AS "column", '{fmt}' AS format, {_RANGE} FROM (SELECT try_strptime(CASE WHEN o_orderkey % 20 = 0 THEN '?'
  WHEN o_orderkey % 23 <> 0 THEN strftime(s, '{p}') END, '{p}') AS t FROM o)""" for i, (fmt, p) in enumerate(_WRITTEN)
) + f""" UNION ALL SELECT 'either', 'free', {_RANGE} FROM (SELECT o_orderdate AS t FROM orders)"""


def _shape(c: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (f"CASE WHEN length(trim({c}, ' ')) <= 100 THEN translate({c}, '0123456789{lower}{upper}', '{'9' * 10}{'a' * 52}') "
            f"ELSE '(long)' END")


SQL["date_shapes"] = each(("orders", "customer", "pages", "events"), lambda t: " UNION ALL ".join(
    f"""SELECT {i}::INTEGER AS ordinal, '{c}' AS "column", {_shape(c)} AS shape, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 3"""
    for i, (c, k) in enumerate(COLUMNS[t]) if k == TEXT))
# The two written dates and what can read them; no other text column of orders has a date's shape.
SQL["date_format_bounds"] = """SELECT 'european' AS "column", unnest(['M/d/yyyy', 'd/M/yyyy']) AS format, 1.0::DOUBLE AS most
UNION ALL SELECT 'packed', 'yyyyMMdd', 1.0"""


def mode_sql(t: str) -> str:
    def one(c: str, kind: str) -> str:
        text = f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if kind == STAMP else f"{c}::VARCHAR"
        return (f"SELECT * FROM (SELECT '{c}' AS \"column\", {text} AS value, count(*) AS n FROM {t} "
                f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)")

    return " UNION ALL ".join(one(c, k) for c, k in COLUMNS[t] if k != OTHER)


SQL["mode_values"] = each(("orders", "labels", "lineitem"), mode_sql)


def balance_sql(src: str, *names: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS classes, min(n) AS minority, max(n) AS majority,
  sum(n)::BIGINT AS total, round(min(n) / max(n), 4) AS ratio, round(min(n) / sum(n), 4) AS minority_share
FROM (SELECT count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY {c})""" for c in names)


SQL["class_balance"] = f"{balance_sql('orders', 'o_orderstatus', 'o_orderpriority')} UNION ALL " \
                       f"{balance_sql('labels', 'quality', 'toxic')}"

SQL["skew_cv"] = each(
    ("events", "lineitem"),
    lambda t: f"""WITH {facts(t, COLUMNS[t])} SELECT "column", round(abs(mean - median) / std, 4) AS skew,
  round(abs(std / mean), 4) AS cv FROM facts WHERE role = 'numeric'""")

SQL["table_totals"] = f"""WITH src AS ({DIRTY_EVENTS}), {facts('src', DIRTY_EVENT_COLUMNS)}
SELECT max("rows") AS "rows", count(*) AS columns, sum(n_null)::BIGINT AS missing_cells,
  coalesce(sum(outliers), 0)::BIGINT AS outliers FROM facts"""

# --- roles --------------------------------------------------------------------


def _words(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TOKENS = "regexp_extract_all(lower(trim({c})), '[a-z0-9]+')"

SQL["name_tokens"] = f"""SELECT p_partkey, array_to_string(tokens, ' ') AS tokens,
  list_has_any(tokens, ['red', 'ring', 'widget']) AS hit, regexp_replace(p_name, '[^A-Za-z0-9_-]+', '_', 'g') AS safe
FROM (SELECT *, {_TOKENS.format(c='p_name')} AS tokens FROM part)"""


def roles(name: str = "facts", by: bool = False) -> str:
    """CTEs tagged, cand, choice on top of a facts CTE."""
    key = "slice, " if by else ""
    tok = _TOKENS.format(c='"column"')
    return f"""tagged AS (
  SELECT *, list_has_any(tokens, {_words(vocab.STRONG_TARGET_WORDS)}) AS strong,
    list_has_any(tokens, {_words(vocab.METRIC_WORDS)}) AS metric,
    list_has_any(tokens, {_words(vocab.FEATURE_WORDS)}) AS feature,
    list_has_any(tokens, {_words(vocab.IDENTIFIER_WORDS)}) AS id_word,
    coalesce(role = 'numeric' AND n >= 2 AND all_whole AND nunique = n AND span = n - 1, false) AS running,
    coalesce(NOT is_numeric AND role <> 'unsupported' AND nunique / "rows" > 0.8, false) AS near_unique
  FROM (SELECT *, {tok} AS tokens FROM {name})),
flags AS (SELECT *, id_word OR running OR near_unique AS is_id, nunique / n AS ratio,
    CASE WHEN NOT is_numeric OR nunique <= 10 OR (nunique <= 20 AND nunique / n < 0.05) THEN 'classification'
      ELSE 'regression' END AS kind FROM tagged),
parts AS (SELECT *,
    CASE WHEN strong THEN 55 WHEN is_numeric AND metric THEN 30 ELSE 0 END AS p1,
    CASE WHEN feature THEN -30 ELSE 0 END AS p2,
    CASE WHEN kind = 'regression' THEN 35 + CASE WHEN ratio >= 0.5 THEN 15 WHEN ratio >= 0.2 THEN 8 ELSE 0 END
      WHEN nunique = 2 THEN 40 WHEN nunique <= 20 THEN 25 ELSE 5 END AS p3,
    CASE WHEN NOT is_numeric AND ratio > 0.5 THEN -40 ELSE 0 END AS p4
  FROM flags WHERE role <> 'unsupported' AND NOT is_id AND nunique > 1),
scored AS (SELECT *, least(greatest(p1 + p2 + p3 + p4, 0), 100)::INTEGER AS score, concat_ws('; ',
    CASE WHEN strong THEN 'name ''' || "column" || ''' matches a common target/label convention'
      WHEN is_numeric AND metric THEN 'name ''' || "column" || ''' is a business metric you''d typically predict' END,
    CASE WHEN feature THEN 'name ''' || "column" ||
      ''' looks like a descriptive feature (geography/time/contact), not a target' END,
    CASE WHEN kind = 'regression' THEN 'continuous numeric with ' || nunique || ' distinct values'
      WHEN nunique = 2 THEN 'binary column -- a natural classification target'
      WHEN nunique <= 20 THEN 'low-cardinality categorical (' || nunique || ' classes)'
      ELSE 'high-cardinality categorical (' || nunique || ' values) -- weak as a target' END,
    CASE WHEN NOT is_numeric AND ratio > 0.5 THEN 'values are nearly all distinct (' ||
      round(ratio * 100)::INTEGER || '% unique) -- reads as free text, not a label' END) AS why FROM parts),
cand AS (SELECT *, upper(why[1]) || why[2:] AS reason FROM scored),
pool AS (SELECT f.*, c.score, c.reason FROM flags f LEFT JOIN cand c USING ({key}ordinal))"""


def candidates_sql(t: str) -> str:
    return f"""WITH {facts(t, COLUMNS[t])}, {roles()}
SELECT row_number() OVER (ORDER BY score DESC, ordinal)::INTEGER AS rank, "column", kind AS type, score,
  round(score / 100, 2) AS confidence, reason FROM cand"""


SQL["identifier_columns"] = each(
    ("events", "customer", "documents", "lineitem", "orders", "part"),
    lambda t: f"""WITH {facts(t, COLUMNS[t])}, {roles()} SELECT ordinal, "column",
  CASE WHEN id_word THEN 'name' WHEN running THEN 'sequence' ELSE 'uniqueness' END AS why FROM flags WHERE is_id""")
SQL["target_candidates"] = each(("events", "lineitem", "customer", "labels"), candidates_sql)
SQL["target_candidates_by_slice"] = f"""
WITH {facts('events', _without(COLUMNS['events'], 'event_type'), 'event_type')}, {roles(by=True)}
SELECT slice, row_number() OVER (PARTITION BY slice ORDER BY score DESC, ordinal)::INTEGER AS rank, "column",
  kind AS type, score, round(score / 100, 2) AS confidence, reason FROM cand"""

_INFERRED = ("'Target inferred automatically based on dataset characteristics: ''' || \"column\" || ''' (confidence ' || "
             "printf('%.2f', score / 100) || ') -- ' || reason || '.'")


def choice_sql(t: str) -> str:
    return f"""WITH {facts(t, COLUMNS[t])}, {roles()},
pick AS (SELECT * FROM pool WHERE strong OR score IS NOT NULL
  ORDER BY strong DESC, coalesce(score, -1) DESC, ordinal LIMIT 1)
SELECT CASE WHEN strong OR score >= 15 THEN "column" END AS target,
  CASE WHEN strong OR score >= 15 THEN round(coalesce(score, 0) / 100, 2) END AS confidence,
  (SELECT count(*) FROM cand) AS candidates, {_INFERRED} AS reasoning FROM pick"""


SQL["target_choice"] = each(("events", "lineitem", "customer", "orders", "labels", "part"), choice_sql)


def _problem(t: str, target: str) -> str:
    return f"""SELECT kind AS problem_type, '{t}.{target}' AS target FROM (
  WITH {facts(t, COLUMNS[t])}, {roles()} SELECT kind FROM flags WHERE "column" = '{target}')"""


SQL["problem_types"] = " UNION ALL ".join([
    _problem("events", "value"), _problem("labels", "quality"), _problem("lineitem", "l_linestatus"),
    _problem("lineitem", "l_tax"), _problem("lineitem", "l_quantity"),
    "(SELECT 'unknown' AS problem_type, 'orders.None' AS target FROM orders LIMIT 1)"])

# --- validity and quality -----------------------------------------------------

_FEW = "After removing duplicate rows, fewer than 2 unique rows remain -- not enough data to analyze."
_NO_FEATURES = ("No usable feature columns remain: every column looks like an identifier (unique IDs, names, or free "
                "text) or the target. There is nothing for a model to learn from.")
_NO_TARGET = ("No clear target column was detected. The dataset will be analyzed for exploratory insights and clustering "
              "rather than supervised prediction.")


def validity_sql(case: str, src: str, columns, target: str | None) -> str:
    tgt = f"'{target}'" if target else "NULL"
    return f"""SELECT '{case}' AS "case", errors = '' AS valid, errors, warnings, duplicate_percentage FROM (
WITH src AS ({src}), {facts('src', columns)}, {roles()}, dup AS ({dup_sql('SELECT * FROM src', columns)}),
feat AS (SELECT count(*) AS k FROM flags WHERE NOT is_id AND "column" IS DISTINCT FROM {tgt}),
bad AS (SELECT max(CASE WHEN n = 0 THEN 'Target column ''' || "column" || ''' is entirely missing/null.'
    WHEN nunique <= 1 THEN 'Target column ''' || "column" || ''' contains only ' || nunique || ' unique value(s) in ' ||
    n || ' non-null row(s). A predictive model cannot learn from a single-class target.' END) AS e
  FROM flags WHERE "column" = {tgt})
SELECT concat_ws(' | ', CASE WHEN "rows" = 0 THEN 'The uploaded file has no data rows.' END,
    CASE WHEN "rows" > 0 AND distinct_rows < 2 THEN '{_FEW}' END, e, CASE WHEN k = 0 THEN '{_NO_FEATURES}' END) AS errors,
  concat_ws(' | ', CASE WHEN pct >= 20 THEN printf('%.1f', round(pct, 1)) || '% of rows (' || duplicates ||
      ') are exact duplicates; they will be removed during cleaning.' END,
    CASE WHEN "rows" > 0 AND "rows" < 5 THEN 'Only ' || "rows" ||
      ' rows -- too little data for a reliable model recommendation; treat results as illustrative only.' END,
    CASE WHEN {tgt} IS NULL AND k > 0 THEN '{_NO_TARGET}' END) AS warnings, pct AS duplicate_percentage
FROM (SELECT *, round(duplicates / "rows" * 100, 2) AS pct FROM dup), feat, bad)"""


SQL["validity_report"] = " UNION ALL ".join([
    validity_sql("events", "SELECT * FROM events", COLUMNS["events"], "value"),
    validity_sql("constant", "SELECT *, 0 AS target FROM events", COLUMNS["events"] + [("target", INT)], "target"),
    validity_sql("repeated", "SELECT o_orderstatus, o_orderpriority FROM orders",
                 [("o_orderstatus", TEXT), ("o_orderpriority", TEXT)], "o_orderstatus"),
    validity_sql("keys", "SELECT c_custkey, c_name FROM customer", [("c_custkey", INT), ("c_name", TEXT)], None),
    validity_sql("untargeted", "SELECT o_orderpriority, o_totalprice FROM orders",
                 [("o_orderpriority", TEXT), ("o_totalprice", NUM)], None),
])


def quality_sql(src: str, columns, target: str | None, ids) -> str:
    """CTEs ending in ``score``: shares, components and score; ``src`` becomes a CTE of that name.

    Without a categorical target the class balance counts as perfect.
    """
    listed = ", ".join(f"'{i}'" for i in ids) or "''"
    bal = balance_sql("src", target) if target else "SELECT 1 AS minority, 1 AS majority, 1 AS total"
    return f"""src AS ({src}), {facts('src', columns)}, dup AS ({dup_sql('SELECT * FROM src', columns)}),
bal AS ({bal}),
raw AS (SELECT max(f."rows") AS nrows, count(*) AS ncols, sum(n_null) AS missing, coalesce(sum(outliers), 0) AS outs,
  count(*) FILTER (WHERE role = 'numeric' AND nunique > 2) AS eligible,
  count(*) FILTER (WHERE NOT ("column" IN ({listed}) OR (role = 'categorical' AND nunique <= 1)
    OR (role = 'numeric' AND coalesce(min = max, false)))) AS usable FROM facts f),
shares AS (SELECT raw.*, dup.duplicates, missing / (nrows * ncols) AS miss, duplicates / nrows AS rep,
  coalesce(outs / nullif(nrows * eligible, 0), 0) AS outside, usable / ncols AS feat,
  bal.minority / bal.majority AS ratio, bal.minority / bal.total AS least_share FROM raw, dup, bal),
parts AS (SELECT *, greatest(0, 1 - miss) AS s1, greatest(0, 1 - rep) AS s2, greatest(0, 1 - outside) AS s3, feat AS s4,
  least(1, ratio / 0.2) AS s5 FROM shares),
score AS (SELECT *, round_even(100 * (s1 * 0.3 + s2 * 0.2 + s3 * 0.2 + s4 * 0.2 + s5 * 0.1)::DOUBLE, 0)::INTEGER
  AS quality_score FROM parts)"""


_BAD_ROWS = f"""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, source, n_chars, quality,
  CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS toxic, NULL::VARCHAR AS blank, 1 AS fixed FROM ({LABELLED})"""
_BAD = f"{_BAD_ROWS} UNION ALL {_BAD_ROWS} WHERE doc_id % 5 = 0"
_BAD_COLUMNS = [("doc_id", INT), ("lang", TEXT), ("source", TEXT), ("n_chars", INT), ("quality", INT), ("toxic", TEXT),
                ("blank", TEXT), ("fixed", INT)]
_DIRTY_SCORE = quality_sql(DIRTY_LINES, COLUMNS["lineitem"], "l_linestatus", ["l_orderkey"])
_BAD_SCORE = quality_sql(_BAD, _BAD_COLUMNS, "toxic", ["doc_id", "source"])


def band_sql(expr: str, bands, field: int = 1) -> str:
    cases = " ".join(f"WHEN {expr} >= {b[0]} THEN '{b[field]}'" for b in bands)
    return f"CASE {cases} END"


def _component_rows() -> str:
    texts = {
        "missing_values": "CASE WHEN s >= 50 THEN 'Only ' ELSE '' END || (100 - s) || '% of cells are missing.'",
        "duplicates": "(100 - s) || '% of rows are exact duplicates.'",
        "outliers": "(100 - s) || '% of numeric values fall outside the IQR fences.'",
        "feature_quality": "(100 - s) || '% of columns are identifiers or constant and carry no modeling signal.'",
        "class_balance": "CASE WHEN s < 100 THEN 'The minority class is underrepresented relative to the majority class.' "
                         "ELSE 'The target classes are well balanced.' END",
    }
    return " UNION ALL ".join(
        f"""SELECT {i + 1}::INTEGER AS ordinal, '{key}' AS component, '{label}' AS label, {weight}::DOUBLE AS weight,
  s AS score, {band_sql('s', vocab.COLOR_BANDS)} AS status_color, {texts[key]} AS explanation
FROM (SELECT round_even((100 * s{i + 1})::DOUBLE, 0)::INTEGER AS s FROM parts)"""
        for i, (key, weight, label) in enumerate(vocab.QUALITY_COMPONENTS))


SQL["quality_components"] = f"WITH {_DIRTY_SCORE} {_component_rows()}"

_CARDS = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in card) + ")" for card in vocab.ISSUE_CARDS)
SQL["quality_issues"] = f"""WITH {_BAD_SCORE}, issues AS (
SELECT 1 AS o, CASE WHEN miss > 0.05 THEN 'High missing values: ' || printf('%.1f', round(miss * 100, 1)) ||
  '% of all cells are empty.' END AS issue FROM shares
UNION ALL SELECT 2, CASE WHEN rep > 0.05 THEN 'Duplicate rows: ' || printf('%.1f', round(rep * 100, 1)) ||
  '% of rows (' || duplicates || ') are exact duplicates.' END FROM shares
UNION ALL SELECT 3, CASE WHEN outside > 0.05 THEN 'Outliers: ' || printf('%.1f', round(outside * 100, 1)) ||
  '% of numeric values fall outside the IQR fences.' END FROM shares
UNION ALL SELECT 4, CASE WHEN feat < 0.5 THEN 'Low feature quality: ' || (ncols - usable) || ' of ' || ncols ||
  ' columns are identifiers or constant and carry no modeling signal.' END FROM shares
UNION ALL SELECT 5, CASE WHEN ratio < 0.2 THEN 'Target imbalance: the smallest class of ''toxic'' is only ' ||
  printf('%.1f', round(least_share * 100, 1)) || '% of rows (minority/majority ratio ' || printf('%.2f', round(ratio, 2)) ||
  ').' END FROM shares),
cards(prefix, severity, impact, recommendation) AS (VALUES {_CARDS})
SELECT row_number() OVER (ORDER BY o)::INTEGER AS ordinal, issue, severity, impact, recommendation
FROM issues JOIN cards ON starts_with(issue, prefix || ':') WHERE issue IS NOT NULL"""

_BANDS = f"""quality_score, {band_sql('quality_score', vocab.STATUS_BANDS)} AS status,
  {band_sql('quality_score', vocab.STATUS_BANDS, 2)} AS status_detail,
  {band_sql('quality_score', vocab.HEALTH_BANDS)} AS health, {band_sql('quality_score', vocab.HEALTH_BANDS, 2)} AS health_detail,
  {band_sql('quality_score', vocab.READINESS_BANDS)} AS readiness,
  {band_sql('quality_score', vocab.READINESS_BANDS, 2)} AS readiness_detail"""
SQL["quality_bands"] = f"""SELECT * FROM (WITH {_DIRTY_SCORE} SELECT {_BANDS} FROM score)
UNION ALL SELECT * FROM (WITH {_BAD_SCORE} SELECT {_BANDS} FROM score)"""

# --- cleaning -----------------------------------------------------------------

SQL["plan_proposal"] = f"""WITH src AS ({DIRTY_LINES}), {facts('src', COLUMNS['lineitem'])}, {roles()},
dup AS ({dup_sql('SELECT * FROM src', COLUMNS['lineitem'])}), steps AS (
SELECT 1 AS o, ordinal AS p, 'missing_values' AS section, "column",
  CASE WHEN role = 'numeric' THEN 'median' ELSE 'mode' END AS action,
  printf('%.1f', round(n_null / "rows" * 100, 1)) || '% of values are missing.' AS reason
FROM flags WHERE n_null > 0 AND NOT is_id
UNION ALL SELECT 2, 0, 'duplicates', NULL, CASE WHEN duplicates > 0 THEN 'drop' ELSE 'keep' END,
  duplicates || ' exact duplicate rows.' FROM dup
UNION ALL SELECT 3, ordinal, 'outliers', "column", 'cap', outliers || ' values fall outside the IQR fences.'
FROM flags WHERE outliers > 0 AND NOT is_id
UNION ALL SELECT 4, ordinal, 'encoding', "column", 'one_hot', nunique || ' distinct values.' FROM flags
WHERE role = 'categorical' AND nunique BETWEEN 1 AND {vocab.MAX_CATEGORIES} AND nunique / "rows" <= 0.5 AND NOT is_id)
SELECT (row_number() OVER (ORDER BY o, p) - 1)::INTEGER AS ordinal, section, "column", action, reason,
  'high' AS confidence FROM steps"""


def _mode(src: str, c: str) -> str:
    return f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _median(src: str, c: str) -> str:
    return f"(SELECT quantile_cont({c}::DOUBLE, 0.5) FROM {src})"


def fence(src: str, c: str) -> str:
    """One row lo, hi: the IQR fences of a column."""
    return (f"SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, "
            f"quantile_cont({c}::DOUBLE, 0.75) AS b FROM {src})")


SQL["impute_median_mode"] = f"""WITH src AS ({DIRTY_LINES})
SELECT * REPLACE (coalesce(l_quantity, {_median('src', 'l_quantity')}) AS l_quantity,
    coalesce(l_returnflag, {_mode('src', 'l_returnflag')}) AS l_returnflag),
  (l_quantity IS NULL)::INTEGER AS l_quantity_missing, (l_returnflag IS NULL)::INTEGER AS l_returnflag_missing
FROM src"""

SQL["drop_rows_or_column"] = """WITH src AS (SELECT * EXCLUDE (l_discount),
  CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END AS l_discount FROM lineitem),
taxed AS (SELECT * REPLACE (CASE WHEN l_orderkey % 20 <> 0 THEN l_tax END AS l_tax) FROM src)
SELECT * EXCLUDE (l_discount) FROM taxed WHERE l_tax IS NOT NULL"""

SQL["dedupe_rows"] = f"SELECT DISTINCT * FROM ({REPEATED_ORDERS})"
SQL["dedupe_counts"] = f"""SELECT b."rows" AS rows_before, b.duplicates AS duplicates_before, a."rows" AS rows_after,
  a.duplicates AS duplicates_after, b."rows" - a."rows" AS removed
FROM ({dup_sql(REPEATED_ORDERS, COLUMNS['orders'])}) b,
  ({dup_sql(f'SELECT DISTINCT * FROM ({REPEATED_ORDERS})', COLUMNS['orders'])}) a"""

SQL["cap_outliers"] = f"""WITH f AS ({fence('events', 'value')})
SELECT * REPLACE (CASE WHEN value IS NOT NULL THEN least(greatest(value, (SELECT lo FROM f)), (SELECT hi FROM f)) END
  AS value) FROM events"""

SQL["remove_outliers"] = f"""WITH src AS (SELECT * REPLACE (CASE WHEN event_id % 11 <> 0 THEN value END AS value) FROM events),
f AS ({fence('src', 'value')})
SELECT src.* FROM src, f WHERE value IS NULL OR value BETWEEN lo AND hi"""

SQL["remove_two_columns_in_order"] = f"""WITH src AS (SELECT event_id, value, value * value AS squared FROM events),
f AS ({fence('src', 'value')}), one AS (SELECT src.* FROM src, f WHERE value BETWEEN lo AND hi),
g AS ({fence('one', 'squared')}) SELECT one.* FROM one, g WHERE squared BETWEEN lo AND hi"""


def one_hot_sql(c: str, values) -> str:
    return ", ".join(f"coalesce(({c} = '{v}')::INTEGER, 0) AS \"{c}_{v}\"" for v in values)


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SQL["one_hot_orders"] = f"""SELECT o_orderkey, o_totalprice, {one_hot_sql('o_orderpriority', _PRIORITIES)},
  {one_hot_sql('o_orderstatus', ('F', 'O', 'P'))} FROM orders"""

_TYPES = ("click", "error", "purchase", "signup", "view")


def event_clean_sql(target: bool) -> str:
    """CTEs ending in ``done``: the event plan; with ``target`` the value column is left alone."""
    value = "value" if target else f"coalesce(value, {_median('src', 'value')}) AS value"
    flag = "" if target else ", (value IS NULL)::INTEGER AS value_missing"
    capped = "value" if target else (
        "least(greatest(value, (SELECT lo FROM fv)), (SELECT hi FROM fv)) AS value")
    extra = "" if target else ", value_missing"
    return f"""dirty AS ({DIRTY_EVENTS}), src AS (SELECT * EXCLUDE (ts) FROM dirty),
filled AS (SELECT hour, user_id, coalesce(event_type, {_mode('src', 'event_type')}) AS event_type, {value},
  (event_type IS NULL)::INTEGER AS event_type_missing{flag} FROM src),
uniq AS (SELECT DISTINCT * FROM filled), fv AS ({fence('uniq', 'value')}), fu AS ({fence('uniq', 'user_id')}),
kept AS (SELECT hour, user_id, event_type, {capped}, event_type_missing{extra} FROM uniq, fu
  WHERE user_id IS NULL OR user_id BETWEEN lo AND hi),
done AS (SELECT hour, user_id, value, event_type_missing{extra}, {one_hot_sql('event_type', _TYPES)} FROM kept)"""


SQL["clean_full"] = f"WITH {event_clean_sql(False)} SELECT * FROM done"
SQL["snapshot_before_encoding"] = f"WITH {event_clean_sql(False)} SELECT * FROM kept"
SQL["target_protected_clean"] = f"WITH {event_clean_sql(True)} SELECT * FROM done"

SQL["leakage_flags"] = f"""WITH src AS ({PRICED}) SELECT "column", round(r, 4) AS r FROM (
  SELECT CASE WHEN a = 'l_extendedprice' THEN b ELSE a END AS "column", r
  FROM ({pairs_sql('src', PRICED_COLUMNS)}) WHERE 'l_extendedprice' IN (a, b)) WHERE abs(r) > {vocab.LEAKAGE_R}"""

_REMOVED = "(SELECT count(*) FROM filled) - (SELECT count(*) FROM uniq)"
SQL["action_log"] = f"""WITH {event_clean_sql(True)}
SELECT section, "column", requested, executed, removed::BIGINT AS rows_removed FROM (VALUES
 ('dropped_columns', 'ts', 'drop_column', 'drop_column', NULL),
 ('missing_values', 'value', 'median', '{vocab.TARGET_KEPT_LABEL}', NULL),
 ('missing_values', 'event_type', 'mode', 'mode', NULL),
 ('duplicates', NULL, 'drop', 'drop', {_REMOVED}),
 ('outliers', 'value', 'cap', '{vocab.TARGET_KEPT_LABEL}', NULL),
 ('outliers', 'hour', 'keep', 'keep', NULL),
 ('outliers', 'user_id', 'remove', 'remove', NULL),
 ('encoding', 'event_type', 'one_hot', 'one_hot', NULL),
 ('encoding', 'user_id', 'none', 'none', NULL)) t(section, "column", requested, executed, removed)"""

_CLEAN_COLUMNS = [("hour", INT), ("user_id", INT), ("value", NUM), ("event_type_missing", INT), ("value_missing", INT)] + [
    (f"event_type_{v}", INT) for v in _TYPES]
_COMPARED = f"""WITH {event_clean_sql(False)}, {facts('dirty', DIRTY_EVENT_COLUMNS, name='old')},
{facts('done', _CLEAN_COLUMNS, name='new')},
b AS (SELECT max("rows") AS n, sum(n_null) AS gaps, sum(outliers) AS outs,
  sum(n_null) FILTER (WHERE "column" IN ('value', 'event_type')) AS imputed FROM old),
a AS (SELECT max("rows") AS n, sum(n_null) AS gaps, sum(outliers) AS outs FROM new)"""


def _signed(d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN '+' ELSE '' END || ({d})"


SQL["before_after_table"] = f"""{_COMPARED}, t AS (
SELECT 1 AS ordinal, 'Rows' AS metric, b.n AS before, a.n AS after, NULL AS difference FROM a, b
UNION ALL SELECT 2, 'Missing values', b.gaps, a.gaps, NULL FROM a, b
UNION ALL SELECT 3, 'Outliers Detected', b.outs, a.outs, NULL FROM a, b
UNION ALL SELECT 4, 'Duplicate rows removed', {_REMOVED}, 0, '-' || ({_REMOVED}) FROM b
UNION ALL SELECT 5, 'Columns removed', 1, 0, '-1' FROM b
UNION ALL SELECT 6, 'Columns encoded', 1, 1, '0' FROM b
UNION ALL SELECT 7, 'Values imputed', imputed, 0, '-' || imputed FROM b)
SELECT ordinal::INTEGER AS ordinal, metric, before::BIGINT AS before, after::BIGINT AS after,
  coalesce(difference, {_signed('(after - before)::BIGINT')}) AS difference, ordinal = 3 AS informational FROM t"""

SQL["action_timeline"] = f"""SELECT stage::BIGINT AS stage, action, reason, confidence, confidence_percent
FROM (SELECT 1 FROM ({DIRTY_EVENTS}) LIMIT 1), (VALUES
 (1, 'Dropped column ''ts''', '{vocab.IDENTIFIER_REASON}', 'High', '95%'),
 (2, 'Filled missing values using median for ''value''',
  'Column ''value'' had missing values that needed handling before modeling.', 'Not specified', 'Not specified'),
 (2, 'Filled missing values using mode for ''event_type''', 'few gaps', 'high', '95%'),
 (3, 'Removed duplicate rows', 'Exact duplicate rows add no new information and can bias model training.', 'medium', '75%'),
 (4, 'Capped outliers to the IQR fence on ''value''', 'Values in ''value'' fell outside the IQR fences.',
  'Not specified', 'Not specified'),
 (4, 'Removed outlier rows on ''user_id''', 'Values in ''user_id'' fell outside the IQR fences.',
  'Not specified', 'Not specified'),
 (5, 'One-hot encoded ''event_type''', '''event_type'' is categorical; models need numeric input.',
  'Not specified', 'Not specified')) t(stage, action, reason, confidence, confidence_percent)"""

SQL["cleaning_summary"] = f"""{_COMPARED}
SELECT (b.n - a.n)::BIGINT AS rows_affected, 'event_type,hour,ts,user_id,value' AS columns_affected,
  5::INTEGER AS columns_affected_count, 9::BIGINT AS total_actions FROM a, b"""

# --- insights and charts ------------------------------------------------------

_CARD_COLUMNS = _without(DIRTY_EVENT_COLUMNS, "ts")


def _card(i: int, title: str, body: str) -> str:
    return f"SELECT {i}::INTEGER AS ordinal, '{title}' AS title, value, detail FROM ({body})"


SQL["insight_cards"] = f"""WITH src AS (SELECT * EXCLUDE (ts) FROM ({DIRTY_EVENTS})), {facts('src', _CARD_COLUMNS)},
kept AS (SELECT *, round(n_null / "rows" * 100, 2) AS pct, abs(round(std, 4) / round(mean, 4)) AS cov FROM facts
  WHERE "column" <> 'user_id'),
pairs AS (SELECT i, j, a, b, round(r, 4) AS r FROM ({pairs_sql('src', _CARD_COLUMNS)})),
top AS ({top_sql('src', [(2, 'event_type')])}),
spread AS (SELECT "column", min(n) / max(n) AS ratio, count(*) AS k FROM top GROUP BY "column")
""" + " UNION ALL ".join([
    _card(1, "Biggest Missing Column", """SELECT "column" AS value, pct || '% of values are missing.' AS detail FROM kept
  WHERE n_null > 0 ORDER BY pct DESC, ordinal LIMIT 1"""),
    _card(2, "Strongest Correlation", """SELECT a || ' & ' || b AS value, 'Correlation coefficient of ' ||
  printf('%.2f', round(r, 2)) || '.' AS detail FROM pairs WHERE 'user_id' NOT IN (a, b) AND abs(r) > 0
  ORDER BY abs(r) DESC, i, j LIMIT 1"""),
    _card(3, "Most Imbalanced Feature", """SELECT "column" AS value, 'Minority/majority ratio of ' ||
  printf('%.2f', round(ratio, 2)) || '.' AS detail FROM spread WHERE k >= 2 AND ratio < 1 ORDER BY ratio LIMIT 1"""),
    _card(4, "Highest Variance Feature", """SELECT "column" AS value, 'Coefficient of variation ' ||
  printf('%.2f', round(cov, 2)) || '.' AS detail FROM kept WHERE role = 'numeric' AND cov IS NOT NULL
  ORDER BY cov DESC, ordinal LIMIT 1"""),
    _card(5, "Most Important Numeric Feature", """SELECT CASE WHEN a = 'value' THEN b ELSE a END AS value, 'Correlates ' ||
  printf('%.2f', round(r, 2)) || ' with the target (proxy measure, not a trained importance score).' AS detail
  FROM pairs WHERE 'value' IN (a, b) AND 'user_id' NOT IN (a, b) AND abs(r) > 0 ORDER BY abs(r) DESC, i, j LIMIT 1"""),
    _card(6, "Most Unique Category", """SELECT "column" AS value, nunique || ' distinct values.' AS detail FROM kept
  WHERE role = 'categorical' ORDER BY nunique DESC, ordinal LIMIT 1"""),
    _card(7, "Largest Outlier Count", """SELECT "column" AS value, outliers || ' values fall outside the IQR fences.' AS detail
  FROM kept WHERE outliers > 0 ORDER BY outliers DESC, ordinal LIMIT 1"""),
])

SQL["dataset_overview"] = f"""WITH {facts('lineitem', COLUMNS['lineitem'])},
c AS (SELECT max("rows") AS n, count(*) AS k, count(*) FILTER (WHERE role = 'numeric') AS nums,
  count(*) FILTER (WHERE role IN ('categorical', 'datetime')) AS cats FROM facts)
SELECT 'lineitem' AS dataset_name, n AS "rows", k AS columns, CASE
    WHEN n * k * 8 >= 1e9 THEN '~' || printf('%.1f', round(n * k * 8 / 1e9, 1)) || ' GB'
    WHEN n * k * 8 >= 1e6 THEN '~' || printf('%.1f', round(n * k * 8 / 1e6, 1)) || ' MB'
    WHEN n * k * 8 >= 1e3 THEN '~' || printf('%.1f', round(n * k * 8 / 1e3, 1)) || ' KB'
    ELSE '~' || n * k * 8 || ' B' END AS memory_usage, nums AS numeric_features, cats AS categorical_features,
  'l_extendedprice' AS detected_target, 'regression' AS problem_type, 83::INTEGER AS score,
  'Good Dataset' AS readiness, 'Ready for Machine Learning with minor caveats' AS readiness_detail FROM c"""

SQL["statistics_table"] = f"""WITH {facts('events', COLUMNS['events'])}, {roles()}
SELECT "column", {r4('mean', 'median', 'std', 'min', 'max')} FROM flags WHERE role = 'numeric' AND NOT is_id"""

_ROUTES = f"""routes AS (SELECT *, CASE WHEN bar THEN 'bar' ELSE 'histogram' END AS chart, row_number() OVER
  (PARTITION BY bar ORDER BY role = 'numeric' AND bar, ordinal) AS place FROM (SELECT *, role IN ('categorical', 'datetime')
  OR (role = 'numeric' AND nunique <= {vocab.CATEGORICAL_MAX_DISTINCT}) AS bar FROM facts WHERE role <> 'unsupported')),
barred AS (SELECT * FROM routes WHERE bar AND place <= {vocab.MAX_BARS} AND nunique BETWEEN 1 AND {vocab.MAX_BAR_CATEGORIES})"""


def _plain(columns):
    return [(i, c) for i, (c, k) in enumerate(columns) if k in (INT, NUM, TEXT)]


SQL["bar_data"] = f"""WITH {facts('lineitem', COLUMNS['lineitem'])}, {_ROUTES}
SELECT ordinal::INTEGER AS ordinal, "column", value, n,
  (row_number() OVER (PARTITION BY ordinal ORDER BY n DESC, value))::INTEGER AS rk,
  round(n / sum(n) OVER (PARTITION BY ordinal) * 100, 4) AS share
FROM ({_counts('lineitem', _plain(COLUMNS['lineitem']))}) WHERE ordinal IN (SELECT ordinal FROM barred)"""


def hist_sql(columns, log: bool) -> str:
    """Bins of the numeric columns of events with more than 15 values."""
    rows = []
    for i, (c, k) in enumerate(columns):
        if k in (INT, NUM):
            axis = f"CASE WHEN {c} > 0 THEN log10({c}::DOUBLE) END" if log else f"{c}::DOUBLE"
            edge = "pow(10, {})" if log else "{}"
            rows.append(f"""SELECT {i}::INTEGER AS ordinal, '{c}' AS "column", {str(log).lower()} AS log_scale,
  bin::INTEGER AS bin, round({edge.format('lo + bin * (hi - lo) / bins')}, 4) AS bin_from,
  round({edge.format('lo + (bin + 1) * (hi - lo) / bins')}, 4) AS bin_to, n FROM (
  SELECT bin, any_value(lo) AS lo, any_value(hi) AS hi, any_value(bins) AS bins, count(*) AS n FROM (
   SELECT least(floor((v - lo) / (hi - lo) * bins), bins - 1) AS bin, lo, hi, bins FROM (
    SELECT *, ceil((hi - lo) / CASE WHEN fd > 0 THEN least(fd, st) ELSE st END) AS bins FROM (
     SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / (log2(count(v)) + 1) AS st,
      2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / pow(count(v), 1.0::DOUBLE / 3) AS fd
     FROM (SELECT {axis} AS v FROM events))), (SELECT {axis} AS v FROM events) WHERE v IS NOT NULL) GROUP BY bin)
WHERE (SELECT count(DISTINCT {c}) FROM events) > {vocab.CATEGORICAL_MAX_DISTINCT}""")
    return " UNION ALL ".join(rows)


_SHIPPED = [c for c, _ in COLUMNS["lineitem"]].index("l_shipdate")
SQL["bar_data_all"] = SQL["bar_data"].replace(
    f"({_counts('lineitem', _plain(COLUMNS['lineitem']))})",
    f"""({_counts('lineitem', _plain(COLUMNS['lineitem']))} UNION ALL SELECT {_SHIPPED}, 'l_shipdate',
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), count(*) FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 3)""").replace(
    "SELECT ordinal FROM barred", "SELECT ordinal FROM routes WHERE bar AND nunique > 0")
SQL["hist_data"] = hist_sql(_without(COLUMNS["events"], "props"), False)
SQL["hist_log_data"] = hist_sql(_without(COLUMNS["events"], "props"), True)

SQL["kde_curve"] = f"""WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi,
  stddev_samp(value) * pow(count(value), -0.2::DOUBLE) AS h FROM events),
grid AS (SELECT g::INTEGER AS point, lo + g * (hi - lo) / {vocab.DENSITY_POINTS - 1} AS x, n, h
  FROM s, range({vocab.DENSITY_POINTS}) t(g))
SELECT point, round(any_value(x), 4) AS x,
  round(sum(exp(-0.5 * pow((x - value) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 8) AS density
FROM grid, events WHERE value IS NOT NULL GROUP BY point"""

SQL["kde_binned"] = " UNION ALL ".join(f"""SELECT * FROM (WITH s AS (SELECT n, lo, hi, h, (hi - lo) / least(1048576, ceil(400 * (hi - lo) / h)) AS step FROM
  (SELECT count({c}) AS n, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, stddev_samp({c}) * pow(count({c}), -0.2::DOUBLE) AS h FROM lineitem)),
spots AS (SELECT ({c} - lo) / step AS u FROM lineitem, s WHERE {c} IS NOT NULL),
knots AS (SELECT knot, sum(w) AS w FROM (SELECT floor(u) AS knot, 1 - (u - floor(u)) AS w FROM spots
  UNION ALL SELECT floor(u) + 1, u - floor(u) FROM spots) GROUP BY knot),
grid AS (SELECT g::INTEGER AS point, lo + g * (hi - lo) / {vocab.DENSITY_POINTS - 1} AS x FROM s, range({vocab.DENSITY_POINTS}) t(g))
SELECT '{c}' AS "column", point, round(any_value(x), 4) AS x,
  round(sum(w * exp(-0.5 * pow((x - (lo + knot * step)) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 8) AS density
FROM grid, knots, s GROUP BY point)""" for c in ("l_quantity", "l_extendedprice", "l_partkey"))

_CONTINUOUS = f"""src AS ({PRICED}), {facts('src', PRICED_COLUMNS)},
cont AS (SELECT * FROM facts WHERE role = 'numeric' AND nunique > {vocab.CATEGORICAL_MAX_DISTINCT}),
cpairs AS (SELECT * FROM ({pairs_sql('src', PRICED_COLUMNS)})
  WHERE a IN (SELECT "column" FROM cont) AND b IN (SELECT "column" FROM cont)),
tops AS (SELECT a, b, round(r, 4) AS r FROM cpairs WHERE r IS NOT NULL ORDER BY round(abs(r), 9) DESC, i, j
  LIMIT {vocab.MAX_SCATTERS})"""

SQL["scatter_pairs"] = f"""WITH {_CONTINUOUS} SELECT a, b, r, CASE WHEN abs(r) > 0.5 THEN 'strong'
  WHEN abs(r) > 0.25 THEN 'moderate' ELSE 'weak' END || ' ' || CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END
  AS relationship FROM tops"""

_AXIS = " ".join(f"WHEN '{c}' THEN {c}" for c, k in PRICED_COLUMNS if k in (INT, NUM))
SQL["scatter_points"] = f"""WITH {_CONTINUOUS}
SELECT a, b, round(CASE a {_AXIS} END, 4) AS x, round(CASE b {_AXIS} END, 4) AS y FROM src, tops"""

SQL["heatmap_data"] = f"""WITH {_CONTINUOUS},
names AS (SELECT "column" FROM cont WHERE nunique / n <= {vocab.HEATMAP_UNIQUENESS}),
half AS (SELECT a, b, round(r, 4) AS r FROM cpairs WHERE a IN (FROM names) AND b IN (FROM names))
SELECT a, b, r FROM half UNION ALL SELECT b, a, r FROM half UNION ALL SELECT "column", "column", 1.0::DOUBLE FROM names"""

_PLAIN_EVENTS = _without(COLUMNS["events"], "props", "ts")
SQL["chart_manifest"] = f"""WITH src AS (SELECT event_id, user_id, event_type, value FROM events),
{facts('src', _PLAIN_EVENTS)}, {_ROUTES}, cnt AS ({_counts('src', _plain(_PLAIN_EVENTS))}),
tall AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY n DESC, value) AS rk,
  sum(n) OVER (PARTITION BY ordinal) AS total, count(*) OVER (PARTITION BY ordinal) AS k FROM cnt
  WHERE ordinal IN (SELECT ordinal FROM barred)),
cont AS (SELECT *, abs(mean - median) / std AS skew FROM routes WHERE NOT bar),
near AS (SELECT "column" FROM cont WHERE nunique / n <= {vocab.HEATMAP_UNIQUENESS}),
prs AS (SELECT * FROM ({pairs_sql('src', _PLAIN_EVENTS)})
  WHERE a IN (SELECT "column" FROM cont) AND b IN (SELECT "column" FROM cont)),
tops AS (SELECT a, b, round(r, 4) AS r FROM prs WHERE r IS NOT NULL ORDER BY abs(r) DESC LIMIT {vocab.MAX_SCATTERS}),
charts AS (
SELECT 1 AS f, place AS p, 'bar' AS chart_type, 'bar_chart_' || t."column" AS chart_id,
  'Frequency of ''' || t."column" || '''' AS title,
  'Count of each category in ''' || t."column" || ''' (' || k || ' categories shown).' AS description,
  '''' || value || ''' is the most common value, appearing ' || t.n || ' times (' ||
  printf('%.1f', round(round(t.n / total * 100, 4), 1)) || '% of rows).' AS interpretation
FROM tall t JOIN routes USING (ordinal) WHERE rk = 1
UNION ALL SELECT 2, place, 'histogram', 'histogram_' || "column", 'Distribution of ''' || "column" || '''',
  'Distribution of ''' || "column" || ''' across all rows with a non-null value.',
  '''' || "column" || CASE WHEN skew > 0.5 THEN ''' is right-skewed (skew measure ' || printf('%.2f', round(skew, 2)) ||
    '), so this is shown on a log scale.' ELSE ''' is roughly symmetric (skew measure ' || printf('%.2f', round(skew, 2)) ||
    ').' END FROM cont
UNION ALL SELECT 3, row_number() OVER (ORDER BY abs(r) DESC, a, b), 'scatter', 'scatter_' || a || '_vs_' || b,
  '''' || a || ''' vs ''' || b || '''', 'Relationship between ''' || a || ''' and ''' || b ||
  ''', the numeric pair with one of the strongest correlations in this dataset.', 'A ' || CASE WHEN abs(r) > 0.5 THEN 'strong'
  WHEN abs(r) > 0.25 THEN 'moderate' ELSE 'weak' END || ' ' || CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END ||
  ' relationship (correlation ' || printf('%.2f', round(r, 2)) || ').' FROM tops
UNION ALL SELECT 4, 1, 'heatmap', 'correlation_heatmap', 'Correlation Matrix', 'Pairwise correlation across ' ||
  (SELECT count(*) FROM near) || ' numeric columns.', 'The strongest relationship is between ''' ||
  a || ''' and ''' || b || ''' (correlation ' || printf('%.2f', round(r, 2)) || ').' FROM (SELECT * FROM prs
  WHERE a IN (FROM near) AND b IN (FROM near) ORDER BY abs(r) DESC LIMIT 1))
SELECT row_number() OVER (ORDER BY f, p)::INTEGER AS ordinal, chart_type, chart_id, title, description, interpretation
FROM charts"""

# --- model ranking ------------------------------------------------------------


def signals_sql(src: str, columns, target: str | None, balance: str | None = None, prefix: str = "") -> str:
    """CTEs ending in ``sig``: one row of signals."""
    feature = f"\"column\" <> '{target}'" if target else "true"
    bal = balance or "SELECT NULL::BIGINT AS minority, NULL::BIGINT AS majority, NULL::BIGINT AS total, 0 AS classes"
    return f"""src AS ({src}), {facts('src', columns)}, bal AS ({bal}),
raw AS (SELECT max("rows") AS n_rows, count(*) AS n_columns,
  count(*) FILTER (WHERE {feature} AND role = 'numeric') AS n_numeric,
  count(*) FILTER (WHERE {feature} AND role IN ('categorical', 'datetime')) AS n_categorical,
  coalesce(sum(outliers), 0)::BIGINT AS n_outliers, sum(n_null)::BIGINT AS n_missing,
  coalesce(avg(CASE WHEN std > 0 THEN abs(mean - median) / std END), 0) AS skew FROM facts),
sig AS (SELECT n_rows, n_columns, n_numeric, n_categorical, n_outliers, n_missing, n_rows <= 300 AS small,
  n_rows >= 50000 AS large, (n_numeric > 0 AND n_categorical > 0) OR n_columns >= 15 AS mixed,
  n_categorical >= 5 OR (n_categorical >= 3 AND n_categorical > n_numeric) AS categorical_heavy,
  n_outliers / (n_rows * greatest(n_numeric, 1)) > 0.02 AS outliers,
  n_missing / (n_rows * greatest(n_columns, 1)) > 0.05 AS missing, skew > 0.5 AS skewed,
  coalesce(minority / majority < 0.2, false) AS imbalanced, minority / majority AS class_ratio FROM raw, bal)"""


_DOC_COLUMNS = _without(LABELLED_COLUMNS, "doc_id")
_DOC_SIGNALS = signals_sql(
    f"SELECT * EXCLUDE (doc_id) FROM ({LABELLED})", _DOC_COLUMNS, "toxic",
    "SELECT min(n) AS minority, max(n) AS majority, sum(n) AS total, count(*) AS classes FROM "
    "(SELECT count(*) AS n FROM src GROUP BY toxic)")
_LINE_SIGNALS = signals_sql("SELECT * FROM lineitem", COLUMNS["lineitem"], "l_extendedprice")
SQL["signals"] = f"""SELECT * REPLACE (round(class_ratio, 4) AS class_ratio), 'documents' AS "case"
  FROM (WITH {_DOC_SIGNALS} SELECT * FROM sig)
UNION ALL SELECT *, 'lineitem' AS "case" FROM (WITH {_LINE_SIGNALS} SELECT * FROM sig)"""

_TREE = "strong on structured tabular data with non-linear relationships"
_NOTE = "'class distribution is imbalanced (minority/majority ratio ' || printf('%.2f', round(class_ratio, 2)) || ')'"


def ranking_sql(signals: str, regressor: bool) -> str:
    """CTEs ending in ``ranked``: scores as one expression per model, reasons as ordered lists."""
    tail = " Regressor" if regressor else ""
    linear = "Linear Regression" if regressor else "Logistic Regression"
    easy = ("robust baseline requiring minimal tuning" if regressor else
            "robust baseline that needs little tuning and is easy to interpret via feature importances")
    imb = "false" if regressor else "imbalanced"
    out = "CASE WHEN outliers THEN 'robust to the outliers found in the profile' END"
    mix = "CASE WHEN mixed THEN 'handles higher-dimensional mixed features without heavy preprocessing' END"
    note = f"CASE WHEN {imb} THEN {_NOTE} END"
    add = f"outliers::INT + mixed::INT + 0.5 * ({imb})::INT"
    rows = "format('{{:,}}', n_rows)"
    small = "'the small dataset (' || n_rows || ' rows) "
    models = [
        (f"Gradient Boosting{tail}", "true", f"3 + categorical_heavy::INT + {add}", [f"'{_TREE}'", out, mix, note]),
        (f"Random Forest{tail}", "true", f"2 + {add}", [f"'{_TREE}'", f"'{easy}'", out, mix, note]),
        (f"XGBoost{tail}", "true", f"2 + 4 * large::INT + 2 * categorical_heavy::INT - small::INT + {add}", [
            f"'{_TREE}'", f"CASE WHEN large THEN 'excels on large datasets (' || {rows} || ' rows)' END",
            "CASE WHEN categorical_heavy THEN 'handles mixed categorical/numeric features well' END",
            f"CASE WHEN small THEN {small}gives this data-hungry booster less room to shine; it benefits from more data "
            "and tuning' END", out, mix, note]),
        (linear, "true", "1 + 1.5 * small::INT - outliers::INT", [
            f"CASE WHEN small THEN {small}makes this simple, interpretable model a competitive baseline' END",
            "'a simple, highly interpretable linear baseline'",
            "CASE WHEN outliers THEN 'more sensitive to the outliers detected in this dataset' END"]),
        (f"LightGBM{tail}", "large", "5.5", [f"'scales efficiently to large datasets (' || {rows} || ' rows)'"]),
        (f"CatBoost{tail}", "large OR categorical_heavy", "CASE WHEN categorical_heavy THEN 6 ELSE 5 END", [
            "CASE WHEN categorical_heavy THEN 'handles the many categorical features (' || n_categorical || "
            "') natively without heavy encoding' END",
            "CASE WHEN large THEN 'handles large tabular data well with strong defaults' END"]),
    ]
    union = " UNION ALL ".join(
        f"SELECT {i} AS o, '{m}' AS model, ({score})::DOUBLE AS score, "
        f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL) AS parts FROM sig WHERE {when}"
        for i, (m, when, score, parts) in enumerate(models)).replace("{{", "{").replace("}}", "}")
    return f"""{signals}, m AS ({union}),
j AS (SELECT *, array_to_string(parts[1:3], '; ') AS t, max(score) OVER () - score AS gap FROM m),
ranked AS (SELECT row_number() OVER (ORDER BY score DESC, o)::INTEGER AS rank, model, score,
  CASE WHEN gap <= 0.5 THEN 'High' WHEN gap <= 2 THEN 'Medium-High' ELSE 'Medium' END AS confidence,
  upper(t[1]) || t[2:] || CASE WHEN t LIKE '%.' THEN '' ELSE '.' END AS reason FROM j)"""


SQL["rank_classification"] = f"WITH {ranking_sql(_DOC_SIGNALS, False)} SELECT * FROM ranked"
_LINE_RANKING = ranking_sql(_LINE_SIGNALS, True)
SQL["rank_regression"] = f"WITH {_LINE_RANKING} SELECT * FROM ranked"

SQL["rank_clustering"] = f"""WITH {signals_sql('SELECT * FROM events', COLUMNS['events'], None)},
s AS (SELECT *, skewed OR outliers AS rough, concat_ws(' and ', CASE WHEN skewed THEN
  'notable skew across numeric columns' END, CASE WHEN outliers THEN 'a significant fraction of outlier points' END) AS d FROM sig)
SELECT CASE WHEN rough THEN 1 ELSE 2 END::INTEGER AS rank, 'DBSCAN' AS model, CASE WHEN rough THEN 2 ELSE 0 END::DOUBLE AS score,
  CASE WHEN rough THEN 'High' ELSE 'Medium' END AS confidence, CASE WHEN rough THEN 'The profile shows ' || d ||
  ', which violates KMeans''s assumption of roughly spherical, similarly-sized clusters -- DBSCAN''s density-based approach '
  || 'handles noise and irregular cluster shapes better.' ELSE 'A solid alternative if the true cluster structure turns out '
  || 'to be density-based or noisy, but there''s no strong signal for that in this profile.' END AS reason FROM s
UNION ALL SELECT CASE WHEN rough THEN 2 ELSE 1 END::INTEGER, 'KMeans', CASE WHEN rough THEN 0 ELSE 2 END::DOUBLE,
  CASE WHEN rough THEN 'Medium' ELSE 'High' END, CASE WHEN rough THEN 'A reasonable alternative once the data is de-skewed or '
  || 'outliers are handled, but its spherical-cluster assumption is a weaker fit for this profile as-is.' ELSE 'The profile '
  || 'shows no extreme skew or significant outliers, so the roughly spherical, similarly-sized cluster assumption KMeans '
  || 'relies on is plausible here.' END FROM s"""

_WARNINGS = """w AS (
SELECT 1 AS o, CASE WHEN classes >= 2 AND minority / total < 0.1 THEN
  'Target classes are highly imbalanced (minority class: ' || printf('%.0f', round(minority / total * 100)) ||
  '% of rows -- ' || format('{:,}', minority) || ' of ' || format('{:,}', total::BIGINT) ||
  '). Consider class weights, oversampling, or stratified splitting when training.' END AS warning FROM bal
UNION ALL SELECT 2, CASE WHEN n_rows < 50 THEN 'Only ' || n_rows || ' rows: this is below the ~50-row floor for a reliable ' ||
  'model, so treat the recommendation as indicative rather than definitive.' END FROM sig
UNION ALL SELECT 3, CASE WHEN n_numeric + n_categorical < 2 THEN 'Only ' || (n_numeric + n_categorical) || ' usable ' ||
  'feature column(s): with so few predictors, model choice matters less than gathering more informative features.' END FROM sig
UNION ALL SELECT 4, CASE WHEN minority < 10 THEN 'The smallest class has only ' || minority || ' row(s) (< 10); a classifier '
  || 'cannot learn it reliably. Consider collecting more examples or merging rare classes.' END FROM bal)"""
_RARE = "SELECT o_orderpriority, o_totalprice, CASE WHEN o_totalprice > 490000 THEN 'yes' ELSE 'no' END AS rare FROM orders"
_RARE_SIGNALS = signals_sql(
    _RARE, [("o_orderpriority", TEXT), ("o_totalprice", NUM), ("rare", TEXT)], "rare",
    "SELECT min(n) AS minority, max(n) AS majority, sum(n) AS total, count(*) AS classes FROM "
    "(SELECT count(*) AS n FROM src GROUP BY rare)")
SQL["model_warnings"] = f"""WITH {_RARE_SIGNALS}, {_WARNINGS}
SELECT row_number() OVER (ORDER BY o)::INTEGER AS ordinal, warning FROM w WHERE warning IS NOT NULL"""

_NATION_SIGNALS = signals_sql(
    "SELECT s_acctbal, 'n' || s_nationkey AS nation FROM supplier", [("s_acctbal", NUM), ("nation", TEXT)], "nation",
    "SELECT min(n) AS minority, max(n) AS majority, sum(n) AS total, count(*) AS classes FROM "
    "(SELECT count(*) AS n FROM src GROUP BY nation)")
SQL["cautions_small_classes"] = f"""WITH {_NATION_SIGNALS}, {_WARNINGS}
SELECT row_number() OVER (ORDER BY o)::INTEGER AS ordinal, warning FROM w WHERE warning IS NOT NULL"""

_FAMILIES = ", ".join(
    "('{}', '{}', '{}', '{}', '{}', '{}')".format(f[0], f[1], f[2], f[4], f[6], "; ".join(f[7])) for f in vocab.MODEL_FAMILIES)
SQL["model_cards"] = f"""WITH {_LINE_RANKING},
fam(family, interpretability, training_speed, handles_missing, scalability, advantages) AS (VALUES {_FAMILIES})
SELECT rank, model, interpretability, training_speed, handles_missing, scalability, advantages
FROM ranked LEFT JOIN fam ON family = regexp_replace(model, ' Regressor$', '')"""

SQL["why_not_others"] = f"""WITH {_LINE_RANKING}
SELECT rank, model, 'Ranked below ' || (SELECT model FROM ranked WHERE rank = 1) || ' (' || confidence ||
  ' confidence): ' || reason AS explanation FROM ranked WHERE rank > 1"""

SQL["readiness_stars"] = f"""WITH {_DOC_SIGNALS}, t AS (
SELECT 1 AS ordinal, 'business_intelligence' AS dimension, 5 AS stars FROM sig
UNION ALL SELECT 2, 'machine_learning', CASE WHEN n_rows < 50 THEN 3 ELSE 5 END FROM sig
UNION ALL SELECT 3, 'deep_learning', CASE WHEN n_rows < 50 THEN 2 ELSE 3 END FROM sig
UNION ALL SELECT 4, 'visualization', 5 FROM sig UNION ALL SELECT 5, 'deployment', 4 FROM sig)
SELECT ordinal::INTEGER AS ordinal, dimension, stars::INTEGER AS stars,
  repeat('★', stars) || repeat('☆', 5 - stars) AS display FROM t"""

# --- sources and sinks --------------------------------------------------------

SQL["csv_roundtrip"] = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"
SQL["csv_na_tokens"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus, o_orderkey % 2 = 0 AS even FROM orders"""
SQL["csv_preamble"] = """SELECT c_custkey, c_name || ', Ltd' AS c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal,
  c_mktsegment FROM customer"""
SQL["csv_headerless"] = """SELECT l_orderkey AS column_0, l_linenumber::BIGINT AS column_1, l_quantity AS column_2,
  l_extendedprice AS column_3 FROM lineitem"""
SQL["csv_broken_cells"] = "SELECT * FROM documents"
SQL["csv_broken_banner"] = """SELECT page_id, url || chr(10) || 'a "quoted" part, and more' AS url, html FROM pages"""
SQL["csv_folder_layouts"] = """WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 7 = 0) AS short FROM orders)
SELECT 'plain' AS finding, 6 AS width, 3 AS files, n + 3 AS records, 0 AS ragged FROM o
UNION ALL SELECT 'ragged', 6, 2, n + 2, short FROM o
UNION ALL SELECT 'disagrees', 4, 2, count(*) + 2, 0 FROM part
UNION ALL SELECT 'banner', 5, 2, count(*) + 4, 0 FROM customer
UNION ALL SELECT 'malformed', 5, 2, count(*) + 2, 0 FROM customer"""
SQL["csv_latin1"] = "SELECT p_partkey, 'Café ' || p_name AS p_name FROM part"
SQL["round_trip_check"] = f"""SELECT "rows" AS rows_table, "rows" AS rows_file, duplicates AS duplicates_table,
  duplicates AS duplicates_file, true AS same FROM ({dup_sql(REPEATED_ORDERS, COLUMNS['orders'])})"""
SQL["result_tables"] = balance_sql("orders", "o_orderstatus")

# --- streams and the whole analysis -------------------------------------------


def admission_sql(key: str, limit: int, seconds: int) -> str:
    """Event by event per key, carrying the last ``limit`` admitted times (newest first)."""
    w = seconds * 1_000_000
    last = [f"a{i}" for i in range(1, limit + 1)]
    oldest = last[-1]
    ok = f"({oldest} IS NULL OR {oldest} <= us - {w})"
    # The window holds `limit` admitted events when one is rejected, so its oldest is the last carried.
    shift = ", ".join(
        f"CASE WHEN {ok} THEN {'us' if i == 0 else last[i - 1]} ELSE {last[i]} END" for i in range(limit))
    return f"""WITH RECURSIVE e AS (SELECT {key} AS k, event_id, ts, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT k, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::BOOLEAN AS admitted,
    NULL::BIGINT AS retry_after, {', '.join(f'NULL::BIGINT AS {a}' for a in last)} FROM (SELECT DISTINCT k FROM e)
  UNION ALL SELECT e.k, e.rn, e.event_id, e.ts, {ok}, CASE WHEN {ok} THEN 0
      ELSE greatest(1, floor(({w} - (us - {oldest})) / 1e6)::BIGINT + 1) END, {shift}
  FROM r JOIN e ON e.k = r.k AND e.rn = r.rn + 1)
SELECT k AS {key}, event_id, ts, admitted, retry_after FROM r WHERE rn > 0"""


SQL["admission_audit_events"] = admission_sql("user_id", 2, 6 * 3600)
SQL["admission_stream_events"] = SQL["admission_typed_stream"] = SQL["admission_audit_events"]
SQL["admission_live_keys"] = f"""WITH audit AS ({admission_sql("user_id", 2, 6 * 3600)}),
m AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 10800000000 AS mark FROM events),
held AS (SELECT user_id, count(*) FILTER (admitted AND epoch_us(ts) < mark AND epoch_us(ts) > mark - 21600000000) AS admitted_times,
  count(*) FILTER (epoch_us(ts) >= mark) AS waiting_rows FROM audit, m GROUP BY user_id UNION ALL SELECT -1, 0, 1)
SELECT user_id, admitted_times + waiting_rows > 0 AS live, admitted_times, waiting_rows FROM held"""
SQL["admission_prefix_events"] = SQL["admission_audit_events"]
SQL["admission_audit_chunked"] = SQL["admission_prefix_types"] = admission_sql("event_type", 3, 3600)


def report_sql(name: str, columns, target: str, ids, before: str, ctes: str, cleaned_columns, removed: str) -> str:
    """Headline rows of an analysis whose cleaned relation is the CTE ``cleaned``."""
    score = quality_sql("SELECT * FROM cleaned", cleaned_columns, None, ids)
    ranked = ranking_sql(signals_sql("SELECT * FROM cleaned", cleaned_columns, target), True)
    count = "(SELECT count(*) FROM cleaned)"
    gaps = " + ".join(f"count(*) - count({c})" for c, _ in cleaned_columns)
    items = [
        ("dataset", f"'{name}'"), ("rows", f"(SELECT count(*) FROM {before})::VARCHAR"), ("columns", f"'{len(columns)}'"),
        ("target", f"'{target}'"), ("identifiers", "'" + ", ".join(ids) + "'"), ("valid", "'true'"),
        ("problem_type", "'regression'"), ("rows_after", f"{count}::VARCHAR"),
        ("missing_after", f"(SELECT ({gaps})::BIGINT FROM cleaned)::VARCHAR"),
        ("duplicates_removed", f"({removed})::VARCHAR"),
        ("quality_score", f"(WITH {score} SELECT quality_score FROM score)::VARCHAR"),
        ("top_model", f"(WITH {ranked} SELECT model FROM ranked WHERE rank = 1)"),
    ]
    return f"WITH {ctes} " + " UNION ALL ".join(
        f"SELECT {i + 1}::INTEGER AS ordinal, '{k}' AS item, {v} AS value" for i, (k, v) in enumerate(items))


SQL["analyze_report"] = report_sql(
    "events", COLUMNS["events"], "value", ["event_id", "ts", "user_id"], "events",
    f"cleaned AS (SELECT value, props, {one_hot_sql('event_type', _TYPES)} FROM events)",
    [("value", NUM), ("props", TEXT)] + [(f"event_type_{t}", INT) for t in _TYPES], "0")

SQL["analyze_stops"] = """SELECT count(DISTINCT c_custkey) < count(*) OR count(DISTINCT c_name) < count(*) AS valid,
  CASE WHEN count(DISTINCT c_custkey) = count(*) AND count(DISTINCT c_name) = count(*) THEN 'No usable feature columns remain: every '
    || 'column looks like an identifier (unique IDs, names, or free text) or the target. There is nothing for a model to learn from.'
    ELSE '' END AS errors, false AS cleaned, false AS ranked FROM customer"""
SQL["analyze_from_csv"] = SQL["analyze_report"]

_FLAGS, _STATUS = ("A", "N", "R"), ("F", "O")
_CLEAN_LINES = _without(COLUMNS["lineitem"], "l_returnflag", "l_linestatus", "l_shipdate") + [
    ("l_quantity_missing", INT), ("l_returnflag_missing", INT)] + [(f"l_returnflag_{f}", INT) for f in _FLAGS] + [
    (f"l_linestatus_{f}", INT) for f in _STATUS]
SQL["analyze_dirty"] = report_sql(
    "lineitem", _without(COLUMNS["lineitem"], "l_shipdate"), "l_extendedprice", [], "dirty",
    f"""dirty AS (SELECT * EXCLUDE (l_shipdate) FROM ({DIRTY_LINES})),
filled AS (SELECT * REPLACE (coalesce(l_quantity, {_median('dirty', 'l_quantity')}) AS l_quantity,
    coalesce(l_returnflag, {_mode('dirty', 'l_returnflag')}) AS l_returnflag),
  (l_quantity IS NULL)::INTEGER AS l_quantity_missing, (l_returnflag IS NULL)::INTEGER AS l_returnflag_missing FROM dirty),
uniq AS (SELECT DISTINCT * FROM filled),
cleaned AS (SELECT * EXCLUDE (l_returnflag, l_linestatus), {one_hot_sql('l_returnflag', _FLAGS)},
  {one_hot_sql('l_linestatus', _STATUS)} FROM uniq)""",
    _CLEAN_LINES, "(SELECT count(*) FROM filled) - (SELECT count(*) FROM uniq)")
