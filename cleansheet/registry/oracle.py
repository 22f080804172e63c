"""SQL counterparts of the registered queries, for a second engine.

Every decision the library takes from the data is taken again here in SQL.
"""

from __future__ import annotations

from cleansheet.functions.text import CSV_NULL_TOKENS, MISSING_TOKENS, WHITESPACE
from cleansheet.operators.query_audit import FOLDED, NAME, NO_CALLS, TOKEN
from cleansheet.registry.views import DATE_COLUMNS, DATE_FORMS, LANDED_FILES, MESSY_COLUMNS, MESSY_HEADINGS, QUERY_TEXTS


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_literal(v) for v in values) + ")"


WS = _literal(WHITESPACE)
NUMBER = r"(?i)\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)\s*"
LOOSE = (
    r"(?i)[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?"
    r"|inf|infinity|nan)"
)
SPACES = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
TEXTS = ["priority", "confirmed", "amount", "order_day", "empty_col", "const_col"]
NUMERICS = ["order_id", "qty"]

MESSY = """base AS (
  SELECT o_orderkey AS order_id,
         CASE WHEN o_orderkey % 11 = 0 THEN '-'
              WHEN o_orderkey % 13 = 0 THEN '  '
              WHEN o_orderkey % 19 = 0 THEN NULL
              ELSE concat(' ', o_orderpriority, '  x ') END AS priority,
         CASE WHEN o_orderkey % 3 = 0 THEN 'yes' WHEN o_orderkey % 3 = 1 THEN 'YES' ELSE ' No ' END AS confirmed,
         CASE WHEN o_orderkey % 23 = 0 THEN 'N/A'
              WHEN o_orderkey % 29 = 0 THEN '1d'
              ELSE concat(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR), ',',
                          lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0')) END AS amount,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS DOUBLE) END AS qty,
         CASE WHEN o_orderkey % 31 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS order_day,
         CAST(NULL AS VARCHAR) AS empty_col,
         'x' AS const_col
  FROM orders),
mo AS (
  SELECT * FROM base
  UNION ALL SELECT * FROM base WHERE order_id % 17 = 0
  UNION ALL SELECT CAST(NULL AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM base WHERE order_id % 1000 = 1
)"""

HISTORY = """hist AS (
  SELECT event_id AS id, user_id, event_type AS command, value AS execution_time,
         CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success,
         CAST(floor(value * 1000) AS BIGINT) AS duration_ms, ts AS created_at
  FROM events
)"""

# Ids of the log in three batches, each in the order of time (which has no ties).
_BATCH = "CAST(floor(epoch(created_at)) AS BIGINT) % 3"
_NUMBERED = f"SELECT * EXCLUDE (id), row_number() OVER (ORDER BY {_BATCH}, created_at) AS id FROM hist"

# Cell texts of one column per kind, as in the derived view.
CELLS = MESSY + """,
cells AS (
  SELECT CAST(k AS VARCHAR) AS c_whole,
         CASE WHEN k % 7 = 0 THEN 'NULL' ELSE CAST(k AS VARCHAR) END AS c_whole_gap,
         CAST(CAST(9223372036854775807 AS HUGEINT) + k AS VARCHAR) AS c_big,
         concat('99999999999999999999', CAST(k AS VARCHAR)) AS c_huge,
         concat(CAST(k AS VARCHAR), '.5e-3') AS c_real,
         CASE WHEN k % 2 = 0 THEN 'TRUE' ELSE 'false' END AS c_flag,
         CASE WHEN k % 2 = 0 THEN 'True' WHEN k % 3 = 0 THEN 'n/a' ELSE 'False' END AS c_flag_gap,
         CASE WHEN k % 2 = 0 THEN '' ELSE '#N/A' END AS c_nothing,
         CASE WHEN k % 5000 = 17 THEN '1d' ELSE CAST(k AS VARCHAR) END AS c_almost,
         CAST(order_id AS VARCHAR) AS c_order_id, priority AS c_priority, confirmed AS c_confirmed,
         amount AS c_amount, CAST(qty AS VARCHAR) AS c_qty, order_day AS c_order_day,
         empty_col AS c_empty_col, const_col AS c_const_col
  FROM (SELECT *, coalesce(order_id, 0) AS k FROM mo)
)"""
CELL_COLUMNS = [
    "c_whole", "c_whole_gap", "c_big", "c_huge", "c_real", "c_flag", "c_flag_gap", "c_nothing", "c_almost",
    *[f"c_{c}" for c in MESSY_COLUMNS],
]

TABLE_TEXTS = {
    "messy_orders": ("mo", TEXTS),
    "documents": ("documents", ["text", "lang", "source"]),
    "customer": ("customer", ["c_name", "c_mktsegment"]),
}


def _trim(c: str) -> str:
    return f"trim({c}, {WS})"


def _token_null(c: str) -> str:
    return f"CASE WHEN {_trim(c)} NOT IN {_in(MISSING_TOKENS)} THEN {_trim(c)} END"


def _number(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '{NUMBER}') THEN TRY_CAST({c} AS DOUBLE) END"


def _plain(c: str) -> str:
    return f"trim(replace({c}, ',', ''), {WS})"


def _day(c: str) -> str:
    """Dates in the data have one format; no other text has a known one."""
    return f"try_strptime({c}, '%Y-%m-%d')"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _long(source: str, columns: list[str]) -> str:
    return _union([
        f"SELECT {i} AS pos, '{c}' AS column_name, {c} AS value FROM {source}" for i, c in enumerate(columns)
    ])


def _frequencies(source: str, columns: list[str]) -> str:
    return (
        f"SELECT column_name, value, count(*) AS n FROM ({_long(source, columns)}) "
        "WHERE value IS NOT NULL GROUP BY column_name, value"
    )


def _top(source: str, columns: list[str], k: int) -> str:
    return (
        "SELECT column_name, value_rank, value, n FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY column_name ORDER BY n DESC, value) AS value_rank FROM ({_frequencies(source, columns)})) "
        f"WHERE value_rank <= {k}"
    )


def _mixed(source: str, columns: list[str]) -> str:
    numeric = f"count(*) FILTER (regexp_full_match({_trim('value')}, '{LOOSE}'))"
    return (
        f"SELECT column_name, count(value) AS n_values, CAST({numeric} AS BIGINT) AS n_numeric "
        f"FROM ({_long(source, columns)}) GROUP BY column_name HAVING {numeric} BETWEEN 1 AND count(value) - 1"
    )


def _missing(source: str, columns: list[str]) -> str:
    return _union([
        f"SELECT {i} AS position, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing FROM {source}"
        for i, c in enumerate(columns)
    ])


def _duplicates(source: str, columns: list[str]) -> str:
    names = ", ".join(columns)
    return (
        f"(SELECT CAST((SELECT count(*) FROM {source}) - "
        f"(SELECT count(*) FROM (SELECT DISTINCT {names} FROM {source})) AS BIGINT))"
    )


def _bytes(source: str, texts: list[str], fixed: int) -> str:
    sizes = " + ".join([f"coalesce(octet_length(encode({c})), 0)" for c in texts] + [str(fixed)])
    return f"(SELECT CAST(sum({sizes}) AS BIGINT) FROM {source})"


def _score(rows: str, columns: int, missing: str, duplicates: str, mixed: str) -> str:
    return (
        f"round(greatest(0.0, least(10.0, CAST(10.0 AS DOUBLE) - 4.0 * CAST({missing} AS DOUBLE) / ({rows} * {columns}) "
        f"- 3.0 * CAST({duplicates} AS DOUBLE) / {rows} - 3.0 * CAST({mixed} AS DOUBLE) / {columns})), 1)"
    )


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
PROFILED = {
    "messy_orders": ("mo", MESSY_COLUMNS, TEXTS, 16),
    "orders": ("orders", ORDER_COLUMNS, ["o_orderstatus", "o_orderpriority"], 32),
}


def _quality(name: str, source: str, columns: list[str], texts: list[str]) -> str:
    return f"""
SELECT '{name}' AS table_name, n_rows, CAST({len(columns)} AS BIGINT) AS n_columns, missing_values, duplicate_rows,
       inconsistent_columns,
       {_score('n_rows', len(columns), 'missing_values', 'duplicate_rows', 'inconsistent_columns')} AS quality_score
FROM (SELECT (SELECT count(*) FROM {source}) AS n_rows,
             (SELECT CAST(sum(missing) AS BIGINT) FROM ({_missing(source, columns)})) AS missing_values,
             {_duplicates(source, columns)} AS duplicate_rows,
             (SELECT count(*) FROM ({_mixed(source, texts)})) AS inconsistent_columns)"""


def _describe(source: str, columns: list[str], round_to: int | None = 4) -> str:
    def shown(e: str) -> str:
        return f"round({e}, {round_to})" if round_to is not None else e

    return _union([
        f"SELECT {i} AS pos, '{c}' AS column_name, count({c}) AS n_values, {shown(f'avg({c})')} AS mean, "
        f"{shown(f'stddev_samp({c})')} AS std, {shown(f'CAST(min({c}) AS DOUBLE)')} AS min, "
        f"{shown(f'quantile_cont({c}::DOUBLE, 0.25)')} AS p25, {shown(f'quantile_cont({c}::DOUBLE, 0.5)')} AS p50, "
        f"{shown(f'quantile_cont({c}::DOUBLE, 0.75)')} AS p75, {shown(f'CAST(max({c}) AS DOUBLE)')} AS max FROM {source}"
        for i, c in enumerate(columns)
    ])


def _outliers(name: str, source: str, columns: list[str], round_to: int = 4) -> str:
    return _union([
        f"""SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} < lo OR {c} > hi) AS n_outliers,
       round(any_value(lo), {round_to}) AS lower_bound, round(any_value(hi), {round_to}) AS upper_bound
FROM {source}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q3 - q1 AS iqr FROM
  (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source}))
WHERE iqr <> 0 HAVING count(*) FILTER ({c} < lo OR {c} > hi) > 0"""
        for c in columns
    ])


def _mode(source: str, c: str) -> str:
    return (
        f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    )


_SETS = (("male", "female"), ("yes", "no"), ("true", "false"))


def _canonical(c: str) -> str:
    key = f"lower({_trim(c)})"
    return f"CASE {key} " + " ".join(
        f"WHEN '{m}' THEN '{m.capitalize()}'" for s in _SETS for m in s
    ) + f" ELSE {c} END"


def _is_category(source: str, c: str) -> str:
    return "(SELECT " + " OR ".join(
        f"coalesce(bool_and(lower({_trim(c)}) IN {_in(s)}), false)" for s in _SETS
    ) + f" FROM {source})"


# The cleaning stages as CTEs: distinct rows, without empty rows, trimmed with
# tokens removed, filled, and per text column the shares that decide its type.
_FILLABLE = ["priority", "confirmed", "amount", "order_day", "const_col"]
_STAGES = f""",
d AS (SELECT DISTINCT * FROM mo),
k AS (SELECT * FROM d WHERE NOT ({' AND '.join(f'{c} IS NULL' for c in MESSY_COLUMNS)})),
t AS (SELECT order_id, qty, {', '.join(f'{_token_null(c)} AS {c}' for c in _FILLABLE)} FROM k),
f AS (SELECT order_id, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM t)) AS qty,
             {', '.join(f"coalesce({c}, {_mode('t', c)}, 'Unknown') AS {c}" for c in _FILLABLE)} FROM t),
shares AS (
  SELECT column_name, pos, avg(CAST(({_number(_plain('value'))}) IS NOT NULL AS INT)) AS number_share,
         avg(CAST({_day('value')} IS NOT NULL AS INT)) AS date_share
  FROM ({_long('f', _FILLABLE)}) GROUP BY column_name, pos),
c AS (SELECT order_id, qty,
             regexp_replace(priority, '{SPACES}', ' ', 'g') AS priority,
             CASE WHEN {_is_category('f', 'confirmed')} THEN {_canonical('confirmed')} ELSE confirmed END AS confirmed,
             CASE WHEN (SELECT number_share FROM shares WHERE column_name = 'amount') >= 0.9
                  THEN {_number(_plain('amount'))} END AS amount,
             CASE WHEN (SELECT date_share FROM shares WHERE column_name = 'order_day') >= 0.9
                  THEN {_day('order_day')} END AS order_day
      FROM f),
gone AS (
  SELECT 'empty_col' AS column_name, 1 AS pos FROM k HAVING count(empty_col) = 0
  UNION ALL
  SELECT column_name, 2 + pos FROM ({_long('f', _FILLABLE)}) GROUP BY column_name, pos HAVING count(DISTINCT value) <= 1),
counts AS (
  SELECT (SELECT count(*) FROM mo) AS rows_before, (SELECT count(*) FROM k) AS rows_after,
         (SELECT count(*) FROM mo) - (SELECT count(*) FROM d) AS duplicates_removed,
         (SELECT count(*) FROM d) - (SELECT count(*) FROM k) AS empty_rows_removed,
         (SELECT count(*) FROM gone) AS n_gone,
         (SELECT string_agg(column_name, ', ' ORDER BY pos) FROM gone) AS columns_removed,
         (SELECT string_agg(column_name, ', ' ORDER BY pos) FROM gone WHERE pos = 1) AS empty_columns,
         (SELECT string_agg(column_name, ', ' ORDER BY pos) FROM gone WHERE pos > 1) AS constant_columns,
         (SELECT string_agg(column_name, ', ' ORDER BY pos) FROM shares WHERE number_share >= 0.9) AS numbers_made,
         (SELECT string_agg(column_name, ', ' ORDER BY pos) FROM shares
          WHERE date_share >= 0.9 AND number_share < 0.9) AS dates_made,
         (SELECT CAST(sum(CAST({_trim('value')} IN {_in(MISSING_TOKENS)} AS INT)) AS BIGINT)
          FROM ({_long('k', _FILLABLE)})) AS tokens_normalized),
filled AS (SELECT column_name, pos, count(*) AS n FROM (
             {_union([f"SELECT {MESSY_COLUMNS.index(c)} AS pos, '{c}' AS column_name FROM t WHERE {c} IS NULL"
                      for c in ['qty', *_FILLABLE]])}) GROUP BY column_name, pos),
outliers AS ({_outliers('c', 'c', ['order_id', 'amount', 'qty'], 12)})"""
CLEAN = MESSY + _STAGES

# The same after a CSV round trip: cells that read as missing are NULL.
CLEAN_CSV = MESSY.replace("mo AS (", "written AS (") + f""",
mo AS (SELECT order_id, qty, {', '.join(f"CASE WHEN {c} NOT IN {_in(CSV_NULL_TOKENS)} THEN {c} END AS {c}" for c in TEXTS)}
       FROM written)""" + _STAGES

HEADING_NAMES = {
    old: new for old, new in zip(MESSY_HEADINGS, MESSY_COLUMNS) if old != new
}


_ACTIONS = f"""SELECT CAST(stage AS BIGINT) AS stage, message FROM (
SELECT 1 AS stage, 'renamed {len(HEADING_NAMES)} column(s)' AS message
UNION ALL SELECT 2, concat('dropped ', duplicates_removed::VARCHAR, ' repeated row(s)') FROM counts
UNION ALL SELECT 3, concat('dropped ', empty_rows_removed::VARCHAR, ' row(s) without any value') FROM counts
UNION ALL SELECT 4, concat('dropped columns without any value: ', empty_columns) FROM counts WHERE empty_columns IS NOT NULL
UNION ALL SELECT 5, 'cut off outer white space'
UNION ALL SELECT 6, concat('emptied ', tokens_normalized::VARCHAR, ' cell(s) that stood for no value')
  FROM counts WHERE tokens_normalized > 0
UNION ALL SELECT 7, concat('filled gaps: ',
  string_agg(concat(column_name, ' (', n::VARCHAR, ')'), ', ' ORDER BY pos)) FROM filled HAVING count(*) > 0
UNION ALL SELECT 8, concat('made numbers of: ', numbers_made) FROM counts WHERE numbers_made IS NOT NULL
UNION ALL SELECT 9, concat('made timestamps of: ', dates_made) FROM counts WHERE dates_made IS NOT NULL
UNION ALL SELECT 10, 'gave one spelling to: confirmed' WHERE {_is_category('f', 'confirmed')}
UNION ALL SELECT 11, concat('saw outliers in ', count(*)::VARCHAR, ' column(s), left as they are')
  FROM outliers HAVING count(*) > 0
UNION ALL SELECT 12, concat('dropped columns of one value: ', constant_columns) FROM counts
  WHERE constant_columns IS NOT NULL
UNION ALL SELECT 13, 'reduced inner white space to single spaces')"""


def _report() -> str:
    fixed = ["order_id", "qty", "empty_col"]
    texts = [c for c in TEXTS if c != "empty_col"]
    printed = ["order_id", "priority", "confirmed", "amount", "qty", "order_day"]

    def quality(source: str, columns: list[str], texts: list[str]) -> dict[str, str]:
        q = _quality("t", source, columns, texts)
        return {
            "quality score": f"(SELECT concat(quality_score::VARCHAR, '/10') FROM ({q}))",
            "repeated rows": f"(SELECT duplicate_rows::VARCHAR FROM ({q}))",
            "missing cells": f"(SELECT missing_values::VARCHAR FROM ({q}))",
        }

    def count(name: str) -> str:
        return f"(SELECT {name}::VARCHAR FROM counts)"

    megabytes = f"{_bytes('mo', texts, 8 * len(fixed))} / 1048576.0"
    sections = {
        "input": {
            "file": "'messy_orders.csv'", "rows": "(SELECT count(*) FROM mo)::VARCHAR", "columns": "'8'",
            "megabytes": f"printf('%.2f', {megabytes})",
        },
        "before": quality("mo", MESSY_COLUMNS, texts),
        "cleaning": {
            "rows dropped": "(SELECT (rows_before - rows_after)::VARCHAR FROM counts)",
            "repeated rows dropped": count("duplicates_removed"), "empty rows dropped": count("empty_rows_removed"),
            "columns dropped": count("columns_removed"),
            "columns retyped": "(SELECT concat_ws(', ', numbers_made, dates_made) FROM counts)",
            "columns renamed": _literal(", ".join(f"{o} to {n}" for o, n in HEADING_NAMES.items())),
            "steps": f"(SELECT string_agg(message, '; ' ORDER BY stage) FROM ({_ACTIONS}))",
        },
        "after": quality("printed", printed, ["priority", "confirmed", "order_day"]),
        "output": {"file": "'messy_orders_cleaned.csv'"},
    }
    rows = [(n, f, v) for n, fields in sections.items() for f, v in fields.items()]
    return f"""WITH {CLEAN_CSV},
printed AS (SELECT order_id, priority, confirmed, amount, qty, strftime(order_day, '%Y-%m-%d') AS order_day FROM c)
""" + _union([
        f"SELECT CAST({i} AS BIGINT) AS position, '{n}' AS section, '{f}' AS field, {v} AS value"
        for i, (n, f, v) in enumerate(rows)
    ])


def _after_profile() -> str:
    """The cleaned table as it is read back: dates are text again, empty text is missing."""
    columns = ["order_id", "priority", "confirmed", "amount", "qty", "order_day"]
    texts = ["priority", "confirmed", "order_day"]

    def metrics(label: str, source: str, columns: list[str], texts: list[str], fixed: int) -> str:
        rows = f"(SELECT count(*) FROM {source})"
        missing = f"(SELECT CAST(sum(missing) AS BIGINT) FROM ({_missing(source, columns)}))"
        duplicates = _duplicates(source, columns)
        mixed = f"(SELECT count(*) FROM ({_mixed(source, texts)}))"
        entries = {
            "columns": str(len(columns)), "duplicate_rows": duplicates, "missing_values": missing, "rows": rows,
            "memory_bytes": _bytes(source, texts, fixed),
            "quality_score": _score(rows, len(columns), missing, duplicates, mixed),
        }
        return _union([f"SELECT '{m}' AS metric, CAST({e} AS DOUBLE) AS {label}" for m, e in entries.items()])

    return f"""WITH {CLEAN},
printed AS (SELECT order_id, priority, confirmed, amount, qty, strftime(order_day, '%Y-%m-%d') AS order_day FROM c)
SELECT metric, before, after, after - before AS change
FROM ({metrics('before', 'mo', MESSY_COLUMNS, TEXTS, 16)}) FULL JOIN
     ({metrics('after', 'printed', columns, texts, 24)}) USING (metric)"""


_RECOMMENDED = f"""
SELECT CAST(0 AS BIGINT) AS message_order,
       concat(CAST({_duplicates('mo', MESSY_COLUMNS)} AS VARCHAR), ' repeated row(s) can be dropped') AS message
WHERE {_duplicates('mo', MESSY_COLUMNS)} > 0
UNION ALL
SELECT CAST(1000000 + position * 10 AS BIGINT),
       concat(CAST(missing AS VARCHAR), ' cell(s) of `', column_name, '` have no value')
FROM ({_missing('mo', MESSY_COLUMNS)}) WHERE missing > 0
UNION ALL
SELECT CAST(2000000 + pos * 10 + chk AS BIGINT), concat(head, column_name, tail) FROM (
  SELECT pos, column_name, avg(CAST({_day('value')} IS NOT NULL AS INT)) >= 0.9 AS dates,
         bool_or(value <> {_trim('value')}) AS untrimmed,
         avg(CAST(regexp_full_match(value, '{NUMBER}') AS INT)) >= 0.9 AS numbers
  FROM ({_union([
      f"SELECT * FROM (SELECT {MESSY_COLUMNS.index(c)} AS pos, '{c}' AS column_name, {c} AS value FROM mo "
      f"WHERE {c} IS NOT NULL)" for c in TEXTS])}) GROUP BY pos, column_name),
  (VALUES (0, '`', '` holds dates as text'),
          (1, '`', '` has values with outer white space'),
          (2, '`', '` holds numbers as text')) AS v(chk, head, tail)
WHERE (chk = 0 AND dates) OR (chk = 1 AND untrimmed) OR (chk = 2 AND numbers)"""


def _date_forms() -> str:
    """What each form keeps of the moment it was printed from."""
    day = "date_trunc('day', moment)"
    kept = {"H:%M:%S": "moment", "M": "date_trunc('minute', moment)"}
    arms = []
    for i, (_, form) in enumerate(DATE_FORMS):
        if form.startswith("on"):
            value = "NULL"
        elif ".25" in form:
            value = "moment + INTERVAL 250 MILLISECOND"
        elif "+02:00" in form:
            value = "moment - INTERVAL 2 HOUR"
        elif "%S" in form:
            value = kept["H:%M:%S"]
        elif "%M" in form:
            value = kept["M"]
        elif form == "%B %Y":
            value = "date_trunc('month', moment)"
        else:
            value = day
        arms.append((i, form, value))
    written = " ".join(f"WHEN {i} THEN strftime(moment, {_literal(form)})" for i, form, _ in arms)
    read = " ".join(f"WHEN {i} THEN {value}" for i, _, value in arms)
    return f"""
WITH m AS (SELECT o_orderkey AS order_id, date_trunc('day', o_orderdate) + to_seconds(o_orderkey % 86400) AS moment FROM orders)
SELECT order_id, CASE order_id % {len(DATE_FORMS)} {written} END AS written,
  strftime(CASE order_id % {len(DATE_FORMS)} {read} END, '%Y-%m-%d %H:%M:%S.%g') AS read,
  order_id % {len(DATE_FORMS)} <> {len(DATE_FORMS) - 1} AS known FROM m"""


def _dated_columns() -> str:
    """The view, and next to every text the day that it stands for."""

    def printed(name: str) -> str:
        _, form, years, other = DATE_COLUMNS[name]
        moved = f"(day + INTERVAL {years} YEAR)"
        text = f"strftime({moved}, {_literal(form)})"
        if other:
            text = f"CASE WHEN order_id % 10 = 0 THEN strftime({moved}, {_literal(other[1])}) ELSE {text} END"
        kept = f"date_trunc('month', {moved})" if name == "month" else moved
        return (f"CASE WHEN order_id % 40 = 3 THEN 'soon' ELSE {text} END AS {name}, "
                f"CASE WHEN order_id % 40 <> 3 THEN strftime({kept}, '%Y-%m-%d') END AS {name}_day")

    columns = ", ".join(printed(n) for n in DATE_COLUMNS)
    return f"""dated AS (
  SELECT order_id, day, {columns} FROM (SELECT o_orderkey AS order_id, date_trunc('day', o_orderdate) AS day FROM orders))"""


def _date_evidence() -> str:
    shapes = {
        "dotted": "MM.dd.yyyy", "american": "MM/dd/yy", "future": "MM/dd/yy", "packed": "yyyyMMdd", "mail": "EEE, d MMM yyyy",
        "named": "d-MMM-yy", "words": None,
    }
    others = {"future": "MM/dd/yyyy", "named": "MMM d, yyyy"}

    def shape(name: str) -> str:
        if name == "month":
            return "CASE WHEN strftime(day, '%B') = 'May' THEN 'MMM yyyy' ELSE 'MMMM yyyy' END"
        usual = "NULL" if shapes[name] is None else f"'{shapes[name]}'"
        return f"CASE WHEN order_id % 10 = 0 THEN '{others[name]}' ELSE {usual} END" if name in others else usual

    def part(name: str) -> str:
        years = DATE_COLUMNS[name][2]
        year = f"year(day + INTERVAL {years} YEAR)"
        written = {"american": "NULL", "future": f"CASE WHEN order_id % 10 = 0 THEN {year} END",
                   "named": f"CASE WHEN order_id % 10 = 0 THEN {year} END", "words": "NULL"}.get(name, year)
        return f"""SELECT '{name}' AS column_name, count(*) AS n_values,
  count(*) FILTER (order_id % 40 <> 3 AND {'false' if name == 'words' else 'true'}) AS n_dates,
  {'true' if name in ('dotted', 'future') else 'false'} AS day_first,
  CAST(coalesce(max({written}) FILTER (order_id % 40 <> 3), 2068) AS INTEGER) AS last_year,
  coalesce((SELECT string_agg(concat(shape, '=', n::VARCHAR), '; ' ORDER BY shape) FROM (SELECT {shape(name)} AS shape, count(*) AS n
   FROM dated WHERE order_id % 40 <> 3 GROUP BY 1) WHERE shape IS NOT NULL), '') AS shapes FROM dated"""

    return f"WITH {_dated_columns()} " + _union([part(n) for n in DATE_COLUMNS])


def _summary() -> str:
    def listed(entry: str, order: str, source: str) -> str:
        return f"coalesce((SELECT string_agg({entry}, '; ' ORDER BY {order}) FROM {source}), '')"

    types = "; ".join(
        f"{c}: {'bigint' if c == 'order_id' else 'double' if c == 'qty' else 'string'}" for c in MESSY_COLUMNS
    )
    statistics = "concat(column_name, ': n_values=', n_values::VARCHAR, " + ", ".join(
        f"' {s}=', printf('%.4f', {s})" for s in ("mean", "std", "min", "p25", "p50", "p75", "max")
    ) + ")"
    tops = f"""(SELECT u.column_name, u.pos, n_unique, tops FROM
      (SELECT column_name, pos, count(DISTINCT value) AS n_unique FROM ({_long('mo', TEXTS)}) GROUP BY column_name, pos) u
      LEFT JOIN (SELECT column_name, string_agg(concat(value, '=', n::VARCHAR), '|' ORDER BY value_rank) AS tops
                 FROM ({_top('mo', TEXTS, 5)}) GROUP BY column_name) USING (column_name))"""
    quality = _quality("mo", "mo", MESSY_COLUMNS, TEXTS)
    missing = f"({_missing('mo', MESSY_COLUMNS)})"
    lines = {
        "dataset": "'messy_orders'",
        "rows": "(SELECT count(*) FROM mo)::VARCHAR",
        "columns": "'8'",
        "column names": _literal(", ".join(MESSY_COLUMNS)),
        "column types": _literal(types),
        "missing cells": f"(SELECT CAST(sum(missing) AS BIGINT) FROM {missing})::VARCHAR",
        "missing cells by column": listed(
            "concat(column_name, ': ', missing::VARCHAR)", "position", f"{missing} WHERE missing > 0"),
        "repeated rows": f"{_duplicates('mo', MESSY_COLUMNS)}::VARCHAR",
        "bytes": f"{_bytes('mo', TEXTS, 16)}::VARCHAR",
        "numeric columns": listed(statistics, "pos", f"({_describe('mo', NUMERICS, None)})"),
        "text columns": listed(
            "concat(column_name, ': unique=', n_unique::VARCHAR, ' top=', tops)", "pos", tops),
        "quality score of 10": f"(SELECT quality_score FROM ({quality}))::VARCHAR",
        "advice":
            f"(SELECT string_agg(message, '; ' ORDER BY message_order) FROM ({_RECOMMENDED}))",
    }
    return f"WITH {MESSY}\n" + _union([f"SELECT '{k}' AS field, {v} AS value" for k, v in lines.items()])


def _kinds() -> str:
    cell = f"CASE WHEN value NOT IN {_in(CSV_NULL_TOKENS)} THEN value END"
    wide = "TRY_CAST(v AS HUGEINT)"
    return f"""WITH {CELLS},
marked AS (SELECT column_name, v, CASE
    WHEN v IS NULL THEN 'missing'
    WHEN regexp_full_match(v, '\\s*[+-]?[0-9]+\\s*') THEN
      CASE WHEN {wide} IS NULL OR {wide} > 18446744073709551615 OR {wide} < -9223372036854775808 THEN 'text'
           WHEN {wide} > 9223372036854775807 THEN 'big' WHEN {wide} < 0 THEN 'negative' ELSE 'whole' END
    WHEN regexp_full_match(v, '{NUMBER}') THEN 'real'
    WHEN v IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false') THEN 'flag'
    ELSE 'text' END AS mark FROM (SELECT column_name, {cell} AS v FROM ({_long('cells', CELL_COLUMNS)})))
SELECT column_name, CASE
    WHEN bool_and(mark = 'missing') THEN 'float64'
    WHEN bool_or(mark = 'text') THEN 'text'
    WHEN bool_and(mark IN ('flag', 'missing')) THEN CASE WHEN bool_or(mark = 'missing') THEN 'mixed_bool' ELSE 'bool' END
    WHEN bool_or(mark = 'flag') THEN 'text'
    WHEN bool_or(mark = 'real') THEN 'float64'
    WHEN bool_or(mark = 'big') THEN CASE WHEN bool_or(mark IN ('missing', 'negative')) THEN 'text' ELSE 'uint64' END
    WHEN bool_or(mark = 'missing') THEN 'float64' ELSE 'int64' END AS kind
FROM marked GROUP BY column_name"""


# rule, severity, condition on a select (s), a unit (u) or a statement (t) of the text, or on the whole.
_FROM = r"regexp_extract(s, '\bfrom\b(.*?)(?:\b(?:where|group|having|order|limit|window|qualify|fetch|for)\b|$)', 1)"
_WHERE = r"regexp_extract(u, '\bwhere\b(.*?)(?:\b(?:group|having|order|limit|window|qualify|fetch)\b|$)', 1)"
_RULES = {
    "select_star": ("Medium", "selects", r"regexp_matches(s, '^select (?:distinct |all )?\*')"),
    "select_without_where": ("Low", "selects", r"NOT regexp_matches(s, '\bwhere\b')"),
    "delete_without_where": ("High", "units", r"regexp_matches(u, '^delete\b') AND NOT regexp_matches(u, '\bwhere\b')"),
    "update_without_where": ("High", "units", r"regexp_matches(u, '^update\b') AND NOT regexp_matches(u, '\bwhere\b')"),
    "truncate": ("High", "statements", r"regexp_matches(t, '^truncate\b')"),
    "drop": ("High", "statements", r"regexp_matches(t, '^drop\b')"),
    "eq_null": ("Medium", "units", rf"regexp_matches(CASE WHEN regexp_matches(u, '^update\b') THEN {_WHERE} ELSE u END, "
                r"'(?:=|<>|!=) null\b')"),
    "leading_wildcard_like": ("Medium", "units", r"regexp_matches(u, '\bi?like ''%')"),
    "order_without_limit": (
        "Low", "selects", r"regexp_matches(s, '\border by\b') AND NOT regexp_matches(s, '\b(?:limit|fetch)\b')"),
    "function_on_column": (
        "Medium", "units", rf"len(list_filter(regexp_extract_all({_WHERE}, '(\w+) {FOLDED} (?:=|<|>|!)', 1), "
        f"lambda w: w NOT IN {_in(NO_CALLS)})) > 0"),
    "cartesian_join": (
        "High", "selects", rf"contains({_FROM}, ',') OR regexp_matches({_FROM}, '\bcross join\b') OR "
        rf"len(regexp_extract_all({_FROM}, '\bjoin\b')) - len(regexp_extract_all({_FROM}, '\bnatural\b')) > "
        rf"len(regexp_extract_all({_FROM}, '\b(?:on|using)\b'))"),
    "having_without_group": (
        "Medium", "selects", r"regexp_matches(s, '\bhaving\b') AND NOT regexp_matches(s, '\bgroup by\b')"),
    "unbalanced_parens": (
        "High", "", "length(replace(flat, '(', '')) <> length(replace(flat, ')', '')) OR regexp_matches(folded, '[()]')"),
    "injection_pattern": (
        "High", "", r"regexp_matches(flat, '\bor 1 = 1\b') OR len(statements) > 1 OR "
        r"coalesce(regexp_matches(tokens[-1], '^--\s*$'), false)"),
    "select_without_from": ("Medium", "selects", r"NOT regexp_matches(s, '\bfrom\b')"),
    "distinct_used": ("Low", "selects", r"regexp_matches(s, '^select distinct\b')"),
}


def _rule_test(looks_at: str, test: str) -> str:
    if not looks_at:
        return test
    name = {"selects": "s", "units": "u", "statements": "t"}[looks_at]
    return f"len(list_filter({looks_at}, lambda {name}: {test})) > 0"


def _asked(key: str, number: str) -> str:
    texts = ", ".join(_literal(q) for q in QUERY_TEXTS)
    return f"replace([{texts}][{key} % {len(QUERY_TEXTS)} + 1], '{{u}}', CAST({number} AS VARCHAR))"


_TOKEN = _literal(TOKEN.replace("*+", "*"))
_MAIN = (r"list_filter(list_transform({units}, lambda u: CASE WHEN regexp_matches(trim(u), '^with\b') "
         r"THEN regexp_extract(trim(u), '\b(?:select|insert|update|delete|merge)\b.*', 0) ELSE trim(u) END), lambda u: u <> '')")
_AUDITED = rf"""RECURSIVE logged AS (
  SELECT event_id AS id, user_id, concat(
    CASE WHEN event_id % 3 = 0 THEN concat('/* ', event_type, '; drop ( */ ') ELSE '' END, {_asked('event_id', 'user_id')},
    CASE WHEN event_id % 2 = 0 THEN concat(' -- at ', epoch_us(ts)::VARCHAR, '; delete '' or 1=1') ELSE '' END) AS input_text
  FROM events
  UNION ALL
  SELECT doc_id + 1000000000000, doc_id % 97, CASE (doc_id // {len(QUERY_TEXTS)}) % 7
    WHEN 0 THEN concat('/*', replace(text, '*/', ''), '*/', sql)
    WHEN 1 THEN concat(sql, ' ', line)
    WHEN 2 THEN concat('with c as (select a from t where b = ', lit, ') ', sql)
    WHEN 3 THEN concat('select x from (', sql, ') as "', replace(text, '"', '""'), '" where x = 1 limit 1')
    WHEN 4 THEN concat(replace(upper(sql), ' ', concat(chr(10), chr(9), ' ')), line)
    WHEN 5 THEN concat('select a from t where b in (', lit, ', (', sql, ')) limit 3')
    ELSE concat('select a from t where b = ', lit, ' limit 1 union all ', sql) END
  FROM (SELECT doc_id, text, {_asked('doc_id', 'n_chars')} AS sql, concat('''', replace(text, '''', ''''''), '''') AS lit,
          concat('--', replace(text, chr(10), ' '), chr(10)) AS line FROM documents)),
lexed AS (SELECT id, user_id, regexp_extract_all(input_text, {_TOKEN}) AS tokens FROM logged),
flattened AS (
  SELECT *, array_to_string(list_transform(
    list_filter(tokens, lambda t: NOT (starts_with(t, '--') OR starts_with(t, '/*'))),
    lambda t: CASE WHEN starts_with(t, '''%') THEN '''%''' WHEN starts_with(t, '''') THEN ''''''
      WHEN starts_with(t, '"') OR starts_with(t, '`') THEN '{NAME}' WHEN t = '{FOLDED}' THEN '?' ELSE lower(t) END), ' ') AS flat
  FROM lexed),
folding(id, n, folded, blocks) AS (
  SELECT id, 0, flat, CAST([] AS VARCHAR[]) FROM flattened
  UNION ALL
  SELECT id, n + 1, regexp_replace(folded, '\(([^()]*)\)', '{FOLDED}', 'g'),
    list_concat(blocks, regexp_extract_all(folded, '\(([^()]*)\)', 1)) FROM folding WHERE regexp_matches(folded, '\([^()]*\)')),
apart AS (
  SELECT f.id, user_id, tokens, flat, folded, {_MAIN.format(units="string_split(folded, ';')")} AS statements,
    {_MAIN.format(units="list_concat(string_split(folded, ';'), blocks)")} AS units
  FROM flattened f JOIN (SELECT id, arg_max(folded, n) AS folded, arg_max(blocks, n) AS blocks FROM folding GROUP BY id) USING (id)),
judged AS (
  SELECT *, list_filter(flatten(list_transform(units, lambda u: CASE WHEN regexp_matches(u, '^(?:grant|revoke|deny)\b')
    THEN CAST([] AS VARCHAR[]) ELSE list_transform(
      string_split_regex(u, '\b(?:union(?: all| distinct)?|intersect(?: all)?|except(?: all)?|minus)\b'),
      lambda p: regexp_extract(p, '\bselect\b.*', 0)) END)), lambda s: s <> '') AS selects FROM apart),
hits AS ({_union([
    f"SELECT id, user_id, '{rule}' AS rule, '{severity}' AS severity FROM judged WHERE {_rule_test(looks_at, test)}"
    for rule, (severity, looks_at, test) in _RULES.items()])})"""


def oracle_sql() -> dict[str, str]:
    mo = f"WITH {MESSY} "
    hist = f"WITH {HISTORY} "
    table_texts = TABLE_TEXTS.items()
    history_columns = "id, user_id, command, execution_time, success, duration_ms, created_at"
    return {
        "describe_numeric": "SELECT * EXCLUDE (pos) FROM (" + _describe("lineitem", [
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        ]) + ")",
        "dataset_shape": mo + _union([
            f"SELECT '{n}' AS table_name, count(*) AS n_rows, CAST({len(cols)} AS BIGINT) AS n_columns, "
            f"'{', '.join(cols)}' AS column_names FROM {source}" for n, (source, cols, _, _) in PROFILED.items()
        ]),
        "missing_by_column": mo + _union([
            f"SELECT '{n}' AS table_name, column_name, missing FROM ({_missing(source, cols)}) WHERE missing > 0"
            for n, (source, cols, _, _) in PROFILED.items()
        ]),
        "duplicate_count": mo + _union([
            f"SELECT '{n}' AS table_name, {_duplicates(source, cols)} AS duplicate_rows" for n, source, cols in (
                ("messy_orders", "mo", MESSY_COLUMNS), ("orders", "orders", ORDER_COLUMNS),
                ("documents", "documents", ["text", "lang", "source"]))
        ]),
        "byte_footprint": mo + "SELECT *, round(memory_bytes / 1048576.0, 2) AS memory_mb FROM (" + _union([
            f"SELECT '{n}' AS table_name, {_bytes(source, texts, fixed)} AS memory_bytes"
            for n, (source, _, texts, fixed) in PROFILED.items()
        ]) + ")",
        "distinct_counts": mo + _union([
            f"SELECT '{n}' AS table_name, column_name, count(DISTINCT value) AS n_unique FROM ({_long(source, cols)}) "
            "GROUP BY column_name" for n, (source, cols) in table_texts
        ]),
        "top_values": mo + _union([
            f"SELECT '{n}' AS table_name, * FROM ({_top(source, cols, 5)})" for n, (source, cols) in table_texts
        ]),
        "column_mode": mo + _union([
            f"SELECT '{n}' AS table_name, column_name, value AS mode_value, n FROM ({_top(source, cols, 1)})"
            for n, (source, cols) in table_texts
        ]),
        "inconsistent_columns": f"WITH {CELLS} " + _union([
            f"SELECT '{n}' AS table_name, * FROM ({_mixed(source, cols)})"
            for n, (source, cols) in [*table_texts, ("raw_cells", ("cells", CELL_COLUMNS))]
        ]),
        "quality_score": mo + _union([
            _quality(n, source, cols, texts) for n, (source, cols, texts, _) in PROFILED.items()
        ]),
        "recommendations": mo + _RECOMMENDED,
        "profile_summary": _summary(),
        "iqr_outliers": _union([
            _outliers("events", "events", ["event_id", "user_id", "value"]),
            _outliers("documents", "documents", ["doc_id", "n_chars"]),
            _outliers("lineitem", "lineitem", [
                "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax"]),
        ]),
        "sketch_profile": _union([
            f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS missing, {low} AS least, {high} AS greatest, "
            "true AS distinct_holds, true AS quartiles_hold, true AS counts_hold FROM events"
            for c, low, high in (("event_type", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"), *[
                (c, f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)") for c in ("user_id", "value")])
        ]),
        "infer_types": _kinds(),
        "null_tokens": f"WITH {CELLS} SELECT " + ", ".join(
            f"CASE WHEN {c} NOT IN {_in(CSV_NULL_TOKENS)} THEN {c} END AS {c}" for c in CELL_COLUMNS
        ) + " FROM cells",
        "snake_case_names": r"""
SELECT p_partkey, heading, trim(lower(regexp_replace(trim(regexp_replace(trim(heading, {ws}),
       '[^\p{{L}}\p{{N}}_{spaces}]', '', 'g'), {ws}), '([{spaces}]|_)+', '_', 'g')), '_') AS snake_name
FROM (SELECT p_partkey, concat(' ', upper(substr(p_name, 1, instr(p_name, ' '))[1]),
             substr(p_name, 2, instr(p_name, ' ') - 1), upper(substr(p_name, instr(p_name, ' ') + 1, 1)),
             substr(p_name, instr(p_name, ' ') + 2), ' – (', p_brand, ') Größe_', CAST(p_size AS VARCHAR),
             chr(160), ' %__', lower(p_type), ' ') AS heading FROM part)""".format(ws=WS, spaces=SPACES[1:-2]),
        "renamed_columns": mo + "SELECT *, qty AS qty_2, qty AS qty_2_2 FROM mo",
        "trim_strings": mo + "SELECT order_id, qty, " + ", ".join(f"{_trim(c)} AS {c}" for c in TEXTS) + " FROM mo",
        "missing_tokens": mo + _union([
            f"SELECT '{c}' AS column_name, count(*) FILTER ({_trim(c)} IN {_in(MISSING_TOKENS)}) AS tokens FROM mo"
            for c in TEXTS
        ]),
        "fill_median": mo + "SELECT order_id, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM mo)) AS qty FROM mo",
        "fill_mode": mo + ", t AS (SELECT order_id, " + ", ".join(
            f"{_token_null(c)} AS {c}" for c in ("priority", "amount", "empty_col")
        ) + ") SELECT order_id, ".replace(")", " FROM mo)", 1) + ", ".join(
            f"coalesce({c}, {_mode('t', c)}, 'Unknown') AS {c}" for c in ("priority", "amount", "empty_col")
        ) + " FROM t",
        "to_numeric": mo + f"""SELECT order_id, CASE WHEN
 (SELECT avg(CAST(({_number(_plain('amount'))}) IS NOT NULL AS INT)) FROM mo WHERE amount IS NOT NULL) >= 0.9
 THEN {_number(_plain('amount'))} END AS amount, priority, order_day FROM mo""",
        "to_datetime": mo + f"""SELECT order_id, CASE WHEN
 (SELECT avg(CAST({_day('order_day')} IS NOT NULL AS INT)) FROM mo WHERE order_day IS NOT NULL) >= 0.9
 THEN strftime({_day('order_day')}, '%Y-%m-%d %H:%M:%S') END AS order_day, priority FROM mo""",
        "date_forms": _date_forms(),
        "date_evidence": _date_evidence(),
        "to_datetime_evidence": f"WITH {_dated_columns()} SELECT order_id, " + ", ".join(
            c if c == "words" else f"{c}_day AS {c}" for c in DATE_COLUMNS) + " FROM dated",
        "date_export": mo + f"""SELECT order_id, CASE WHEN
 (SELECT avg(CAST({_day('order_day')} IS NOT NULL AS INT)) FROM mo WHERE order_day IS NOT NULL) >= 0.9
 THEN coalesce(strftime({_day('order_day')}, '%Y-%m-%d'), '') ELSE order_day END AS order_day FROM mo""",
        "parse_ratio": mo + _union([
            f"SELECT '{n}' AS table_name, column_name, count(value) AS n_values, "
            f"round(count({_number(_plain('value'))}) / nullif(count(value), 0), 6) AS numeric_ratio, "
            f"round(count({_day('value')}) / nullif(count(value), 0), 6) AS date_ratio FROM ({_long(source, cols)}) "
            "GROUP BY column_name" for n, (source, cols) in table_texts
        ]) + f"""
UNION ALL SELECT 'dated_orders', 'written', count(*), round(count(*) FILTER (written SIMILAR TO '[0-9]{{8}}') / count(*), 6),
  round(count(read) / count(*), 6) FROM ({_date_forms()})""",
        "canonical_categories": mo + "SELECT order_id, " + ", ".join(
            f"CASE WHEN {_is_category('mo', c)} THEN {_canonical(c)} ELSE {c} END AS {c}" for c in ("confirmed", "priority")
        ) + " FROM mo",
        "collapse_ws": f"SELECT doc_id, regexp_replace(text, '{SPACES}', ' ', 'g') AS text FROM documents",
        "dedup_rows": mo + "SELECT DISTINCT * FROM mo",
        "drop_empty_rows": mo + "SELECT * FROM mo WHERE " + " OR ".join(f"{c} IS NOT NULL" for c in MESSY_COLUMNS),
        "drop_null_columns": mo + "SELECT column_name FROM (" + _missing("mo", MESSY_COLUMNS)
        + ") WHERE missing = (SELECT count(*) FROM mo)",
        "drop_constant_columns": mo + "SELECT column_name, n_values FROM (" + _union([
            f"SELECT '{c}' AS column_name, count({c}) AS n_values, count(DISTINCT {c}) AS n FROM mo" for c in MESSY_COLUMNS
        ]) + ") WHERE n <= 1",
        "clean_rows": f"""WITH {CLEAN} SELECT order_id, priority, confirmed, amount, qty,
 strftime(order_day, '%Y-%m-%d %H:%M:%S') AS order_day FROM c""",
        "cleaning_report": f"""WITH {CLEAN}
SELECT rows_before, rows_after, rows_before - rows_after AS rows_removed, CAST(8 AS BIGINT) AS columns_before,
       8 - n_gone AS columns_after, duplicates_removed, empty_rows_removed,
       (SELECT count(*) FROM gone WHERE pos = 1) AS empty_columns_removed, tokens_normalized,
       duplicates_removed + empty_rows_removed + n_gone + {len(HEADING_NAMES)}
         + (SELECT count(*) FROM shares WHERE number_share >= 0.9 OR date_share >= 0.9) AS total_changes,
       columns_removed, concat_ws(', ', numbers_made, dates_made) AS columns_converted,
       CASE WHEN {_is_category('f', 'confirmed')} THEN 'confirmed' ELSE '' END AS categories_standardized,
       {_literal('; '.join(f'{o}={n}' for o, n in sorted(HEADING_NAMES.items())))} AS renamed_columns,
       (SELECT string_agg(concat(column_name, '=', n::VARCHAR), '; ' ORDER BY column_name) FROM filled)
         AS missing_values_filled,
       coalesce((SELECT string_agg(concat(column_name, '=', n_outliers::VARCHAR, ' outside ',
         printf('%.2f..%.2f', lower_bound, upper_bound)), '; ' ORDER BY column_name) FROM outliers), '') AS outlier_summary,
       duplicates_removed > 0 AS has_removed_duplicates, empty_rows_removed > 0 AS has_removed_empty_rows,
       n_gone > 0 AS has_removed_columns, numbers_made IS NOT NULL OR dates_made IS NOT NULL AS has_converted_columns
FROM counts""",
        "cleaning_actions": f"WITH {CLEAN} {_ACTIONS}",
        "before_after": _after_profile(),
        "dataset_report": _report(),
        "landing_audit": f"""
SELECT path, length, CASE WHEN NOT lower(path) LIKE '%.csv' THEN 'extension' WHEN length = 0 THEN 'empty'
       WHEN length > 30000 THEN 'too_large' WHEN broken THEN 'not_text' ELSE 'ok' END AS verdict
FROM (SELECT concat('f', n::VARCHAR, CASE WHEN n % 11 = 0 THEN '.txt' WHEN n % 3 = 0 THEN '.CSV' ELSE '.csv' END) AS path,
             n % 5 = 0 AND bool_or(doc_id % 7 = 0) AS broken,
             CAST(CASE WHEN n % 13 = 0 THEN 0 ELSE sum(octet_length(encode(text)) + 1
               + CASE WHEN doc_id % 7 = 0 AND n % 5 = 0 THEN 2 ELSE 0 END) END AS BIGINT) AS length
      FROM (SELECT *, doc_id % {LANDED_FILES} AS n FROM documents) GROUP BY n)""",
        "safe_names": """
WITH named AS (SELECT doc_id, concat('../data/', CASE WHEN doc_id % 9 = 0 THEN '???'
    ELSE concat(source, ' répört (', lang, ')') END, '.v1.CSV') AS file_name,
  CAST(1767225600 + doc_id // 100 AS BIGINT) AS uploaded_second FROM documents),
based AS (SELECT *, concat(strftime(make_timestamp(uploaded_second * 1000000), '%Y%m%d_%H%M%S'), '_',
  trim(regexp_replace(regexp_replace(parse_filename(file_name), '\\.[^.]+$', ''), '[^A-Za-z0-9_.-]+', '_', 'g'), '_'))
  AS base FROM named)
SELECT doc_id, file_name, uploaded_second, concat(base, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY base)
  THEN concat('~', CAST(doc_id AS VARCHAR)) ELSE '' END, '.csv') AS safe_name FROM based""",
        "csv_scan": mo + f"""SELECT CAST(order_id AS DOUBLE) AS order_id, CAST(NULL AS DOUBLE) AS empty_col, qty,
 {', '.join(f"CASE WHEN {c} NOT IN {_in(CSV_NULL_TOKENS)} THEN {c} END AS {c}"
            for c in TEXTS if c != 'empty_col')} FROM mo""",
        "csv_scan_multiline": "SELECT doc_id, n_chars, " + ", ".join(
            f"CASE WHEN {c} NOT IN {_in(CSV_NULL_TOKENS)} THEN {c} END AS {c}" for c in ("text", "lang", "source")
        ) + " FROM documents",
        "clean_export": f"""WITH {CLEAN} SELECT CAST(CAST(order_id AS DOUBLE) AS VARCHAR) AS order_id, priority, confirmed,
 CAST(amount AS VARCHAR) AS amount, CAST(qty AS VARCHAR) AS qty, strftime(order_day, '%Y-%m-%d') AS order_day FROM c""",
        "upload_stream": mo + f"""SELECT 'dataset' AS command, CAST(0 AS BIGINT) AS n_failed, count(*) AS rows_before,
 (SELECT count(*) FROM (SELECT DISTINCT * FROM mo) WHERE NOT ({' AND '.join(f'{c} IS NULL' for c in MESSY_COLUMNS)}))
   AS rows_after FROM mo""",
        "history_recent": hist + f"SELECT {history_columns} FROM hist ORDER BY created_at DESC, id DESC LIMIT 10",
        "history_by_user": hist
        + f"SELECT {history_columns} FROM hist WHERE user_id = 7 ORDER BY created_at DESC, id DESC LIMIT 20",
        "history_by_command": hist
        + f"SELECT {history_columns} FROM hist WHERE command = 'click' ORDER BY created_at DESC, id DESC LIMIT 20",
        "history_failures": hist
        + f"SELECT {history_columns} FROM hist WHERE success = 0 ORDER BY created_at DESC, id DESC LIMIT 10",
        "history_stats": hist + """SELECT count(*) AS total_commands, count(*) FILTER (success = 1) AS successful_commands,
 count(*) FILTER (success = 0) AS failed_commands, round(coalesce(avg(execution_time), 0.0), 4) AS average_execution_time,
 round(coalesce(avg(duration_ms), 0.0), 4) AS average_duration_ms FROM hist""",
        "history_by_type": hist + "SELECT command, count(*) AS n FROM hist GROUP BY command ORDER BY n DESC, command",
        "history_top_command": hist + "SELECT command AS most_used_command FROM hist GROUP BY command "
        "ORDER BY count(*) DESC, command LIMIT 1",
        "history_exists": hist + "SELECT count(*) > 0 AS history_exists FROM hist",
        "history_append": hist + """SELECT id, CAST(user_id AS VARCHAR) AS user_id, command,
 concat('input ', CAST(id AS VARCHAR)) AS input_text, 'batch' AS provider, execution_time, success,
 CASE WHEN success = 0 THEN 'failed' END AS error_message, duration_ms,
 strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM hist""",
        "history_delete_user": hist + """SELECT command, count(*) AS n_left,
 (SELECT count(*) FROM hist WHERE user_id = 7) AS n_deleted FROM hist WHERE user_id <> 7 GROUP BY command""",
        "history_stored_reads": f"""WITH {HISTORY}, numbered AS ({_NUMBERED}),
shown AS (SELECT id, CAST(user_id AS VARCHAR) AS user_id, command, execution_time, success, duration_ms,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, created_at AS moment FROM numbered)
""" + _union([
            f"SELECT '{kind}' AS kind, * EXCLUDE (moment) FROM (SELECT * FROM shown {where} ORDER BY moment DESC, id DESC LIMIT {n})"
            for kind, where, n in (("recent", "", 10), ("user", "WHERE user_id = '7'", 20),
                                   ("command", "WHERE command = 'click'", 20), ("failures", "WHERE success = 0", 10))]),
        "history_gapless_ids": f"WITH {HISTORY} SELECT id, CAST(user_id AS VARCHAR) AS user_id, command, duration_ms "
        f"FROM ({_NUMBERED})",
        "history_kept_totals": hist + """SELECT count(*) AS total_commands, count(*) FILTER (success = 1) AS successful_commands,
 count(*) FILTER (success = 0) AS failed_commands, round(coalesce(avg(execution_time), 0.0), 4) AS average_execution_time,
 round(coalesce(avg(duration_ms), 0.0), 4) AS average_duration_ms,
 (SELECT count(*) FROM hist WHERE user_id = 7) AS n_deleted, count(*) AS rows_left, CAST(0 AS BIGINT) AS of_user,
 true AS fewer_files FROM hist WHERE user_id <> 7""",
        "parse_commands": f"""
WITH m AS (SELECT conv_id, turn, CASE (conv_id + turn) % 8 WHEN 0 THEN concat('<@U1> explain ', text)
    WHEN 1 THEN concat('<@U1> CLEAN   ', text) WHEN 2 THEN concat('<@U1> cleanup ', text) WHEN 3 THEN '<@U1> optimize'
    WHEN 4 THEN concat('hello <@U1> ', text) WHEN 5 THEN concat('  Validate <@U2>', chr(10), text)
    WHEN 6 THEN concat('<@U1>generate', text) ELSE text END AS text FROM conversations),
s AS (SELECT *, trim(regexp_replace(text, '<@[^>]+>', '', 'g'), {WS}) AS said FROM m),
w AS (SELECT *, lower(regexp_extract(said, '^(explain|clean|generate|optimize|validate)', 1, 'i')) AS command FROM s),
a AS (SELECT conv_id, turn, command, trim(substr(said, length(command) + 1), {WS}) AS argument FROM w WHERE command <> '')
SELECT *, argument = '' AS missing_input FROM a""",
        "csv_shares": """
WITH f AS (SELECT doc_id, concat_ws('_', source, lang, CAST(doc_id AS VARCHAR)) AS stem FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(stem, '.csv') WHEN doc_id % 3 = 0 THEN concat(stem, '.CSV')
  WHEN doc_id % 2 = 0 THEN concat(stem, 'b.Csv') END AS file_name FROM f)
SELECT doc_id, file_name, concat('https://files/', file_name) AS file_url FROM n WHERE file_name IS NOT NULL""",
        "audit_rules": f"WITH {_AUDITED} SELECT * FROM hits",
        "audit_by_rule": f"WITH {_AUDITED} SELECT rule, severity, user_id, count(*) AS n FROM hits "
        "GROUP BY rule, severity, user_id",
        "scalar_functions": """
SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(left(text, 100), '...') ELSE text END AS preview,
       CAST(trunc(n_chars / 7.0::DOUBLE * 1000) AS BIGINT) AS duration_ms,
       round(octet_length(encode(text)) * 1000 / 1048576.0::DOUBLE, 2) AS megabytes,
       CAST(n_chars / 8.0::DOUBLE AS VARCHAR) AS eighth, false AS numeric_lang,
       strftime(make_timestamp(n_chars * 86400000000), '%Y-%m-%d') AS day FROM documents""",
    }
