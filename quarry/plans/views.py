"""Derived views over the test tables.

The test tables hold no questions, queries or predictions, so these views
make them at the grain of ``orders`` / ``lineitem`` (their work grows with the
data).  Each view is spelled once, in SQL that Spark and DuckDB both run:
only ``md5``, ``substr``, ``instr``, integer ``%``, ``CASE``, ``||``, ``chr``,
``lower``, ``replace`` and casts.  No randomness: every choice is a hex digit
of an ``md5`` or a residue of a key.

Spark side: ``view(spark, sf_dir, name)``.  Oracle side: ``with_views(sql)``
prefixes the SQL with the CTEs it needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import TABLES, register

NL = "chr(10)"


def hexd(expr: str, k: int) -> str:
    """k-th hex digit (1-based) of md5(expr) as an integer 0..15."""
    return f"(instr('0123456789abcdef', substr(md5({expr}), {k}, 1)) - 1)"


def s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


# -- fixed values: complexity class per gold template, in template order -----
CLASS_NAMES = ["basic SQL", "aggregation", "single join", "multiple_joins",
               "subqueries", "set operations", "window functions", "basic SQL"]


def class_of(t: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASS_NAMES))
    return f"(CASE {t} {whens} END)"


_K, _C = "o_orderkey", "o_custkey"
_STATUS = "o_orderstatus"
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"

GOLD = f"""(CASE {_K} % 8
  WHEN 0 THEN 'SELECT order_id, total FROM orders WHERE customer_id = ' || {s(_C)}
  WHEN 1 THEN 'SELECT COUNT(*) FROM orders WHERE status = ''' || {_STATUS} || '''; '
  WHEN 2 THEN 'SELECT c.name, o.total FROM orders o JOIN customers c ON o.customer_id = c.customer_id WHERE o.order_id = ' || {s(_K)}
  WHEN 3 THEN 'SELECT n.region, COUNT(*) FROM orders o JOIN customers c ON o.customer_id = c.customer_id JOIN nations n ON c.country = n.country GROUP BY n.region ORDER BY n.region'
  WHEN 4 THEN 'SELECT order_id FROM orders WHERE total > (SELECT AVG(total) FROM orders)'
  WHEN 5 THEN 'SELECT customer_id FROM orders UNION SELECT customer_id FROM customers'
  WHEN 6 THEN 'SELECT order_id, RANK() OVER (ORDER BY total DESC) AS rnk FROM orders'
  ELSE 'UPDATE orders SET status = ''F'' WHERE order_id = ' || {s(_K)}
END)"""

_DDL = ("'CREATE TABLE customers (customer_id INTEGER PRIMARY KEY, name TEXT, country TEXT);' || chr(10) || "
        "'CREATE TABLE orders (order_id INTEGER PRIMARY KEY, customer_id INTEGER, total REAL, status TEXT);' || chr(10) || "
        "'CREATE TABLE nations (country TEXT PRIMARY KEY, region TEXT);'")


def _ins(broken: bool) -> str:
    # SQL literal that closes the last value: ') + ';' (or a stray extra ')')
    close = "'''));'" if broken else "''');'"
    return (f"chr(10) || 'INSERT INTO customers VALUES (' || {s(_C)} || ', ''Customer ' || {s(_C)} "
            f"|| ''', ''NATION_' || {s(f'{_C} % 25')} || ''');' || chr(10) || "
            f"'INSERT INTO orders VALUES (' || {s(_K)} || ', ' || {s(_C)} || ', ' || {_PRICE} "
            f"|| ', ''' || {_STATUS} || '''), (' || {s(f'{_K} + 1000000000')} || ', ' || {s(_C)} "
            f"|| ', 10.5, ''O'');' || chr(10) || "
            f"'INSERT INTO nations VALUES (''NATION_' || {s(f'{_C} % 25')} || ''', ''REGION_' "
            f"|| {s(f'{_C} % 5')} || {close}")


CONTEXT = f"""(CASE {_K} % 5
  WHEN 0 THEN {_DDL} || {_ins(False)}
  WHEN 1 THEN lower({_DDL} || {_ins(False)})
  WHEN 2 THEN 'customers: customer_id, name, country' || chr(10) || 'orders: order_id, customer_id, total, status'
  WHEN 3 THEN {_DDL}
  ELSE {_DDL} || {_ins(True)}
END)"""

QUESTION = f"""(CASE {_K} % 6
  WHEN 0 THEN 'For each country, find the top 2 customers by total order value.'
  WHEN 1 THEN 'What percentage of orders are completed?'
  WHEN 2 THEN 'List the orders of customer ' || {s(_C)} || ', excluding cancelled ones.'
  WHEN 3 THEN 'How many orders did customer ' || {s(_C)} || ' place?'
  WHEN 4 THEN 'Show the highest 3 orders by total.'
  ELSE 'Which regions have customers with orders?'
END)"""

EXAMPLES = f"""
SELECT {_K} AS example_id,
       CASE {_K} % 3 WHEN 0 THEN 'gretel' WHEN 1 THEN 'createcontext' ELSE 'multilevel' END AS source,
       o_orderpriority AS domain,
       {CONTEXT} AS sql_context,
       {QUESTION} AS question,
       {GOLD} AS gold_sql,
       CASE WHEN {_K} % 3 = 1 THEN NULL ELSE 'ex' || {s(_K)} END AS ext_id,
       CASE WHEN {_K} % 3 <> 0 THEN NULL WHEN {_K} % 4 = 0 THEN '' ELSE {class_of(f'{_K} % 8')} END AS given_class
FROM orders"""

# Raw rows as the two sources ship them (their own column names).
SOURCE_A = """
SELECT sql_context, question AS sql_prompt, gold_sql AS sql, domain,
       given_class AS sql_complexity, ext_id AS id
FROM examples WHERE source = 'gretel'"""

SOURCE_B = """
SELECT sql_context AS context, question, gold_sql AS answer
FROM examples WHERE source = 'createcontext'"""

_GOLD_E = "e.gold_sql"
_EID = "e.example_id"


def _raw(model: str) -> str:
    key = f"'{model}:' || {s(_EID)}"
    return f"""(CASE {hexd(key, 1)} % 7
  WHEN 0 THEN '```sql' || chr(10) || {_GOLD_E} || chr(10) || '```'
  WHEN 1 THEN '```SQL' || chr(10) || {_GOLD_E} || chr(10) || '```' || chr(10) || 'This query answers it.'
  WHEN 2 THEN 'Here is the query:' || chr(10) || '  ' || {_GOLD_E} || chr(10) || 'Hope it helps.'
  WHEN 3 THEN 'The answer is ' || {_GOLD_E} || ' as requested'
  WHEN 4 THEN CASE WHEN {hexd(key, 2)} % 2 = 0 THEN 'I cannot help with that request.' ELSE 'DROP TABLE orders' END
  WHEN 5 THEN {_GOLD_E} || '; DROP TABLE orders;'
  ELSE CASE WHEN {hexd(key, 2)} % 2 = 0
            THEN 'SELECT o.country, SUM(o.total) FROM orders o GROUP BY o.country'
            ELSE 'SELECT COUNT(*) FROM orders WHERE customer_id = ' || {s(f'{_EID} + 1')} END
END)"""


PREDICTIONS = f"""
SELECT {_EID} AS example_id, 'base' AS model, {_raw('base')} AS raw FROM examples e
UNION ALL
SELECT {_EID} AS example_id, 'tuned' AS model, {_raw('tuned')} AS raw FROM examples e
WHERE {_EID} % 17 <> 0"""

RUNS = ["r1", "r2", "r3", "r4"]


def _outcome(run: str) -> str:
    b = f"'o|' || {s('example_id')}"
    f = hexd(f"'{run}|' || {s('example_id')}", 1)
    base_ok = f"({hexd(b, 1)} < 12)"
    ok = base_ok if run == "base" else (
        f"(CASE WHEN {base_ok} THEN NOT ({f} = 0) ELSE ({f} < 3) END)")
    return (f"SELECT example_id, '{run}' AS run, {class_of('example_id % 8')} AS class, "
            f"({ok} OR {hexd(b, 2)} < 10) AS runs, {ok} AS exec_ok, "
            f"({ok} AND {hexd(b, 3)} < 6) AS exact FROM examples")


OUTCOMES = "\nUNION ALL\n".join(_outcome(r) for r in ["base"] + RUNS)

_Q = "'SELECT * FROM orders WHERE order_id = ' || " + s("example_id")


def _cand(phase: str, attempt: int, cond: str, sql: str, err: str, lint: str) -> str:
    return (f"SELECT example_id, '{phase}' AS phase, {attempt} AS attempt, {sql} AS sql, "
            f"{err} AS err, {lint} AS lint_n FROM examples WHERE {cond}")


_P = "example_id % 7"
CANDIDATES = "\nUNION ALL\n".join([
    _cand("first", 0, "TRUE", _Q,
          f"CASE {_P} WHEN 1 THEN 'query error: no such column: x' "
          f"WHEN 2 THEN 'query error: misuse of window function rank()' "
          f"WHEN 3 THEN 'query error: ambiguous column name: id' "
          f"WHEN 6 THEN 'only read queries are executed in this demo' ELSE NULL END",
          f"CASE {_P} WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END"),
    _cand("repair", 1, f"{_P} IN (1, 2, 3)",
          f"CASE {_P} WHEN 1 THEN '' WHEN 2 THEN {_Q} ELSE 'SELECT order_id FROM orders' END",
          "CAST(NULL AS STRING)", "0"),
    _cand("repair", 2, f"{_P} IN (1, 2)",
          f"CASE {_P} WHEN 1 THEN 'SELECT order_id, total FROM orders' ELSE 'SELECT 2 FROM nowhere' END",
          f"CASE {_P} WHEN 2 THEN 'query error: no such table: nowhere' ELSE NULL END", "0"),
    _cand("lint", 1, f"{_P} IN (4, 5)",
          f"CASE {_P} WHEN 4 THEN 'SELECT total FROM orders' ELSE 'SELECT bad FROM orders' END",
          f"CASE {_P} WHEN 5 THEN 'query error: no such column: bad' ELSE NULL END",
          f"CASE {_P} WHEN 4 THEN 1 ELSE 0 END"),
    _cand("lint", 2, f"{_P} IN (4, 5)",
          f"CASE {_P} WHEN 4 THEN 'WITH a AS (SELECT total FROM orders) SELECT * FROM a' ELSE {_Q} END",
          "CAST(NULL AS STRING)", "0"),
])

_GOLD_ROW = ("SELECT l_orderkey AS example_id, 'gold' AS side, l_linenumber AS row_idx, "
             "l_partkey AS c_int, l_extendedprice AS c_num, l_returnflag AS c_txt FROM lineitem")
RESULT_ROWS = f"""
{_GOLD_ROW}
UNION ALL
SELECT l_orderkey AS example_id, 'pred' AS side,
       CASE WHEN l_orderkey % 5 = 0 THEN 100 - l_linenumber ELSE l_linenumber END AS row_idx,
       l_partkey AS c_int,
       CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 1 THEN l_extendedprice + 1.0
            ELSE l_extendedprice + 0.000001 END AS c_num,
       CASE WHEN l_orderkey % 3 = 0 THEN ' ' || l_returnflag || chr(10) ELSE l_returnflag END AS c_txt
FROM lineitem WHERE NOT (l_orderkey % 11 = 0 AND l_linenumber = 1)
UNION ALL
SELECT l_orderkey AS example_id, 'pred' AS side, 0 AS row_idx, l_partkey AS c_int,
       l_extendedprice AS c_num, l_returnflag AS c_txt
FROM lineitem WHERE l_orderkey % 13 = 0 AND l_linenumber = 1"""

# -- fixed values: the columns of the example schema (table, column, ordinal,
#    declared type, primary-key flag), as CREATE TABLE declares them ---------
SCHEMA_COLUMNS = [
    ("customers", "customer_id", 0, "INTEGER", 1),
    ("customers", "name", 1, "TEXT", 0),
    ("customers", "country", 2, "TEXT", 0),
    ("orders", "order_id", 0, "INTEGER", 1),
    ("orders", "customer_id", 1, "INTEGER", 0),
    ("orders", "total", 2, "REAL", 0),
    ("orders", "status", 3, "TEXT", 0),
    ("nations", "country", 0, "TEXT", 1),
    ("nations", "region", 1, "TEXT", 0),
]


def _values(rows, names) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(names)})"


# one copy per context variant whose script builds (0, 1 lower case, 3 empty);
# SQLite reports the standard type names in upper case whatever the script says
SCHEMA_COLS_SQL = f"SELECT * FROM {_values([(v, t, c, o, ty, pk) for v in (0, 1, 3) for (t, c, o, ty, pk) in SCHEMA_COLUMNS], ['v', 'tbl', 'col', 'ordinal', 'type', 'pk'])}"

# One catalog per example whose script builds.
CATALOG = """
SELECT e.example_id AS context_id, c.tbl, c.col, c.ordinal, c.type, c.pk
FROM examples e JOIN schema_columns c ON e.example_id % 5 = c.v"""

# -- fixed values: measured accuracy and share per complexity class ----------
CLASS_STATS_ROWS = [
    ("basic SQL", 0.885, 0.550),
    ("aggregation", 0.704, 0.237),
    ("single join", 0.632, 0.127),
    ("subqueries", 0.692, 0.043),
    ("window functions", 0.300, 0.033),
    ("multiple_joins", 0.500, 0.007),
    ("set operations", 0.500, 0.003),
]
CLASS_STATS = (f"SELECT class, CAST(acc AS DOUBLE) AS acc, CAST(share AS DOUBLE) AS share "
               f"FROM {_values(CLASS_STATS_ROWS, ['class', 'acc', 'share'])}")

_V = "CAST(CAST(value AS DECIMAL(18,2)) AS STRING)"
_FRAME = f"""(CASE event_id % 9
  WHEN 0 THEN 'data: {{"data": "step ' || {s('event_id')} || ' loss ' || {_V} || '"}}'
  WHEN 1 THEN '{{"message": "epoch ' || {s('user_id')} || ' ' || event_type || '"}}'
  WHEN 2 THEN 'data: {{"text": "eval ' || {_V} || '"}}'
  WHEN 3 THEN 'data: {{"data": "", "message": "fallback ' || {s('event_id')} || '"}}'
  WHEN 4 THEN 'plain text line ' || {s('event_id')} || '   '
  WHEN 5 THEN ''
  WHEN 6 THEN CASE WHEN event_type = 'error' AND event_id % 4 = 2 THEN 'data: END_OF_LOG' ELSE 'data: {{"data": ""}}' END
  WHEN 7 THEN 'data:   {{"message": "  spaced ' || event_type || '  "}}'
  ELSE 'data: not json ' || event_type
END)"""
LOG_FRAMES = f"""
SELECT user_id % 16 AS stream_id, event_id AS line_no, {_FRAME} AS value FROM events
UNION ALL
SELECT user_id % 16 AS stream_id, event_id AS line_no, {_FRAME} AS value FROM events
WHERE event_id % 10 = 0"""

# Lines with their time of arrival: some come again within the hour after a
# reconnect, a few once more weeks later.
LOG_ARRIVALS = """
SELECT user_id % 16 AS stream_id, event_id AS line_no, ts AS arrived, 'first' AS copy FROM events
UNION ALL
SELECT user_id % 16 AS stream_id, event_id AS line_no, ts + INTERVAL '1' HOUR AS arrived, 'near' AS copy FROM events
WHERE event_id % 10 = 0
UNION ALL
SELECT user_id % 16 AS stream_id, event_id AS line_no, ts + INTERVAL '20' DAY AS arrived, 'far' AS copy FROM events
WHERE event_id % 70 = 0"""

REQUESTS = f"""
SELECT example_id AS request_id,
       CASE WHEN example_id % 43 = 0 THEN repeat(sql_context, 200) ELSE sql_context END AS schema,
       CASE WHEN example_id % 31 = 0 THEN '' WHEN example_id % 37 = 0 THEN '   ' ELSE question END AS question,
       CASE WHEN {hexd("'t|' || " + s('example_id'), 1)} < 4 THEN NULL
            ELSE {hexd("'t|' || " + s('example_id'), 1)} * 40 END AS max_tokens,
       CASE WHEN {hexd("'t|' || " + s('example_id'), 2)} < 4 THEN NULL
            ELSE CAST({hexd("'t|' || " + s('example_id'), 2)} - 6 AS DOUBLE) / 5 END AS temperature
FROM examples"""

# One served request per example: kind, outcome flags and latency.
E2E_RESULTS = f"""
SELECT example_id, question, {class_of('example_id % 8')} AS kind,
       CASE WHEN example_id % 29 = 0 THEN 'failed' ELSE 'ok' END AS status,
       example_id % 7 <> 6 AS executed,
       example_id % 7 <> 6 AND {hexd("'e|' || " + s('example_id'), 1)} < 13 AS correct,
       example_id % 7 IN (1, 3, 4) AS repaired,
       1.0 + CAST({hexd("'e|' || " + s('example_id'), 2)} AS DOUBLE) / 8 AS seconds
FROM examples"""

# Execution accuracy per example, model and prompt kind (bare or enriched schema).
def _prompt_outcome(model: str, kind: str) -> str:
    d = hexd(f"'{model}/{kind}|' || {s('example_id')}", 1)
    return (f"SELECT example_id, '{model}' AS model, '{kind}' AS prompt_kind, "
            f"{d} < {12 if model == 'tuned' else 11} + {1 if kind == 'enriched' else 0} AS exec_ok "
            f"FROM examples")


PROMPT_OUTCOMES = "\nUNION ALL\n".join(
    _prompt_outcome(m, k) for m in ("base", "tuned") for k in ("bare", "enriched"))

# Server-sent event lines of result streams: "event:" and "data:" lines, a
# blank line after every frame; the event name carries over to later frames.
_EV = f"""(CASE WHEN event_type = 'purchase' THEN 'event: complete'
                WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'event: error'
                WHEN event_type = 'view' THEN 'event: heartbeat'
                ELSE '' END)"""
_DATA = f"""(CASE WHEN event_type = 'purchase'
                 THEN 'data: ["SELECT ' || {s('event_id')} || '", "| n |", {{"executed": true, "row_count": ' || {s('user_id')} || '}}]'
                 WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'data: null'
                 WHEN event_type = 'error' THEN 'data: backend failed ' || {s('event_id')}
                 ELSE 'data: {{"progress": ' || {s('event_id % 100')} || '}}' END)"""
SSE_LINES = f"""
SELECT user_id AS stream_id, event_id * 3 AS line_no, {_EV} AS line FROM events WHERE {_EV} <> ''
UNION ALL
SELECT user_id AS stream_id, event_id * 3 + 1 AS line_no, {_DATA} AS line FROM events
UNION ALL
SELECT user_id AS stream_id, event_id * 3 + 2 AS line_no, '' AS line FROM events"""

# name -> (sql, dependencies)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "examples": (EXAMPLES, ()),
    "source_a": (SOURCE_A, ("examples",)),
    "source_b": (SOURCE_B, ("examples",)),
    "predictions": (PREDICTIONS, ("examples",)),
    "outcomes": (OUTCOMES, ("examples",)),
    "candidates": (CANDIDATES, ("examples",)),
    "result_rows": (RESULT_ROWS, ()),
    "schema_columns": (SCHEMA_COLS_SQL, ()),
    "catalog": (CATALOG, ("examples", "schema_columns")),
    "class_stats": (CLASS_STATS, ()),
    "log_frames": (LOG_FRAMES, ()),
    "log_arrivals": (LOG_ARRIVALS, ()),
    "requests": (REQUESTS, ("examples",)),
    "e2e_results": (E2E_RESULTS, ("examples",)),
    "prompt_outcomes": (PROMPT_OUTCOMES, ("examples",)),
    "sse_lines": (SSE_LINES, ()),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in VIEWS[n][1]:
            visit(d)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def views_used(sql: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]


def with_views(sql: str) -> str:
    """Prefix DuckDB SQL with CTEs for every derived view it mentions."""
    names = _order(views_used(sql))
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in names)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


_REGISTERED: dict[tuple[int, str], str] = {}


def _base_tables(names) -> list[str]:
    return [t for t in TABLES if any(re.search(rf"\b{t}\b", VIEWS[n][0]) for n in names)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of a derived view.  Registers the base tables and
    views it depends on, once per session and data folder."""
    order = _order([name])
    key = id(spark)
    todo_tables = [t for t in _base_tables(order) if _REGISTERED.get((key, t)) != sf_dir]
    if todo_tables:
        register(spark, sf_dir, todo_tables)
        for t in todo_tables:
            _REGISTERED[(key, t)] = sf_dir
    for n in order:
        if _REGISTERED.get((key, n)) != sf_dir or todo_tables:
            spark.sql(VIEWS[n][0]).createOrReplaceTempView(n)
            _REGISTERED[(key, n)] = sf_dir
    return spark.table(name)
