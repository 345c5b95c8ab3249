"""Text functions over columns of queries and completions.

All are native Column expressions (regex functions run in the JVM inside
whole-stage codegen); none is a Python UDF.  Java regex and Python ``re``
agree on every construct used here for ASCII text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values: patterns that must equal the reference's behaviour --------
SQL_KEYWORD = "(?:WITH|SELECT|INSERT|UPDATE|DELETE)"
FENCE = r"(?is)```(?:sql)?\s*(.*?)```"
LINE_START = r"(?im)^\s*" + SQL_KEYWORD + r"\b"
LAST_KEYWORD = r"(?is)^.*\b(" + SQL_KEYWORD + r"\b.*)$"
ORDER_BY = r"(?i)\border\s+by\b"
AGG_WORDS = r"(?i)\b(COUNT|SUM|AVG|MIN|MAX|GROUP\s+BY|HAVING)\b"
JOIN_WORD = r"(?i)\bJOIN\b"
WINDOW_CALL = r"(?i)\bOVER\s*\("
SET_OP = r"(?i)\b(UNION|INTERSECT|EXCEPT)\b"
SUBQUERY = r"(?i)\(\s*SELECT\b"
WRITE_STATEMENT = r"(?i)^\s*(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|REPLACE)\b"
DESTRUCTIVE = r"(?i)\b(DROP|ALTER|TRUNCATE|ATTACH|PRAGMA)\b"
TOP_N = r"(?i)\b(?:top|highest|best|largest|bottom|lowest)\s+(\d+|two|three|five|ten)\b"
RANK_FN = r"(?i)\b(?:RANK|DENSE_RANK|ROW_NUMBER)\s*\(\s*\)\s*OVER"
RANK_FILTERED = r"(?i)\bWHERE\b[^;]*\b(?:rnk|rank|rn|row_num|position)\b|\bQUALIFY\b|\bLIMIT\b"
GROUP_BY = r"(?i)\bGROUP\s+BY\b"
WITH_CTE = r"(?i)^\s*WITH\b"
SHARE_WORDS = r"(?i)\b(percentage|percent|share|proportion|fraction|ratio of)\b"
RESTRICT_WORDS = (r"(?i)\b(exclude|excluding|only|completed|cancelled|canceled|active|pending|"
                  r"shipped|delivered|returned)\b")
HAS_WHERE = r"(?i)\bWHERE\b"
# complexity classes, in the order they are tested
CLASSES = ["window functions", "set operations", "subqueries", "multiple_joins",
           "single join", "aggregation", "basic SQL"]
# repair hints: (needle in the lower-cased error, hint key), first match wins
REPAIR_NEEDLES = ["window function", "no such column", "no such table", "ambiguous column"]
REPAIR_HINT_TEXT = {
    "window function": ("\nSQLite does not allow window functions in WHERE or HAVING. "
                        "Compute the window expression in a subquery or CTE, then filter "
                        "the outer query on its result."),
    "no such column": ("\nOne of the columns does not exist. Re-read the CREATE TABLE "
                       "statements and use only the column names written there."),
    "no such table": "\nOne of the tables does not exist. Use only the tables in the schema above.",
    "ambiguous column": "\nQualify every column with its table alias.",
}
LINT_CODES = ["topn_rank_unfiltered", "share_window_same_select", "restriction_without_where"]
READ_ONLY_ERROR = "only read queries are executed in this demo"
NO_SQL_ERROR = "model produced no SQL"
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


WHITESPACE = " \t\n\x0b\f\r"  # the characters of Java's \s


def strip(x) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (Spark ``trim`` strips
    spaces only); ``btrim`` with an explicit set, no regex engine."""
    return F.btrim(_c(x), F.lit(WHITESPACE))


def extract_sql(raw) -> Column:
    """First fenced block if any; from the first line that starts with a SQL
    keyword, else from the last keyword anywhere, else ''; cut at the first
    ``;`` and strip (TXT-1)."""
    raw = _c(raw)
    # cheap substring test first: most completions have no fence at all
    fenced = raw.contains("```") & raw.rlike(FENCE)
    body = F.when(fenced, F.regexp_extract(raw, FENCE, 1)).otherwise(raw)
    pos = F.regexp_instr(body, F.lit(LINE_START))
    picked = (F.when(pos > 0, body.substr(pos, F.length(body) + 1))
              .otherwise(F.regexp_extract(body, LAST_KEYWORD, 1)))
    return strip(F.split_part(F.coalesce(picked, F.lit("")), F.lit(";"), F.lit(1)))


def normalize_sql(sql) -> Column:
    """strip, right-strip ';', squeeze whitespace, no space around ( ) , and
    lower case (TXT-2)."""
    x = F.regexp_replace(strip(sql), ";+$", "")
    x = F.regexp_replace(x, r"\s+", " ")
    x = F.regexp_replace(x, r"\s*([(),])\s*", "$1")
    return F.lower(x)


def classify_sql(sql) -> Column:
    """window > set op > subquery > 2+ joins > 1 join > aggregate > basic (TXT-4)."""
    sql = _c(sql)
    joins = F.regexp_count(sql, F.lit(JOIN_WORD))
    return (F.when(sql.rlike(WINDOW_CALL), "window functions")
            .when(sql.rlike(SET_OP), "set operations")
            .when(sql.rlike(SUBQUERY), "subqueries")
            .when(joins > 1, "multiple_joins")
            .when(joins == 1, "single join")
            .when(sql.rlike(AGG_WORDS), "aggregation")
            .otherwise("basic SQL"))


def is_ordered(gold_sql) -> Column:
    """Does the gold text ask for an order (anywhere in the text)?"""
    return _c(gold_sql).rlike(ORDER_BY)


def lint_flags(question, sql) -> Column:
    """Array of structural issues of a query that runs (TXT-5)."""
    q, s = _c(question), _c(sql)
    a = F.when(q.rlike(TOP_N) & s.rlike(RANK_FN) & ~s.rlike(RANK_FILTERED), F.lit(LINT_CODES[0]))
    b = F.when(q.rlike(SHARE_WORDS) & s.rlike(WINDOW_CALL) & s.rlike(GROUP_BY) & ~s.rlike(WITH_CTE),
               F.lit(LINT_CODES[1]))
    c = F.when(q.rlike(RESTRICT_WORDS) & ~s.rlike(HAS_WHERE), F.lit(LINT_CODES[2]))
    return F.array_compact(F.array(a, b, c))


def repair_hint_key(error) -> Column:
    """Needle of the first repair hint whose needle occurs in the error (TXT-6)."""
    low = F.lower(F.coalesce(_c(error), F.lit("")))
    out = None
    for needle in REPAIR_NEEDLES:
        cond = low.contains(needle)
        out = F.when(cond, F.lit(needle)) if out is None else out.when(cond, F.lit(needle))
    return out.otherwise(F.lit(""))


def repair_hint_text(error) -> Column:
    key = repair_hint_key(error)
    m = F.create_map(*[x for k, v in REPAIR_HINT_TEXT.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[key], F.lit(""))


def error_class(err) -> Column:
    """no_sql / read_only / schema_error / query_error / ok (TXT-7)."""
    e = _c(err)
    return (F.when(e.isNull(), "ok")
            .when(e == NO_SQL_ERROR, "no_sql")
            .when(e.startswith("only read"), "read_only")
            .when(e.startswith("schema error:"), "schema_error")
            .when(e.startswith("query error:"), "query_error")
            .otherwise("other"))


def writes(sql) -> Column:
    """Statement starts with a write/DDL keyword (FLT-6)."""
    return _c(sql).rlike(WRITE_STATEMENT)


def destructive_without_sql(raw, sql) -> Column:
    """Raw completion names a destructive command and no SQL was found (FLT-7)."""
    return (_c(sql) == "") & _c(raw).rlike(DESTRUCTIVE)


def has_ddl(ctx) -> Column:
    """Context contains CREATE TABLE in any case; NULL context is false (FLT-1)."""
    return F.coalesce(F.upper(_c(ctx)).contains("CREATE TABLE"), F.lit(False))


def norm_num(x) -> Column:
    """Cell normalisation for numbers: 4 decimals, as canonical text (TXT-8);
    NaN, the infinities and numbers of over 34 digits keep the text of a double."""
    n = F.round(_c(x).cast("double"), 4)
    return F.coalesce(n.try_cast("decimal(38,4)").cast("string"), n.cast("string"))


def norm_text(x) -> Column:
    return strip(x)


def word_tokens(text) -> Column:
    """Token count stand-in: words and single punctuation marks (TXT-9)."""
    return F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit(r"\w+|[^\w\s]")).cast("long")
