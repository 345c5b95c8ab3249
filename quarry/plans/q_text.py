"""Text and guard functions over the derived ``predictions`` / ``examples``
(TXT-1..8, FLT-1, FLT-6, FLT-7, SEL helpers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.registry import query
from quarry.plans.views import view, with_views

KW = "(?:WITH|SELECT|INSERT|UPDATE|DELETE)"

# DuckDB twin of extract_sql, used by several oracles
DUCK_EXTRACT = f"""
ex_b AS (
  SELECT p.*, CASE WHEN regexp_matches(raw, '(?is)```(?:sql)?\\s*(.*?)```')
                   THEN regexp_extract(raw, '(?is)```(?:sql)?\\s*(.*?)```', 1) ELSE raw END AS b
  FROM predictions p),
ex_q AS (
  SELECT *, regexp_extract(b, '(?ims)(^\\s*{KW}\\b.*)', 1) AS ls,
            regexp_extract(b, '(?is)^.*\\b({KW}\\b.*)$', 1) AS la
  FROM ex_b),
extracted AS (
  SELECT example_id, model, raw,
         regexp_replace(split_part(CASE WHEN ls <> '' THEN ls ELSE la END, ';', 1), '^\\s+|\\s+$', '', 'g') AS sql
  FROM ex_q)"""

DUCK_NORM = ("lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), "
             "';+$', ''), '\\s+', ' ', 'g'), '\\s*([(),])\\s*', '\\1', 'g'))")

DUCK_CLASS = """CASE
  WHEN regexp_matches({x}, '(?i)\\bOVER\\s*\\(') THEN 'window functions'
  WHEN regexp_matches({x}, '(?i)\\b(UNION|INTERSECT|EXCEPT)\\b') THEN 'set operations'
  WHEN regexp_matches({x}, '(?i)\\(\\s*SELECT\\b') THEN 'subqueries'
  WHEN len(regexp_extract_all({x}, '(?i)\\bJOIN\\b')) > 1 THEN 'multiple_joins'
  WHEN len(regexp_extract_all({x}, '(?i)\\bJOIN\\b')) = 1 THEN 'single join'
  WHEN regexp_matches({x}, '(?i)\\b(COUNT|SUM|AVG|MIN|MAX|GROUP\\s+BY|HAVING)\\b') THEN 'aggregation'
  ELSE 'basic SQL' END"""


def extracted(spark, sf_dir):
    p = view(spark, sf_dir, "predictions")
    return p.select("example_id", "model", "raw", T.extract_sql("raw").alias("sql"))


@query("extract_sql", oracle=with_views(f"WITH {DUCK_EXTRACT} SELECT example_id, model, sql FROM extracted"),
       bench=True)
def extract_sql_q(spark, sf_dir):
    return extracted(spark, sf_dir).select("example_id", "model", "sql")


@query("normalize_sql", oracle=with_views(
    f"SELECT example_id, {DUCK_NORM.format(x='gold_sql')} AS norm FROM examples"))
def normalize_sql_q(spark, sf_dir):
    e = view(spark, sf_dir, "examples")
    return e.select("example_id", T.normalize_sql("gold_sql").alias("norm"))


@query("exact_match", oracle=with_views(f"""
WITH {DUCK_EXTRACT}
SELECT x.example_id, x.model,
       {DUCK_NORM.format(x='x.sql')} = {DUCK_NORM.format(x='e.gold_sql')} AS exact
FROM extracted x JOIN examples e ON x.example_id = e.example_id"""))
def exact_match_q(spark, sf_dir):
    x = extracted(spark, sf_dir)
    e = view(spark, sf_dir, "examples").select("example_id", "gold_sql")
    return (x.join(e, "example_id")
            .select("example_id", "model",
                    (T.normalize_sql("sql") == T.normalize_sql("gold_sql")).alias("exact")))


@query("classify_sql", oracle=with_views(
    f"SELECT example_id, {DUCK_CLASS.format(x='gold_sql')} AS class FROM examples"))
def classify_sql_q(spark, sf_dir):
    e = view(spark, sf_dir, "examples")
    return e.select("example_id", T.classify_sql("gold_sql").alias("class"))


_DUCK_LINT = """[
  CASE WHEN regexp_matches(e.question, '(?i)\\b(?:top|highest|best|largest|bottom|lowest)\\s+(\\d+|two|three|five|ten)\\b')
        AND regexp_matches(x.sql, '(?i)\\b(?:RANK|DENSE_RANK|ROW_NUMBER)\\s*\\(\\s*\\)\\s*OVER')
        AND NOT regexp_matches(x.sql, '(?i)\\bWHERE\\b[^;]*\\b(?:rnk|rank|rn|row_num|position)\\b|\\bQUALIFY\\b|\\bLIMIT\\b')
       THEN 'topn_rank_unfiltered' END,
  CASE WHEN regexp_matches(e.question, '(?i)\\b(percentage|percent|share|proportion|fraction|ratio of)\\b')
        AND regexp_matches(x.sql, '(?i)\\bOVER\\s*\\(') AND regexp_matches(x.sql, '(?i)\\bGROUP\\s+BY\\b')
        AND NOT regexp_matches(x.sql, '(?i)^\\s*WITH\\b')
       THEN 'share_window_same_select' END,
  CASE WHEN regexp_matches(e.question, '(?i)\\b(exclude|excluding|only|completed|cancelled|canceled|active|pending|shipped|delivered|returned)\\b')
        AND NOT regexp_matches(x.sql, '(?i)\\bWHERE\\b')
       THEN 'restriction_without_where' END]"""


def _lint_frame(spark, sf_dir):
    x = extracted(spark, sf_dir).where(F.col("sql") != "")
    e = view(spark, sf_dir, "examples").select("example_id", "question")
    return x.join(e, "example_id").select(
        "example_id", "model", T.lint_flags("question", "sql").alias("flags"))


@query("lint_flags", oracle=with_views(f"""
WITH {DUCK_EXTRACT},
f AS (SELECT x.example_id, x.model, {_DUCK_LINT} AS a
      FROM extracted x JOIN examples e ON x.example_id = e.example_id WHERE x.sql <> '')
SELECT example_id, model, concat_ws(',', a[1], a[2], a[3]) AS flags FROM f"""))
def lint_flags_q(spark, sf_dir):
    return _lint_frame(spark, sf_dir).select(
        "example_id", "model", F.array_join("flags", ",").alias("flags"))


@query("lint_counts", oracle=with_views(f"""
WITH {DUCK_EXTRACT},
f AS (SELECT x.model, unnest({_DUCK_LINT}) AS issue
      FROM extracted x JOIN examples e ON x.example_id = e.example_id WHERE x.sql <> '')
SELECT model, issue, COUNT(*) AS n FROM f WHERE issue IS NOT NULL GROUP BY model, issue"""))
def lint_counts_q(spark, sf_dir):
    return (_lint_frame(spark, sf_dir)
            .select("model", F.explode("flags").alias("issue"))
            .groupBy("model", "issue").agg(F.count(F.lit(1)).alias("n")))


@query("guard_flags", oracle=with_views(f"""
WITH {DUCK_EXTRACT}
SELECT example_id, model,
       regexp_matches(sql, '(?i)^\\s*(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|REPLACE)\\b') AS writes,
       (sql = '' AND regexp_matches(raw, '(?i)\\b(DROP|ALTER|TRUNCATE|ATTACH|PRAGMA)\\b')) AS destructive
FROM extracted"""))
def guard_flags_q(spark, sf_dir):
    x = extracted(spark, sf_dir)
    return x.select("example_id", "model", T.writes("sql").alias("writes"),
                    T.destructive_without_sql("raw", "sql").alias("destructive"))


@query("error_hints", oracle=with_views("""
SELECT example_id, phase, attempt,
       CASE WHEN strpos(lower(coalesce(err, '')), 'window function') > 0 THEN 'window function'
            WHEN strpos(lower(coalesce(err, '')), 'no such column') > 0 THEN 'no such column'
            WHEN strpos(lower(coalesce(err, '')), 'no such table') > 0 THEN 'no such table'
            WHEN strpos(lower(coalesce(err, '')), 'ambiguous column') > 0 THEN 'ambiguous column'
            ELSE '' END AS hint
FROM candidates"""))
def error_hints_q(spark, sf_dir):
    c = view(spark, sf_dir, "candidates")
    return c.select("example_id", "phase", "attempt", T.repair_hint_key("err").alias("hint"))


@query("error_taxonomy", oracle=with_views(f"""
WITH {DUCK_EXTRACT},
first AS (
  SELECT CASE WHEN sql = '' AND regexp_matches(raw, '(?i)\\b(DROP|ALTER|TRUNCATE|ATTACH|PRAGMA)\\b') THEN 'read_only'
              WHEN sql = '' THEN 'no_sql'
              WHEN regexp_matches(sql, '(?i)^\\s*(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|REPLACE)\\b') THEN 'read_only'
              ELSE 'executable' END AS cls, model
  FROM extracted)
SELECT model, cls, COUNT(*) AS n FROM first GROUP BY model, cls"""))
def error_taxonomy_q(spark, sf_dir):
    """Pre-execution verdict of the serving path: no SQL, read-only refusal
    (destructive completion or write statement), or goes to execution."""
    x = extracted(spark, sf_dir)
    cls = (F.when(T.destructive_without_sql("raw", "sql"), "read_only")
           .when(F.col("sql") == "", "no_sql")
           .when(T.writes("sql"), "read_only")
           .otherwise("executable"))
    return x.groupBy("model", cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_has_ddl", oracle=with_views(
    "SELECT example_id FROM examples WHERE coalesce(strpos(upper(sql_context), 'CREATE TABLE') > 0, FALSE)"))
def filter_has_ddl_q(spark, sf_dir):
    e = view(spark, sf_dir, "examples")
    return e.where(T.has_ddl("sql_context")).select("example_id")


@query("normalize_cells", oracle=with_views("""
SELECT example_id, side, row_idx, c_int,
       CAST(CAST(ROUND(c_num, 4) AS DECIMAL(38,4)) AS VARCHAR) AS c_num,
       regexp_replace(c_txt, '^\\s+|\\s+$', '', 'g') AS c_txt
FROM result_rows"""))
def normalize_cells_q(spark, sf_dir):
    r = view(spark, sf_dir, "result_rows")
    return r.select("example_id", "side", "row_idx", "c_int",
                    T.norm_num("c_num").alias("c_num"), T.norm_text("c_txt").alias("c_txt"))
