"""Schema catalog jobs over the derived per-example ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import catalog as K
from quarry.plans.q_text import DUCK_EXTRACT, extracted
from quarry.plans.registry import query
from quarry.plans.views import view, with_views


@query("join_paths", oracle=with_views("""
SELECT DISTINCT a.context_id, a.tbl, a.col, b.tbl AS other
FROM catalog a JOIN catalog b ON a.context_id = b.context_id AND a.col = b.col AND a.tbl <> b.tbl AND b.pk > 0"""))
def join_paths(spark, sf_dir):
    return K.join_paths(view(spark, sf_dir, "catalog"))


@query("ambiguous_columns", oracle=with_views("""
SELECT context_id, col, string_agg(DISTINCT tbl, ', ' ORDER BY tbl) AS tables
FROM catalog GROUP BY context_id, col HAVING COUNT(DISTINCT tbl) > 1"""))
def ambiguous_columns(spark, sf_dir):
    return K.shared_columns(view(spark, sf_dir, "catalog"))


_D_BLOCK = """
tl AS (SELECT context_id, tbl,
              '--   ' || tbl || ': ' || string_agg(col || CASE WHEN coalesce(type, '') <> '' THEN '(' || type || ')' ELSE '' END, ', ' ORDER BY ordinal)
              || coalesce('   [primary key: ' || string_agg(CASE WHEN pk > 0 THEN col END, ', ' ORDER BY ordinal) || ']', '') AS line
       FROM catalog GROUP BY context_id, tbl),
t AS (SELECT context_id, string_agg(line, chr(10) ORDER BY tbl) AS lines FROM tl GROUP BY context_id),
jp AS (SELECT DISTINCT a.context_id, '--   ' || a.tbl || '.' || a.col || ' = ' || b.tbl || '.' || a.col AS l
       FROM catalog a JOIN catalog b ON a.context_id = b.context_id AND a.col = b.col AND a.tbl <> b.tbl AND b.pk > 0),
j AS (SELECT context_id, string_agg(l, chr(10) ORDER BY l) AS lines FROM jp GROUP BY context_id),
sh AS (SELECT context_id, col, '--   ' || col || ': ' || string_agg(DISTINCT tbl, ', ' ORDER BY tbl) AS l
       FROM catalog GROUP BY context_id, col HAVING COUNT(DISTINCT tbl) > 1),
s AS (SELECT context_id, string_agg(l, chr(10) ORDER BY col) AS lines FROM sh GROUP BY context_id),
blk AS (SELECT t.context_id,
               '-- Column index. Each column belongs to exactly the table listed here;' || chr(10) ||
               '-- qualify every column with its own table and do not move one between tables.' || chr(10) || t.lines
               || coalesce(chr(10) || '-- Join paths:' || chr(10) || j.lines, '')
               || coalesce(chr(10) || '-- These column names appear in several tables, so always qualify them:' || chr(10) || s.lines, '') AS block
        FROM t LEFT JOIN j USING (context_id) LEFT JOIN s USING (context_id))"""


@query("enrich_schema", oracle=with_views(f"""
WITH {_D_BLOCK}
SELECT e.example_id AS context_id,
       CASE WHEN blk.block IS NULL THEN e.sql_context
            ELSE regexp_replace(e.sql_context, '\\s+$', '') || chr(10) || chr(10) || blk.block END AS enriched
FROM examples e LEFT JOIN blk ON e.example_id = blk.context_id"""))
def enrich_schema(spark, sf_dir):
    e = view(spark, sf_dir, "examples").select(F.col("example_id").alias("context_id"), "sql_context")
    return K.enrich_schema(e, view(spark, sf_dir, "catalog"))


_P = "\\b([A-Za-z_][A-Za-z0-9_]*)\\.([A-Za-z_][A-Za-z0-9_]*)\\b"
_FI = "(?i)\\b(?:FROM|JOIN)\\s+([A-Za-z_][A-Za-z0-9_]*)(?:\\s+(?:AS\\s+)?([A-Za-z_][A-Za-z0-9_]*))?"


@query("grounding_errors", oracle=with_views(f"""
WITH {DUCK_EXTRACT},
q AS (SELECT example_id AS context_id, model AS query_id, sql FROM extracted x
      WHERE EXISTS (SELECT 1 FROM catalog c WHERE c.context_id = x.example_id)),
refs AS (SELECT context_id, query_id, unnest(regexp_extract_all(sql, '{_P}', 1)) AS alias,
                unnest(regexp_extract_all(sql, '{_P}', 2)) AS col FROM q),
items AS (SELECT context_id, query_id, unnest(regexp_extract_all(sql, '{_FI}', 1)) AS tbl,
                 unnest(regexp_extract_all(sql, '{_FI}', 2)) AS alias FROM q),
amap AS (SELECT context_id, query_id, tbl, alias FROM items WHERE alias <> ''
         UNION SELECT context_id, query_id, tbl, tbl AS alias FROM items),
res AS (SELECT r.context_id, r.query_id, r.alias, r.col, m.tbl FROM refs r JOIN amap m USING (context_id, query_id, alias)),
miss AS (SELECT * FROM res r WHERE NOT EXISTS (
           SELECT 1 FROM catalog c WHERE c.context_id = r.context_id AND c.tbl = r.tbl AND c.col = r.col)),
own AS (SELECT context_id, col, string_agg(DISTINCT tbl, ', ' ORDER BY tbl) AS owners FROM catalog GROUP BY context_id, col)
SELECT DISTINCT m.context_id, m.query_id, m.alias, m.tbl, m.col, coalesce(o.owners, '') AS owners
FROM miss m LEFT JOIN own o USING (context_id, col)"""))
def grounding_errors(spark, sf_dir):
    q = extracted(spark, sf_dir).select(F.col("example_id").alias("context_id"),
                                        F.col("model").alias("query_id"), "sql")
    return K.grounding_errors(q, view(spark, sf_dir, "catalog"))


SAMPLE_ROWS = 2


@query("enrich_schema_samples")
def enrich_schema_samples(spark, sf_dir):
    """Enrichment block with the first rows of every table (WIN-9)."""
    from quarry.operators import execute as X
    e = view(spark, sf_dir, "examples").select(F.col("example_id").alias("context_id"), "sql_context")
    smp = X.sample_rows_scan(e.select("context_id", F.col("sql_context").alias("context")), SAMPLE_ROWS)
    return K.enrich_schema(e, view(spark, sf_dir, "catalog"), samples=smp)
