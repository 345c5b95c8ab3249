"""Best-candidate choice over the derived ``candidates`` (SEL-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import select as SEL
from quarry.plans.registry import query
from quarry.plans.views import view, with_views

_D_SELECT = """
first AS (SELECT example_id, sql AS sql0, err AS err0, lint_n AS lint0 FROM candidates WHERE phase = 'first'),
rep0 AS (SELECT c.example_id, c.attempt, c.sql, c.err, c.lint_n,
                (c.sql <> '') AS has, (c.sql = f.sql0) AS same,
                (c.sql <> '' AND c.sql <> f.sql0 AND c.err IS NULL) AS ok
         FROM candidates c JOIN first f USING (example_id)
         WHERE c.phase = 'repair' AND f.err0 IS NOT NULL AND NOT starts_with(f.err0, 'only read')),
rep1 AS (SELECT *, MIN(CASE WHEN ok THEN attempt END) OVER (PARTITION BY example_id) AS win FROM rep0),
rep AS (SELECT * FROM rep1 WHERE win IS NULL OR attempt <= win),
ragg AS (SELECT example_id, MIN(win) AS win,
                arg_max(sql, attempt) FILTER (WHERE has) AS repair_sql,
                arg_max(CASE WHEN NOT has THEN 'the repair attempt produced no SQL'
                             WHEN same THEN 'the model returned the same query unchanged' ELSE err END, attempt) AS last_msg,
                arg_min(sql, attempt) FILTER (WHERE ok) AS wsql,
                arg_min(lint_n, attempt) FILTER (WHERE ok) AS wlint
         FROM rep GROUP BY example_id),
st AS (SELECT f.example_id, f.sql0, f.err0, r.repair_sql,
              coalesce(f.err0 IS NOT NULL AND NOT starts_with(f.err0, 'only read'), FALSE) AS repair_attempted,
              (r.win IS NOT NULL) AS repaired1,
              CASE WHEN r.win IS NOT NULL THEN r.wsql ELSE f.sql0 END AS sql1,
              CASE WHEN r.win IS NOT NULL THEN NULL ELSE f.err0 END AS err1,
              CASE WHEN r.win IS NOT NULL THEN r.wlint ELSE f.lint0 END AS lint1,
              array_to_string(list_transform(range(1, CASE WHEN r.win IS NOT NULL THEN r.wlint ELSE f.lint0 END + 1), lambda i: 'issue ' || i), ' ') AS issues1,
              CASE WHEN r.win IS NOT NULL OR NOT coalesce(f.err0 IS NOT NULL AND NOT starts_with(f.err0, 'only read'), FALSE)
                   THEN NULL ELSE r.last_msg END AS repair_error
       FROM first f LEFT JOIN ragg r USING (example_id)),
lint AS (SELECT c.example_id,
                arg_min(c.sql, c.attempt) FILTER (WHERE c.sql <> '' AND c.sql <> s.sql1 AND c.err IS NULL AND c.lint_n = 0) AS lint_sql
         FROM candidates c JOIN st s USING (example_id)
         WHERE c.phase = 'lint' AND s.err1 IS NULL AND s.lint1 > 0 GROUP BY c.example_id),
chosen AS (
  SELECT s.example_id,
         CASE WHEN l.lint_sql IS NOT NULL THEN l.lint_sql ELSE s.sql1 END AS sql,
         s.err1 IS NULL AS executed, s.err1 AS error,
         (s.repaired1 OR l.lint_sql IS NOT NULL) AS repaired,
         s.repair_attempted, s.repair_sql, s.repair_error,
         CAST(CASE WHEN l.lint_sql IS NOT NULL OR s.err1 IS NOT NULL THEN 0 ELSE s.lint1 END AS INTEGER) AS lint_n,
         l.lint_sql IS NOT NULL AS lint_fixed,
         CASE WHEN l.lint_sql IS NULL AND s.err1 IS NULL AND s.lint1 > 0 THEN s.issues1 END AS lint_issues,
         CASE WHEN l.lint_sql IS NOT NULL THEN s.sql1 WHEN s.repair_attempted THEN s.sql0 END AS first_attempt_sql,
         CASE WHEN l.lint_sql IS NOT NULL THEN 'structural: ' || s.issues1 WHEN s.repair_attempted THEN s.err0 END AS first_attempt_error
  FROM st s LEFT JOIN lint l USING (example_id))"""


def _attempts(spark, sf_dir):
    """Attempts with a text for each issue of the lint."""
    texts = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.col("lint_n")), lambda i: i > 0), lambda i: F.concat(F.lit("issue "), i.cast("string"))), " ")
    return view(spark, sf_dir, "candidates").withColumn("issues", texts)


@query("select_candidate", oracle=with_views(f"WITH {_D_SELECT} SELECT * FROM chosen"))
def select_candidate(spark, sf_dir):
    return SEL.select_candidate(_attempts(spark, sf_dir))


@query("repair_stats", oracle=with_views(f"""
WITH {_D_SELECT}
SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE executed) AS executed,
       COUNT(*) FILTER (WHERE repair_attempted) AS repair_attempted,
       COUNT(*) FILTER (WHERE repaired) AS repaired, COUNT(*) FILTER (WHERE lint_fixed) AS lint_fixed,
       COUNT(*) FILTER (WHERE lint_n > 0) AS lint_open,
       COUNT(*) FILTER (WHERE repair_attempted AND NOT executed) AS still_failing
FROM chosen"""))
def repair_stats(spark, sf_dir):
    return SEL.repair_stats(SEL.select_candidate(_attempts(spark, sf_dir)))
