"""Evaluation report, run comparison and preference pairs over the derived
``outcomes`` / ``predictions`` / ``examples`` views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import chat
from quarry.functions import text as T
from quarry.operators import report as R
from quarry.plans.q_text import DUCK_CLASS, DUCK_EXTRACT
from quarry.plans.registry import query
from quarry.plans.views import RUNS, view, with_views


def _outcomes(spark, sf_dir):
    return view(spark, sf_dir, "outcomes")


_RATES = """COUNT(*) AS n,
       ROUND(AVG(CAST(exec_ok AS DOUBLE)), 4) AS execution_accuracy,
       ROUND(AVG(CAST(runs AS DOUBLE)), 4) AS valid_sql_rate,
       ROUND(AVG(CAST(exact AS DOUBLE)), 4) AS exact_match"""

_PAIRED = """paired AS (
  SELECT example_id, MAX(class) AS class,
         MAX(CASE WHEN run = 'base' THEN CAST(exec_ok AS INT) END) AS a_ok,
         MAX(CASE WHEN run = 'r1' THEN CAST(exec_ok AS INT) END) AS b_ok
  FROM outcomes WHERE run IN ('base', 'r1') GROUP BY example_id
  HAVING MAX(CASE WHEN run = 'base' THEN 1 END) IS NOT NULL
     AND MAX(CASE WHEN run = 'r1' THEN 1 END) IS NOT NULL),
labelled AS (
  SELECT *, CASE WHEN b_ok = 1 AND a_ok = 0 THEN 'tuned_win'
                 WHEN b_ok = 1 AND a_ok = 1 THEN 'both_correct'
                 WHEN b_ok = 0 AND a_ok = 1 THEN 'tuned_regression'
                 ELSE 'both_wrong' END AS outcome
  FROM paired)"""


@query("summarise_metrics", oracle=with_views(f"SELECT run, {_RATES} FROM outcomes GROUP BY run"))
def summarise_metrics(spark, sf_dir):
    return R.summarise(_outcomes(spark, sf_dir))


@query("accuracy_by_class", oracle=with_views(f"""
WITH {_PAIRED}
SELECT coalesce(nullif(class, ''), 'unknown') AS class, COUNT(*) AS n,
       ROUND(AVG(CAST(a_ok AS DOUBLE)), 4) AS base, ROUND(AVG(CAST(b_ok AS DOUBLE)), 4) AS tuned
FROM paired GROUP BY 1"""))
def accuracy_by_class(spark, sf_dir):
    return R.accuracy_by_class(_outcomes(spark, sf_dir))


@query("paired_counts", oracle=with_views(f"""
WITH {_PAIRED}
SELECT COUNT(*) FILTER (WHERE outcome = 'tuned_win') AS tuned_win,
       COUNT(*) FILTER (WHERE outcome = 'both_correct') AS both_correct,
       COUNT(*) FILTER (WHERE outcome = 'tuned_regression') AS tuned_regression,
       COUNT(*) FILTER (WHERE outcome = 'both_wrong') AS both_wrong
FROM labelled"""))
def paired_counts(spark, sf_dir):
    return R.paired_counts(_outcomes(spark, sf_dir))


@query("metric_deltas", oracle=with_views(f"""
WITH s AS (SELECT run, {_RATES} FROM outcomes GROUP BY run),
u AS (UNPIVOT s ON execution_accuracy, valid_sql_rate, exact_match INTO NAME metric VALUE value)
SELECT t.metric, ROUND(t.value - b.value, 4) AS delta
FROM u t JOIN u b ON t.metric = b.metric AND b.run = 'base' WHERE t.run = 'r1'"""))
def metric_deltas(spark, sf_dir):
    m = R.metrics_long(_outcomes(spark, sf_dir))
    t = m.where(F.col("run") == "r1").select("metric", F.col("value").alias("t"))
    b = m.where(F.col("run") == "base").select("metric", F.col("value").alias("b"))
    return t.join(b, "metric").select("metric", F.round(F.col("t") - F.col("b"), 4).alias("delta"))


_DUCK_BC = """base AS (SELECT example_id, CAST(exec_ok AS INT) AS a FROM outcomes WHERE run = 'base'),
o AS (SELECT example_id, run, CAST(exec_ok AS INT) AS b FROM outcomes WHERE run <> 'base'),
bc AS (SELECT run, COUNT(*) FILTER (WHERE b = 1 AND a = 0) AS b, COUNT(*) FILTER (WHERE b = 0 AND a = 1) AS c
       FROM o JOIN base USING (example_id) GROUP BY run)"""


@query("mcnemar_exact", oracle=with_views(f"""
WITH {_DUCK_BC},
t AS (SELECT run, b, c, b + c AS n, unnest(range(0, least(b, c) + 1)) AS k FROM bc),
l AS (SELECT *, SUM(CASE WHEN k = 0 THEN 0.0 ELSE ln(n - k + 1) - ln(k) END)
                  OVER (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS logc
      FROM t)
SELECT run, b, c, ROUND(least(1.0, 2.0 * SUM(exp(logc - n * ln(2.0)))), 6) AS p_value
FROM l GROUP BY run, b, c"""))
def mcnemar_exact(spark, sf_dir):
    return R.mcnemar_exact(R.discordant(_outcomes(spark, sf_dir), "base", RUNS))


@query("accuracy_se", oracle=with_views("""
SELECT run, COUNT(*) AS n, ROUND(AVG(CAST(exec_ok AS DOUBLE)), 4) AS accuracy,
       ROUND(sqrt(AVG(CAST(exec_ok AS DOUBLE)) * (1 - AVG(CAST(exec_ok AS DOUBLE))) / COUNT(*)), 6) AS se
FROM outcomes GROUP BY run"""))
def accuracy_se(spark, sf_dir):
    return R.accuracy_se(_outcomes(spark, sf_dir))


@query("report_samples", oracle=with_views(f"""
WITH {_PAIRED},
caps AS (SELECT * FROM (VALUES ('tuned_win', 14), ('both_correct', 4), ('tuned_regression', 3), ('both_wrong', 3)) AS t(outcome, cap)),
r AS (SELECT outcome, example_id, ROW_NUMBER() OVER (PARTITION BY outcome ORDER BY example_id) AS k FROM labelled)
SELECT r.outcome, r.example_id, r.k FROM r JOIN caps USING (outcome) WHERE r.k <= caps.cap"""))
def report_samples(spark, sf_dir):
    return R.report_samples(_outcomes(spark, sf_dir))


_RUN_COLS = ", ".join(f"MAX(CASE WHEN run = '{r}' THEN value END) AS {r}" for r in ["base", *RUNS])
_PTS = ", ".join(f"{r}, ROUND(({r} - base) * 100, 1) AS {r}_points" for r in RUNS)


@query("compare_runs", oracle=with_views(f"""
WITH s AS (SELECT run, {_RATES} FROM outcomes GROUP BY run),
u AS (UNPIVOT s ON execution_accuracy, valid_sql_rate, exact_match INTO NAME metric VALUE value),
w AS (SELECT metric, {_RUN_COLS} FROM u GROUP BY metric)
SELECT metric, base, {_PTS} FROM w"""))
def compare_runs(spark, sf_dir):
    return R.compare_runs(_outcomes(spark, sf_dir), RUNS)


_CLS_COLS = ", ".join(f"MAX(CASE WHEN run = '{r}' THEN execution_accuracy END) AS {r}"
                      for r in ["base", *RUNS])


@query("compare_runs_by_class", oracle=with_views(f"""
WITH s AS (SELECT class, run, {_RATES} FROM outcomes GROUP BY class, run)
SELECT class, {_CLS_COLS}, MAX(CASE WHEN run = 'base' THEN n END) AS n FROM s GROUP BY class"""))
def compare_runs_by_class(spark, sf_dir):
    return R.compare_runs_by_class(_outcomes(spark, sf_dir), RUNS)


@query("runs_comparable", oracle=with_views("""
WITH b AS (SELECT example_id FROM outcomes WHERE run = 'base'),
nb AS (SELECT COUNT(*) AS n_base FROM b),
per AS (SELECT o.run, COUNT(*) AS n, COUNT(b.example_id) AS shared
        FROM outcomes o LEFT JOIN b ON o.example_id = b.example_id WHERE o.run <> 'base' GROUP BY o.run)
SELECT run, n, shared, n_base, (n = n_base AND shared = n) AS comparable FROM per, nb"""))
def runs_comparable(spark, sf_dir):
    return R.runs_comparable(_outcomes(spark, sf_dir), "base", RUNS)


@query("points_vs_bar", oracle=with_views("""
WITH a AS (SELECT run, ROUND(AVG(CAST(exec_ok AS DOUBLE)) * 100, 1) AS accuracy_pct FROM outcomes GROUP BY run),
bars AS (SELECT * FROM (VALUES ('base', 78.3), ('r1', 84.0), ('r2', 82.7), ('r3', 82.7), ('r4', 82.7)) AS t(run, bar))
SELECT run, accuracy_pct, CAST(bar AS DOUBLE) AS bar, ROUND(accuracy_pct - CAST(bar AS DOUBLE), 1) AS points
FROM a JOIN bars USING (run)"""))
def points_vs_bar(spark, sf_dir):
    return R.points_vs_bar(_outcomes(spark, sf_dir))


# ---------------------------------------------------------------- mixes ------

@query("mix_by_class", oracle=with_views(f"""
SELECT {DUCK_CLASS.format(x='gold_sql')} AS class, COUNT(*) AS n FROM examples GROUP BY 1"""))
def mix_by_class(spark, sf_dir):
    e = view(spark, sf_dir, "examples")
    return e.groupBy(T.classify_sql("gold_sql").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("mix_by_source", oracle=with_views(
    "SELECT source, COUNT(*) AS n FROM examples GROUP BY source"))
def mix_by_source(spark, sf_dir):
    e = view(spark, sf_dir, "examples")
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("source_accounting", oracle=with_views("""
SELECT source, COUNT(*) AS scanned,
       COUNT(*) FILTER (WHERE strpos(upper(coalesce(sql_context, '')), 'CREATE TABLE') > 0
                        AND length(regexp_replace(gold_sql, '^\\s+|\\s+$', '', 'g')) > 0) AS added,
       COUNT(*) FILTER (WHERE NOT (strpos(upper(coalesce(sql_context, '')), 'CREATE TABLE') > 0
                        AND length(regexp_replace(gold_sql, '^\\s+|\\s+$', '', 'g')) > 0)) AS rejected
FROM examples GROUP BY source"""))
def source_accounting(spark, sf_dir):
    e = view(spark, sf_dir, "examples")
    ok = T.has_ddl("sql_context") & (F.length(T.strip("gold_sql")) > 0)
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("scanned"),
                                   F.count_if(ok).alias("added"),
                                   F.count_if(~ok).alias("rejected"))


# ------------------------------------------------------ preference pairs -----

_DUCK_USER = ("'### Schema' || chr(10) || regexp_replace(e.sql_context, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) "
              "|| '### Question' || chr(10) || regexp_replace(e.question, '^\\s+|\\s+$', '', 'g')")

_DUCK_PAIRS = f"""{DUCK_EXTRACT},
scored AS (
  SELECT x.example_id, x.sql, o.runs, o.exec_ok, o.class, e.source, e.gold_sql, {_DUCK_USER} AS prompt
  FROM extracted x JOIN outcomes o ON x.example_id = o.example_id AND o.run = 'r1'
  JOIN examples e ON x.example_id = e.example_id
  WHERE x.model = 'tuned')"""


def _scored(spark, sf_dir):
    x = (view(spark, sf_dir, "predictions").where(F.col("model") == "tuned")
         .select("example_id", T.extract_sql("raw").alias("sql")))
    o = (view(spark, sf_dir, "outcomes").where(F.col("run") == "r1")
         .select("example_id", "runs", "exec_ok", "class"))
    e = view(spark, sf_dir, "examples").select(
        "example_id", "source", "gold_sql", chat.user_content("sql_context", "question").alias("prompt"))
    return x.join(o, "example_id").join(e, "example_id")


@query("preference_pairs", oracle=with_views(f"""
WITH {_DUCK_PAIRS}
SELECT example_id, prompt, gold_sql AS chosen, sql AS rejected,
       CASE WHEN NOT runs THEN 'did_not_run' ELSE 'ran_but_wrong' END AS failure,
       class AS complexity, source
FROM scored WHERE sql <> '' AND NOT exec_ok"""))
def preference_pairs(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return (s.where((F.col("sql") != "") & ~F.col("exec_ok"))
            .select("example_id", "prompt", F.col("gold_sql").alias("chosen"),
                    F.col("sql").alias("rejected"),
                    F.when(~F.col("runs"), "did_not_run").otherwise("ran_but_wrong").alias("failure"),
                    F.col("class").alias("complexity"), "source"))


@query("pair_summary", oracle=with_views(f"""
WITH {_DUCK_PAIRS}
SELECT COUNT(*) AS questions,
       COUNT(*) FILTER (WHERE sql <> '' AND exec_ok) AS model_right,
       COUNT(*) FILTER (WHERE sql = '') AS no_sql,
       COUNT(*) FILTER (WHERE sql <> '' AND NOT exec_ok) AS pairs,
       COUNT(*) FILTER (WHERE sql <> '' AND NOT exec_ok AND NOT runs) AS did_not_run,
       COUNT(*) FILTER (WHERE sql <> '' AND NOT exec_ok AND runs) AS ran_but_wrong,
       ROUND(CAST(COUNT(*) FILTER (WHERE sql <> '' AND exec_ok) AS DOUBLE) / COUNT(*), 4) AS right_rate
FROM scored"""))
def pair_summary(spark, sf_dir):
    s = _scored(spark, sf_dir)
    has = F.col("sql") != ""
    return s.agg(F.count(F.lit(1)).alias("questions"),
                 F.count_if(has & F.col("exec_ok")).alias("model_right"),
                 F.count_if(~has).alias("no_sql"),
                 F.count_if(has & ~F.col("exec_ok")).alias("pairs"),
                 F.count_if(has & ~F.col("exec_ok") & ~F.col("runs")).alias("did_not_run"),
                 F.count_if(has & ~F.col("exec_ok") & F.col("runs")).alias("ran_but_wrong"),
                 F.round(F.count_if(has & F.col("exec_ok")).cast("double") / F.count(F.lit(1)), 4)
                 .alias("right_rate"))


@query("topk_classes", oracle=with_views(f"""
WITH {_DUCK_PAIRS}
SELECT class AS complexity, COUNT(*) AS n FROM scored WHERE sql <> '' AND NOT exec_ok
GROUP BY class ORDER BY n DESC, complexity LIMIT 6"""))
def topk_classes(spark, sf_dir):
    p = preference_pairs(spark, sf_dir)
    return (p.groupBy("complexity").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("complexity")).limit(6))


_D_ALL_PAIRS = """
o AS (SELECT example_id, run, CAST(exec_ok AS INT) AS ok FROM outcomes),
bc AS (SELECT a.run AS run_a, b.run AS run_b, COUNT(*) AS n,
              COUNT(*) FILTER (WHERE b.ok = 1 AND a.ok = 0) AS wins, COUNT(*) FILTER (WHERE b.ok = 0 AND a.ok = 1) AS regressions,
              COUNT(*) FILTER (WHERE b.ok = 1 AND a.ok = 1) AS both_correct, COUNT(*) FILTER (WHERE b.ok = 0 AND a.ok = 0) AS both_wrong
       FROM o a JOIN o b USING (example_id) WHERE a.run <> b.run GROUP BY a.run, b.run),
k AS (SELECT *, unnest(range(0, least(wins, regressions) + 1)) AS k FROM bc),
l AS (SELECT *, SUM(CASE WHEN k = 0 THEN 0.0 ELSE ln(wins + regressions - k + 1) - ln(k) END)
                  OVER (PARTITION BY run_a, run_b ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS logc FROM k),
pv AS (SELECT run_a, run_b, ROUND(least(1.0, 2.0 * SUM(exp(logc - (wins + regressions) * ln(2.0)))), 6) AS p_value FROM l GROUP BY run_a, run_b),
sz AS (SELECT run, COUNT(*) AS size FROM o GROUP BY run)"""


@query("compare_all_runs", oracle=with_views(f"""
WITH {_D_ALL_PAIRS}
SELECT run_a, run_b, n, wins, regressions, both_correct, both_wrong, ROUND((wins - regressions) * 100.0 / n, 1) AS points, p_value,
       n = sa.size AND n = sb.size AS comparable
FROM bc JOIN pv USING (run_a, run_b) JOIN sz sa ON sa.run = run_a JOIN sz sb ON sb.run = run_b"""))
def compare_all_runs(spark, sf_dir):
    """Wins and regressions of every run over every other, with the exact test
    and whether they saw the same examples (AGG-3, AGG-5, AGG-17, JN-12)."""
    return R.pairwise(_outcomes(spark, sf_dir), ["base", *RUNS])


@query("metric_deltas_all", oracle=with_views(f"""
WITH s AS (SELECT run, {_RATES} FROM outcomes GROUP BY run),
u AS (UNPIVOT s ON execution_accuracy, valid_sql_rate, exact_match INTO NAME metric VALUE value)
SELECT t.run, t.metric, ROUND(t.value - b.value, 4) AS delta
FROM u t JOIN u b ON t.metric = b.metric AND b.run = 'base' WHERE t.run <> 'base'"""))
def metric_deltas_all(spark, sf_dir):
    """Every run's metrics less those of the base run (AGG-4): one summary, read once."""
    m = R.metrics_long(_outcomes(spark, sf_dir))
    by = m.groupBy("metric").agg(F.max(F.when(F.col("run") == "base", F.col("value"))).alias("base"),
                                 F.collect_list(F.struct("run", "value")).alias("runs"))  # one entry a run
    x = by.select("metric", "base", F.explode("runs").alias("r")).where("r.run <> 'base' and base is not null")
    return x.select("r.run", "metric", F.round(F.col("r.value") - F.col("base"), 4).alias("delta"))


@query("accuracy_by_class_all", oracle=with_views("""
WITH x AS (SELECT coalesce(nullif(class, ''), 'unknown') AS class, run, COUNT(*) AS n,
                  ROUND(AVG(CAST(exec_ok AS DOUBLE)), 4) AS accuracy FROM outcomes GROUP BY 1, run)
SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY n DESC, class) AS place FROM x"""))
def accuracy_by_class_all(spark, sf_dir):
    """Accuracy of every run by class, the most common class first (AGG-2, AGG-7)."""
    cls = F.coalesce(F.nullif(F.col("class"), F.lit("")), F.lit("unknown"))
    x = _outcomes(spark, sf_dir).groupBy(cls.alias("class"), "run").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("exec_ok").cast("double")), 4).alias("accuracy"))
    order = Window.partitionBy("run").orderBy(F.desc("n"), "class")  # one row a class
    return x.withColumn("place", F.row_number().over(order).cast("long"))


@query("mix_most_common", oracle=with_views(f"""
WITH x AS (SELECT 'class' AS what, {DUCK_CLASS.format(x='gold_sql')} AS name, COUNT(*) AS n FROM examples GROUP BY 2
           UNION ALL SELECT 'source', source, COUNT(*) FROM examples GROUP BY source)
SELECT *, ROW_NUMBER() OVER (PARTITION BY what ORDER BY n DESC, name) AS place FROM x"""))
def mix_most_common(spark, sf_dir):
    """Classes and sources with their counts, most common first, in one pass (AGG-7)."""
    e = view(spark, sf_dir, "examples")
    what = F.array(*[F.struct(F.lit(w).alias("what"), c.alias("name")) for w, c in
                     (("class", T.classify_sql("gold_sql")), ("source", F.col("source")))])
    x = e.select(F.explode(what).alias("x")).groupBy("x.what", "x.name").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("what").orderBy(F.desc("n"), "name")  # one row a class or source
    return x.withColumn("place", F.row_number().over(order).cast("long"))
