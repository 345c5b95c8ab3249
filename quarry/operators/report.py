"""Evaluation report pieces over a long table of scored outcomes
``(example_id, run, class, runs, exec_ok, exact)`` (AGG-1..7, AGG-11, AGG-17,
AGG-22, WIN-8, JN-12).

Paired questions (base vs a run) are answered with conditional aggregation
per example -- one shuffle on ``example_id`` -- instead of a self join.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = {"execution_accuracy": "exec_ok", "valid_sql_rate": "runs", "exact_match": "exact"}

# -- fixed values: report sample caps per paired outcome, in report order ----
SAMPLE_CAPS = [("tuned_win", 14), ("both_correct", 4), ("tuned_regression", 3), ("both_wrong", 3)]
# -- fixed values: published execution accuracy (percent) per run -------------
PUBLISHED_BARS = [("base", 78.3), ("r1", 84.0), ("r2", 82.7), ("r3", 82.7), ("r4", 82.7)]


def rate(flag: str) -> Column:
    return F.round(F.avg(F.col(flag).cast("double")), 4)


def summarise(outcomes: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Mean of exec_ok / runs / exact to 4 decimals, and n (AGG-1)."""
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[rate(f).alias(m) for m, f in METRICS.items()])


def metrics_long(outcomes: DataFrame) -> DataFrame:
    """(run, metric, value) -- unpivot of ``summarise``."""
    s = summarise(outcomes)
    return s.unpivot(["run"], list(METRICS), "metric", "value")


def paired(outcomes: DataFrame, a: str, b: str) -> DataFrame:
    """Per example the (a, b) verdicts side by side; examples seen by both."""
    return (outcomes.where(F.col("run").isin(a, b))
            .groupBy("example_id")
            .agg(F.first("class", ignorenulls=True).alias("class"),
                 F.max(F.when(F.col("run") == a, F.col("exec_ok").cast("int"))).alias("a_ok"),
                 F.max(F.when(F.col("run") == b, F.col("exec_ok").cast("int"))).alias("b_ok"))
            .where(F.col("a_ok").isNotNull() & F.col("b_ok").isNotNull()))


def outcome_label() -> Column:
    return (F.when((F.col("b_ok") == 1) & (F.col("a_ok") == 0), "tuned_win")
            .when((F.col("b_ok") == 1) & (F.col("a_ok") == 1), "both_correct")
            .when((F.col("b_ok") == 0) & (F.col("a_ok") == 1), "tuned_regression")
            .otherwise("both_wrong"))


def paired_counts(outcomes: DataFrame, a: str = "base", b: str = "r1") -> DataFrame:
    """Four-way counts: win, both right, regression, both wrong (AGG-3)."""
    p = paired(outcomes, a, b)
    return p.agg(*[F.count_if(outcome_label() == F.lit(k)).alias(k) for k, _ in SAMPLE_CAPS])


def discordant(outcomes: DataFrame, a: str, runs: Sequence[str]) -> DataFrame:
    """(run, b, c): b = a wrong and run right, c = a right and run wrong."""
    base = outcomes.where(F.col("run") == a).select(
        "example_id", F.col("exec_ok").cast("int").alias("a_ok"))
    other = outcomes.where(F.col("run").isin(*runs)).select(
        "example_id", "run", F.col("exec_ok").cast("int").alias("b_ok"))
    j = other.join(base, "example_id")
    return j.groupBy("run").agg(
        F.count_if((F.col("b_ok") == 1) & (F.col("a_ok") == 0)).alias("b"),
        F.count_if((F.col("b_ok") == 0) & (F.col("a_ok") == 1)).alias("c"))


def _stirling_error(n: Column) -> Column:
    """ln(n!) less Stirling's formula for it: from the factorial for small n, by its series beyond."""
    small = F.log(F.factorial(F.least(n, F.lit(15)).cast("int")).cast("double")) - (n + 0.5) * F.log(n) + n - 0.5 * math.log(2 * math.pi)
    q = n * n
    return F.when(n < 16, small).otherwise((1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / q) / q) / q) / n)


def _deviance(x: Column, m: Column) -> Column:
    """x ln(x/m) + m - x without cancellation."""
    v = (x - m) / (x + m)
    v2, tail = v * v, F.lit(0.0)
    for j in range(10, 0, -1):
        tail = (tail + 1.0 / (2 * j + 1)) * v2
    return F.when(F.abs(v) < 0.1, (x - m) * v + 2 * x * v * tail).otherwise(x * F.log(x / m) + m - x)


def _beta_fraction(a: Column, b: Column, steps: Column) -> Column:
    """Continued fraction of the incomplete beta function at 1/2, by Lentz's
    method: a fold that does nothing any more once its factors are 1."""
    def unit(aa: Column, s: Column) -> tuple[Column, Column]:
        return 1 / (1 + aa * s["d"]), 1 + aa / s["c"]

    def struct(c: Column, d: Column, h: Column, done: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"), done.alias("done"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) / 2 / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) / 2 / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = unit(even, s)
        half = F.element_at(F.transform(F.array(struct(c1, d1, s["h"] * d1 * c1, s["done"])), lambda t: struct(
            unit(odd, t)[1], unit(odd, t)[0], t["h"] * unit(odd, t)[0] * unit(odd, t)[1], F.abs(unit(odd, t)[0] * unit(odd, t)[1] - 1) < 1e-15)), 1)
        return F.when(s["done"], s).otherwise(half)

    d0 = 1 / (1 - (a + b) / 2 / (a + 1))
    return F.aggregate(F.sequence(F.lit(1), steps), struct(F.lit(1.0), d0, d0, F.lit(False)), step, lambda s: s["h"])


def mcnemar_p(b: Column, c: Column) -> Column:
    """min(1, 2 * sum_{k <= min(b, c)} C(n, k) / 2^n), n = b + c (AGG-5): the
    lower tail of a binomial as an incomplete beta function, so the work grows
    as the root of n at most and nothing overflows."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    dense = (F.exp(_stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n / 2) - _deviance(n - k, n / 2))
             * F.sqrt(n / (2 * math.pi * k * (n - k))))
    at_k = F.when(k == 0, F.pow(F.lit(0.5), n)).otherwise(dense)
    steps = (256 + F.ceil(F.sqrt(n) / 4)).cast("int")
    return F.when(b == c, F.lit(1.0)).otherwise(F.least(F.lit(1.0), at_k * _beta_fraction(n - k, k + 1, steps)))


def mcnemar_exact(bc: DataFrame, key: str = "run") -> DataFrame:
    """Two-sided exact McNemar p-value per row of ``(key, b, c)`` (AGG-5)."""
    return bc.select(key, "b", "c", F.round(mcnemar_p(F.col("b"), F.col("c")), 6).alias("p_value"))


def run_masks(outcomes: DataFrame, runs: Sequence[str]) -> DataFrame:
    """One row per example and class: ``ok`` and ``seen``, a bit for each of
    ``runs`` that was right on it, and that looked at it (JN-12, AGG-17)."""
    bit = F.element_at(F.create_map(*[x for i, r in enumerate(runs) for x in (F.lit(r), F.lit(1 << i).cast("long"))]), F.col("run"))
    return (outcomes.where(F.col("run").isin(*runs)).withColumn("_bit", bit).groupBy("example_id")
            .agg(F.max("class").alias("class"), F.bit_or(F.when(F.col("exec_ok").cast("int") == 1, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias("ok"),
                 F.bit_or("_bit").alias("seen")))


def pairwise(outcomes: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Every ordered pair of different ``runs`` in one pass (AGG-3, AGG-17):
    run_a, run_b, n examples of both, wins (b right, a wrong), regressions,
    both_correct, both_wrong, points gained, exact p, and whether both looked
    at the same examples (JN-12).

    Examples become bit masks; equal masks are counted, at most 4 to the power
    of the number of runs, and the pairs are read off the counts."""
    names = F.array(*[F.lit(r) for r in runs])
    masks = run_masks(outcomes, runs).groupBy("ok", "seen").agg(F.count(F.lit(1)).alias("m"))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(len(runs)) for j in range(len(runs)) if i != j])
    x = masks.select("*", F.explode(pairs).alias("p")).select("m", "p.*", *[F.expr(f"shiftright({mask}, p.{at}) & 1 = 1").alias(f"{name}_{at}")
                                                                          for mask, name in (("ok", "ok"), ("seen", "in")) for at in "ij"])
    both = F.col("in_i") & F.col("in_j")
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("m"))), F.lit(0))
    t = x.groupBy("i", "j").agg(
        count(both).alias("n"), count(both & F.col("ok_j") & ~F.col("ok_i")).alias("wins"),
        count(both & F.col("ok_i") & ~F.col("ok_j")).alias("regressions"),
        count(both & F.col("ok_i") & F.col("ok_j")).alias("both_correct"),
        count(both & ~F.col("ok_i") & ~F.col("ok_j")).alias("both_wrong"),
        (count(F.col("in_i") != F.col("in_j")) == 0).alias("comparable")).where("n > 0")
    return t.select(F.element_at(names, F.col("i") + 1).alias("run_a"), F.element_at(names, F.col("j") + 1).alias("run_b"), "n", "wins",
                    "regressions", "both_correct", "both_wrong",
                    F.round((F.col("wins") - F.col("regressions")) * 100.0 / F.col("n"), 1).alias("points"),
                    F.round(mcnemar_p(F.col("wins"), F.col("regressions")), 6).alias("p_value"), "comparable")


def accuracy_se(outcomes: DataFrame) -> DataFrame:
    """Binomial standard error of execution accuracy per run (AGG-6)."""
    s = outcomes.groupBy("run").agg(F.count(F.lit(1)).alias("n"),
                                    F.avg(F.col("exec_ok").cast("double")).alias("p"))
    return s.select("run", "n", F.round("p", 4).alias("accuracy"),
                    F.round(F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")), 6).alias("se"))


def accuracy_by_class(outcomes: DataFrame, a: str = "base", b: str = "r1") -> DataFrame:
    """Per class: n and execution accuracy of both runs, 4 decimals (AGG-2).
    Missing class reads as ``unknown``."""
    p = paired(outcomes, a, b).withColumn(
        "class", F.coalesce(F.nullif(F.col("class"), F.lit("")), F.lit("unknown")))
    return p.groupBy("class").agg(F.count(F.lit(1)).alias("n"),
                                  F.round(F.avg(F.col("a_ok").cast("double")), 4).alias("base"),
                                  F.round(F.avg(F.col("b_ok").cast("double")), 4).alias("tuned"))


def report_samples(outcomes: DataFrame, a: str = "base", b: str = "r1") -> DataFrame:
    """First k examples of each paired outcome in example order (WIN-8)."""
    p = paired(outcomes, a, b).withColumn("outcome", outcome_label())
    caps = p.sparkSession.createDataFrame(SAMPLE_CAPS, "outcome string, cap int")
    top = max(c for _, c in SAMPLE_CAPS)
    w = Window.partitionBy("outcome").orderBy("example_id")
    # constant bound right after the window -> WindowGroupLimit cuts each
    # outcome to `top` rows per task before the shuffle
    ranked = p.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)
    return (ranked.join(F.broadcast(caps), "outcome")
            .where(F.col("k") <= F.col("cap"))
            .select("outcome", "example_id", F.col("k").cast("bigint").alias("k")))


def compare_runs(outcomes: DataFrame, runs: Sequence[str]) -> DataFrame:
    """metric x run table, plus points over base (AGG-17)."""
    m = metrics_long(outcomes)
    wide = m.groupBy("metric").pivot("run", ["base", *runs]).agg(F.first("value"))
    cols = [F.col("metric"), F.col("base")]
    for r in runs:
        cols += [F.col(r), F.round((F.col(r) - F.col("base")) * 100, 1).alias(f"{r}_points")]
    return wide.select(*cols)


def compare_runs_by_class(outcomes: DataFrame, runs: Sequence[str]) -> DataFrame:
    """class x run execution accuracy (AGG-17, by class)."""
    s = summarise(outcomes, ("class", "run")).select("class", "run", "n", "execution_accuracy")
    wide = (s.groupBy("class").pivot("run", ["base", *runs])
            .agg(F.first("execution_accuracy")))
    n = s.where(F.col("run") == "base").select("class", "n")
    return wide.join(n, "class")


def runs_comparable(outcomes: DataFrame, a: str, runs: Sequence[str]) -> DataFrame:
    """Per run: examples scored, examples shared with ``a``, and whether the
    comparison is on the same examples (JN-12)."""
    n_a = outcomes.where(F.col("run") == a).agg(F.count(F.lit(1)).alias("n_base"))
    base_ids = outcomes.where(F.col("run") == a).select("example_id", F.lit(1).alias("in_base"))
    per = (outcomes.where(F.col("run").isin(*runs)).select("example_id", "run")
           .join(base_ids, "example_id", "left")
           .groupBy("run").agg(F.count(F.lit(1)).alias("n"),
                               F.count("in_base").alias("shared")))
    # n_a is a one-row global aggregate
    return per.crossJoin(F.broadcast(n_a)).select(
        "run", "n", "shared", "n_base",
        ((F.col("n") == F.col("n_base")) & (F.col("shared") == F.col("n"))).alias("comparable"))


def points_vs_bar(outcomes: DataFrame) -> DataFrame:
    """Execution accuracy in percent against the published figure (AGG-22)."""
    bars = outcomes.sparkSession.createDataFrame(PUBLISHED_BARS, "run string, bar double")
    acc = outcomes.groupBy("run").agg(
        F.round(F.avg(F.col("exec_ok").cast("double")) * 100, 1).alias("accuracy_pct"))
    return (acc.join(F.broadcast(bars), "run")
            .select("run", "accuracy_pct", "bar",
                    F.round(F.col("accuracy_pct") - F.col("bar"), 1).alias("points")))
