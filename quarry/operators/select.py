"""Best-candidate choice over a table of attempts (SEL-1, WIN-10).

``candidates``: (example_id, phase in {first, repair, lint}, attempt, sql, err,
lint_n, issues).  Rules, per example:

1. keep the first attempt if it runs;
2. else (unless it was refused as a write) take the first repair attempt that
   has SQL, differs from the first, and runs; ``repair_sql`` is the last
   non-empty repair seen, ``repair_error`` the outcome of the last attempt
   looked at;
3. if the chosen query runs but trips the lint, take the first lint rewrite
   that has SQL, differs, runs and lints clean; otherwise keep it.

The rules are a state machine: one fold over an example's attempts in order.
Attempts come in by one scan and one shuffle; an example has a few of them, so
no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_SQL_MSG = "the repair attempt produced no SQL"
SAME_MSG = "the model returned the same query unchanged"
STRUCTURAL = "structural: "
STATE = {"sql0": "string", "err0": "string", "sql": "string", "err": "string", "lint": "int", "issues": "string",
         "attempted": "boolean", "fixed": "boolean", "repair_sql": "string", "repair_error": "string",
         "lint_fixed": "boolean", "first_sql": "string", "first_err": "string"}


def _state(**fields: Column) -> Column:
    return F.struct(*[fields[k].cast(t).alias(k) for k, t in STATE.items()])


def _start() -> Column:
    return _state(**{k: F.lit(False) if t == "boolean" else F.lit(None) for k, t in STATE.items()})


def _step(s: Column, x: Column) -> Column:
    """The state after the next attempt ``x``."""
    first, repair, lint = (x["phase"] == i for i in range(3))
    has = x["sql"] != ""
    runs = has & x["err"].isNull()
    # one repair after another until one is kept
    tried = repair & s["attempted"] & ~s["fixed"]
    fixes = tried & runs & (x["sql"] != s["sql0"])
    why = F.when(~has, F.lit(NO_SQL_MSG)).when(x["sql"] == s["sql0"], F.lit(SAME_MSG)).otherwise(x["err"])
    cleans = lint & s["err"].isNull() & (s["lint"] > 0) & ~s["lint_fixed"] & runs & (x["sql"] != s["sql"]) & (x["lint_n"] == 0)
    cleans = F.coalesce(cleans, F.lit(False))
    new = first | fixes
    pick = lambda cond, value, old: F.when(cond, value).otherwise(s[old])
    return _state(
        sql0=pick(first, x["sql"], "sql0"), err0=pick(first, x["err"], "err0"),
        sql=pick(new | cleans, x["sql"], "sql"), err=pick(new, x["err"], "err"),
        lint=pick(new | cleans, x["lint_n"], "lint"), issues=pick(new | cleans, x["issues"], "issues"),
        attempted=pick(first, x["err"].isNotNull() & ~F.coalesce(x["err"].startswith("only read"), F.lit(False)), "attempted"),
        fixed=s["fixed"] | fixes,
        repair_sql=pick(tried & has, x["sql"], "repair_sql"),
        repair_error=F.when(fixes, F.lit(None).cast("string")).when(tried, why).otherwise(s["repair_error"]),
        lint_fixed=s["lint_fixed"] | cleans,
        # what the last change started from: the answer before the lint rewrite, else the first one
        first_sql=F.when(first, x["sql"]).when(cleans, s["sql"]).otherwise(s["first_sql"]),
        first_err=F.when(first, x["err"]).when(cleans, F.concat(F.lit(STRUCTURAL), s["issues"])).otherwise(s["first_err"]))


def select_candidate(cands: DataFrame) -> DataFrame:
    order = F.when(F.col("phase") == "first", 0).when(F.col("phase") == "repair", 1).otherwise(2)
    attempt = F.struct(order.alias("phase"), "attempt", F.coalesce("sql", F.lit("")).alias("sql"), "err", "lint_n", "issues")
    tries = cands.groupBy("example_id").agg(F.sort_array(F.collect_list(attempt)).alias("tries"))
    # an example without a first attempt has nothing to choose
    tries = tries.where(F.col("tries")[0]["phase"] == 0)
    c = tries.select("example_id", F.explode(F.array(F.aggregate("tries", _start(), _step))).alias("s"))
    s = lambda k: F.col(f"s.{k}")
    changed = s("attempted") | s("lint_fixed")
    return c.select(
        "example_id", s("sql").alias("sql"), s("err").isNull().alias("executed"), s("err").alias("error"),
        (s("fixed") | s("lint_fixed")).alias("repaired"), s("attempted").alias("repair_attempted"),
        s("repair_sql").alias("repair_sql"), s("repair_error").alias("repair_error"),
        F.when(s("err").isNotNull(), F.lit(0)).otherwise(s("lint")).cast("int").alias("lint_n"),
        F.when(s("err").isNull() & (s("lint") > 0), s("issues")).alias("lint_issues"),
        s("lint_fixed").alias("lint_fixed"),
        F.when(changed, s("first_sql")).alias("first_attempt_sql"),
        F.when(changed, s("first_err")).alias("first_attempt_error"))


def repair_stats(chosen: DataFrame) -> DataFrame:
    """Counts of the selection outcome (SEL-1 report)."""
    return chosen.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("executed").alias("executed"),
        F.count_if("repair_attempted").alias("repair_attempted"),
        F.count_if("repaired").alias("repaired"),
        F.count_if("lint_fixed").alias("lint_fixed"),
        F.count_if(F.col("lint_n") > 0).alias("lint_open"),
        F.count_if(F.col("repair_attempted") & ~F.col("executed")).alias("still_failing"))
