"""Best-candidate choice: one example per branch of the rules."""
from quarry.operators.select import select_candidate

ROWS = [
    # keep the first attempt
    (1, "first", 0, "S1", None, 0),
    # repair: empty, then fixed
    (2, "first", 0, "S2", "query error: no such column: x", 0),
    (2, "repair", 1, "", None, 0), (2, "repair", 2, "R2", None, 0),
    # repair: same query, then still failing
    (3, "first", 0, "S3", "query error: no such table: t", 0),
    (3, "repair", 1, "S3", None, 0), (3, "repair", 2, "R3", "query error: boom", 0),
    # refused write: no repair
    (4, "first", 0, "DROP TABLE t", "only read queries are executed in this demo", 0),
    # lint: first rewrite still lints, second is clean
    (5, "first", 0, "S5", None, 1), (5, "lint", 1, "L5a", None, 1), (5, "lint", 2, "L5b", None, 0),
    # lint: rewrite fails, second is the same query -> keep original
    (6, "first", 0, "S6", None, 2), (6, "lint", 1, "L6", "query error: x", 0), (6, "lint", 2, "S6", None, 0),
    # repair, then lint: the first attempt is what the lint rewrite started from
    (7, "first", 0, "S7", "query error: x", 0), (7, "repair", 1, "R7", None, 1), (7, "repair", 2, "R7b", None, 0),
    (7, "lint", 1, "R7", None, 0), (7, "lint", 2, "L7", None, 0), (7, "lint", 3, "L7b", None, 0),
    # attempts without a first one
    (8, "repair", 1, "R8", None, 0),
]


def test_select_branches(spark):
    rows = [(*r, "issue " * r[-1] if r[-1] else "") for r in reversed(ROWS)]
    c = spark.createDataFrame(rows, "example_id long, phase string, attempt int, sql string, err string, lint_n int, issues string")
    got = {r.example_id: r for r in select_candidate(c).collect()}
    assert (got[1].sql, got[1].repaired, got[1].repair_attempted) == ("S1", False, False)
    assert (got[2].sql, got[2].repaired, got[2].repair_sql, got[2].repair_error) == ("R2", True, "R2", None)
    assert (got[3].sql, got[3].executed, got[3].repair_error, got[3].repair_sql) == ("S3", False, "query error: boom", "R3")
    assert (got[4].repair_attempted, got[4].executed) == (False, False)
    assert (got[5].sql, got[5].lint_fixed, got[5].lint_n, got[5].first_attempt_sql) == ("L5b", True, 0, "S5")
    assert (got[6].sql, got[6].lint_fixed, got[6].lint_n) == ("S6", False, 2)
    assert (got[2].first_attempt_sql, got[2].first_attempt_error) == ("S2", "query error: no such column: x")
    assert (got[5].first_attempt_error, got[6].lint_issues) == ("structural: issue ", "issue issue ")
    r = got[7]
    assert (r.sql, r.repaired, r.repair_sql, r.lint_fixed, r.first_attempt_sql, r.first_attempt_error) == ("L7", True, "R7", True, "R7", "structural: issue ")
    assert 8 not in got


def test_one_scan_and_one_shuffle(spark):
    c = spark.createDataFrame([(*r, "") for r in ROWS], "example_id long, phase string, attempt int, sql string, err string, lint_n int, issues string")
    plan = select_candidate(c)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
