"""Execution job on hand-written schemas, and its guards."""
from pyspark.sql import functions as F

from quarry.operators import execute as X

# -- fixture: five vehicle rentals ---------------------------------------------------
RENTALS = """CREATE TABLE rentals (id INTEGER PRIMARY KEY, branch TEXT, season TEXT, vehicle TEXT, days INTEGER, fee INTEGER);
INSERT INTO rentals VALUES (1,'Harbor','dry','Van',12,840),(2,'Hill','dry','Bike',30,450),
(3,'Harbor','wet','Bike',9,135),(4,'Lake','dry','Van',5,350),(5,'Hill','wet','Van',7,490);"""


def test_run_one_answers():
    err, rows = X.run_one(RENTALS, "SELECT branch, SUM(fee) FROM rentals WHERE season='dry' GROUP BY branch ORDER BY branch")
    assert err is None and rows == [("Harbor", 840), ("Hill", 450), ("Lake", 350)]
    err, rows = X.run_one(RENTALS, "SELECT SUM(days) FROM rentals WHERE vehicle='Van'")
    assert rows == [(24,)]


def test_guards():
    assert X.run_one(RENTALS, "")[0] == "model produced no SQL"
    assert X.run_one(RENTALS, "ATTACH DATABASE ':memory:' AS x")[0].startswith("query error")
    assert X.run_one(RENTALS, "PRAGMA user_version")[0].startswith("query error")
    assert X.run_one(RENTALS, "SELECT 1; SELECT 2")[0].startswith("query error")
    endless = "WITH RECURSIVE r(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM r) SELECT COUNT(*) FROM r"
    assert X.run_one(RENTALS, endless, step_limit=200_000)[0].startswith("query error")
    assert X.run_one("CREATE TABLE", "SELECT 1")[0].startswith("schema error")


def test_score_relational(spark):
    tasks = spark.createDataFrame([
        (1, "gold", RENTALS, "SELECT branch FROM rentals WHERE season = 'dry'"),
        (1, "m", RENTALS, "SELECT branch FROM rentals WHERE season = 'dry' ORDER BY id DESC"),
        (2, "gold", RENTALS, "SELECT branch FROM rentals ORDER BY fee DESC"),
        (2, "m", RENTALS, "SELECT branch FROM rentals ORDER BY fee ASC"),
        (3, "gold", RENTALS, "SELECT branch FROM rentals WHERE days > 1000"),
        (3, "m", RENTALS, "SELECT vehicle FROM rentals WHERE days > 1000"),
        (4, "gold", RENTALS, "SELECT 1"),
        (4, "m", RENTALS, "SELECT nope FROM rentals"),
    ], "example_id long, side string, context string, sql string")
    ex = X.execute(tasks)
    ordered = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False)], "example_id long, ordered boolean")
    got = {r.example_id: (r.runs, r.exec_ok) for r in X.score(ex, ordered, ["m"]).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (True, True), 4: (False, False)}


def test_score_counts_missing_sides(spark):
    """A side without a query, or an example without any, counts as not run."""
    sql = "SELECT branch FROM rentals"
    tasks = spark.createDataFrame([(1, "gold", RENTALS, sql), (1, "m", RENTALS, sql), (2, "gold", RENTALS, sql), (2, "n", RENTALS, sql)],
                                  "example_id long, side string, context string, sql string")
    ordered = spark.createDataFrame([(1, False), (2, False), (3, False)], "example_id long, ordered boolean")
    got = {(r.example_id, r.side): (r.runs, r.exec_ok) for r in X.score(X.execute(tasks), ordered, ["m", "n"]).collect()}
    yes, no = (True, True), (False, False)
    assert got == {(1, "m"): yes, (1, "n"): no, (2, "m"): no, (2, "n"): yes, (3, "m"): no, (3, "n"): no}


def test_catalog_scan(spark):
    ctx = spark.createDataFrame([(1, RENTALS), (2, "not sql")], "context_id long, context string")
    rows = X.catalog_scan(ctx).where(F.col("pk") == 1).collect()
    assert [(r.context_id, r.tbl, r.col, r.type) for r in rows] == [(1, "rentals", "id", "INTEGER")]


def test_plain_scripts_share_one_database(monkeypatch):
    """One connection runs script after script, and each finds it empty; a
    script with a guarded word has one of its own."""
    opened = []
    real = X.sqlite3.connect
    monkeypatch.setattr(X.sqlite3, "connect", lambda *a, **k: opened.append(1) or real(*a, **k))
    d = X._Databases(X.STEP_LIMIT)
    sqls = ["DELETE FROM rentals", "SELECT COUNT(*) FROM rentals", "SELECT CASE WHEN days > 10 THEN 1 END AS x FROM rentals WHERE id = 1"]
    for _ in range(20):
        assert [r for _, r in X.run_sides(RENTALS, sqls, databases=d)] == [[], [(5,)], [(1,)]]
        assert X.run_sides("CREATE TABLE other (a)", sqls[1:2], databases=d)[0][0] == "query error: no such table: rentals"
        assert X.run_sides("CREATE TABLE bad (a); CREATE", sqls, databases=d)[0][0].startswith("schema error")
        assert X._catalog_rows(d, 1, "CREATE TABLE other (a)") == [(1, "other", "a", 0, "", 0)]
    assert len(opened) == 1
    for script, sql in [("PRAGMA foreign_keys = ON", "SELECT 1"), ("CREATE TEMP TABLE t (a)", "SELECT 1"), (RENTALS, "END"), (RENTALS + "END;", "SELECT 1"),
                        (RENTALS, "SELECT changes()"), (RENTALS, "SELECT * FROM pragma_table_info('rentals')"), (RENTALS, "VACUUM")]:
        assert not X.plain(script, [sql])
    assert X.plain("CREATE TABLE vendors (temperature, calendar)", ["SELECT CASE WHEN 1 THEN 2 END"])


def test_stopped_queries_leave_the_data():
    """A query that ends its transaction or its steps is a verdict; the next sides
    read the rows of the script."""
    n = "SELECT COUNT(*) FROM rentals"
    endless = "WITH RECURSIVE r(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM r) INSERT INTO rentals (days) SELECT x FROM r"
    d = X._Databases(200_000)
    for q in (endless, "INSERT OR ROLLBACK INTO rentals (id) VALUES (1)"):
        for _ in range(3):
            (e1, r1), (e2, _r2), (e3, r3) = X.run_sides(RENTALS, [n, q, n], 200_000, d)
            assert (e1, r1, e3, r3) == (None, [(5,)], None, [(5,)]) and e2.startswith("query error")


def test_planning_runs_no_join(spark):
    """The joins below the scripts run once, with the query, not to count partitions."""
    bad = spark.range(4).select("id", F.raise_error(F.lit("ran")).cast("string").alias("context")).repartition(2, "id")
    t = (spark.range(4).join(bad, "id").hint("merge")
         .select(F.col("id").alias("example_id"), "context", F.array(F.lit("m")).alias("sides"), F.array(F.lit("SELECT 1")).alias("sqls")))
    X.execute_wide(t)
