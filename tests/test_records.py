"""Generated records: each script and gold query run, and give the answer."""
import sqlite3

from pyspark.sql import functions as F

from quarry.operators import records as R


def test_gold_queries_give_the_answers(spark):
    got = R.records(spark.range(400), "id").collect()
    assert len(got) == 400 and {r.kind for r in got} == {"share", "topn", "top1", "rank", "above_avg"}
    forms = set()
    for r in got:
        con = sqlite3.connect(":memory:")
        con.executescript(r.sql_context)
        rows = con.execute(r.gold_sql).fetchall()
        con.close()
        assert rows
        want = []
        for a in r.answer:
            extra = {"share": (a.pct,), "topn": (a.n_ids, a.pct, a.rnk), "rank": (a.rnk,)}.get(r.kind, ())
            want.append((a.grp, a.sub, float(a.total), *extra))
        assert len(rows) == len(want)
        for got_row, want_row in zip(sorted(rows), sorted(want)):
            assert all(x == y or abs(x - y) <= 1e-4 for x, y in zip(got_row, want_row)), r.gold_sql
        assert [x[0] for x in rows] == sorted(x[0] for x in rows)  # by group
        assert [m.role for m in r.messages] == ["system", "user", "assistant"] and r.messages[2].content == r.gold_sql
        forms.add((r.kind, "AS (" in r.gold_sql.split(") SELECT")[0][10:], "JOIN" in r.gold_sql, " x WHERE" in r.gold_sql))
    assert len(forms) >= 14


def test_later_attempts_are_made_only_where_earlier_fail(spark):
    some = lambda **k: {r.gen_id: r for r in R.records(spark.range(600), "id", unambiguous=True, **k).select("gen_id", "attempts", "kind", "answer").collect()}
    got, once = some(), some(attempts=1)
    assert len(got) == 600 and max(r.attempts for r in got.values()) > 2
    assert set(once) == {i for i, r in got.items() if r.attempts == 1} and len(once) < 600
    for r in got.values():
        if r.kind in ("topn", "top1", "rank"):
            assert len({(a.grp, a.total) for a in r.answer}) == len(r.answer)


def test_first_records_are_a_prefix(spark):
    made = R.records(spark.range(300), "id").select("gen_id")
    all_ = {r.gen_id: r.position for r in R.first_records(made, 1000, 7).collect()}
    few = {r.gen_id: r.position for r in R.first_records(made, 25, 7).collect()}
    assert sorted(all_.values()) == list(range(1, 301)) and sorted(few.values()) == list(range(1, 26))
    assert all(all_[i] == p for i, p in few.items())


def test_no_shuffle_makes_a_record(spark):
    plan = R.records(spark.range(10).select(F.col("id")), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
