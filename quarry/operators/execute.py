"""Execution of example queries against their own small schemas (EXE-1,
FLT-3, SRC-6) and of query workloads on registered tables (EXE-2).

Each example carries its own CREATE/INSERT script, so the engine that runs it
is an in-memory SQLite database inside the task (``mapInArrow``).  Spark distributes the examples; the comparison of result sets stays
relational (``quarry.operators.compare``): the job only emits one canonical
row key per result row, with its fetch position.

Guards for untrusted scripts: an authorizer refuses ATTACH/DETACH and every
PRAGMA except ``table_info``; a progress handler stops a statement after a
fixed number of VM steps (an endless query becomes a verdict, not a stuck
task).  What a side changes is rolled back, so a prediction cannot change
the data its gold query reads.

Opening a database and asking the authorizer cost about as much as a short
script.  Scripts and queries without a word that the authorizer could refuse,
or that could see what ran before (``plain``), run one after another in one
database a task, each in a transaction that is rolled back; the others have a
guarded database of their own.
"""

from __future__ import annotations

import re
import sqlite3
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import compare as C
from quarry.session import tasks_for

EXEC_SCHEMA = ("example_id long, side string, runs boolean, error string, "
               "pos long, row_key string")
CATALOG_SCHEMA = "context_id long, tbl string, col string, ordinal int, type string, pk int"
STEP_LIMIT = 20_000_000


TASK_SCRIPTS = 20_000  # scripts of one task, where their number is known

_DENY_IN_SIDE = {sqlite3.SQLITE_TRANSACTION, sqlite3.SQLITE_SAVEPOINT}

# What the authorizer refuses (ATTACH and DETACH end alike), also where SQLite runs it
# by itself (VACUUM, ALTER TABLE, virtual tables), and what shows or keeps earlier scripts.
_GUARDED = ("tach", "pragma", "vacuum", "virtual", "alter", "rollback", "savepoint", "commit", "changes", "last_insert", "sqlite_", "dbstat")
_TEMP = re.compile(r"\btemp(?:orary)?\b")
_CONTROL = re.compile(r"\b(?:begin|end|release)\b")


def is_select(sql: str) -> bool:
    return sql.lstrip()[:6].lower() == "select"


def plain(script: str, sqls=()) -> bool:
    """No word of the script or its queries, in whatever place, asks for a
    guarded database.  END of a CASE may stand in a SELECT."""
    control = " ".join([script, *(q for q in sqls if not is_select(q))]).lower()
    low = " ".join([control, *(q.lower() for q in sqls if is_select(q))])
    for w in _GUARDED:
        if w in low:
            return False
    return not ("temp" in low and _TEMP.search(low)
                or ("end" in control or "begin" in control or "release" in control) and _CONTROL.search(control))


class _Db:
    """One in-memory database with the guards; ``side_mode`` additionally
    refuses transaction control so that a side cannot end its savepoint.
    Without ``guarded`` it takes one ``plain`` script after another."""

    def __init__(self, step_limit: int, guarded: bool = True):
        self.con = sqlite3.connect(":memory:", isolation_level=None, cached_statements=128 if guarded else 0)
        self.con.text_factory = str
        self.guarded = guarded
        self.side_mode = False
        self.steps = 0
        self.limit = step_limit
        if guarded:
            self.con.set_authorizer(self._auth)
        self.con.set_progress_handler(self._tick, 1000)

    def build(self, script: str):
        self.script, self.steps = script, 0
        self.con.executescript(script if self.guarded else "BEGIN;" + script)

    def _auth(self, action, arg1, arg2, db, trigger):
        if action in (sqlite3.SQLITE_ATTACH, sqlite3.SQLITE_DETACH):
            return sqlite3.SQLITE_DENY
        if action == sqlite3.SQLITE_PRAGMA and (arg1 or "").lower() != "table_info":
            return sqlite3.SQLITE_DENY
        if self.side_mode and action in _DENY_IN_SIDE:
            return sqlite3.SQLITE_DENY
        return sqlite3.SQLITE_OK

    def _tick(self):
        self.steps += 1
        return 1 if self.steps * 1000 > self.limit else 0

    def run_side(self, sql: str):
        """Run one query; every change it makes is rolled back."""
        self.steps = 0
        if not self.guarded and is_select(sql):  # changes nothing
            try:
                return None, self.con.execute(sql).fetchall()
            except Exception as exc:  # noqa: BLE001 -- any failure is a verdict
                return f"query error: {exc}", []
        self.con.execute("SAVEPOINT side")
        self.side_mode = True
        try:
            return None, self.con.execute(sql).fetchall()
        except Exception as exc:  # noqa: BLE001 -- any failure is a verdict
            return f"query error: {exc}", []
        finally:
            self.side_mode, self.steps = False, 0  # the rollback is not stopped
            if self.con.in_transaction:
                self.con.execute("ROLLBACK TO side")
                self.con.execute("RELEASE side")
            elif not self.guarded:  # a stopped change took the script's rows along
                self.build(self.script)

    def close(self):
        self.con.close()


class _Databases:
    """The databases of one task: ``use(script, sqls)`` gives the one to build
    the script in, ``done`` leaves nothing of it."""

    def __init__(self, step_limit: int):
        self.limit = step_limit
        self.kept = None

    def use(self, script: str, sqls=()) -> _Db:
        if not plain(script, sqls):
            return _Db(self.limit)
        if self.kept is None:
            self.kept = _Db(self.limit, guarded=False)
        return self.kept

    def done(self, db: _Db):
        if db.guarded:
            db.close()
        elif db.con.in_transaction:
            db.steps = 0
            db.con.rollback()

    def close(self):
        if self.kept is not None:
            self.kept.close()


def cell_text(v) -> str:
    """One cell of a row key, in the kinds of ``compare.cell_key``."""
    if v is None:
        return "z"
    if isinstance(v, (bytes, bytearray)):
        kind, t = "b", bytes(v).hex().upper()
    elif isinstance(v, float):
        r = round(v, 4)
        kind, t = "n", str(int(r)) if r.is_integer() and abs(r) < 2 ** 63 else repr(r)
    elif isinstance(v, int):
        kind, t = "n", str(int(v))
    else:
        kind, t = "t", str(v).strip()
    return f"{kind}{len(t)}:{t}"


def run_sides(context: str, sqls, step_limit: int = STEP_LIMIT, databases: _Databases | None = None):
    """Build the schema once, run each query on the pristine data: a list of
    (error or None, rows), one per query."""
    out = [None] * len(sqls)
    todo = [i for i, q in enumerate(sqls) if q]
    for i, q in enumerate(sqls):
        if not q:
            out[i] = ("model produced no SQL", [])
    if not todo:
        return out
    own = databases or _Databases(step_limit)
    db = own.use(context or "", [sqls[i] for i in todo])
    try:
        try:
            db.build(context or "")
        except Exception as exc:  # noqa: BLE001
            for i in todo:
                out[i] = (f"schema error: {exc}", [])
            return out
        for i in todo:
            out[i] = db.run_side(sqls[i])
        return out
    finally:
        own.done(db)
        if databases is None:
            own.close()


def run_one(context: str, sql: str, step_limit: int = STEP_LIMIT):
    """(error or None, rows) for one query on a fresh database."""
    return run_sides(context, [sql], step_limit)[0]


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows), fields)],
                                      names=[n for n, _ in fields])


def _batches(row_of, schema: str, step_limit: int):
    """``mapInArrow`` function: the output rows that ``row_of`` (the task's
    databases, the cells of one input row) lists for each input row."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        databases = _Databases(step_limit)
        try:
            for batch in batches:
                out = []
                for cells in zip(*(c.to_pylist() for c in batch.columns)):
                    out.extend(row_of(databases, *cells))
                    if len(out) >= 20_000:
                        yield _batch(out, schema)
                        out = []
                if out:  # an empty batch is not yielded at all
                    yield _batch(out, schema)
        finally:
            databases.close()
    return fn


def _exec_rows(databases, eid, ctx, sides, sqls):
    out = []
    for side, (err, rows) in zip(sides, run_sides(ctx, ["" if q is None else q for q in sqls], databases=databases)):
        if err is not None or not rows:
            out.append((eid, side, err is None, err, None, None))
        else:
            out.extend((eid, side, True, None, i, "".join([cell_text(c) for c in r])) for i, r in enumerate(rows))
    return out


def spread(df: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Hash-spread the rows over ``tasks``, by default twice the cluster's cores
    (a few large files hold few splits): each row is independent CPU work, so
    parallelism matters more than the one shuffle it costs."""
    return df.repartition(tasks or 2 * df.sparkSession.sparkContext.defaultParallelism, key)


def execute_wide(examples: DataFrame, step_limit: int = STEP_LIMIT, tasks: int | None = None) -> DataFrame:
    """(example_id, context, sides array<string>, sqls array<string>): one
    build per example, every side on pristine data.  One output row per
    result row; a query that failed or returned nothing gives one row with
    NULL pos."""
    t = spread(examples.select(F.col("example_id").cast("long"), "context", "sides", "sqls"), "example_id", tasks)
    return t.mapInArrow(_batches(_exec_rows, EXEC_SCHEMA, step_limit), EXEC_SCHEMA)


def execute(tasks: DataFrame, step_limit: int = STEP_LIMIT) -> DataFrame:
    """Long form: (example_id, side, context, sql) tasks.  The sides of one
    example (a handful) are gathered so that its schema is built once."""
    w = (tasks.groupBy("example_id", "context")
         .agg(F.array_sort(F.collect_list(F.struct("side", "sql"))).alias("t")))
    w = w.select("example_id", "context", F.col("t.side").alias("sides"), F.col("t.sql").alias("sqls"))
    return execute_wide(w, step_limit)


def score(executed: DataFrame, ordered: DataFrame, sides) -> DataFrame:
    """(example_id, side, runs, exec_ok) for every predicted side against the
    gold side.  ``ordered``: one row (example_id, ordered) per example -- the
    gold asked for an order.  A side without a query counts as not run.
    Comparison is relational: bag or position-wise on row keys."""
    runs = executed.groupBy("example_id", "side").agg(F.bool_and("runs").alias("runs"))
    gold_runs = runs.where(F.col("side") == "gold").select("example_id", F.col("runs").alias("gold_runs"))
    keys = executed.where(F.col("pos").isNotNull()).select("example_id", "side", "pos", "row_key")
    out = None
    for s in sides:
        k = (keys.where(F.col("side").isin("gold", s))
             .withColumn("side", F.when(F.col("side") == "gold", "gold").otherwise("pred")))
        ids = ordered.select("example_id", "ordered")
        m = C.match_results(k, ids).withColumn("side", F.lit(s))
        out = m if out is None else out.unionByName(m)
    # every side of every example, also where there was no query to run
    pr = (ordered.select("example_id", F.explode(F.array(*[F.lit(s) for s in sides])).alias("side"))
          .join(runs, ["example_id", "side"], "left").withColumn("runs", F.coalesce("runs", F.lit(False))))
    j = pr.join(gold_runs, "example_id", "left").join(out, ["example_id", "side"], "left")
    return j.select("example_id", "side", "runs",
                    (F.col("runs") & F.coalesce("gold_runs", F.lit(False))
                     & F.coalesce("match", F.lit(False))).alias("exec_ok"))


TABLE_NAMES = "SELECT name FROM sqlite_master WHERE type='table' ORDER BY name"


def _catalog_rows(databases, cid, ctx):
    db = databases.use(ctx or "")
    try:
        db.build(ctx or "")
        tables = [r[0] for r in db.con.execute(TABLE_NAMES)]
        return [(cid, t, r[1], r[0], r[2] or "", r[5]) for t in tables for r in db.con.execute(f"PRAGMA table_info({t})")]
    except Exception:  # noqa: BLE001 -- unparseable: no catalog
        return []
    finally:
        databases.done(db)


SAMPLE_SCHEMA = "context_id long, tbl string, line string"


def _sample_rows(n: int):
    def row_of(databases, cid, ctx):
        out = []
        db = databases.use(ctx or "")
        try:
            db.build(ctx or "")
            for t in [r[0] for r in db.con.execute(TABLE_NAMES)]:
                rows = db.con.execute(f"SELECT * FROM {t} LIMIT {int(n)}").fetchall()
                if rows:
                    cols = [r[1] for r in db.con.execute(f"PRAGMA table_info({t})")]
                    out.append((cid, t, f"--   {t}: " + " | ".join(
                        ", ".join(f"{c}={v!r}" for c, v in zip(cols, row)) for row in rows)))
        except Exception:  # noqa: BLE001 -- unparseable: no samples
            pass
        finally:
            databases.done(db)
        return out
    return row_of


def sample_rows_scan(contexts: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows of every table of every script, one rendered line per
    table (WIN-9); the row count per table is bounded by ``n``."""
    c = contexts.select(F.col("context_id").cast("long"), "context")
    return (spread(c, "context_id", tasks_for(c, TASK_SCRIPTS))
            .mapInArrow(_batches(_sample_rows(n), SAMPLE_SCHEMA, STEP_LIMIT), SAMPLE_SCHEMA))


def catalog_scan(contexts: DataFrame) -> DataFrame:
    """(context_id, context) -> catalog rows from SQLite's own catalog (SRC-6)."""
    c = contexts.select(F.col("context_id").cast("long"), "context")
    return (spread(c, "context_id", tasks_for(c, TASK_SCRIPTS))
            .mapInArrow(_batches(_catalog_rows, CATALOG_SCHEMA, STEP_LIMIT), CATALOG_SCHEMA))


def run_workload(spark: SparkSession, pairs, views: dict[str, DataFrame]) -> DataFrame:
    """Run (pair_id, gold_sql, candidate_sql) on registered views with Spark
    SQL and compare each pair's results as bags (EXE-2).  A query that fails
    to analyse or run is a verdict (runs = false), not a crash.  The loop is
    over the workload's queries; every query itself runs distributed."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    rows = []
    for pid, gold_sql, cand_sql in pairs:
        try:
            g = spark.sql(gold_sql)
        except Exception as exc:  # noqa: BLE001
            rows.append((pid, False, False, f"gold: {type(exc).__name__}"))
            continue
        try:
            c = spark.sql(cand_sql)
            if len(c.columns) != len(g.columns):
                rows.append((pid, True, False, "column count differs"))
                continue
            ok = C.frames_equal_bag(g, c).first()["match"]
            rows.append((pid, True, bool(ok), None))
        except Exception as exc:  # noqa: BLE001
            rows.append((pid, False, False, f"candidate: {type(exc).__name__}"))
    return spark.createDataFrame(rows, "pair_id string, runs boolean, match boolean, error string")
