"""Sampling, splitting and length gates over the derived ``examples``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import chat
from quarry.functions import text as T
from quarry.operators import counting as C
from quarry.operators import sample as S
from quarry.plans.q_text import DUCK_CLASS, DUCK_NORM
from quarry.plans.registry import query
from quarry.plans.views import view, with_views
from quarry.session import cut_lineage
from quarry.sources import io as IO
from quarry.sources.versions import VersionedTable

SEED = 42
SOURCES = ["gretel", "createcontext", "multilevel"]
TOTAL_SHARE = 0.28        # balanced budget = 28% of the examples
NATURAL_SHARE = 0.10      # natural-mix budget
VAL_SIZE = 200
TEST_SIZE = 300
HEAD_N = 1000
MAX_SEQ = 160
SCAN_CAP = 1000           # rows a capped harvest looks at in each source
TOLERATE = 0.05


def candidates(spark, sf_dir):
    """Adapted examples with class and validity (PRJ-1/2, FLT-1/2)."""
    e = view(spark, sf_dir, "examples")
    cls = F.coalesce(F.nullif(F.col("given_class"), F.lit("")), T.classify_sql("gold_sql"))
    valid = T.has_ddl("sql_context") & (F.length(T.strip("gold_sql")) > 0)
    return e.select("example_id", "source", "ext_id", "gold_sql", "question",
                    cls.alias("class"), valid.alias("valid"))


def quotas(spark, sf_dir):
    total = view(spark, sf_dir, "examples").agg(
        F.round(F.count(F.lit(1)) * F.lit(TOTAL_SHARE)).alias("total"))
    cs = view(spark, sf_dir, "class_stats").crossJoin(total)  # one-row frame
    return S.headroom_quotas(cs, F.col("total"))


def balanced(spark, sf_dir):
    return S.quota_sample(candidates(spark, sf_dir), quotas(spark, sf_dir), SOURCES, SEED)


_D_CAND = f"""cand AS (
  SELECT example_id, source, ext_id, gold_sql, question,
         coalesce(nullif(given_class, ''), {DUCK_CLASS.format(x='gold_sql')}) AS class,
         (strpos(upper(coalesce(sql_context, '')), 'CREATE TABLE') > 0
          AND length(regexp_replace(gold_sql, '^\\s+|\\s+$', '', 'g')) > 0) AS valid,
         md5('{SEED}|' || CAST(example_id AS VARCHAR)) AS skey
  FROM examples)"""

_D_QUOTAS = f"""tot AS (SELECT round(COUNT(*) * {TOTAL_SHARE}) AS total FROM examples),
w AS (SELECT class, greatest((1 - acc) * share, 0.03 * (1 - acc)) AS w FROM class_stats),
quotas AS (SELECT class, CAST(greatest(1, round_even(w * (total / SUM(w) OVER ()), 0)) AS BIGINT) AS quota
           FROM w, tot)"""

_D_SRC = "src AS (SELECT * FROM (VALUES ('gretel', 0), ('createcontext', 1), ('multilevel', 2)) AS t(source, idx))"


def _d_quota_sample(cand: str, quotas: str, cap: int | None = None) -> str:
    scanned = "" if cap is None else f"sn.s <= {cap} AND "
    return f"""sn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY skey, example_id) AS s FROM {cand}),
v AS (SELECT sn.*, q.quota, greatest(1, ceil(q.quota / 3)) AS fair, src.idx
      FROM sn JOIN {quotas} q USING (class) JOIN src USING (source) WHERE {scanned}sn.valid),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY class, source ORDER BY skey, example_id) AS r FROM v),
p AS (SELECT *, CASE WHEN r <= fair THEN 1 ELSE 2 END AS pass FROM r WHERE r <= quota),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY class ORDER BY pass, idx, r) AS k FROM p),
pool AS (SELECT example_id, source, class, CAST(pass AS INTEGER) AS pass, k FROM k WHERE k <= quota)"""


_D_POOL = f"{_D_CAND},\n{_D_QUOTAS},\n{_D_SRC},\n{_d_quota_sample('cand', 'quotas')}"


@query("seeded_shuffle", oracle=with_views(f"""
SELECT example_id, ROW_NUMBER() OVER (ORDER BY md5('{SEED}|' || CAST(example_id AS VARCHAR)), example_id) - 1 AS pos
FROM examples"""))
def seeded_shuffle(spark, sf_dir):
    e = view(spark, sf_dir, "examples").select("example_id")
    return S.rank_in_groups(e.withColumn("k", S.shuffle_key(SEED, "example_id")), [],
                            ["k", "example_id"]).select("example_id", "pos")


@query("headroom_quotas", oracle=with_views(f"WITH {_D_QUOTAS} SELECT class, quota FROM quotas"))
def headroom_quotas(spark, sf_dir):
    return quotas(spark, sf_dir)


@query("quota_sample", bench=True, oracle=with_views(f"WITH {_D_POOL} SELECT * FROM pool"))
def quota_sample(spark, sf_dir):
    return balanced(spark, sf_dir)


@query("quota_sample_capped", oracle=with_views(
    f"WITH {_D_CAND},\n{_D_QUOTAS},\n{_D_SRC},\n{_d_quota_sample('cand', 'quotas', SCAN_CAP)} SELECT * FROM pool"))
def quota_sample_capped(spark, sf_dir):
    """The quota fill of a harvest that looks at ``SCAN_CAP`` rows of each source (SRT-6)."""
    return S.quota_sample(candidates(spark, sf_dir), quotas(spark, sf_dir), SOURCES, SEED, scan_cap=SCAN_CAP)


@query("quota_fill", oracle=with_views(f"""
WITH {_D_POOL},
got AS (SELECT class, COUNT(*) AS got FROM pool GROUP BY class)
SELECT q.class, q.quota, coalesce(got.got, 0) AS got, coalesce(got.got, 0) < q.quota AS exhausted
FROM quotas q LEFT JOIN got USING (class)"""))
def quota_fill(spark, sf_dir):
    valid = candidates(spark, sf_dir).where("valid")
    counts = valid.groupBy("class", "source").agg(F.count(F.lit(1)).alias("n"))
    q = quotas(spark, sf_dir)
    return S.quota_fill(C.quota_takes(counts, q, SOURCES), q)


@query("natural_sample", oracle=with_views(f"""
WITH cand0 AS (SELECT * REPLACE ('all' AS class) FROM ({_D_CAND[len('cand AS ('):-1]})),
nq AS (SELECT 'all' AS class, CAST(round(COUNT(*) * {NATURAL_SHARE}) AS BIGINT) AS quota FROM examples),
{_D_SRC},
{_d_quota_sample('cand0', 'nq')}
SELECT * FROM pool"""))
def natural_sample(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("class", F.lit("all"))
    want = view(spark, sf_dir, "examples").agg(
        F.round(F.count(F.lit(1)) * F.lit(NATURAL_SHARE)).cast("long").alias("quota"))
    q = want.select(F.lit("all").alias("class"), "quota")
    return S.quota_sample(c, q, SOURCES, SEED)


def _pool(spark, sf_dir):
    """Candidates and pool, each stored once in the shared checkpoint folder:
    the splits and the id exclusion read them again."""
    keep = candidates(spark, sf_dir).drop("question", "gold_sql")
    c = cut_lineage(keep)
    pool, _ = S.quota_rows(c, quotas(spark, sf_dir), SOURCES, SEED)
    return c, cut_lineage(pool.select("example_id", "skey").join(c.select("example_id", "ext_id"), "example_id"))


def _one(spark, n):
    return spark.range(1).select(F.lit(n).alias("take"))


def _train_valid(spark, pool):
    """The first rows of the pool in shuffle order validate, the others train."""
    first = C.first_rows(pool, _one(spark, VAL_SIZE), [], "skey", "example_id").select("example_id", F.lit("valid").alias("split"))
    return (pool.select("example_id").join(F.broadcast(first), "example_id", "left")  # VAL_SIZE rows
            .select("example_id", F.coalesce("split", F.lit("train")).alias("split")))


def _held_out(spark, c, pool):
    """Test rows: the first source only, another seed, ids not in the pool."""
    test = (c.where((F.col("source") == "gretel") & F.col("valid"))
            .join(pool.select("ext_id"), "ext_id", "left_anti")
            .select("example_id", S.shuffle_key(SEED + 1, "example_id").alias("skey")))
    return C.first_rows(test, _one(spark, TEST_SIZE), [], "skey", "example_id").select("example_id", F.lit("test").alias("split"))


def _splits(spark, sf_dir):
    c, pool = _pool(spark, sf_dir)
    return _train_valid(spark, pool).unionByName(_held_out(spark, c, pool))


_D_SPLITS = f"""{_D_POOL},
tv AS (SELECT example_id, CASE WHEN ROW_NUMBER() OVER (ORDER BY md5('{SEED}|' || CAST(example_id AS VARCHAR)), example_id) <= {VAL_SIZE}
                               THEN 'valid' ELSE 'train' END AS split FROM pool),
pool_ext AS (SELECT c.ext_id FROM cand c JOIN pool USING (example_id)),
tc AS (SELECT example_id FROM cand c
       WHERE source = 'gretel' AND valid
         AND NOT EXISTS (SELECT 1 FROM pool_ext p WHERE p.ext_id = c.ext_id)),
te AS (SELECT example_id, 'test' AS split FROM tc
       QUALIFY ROW_NUMBER() OVER (ORDER BY md5('{SEED + 1}|' || CAST(example_id AS VARCHAR)), example_id) <= {TEST_SIZE}),
splits AS (SELECT * FROM tv UNION ALL SELECT * FROM te)"""


@query("split_train_valid", oracle=with_views(f"WITH {_D_SPLITS} SELECT * FROM tv"))
def split_train_valid(spark, sf_dir):
    return _train_valid(spark, _pool(spark, sf_dir)[1])


@query("split_three_way", oracle=with_views(f"WITH {_D_SPLITS} SELECT * FROM splits"))
def split_three_way(spark, sf_dir):
    return _splits(spark, sf_dir)


@query("holdout_antijoin", oracle=with_views(f"""
WITH {_D_POOL},
pool_ext AS (SELECT c.ext_id FROM cand c JOIN pool USING (example_id))
SELECT example_id FROM cand c WHERE source = 'gretel'
  AND NOT EXISTS (SELECT 1 FROM pool_ext p WHERE p.ext_id = c.ext_id)"""))
def holdout_antijoin(spark, sf_dir):
    """Test rows whose id is in the pool are skipped; NULL ids never match (JN-2)."""
    c, pool = _pool(spark, sf_dir)
    return c.where(F.col("source") == "gretel").join(pool.select("ext_id"), "ext_id", "left_anti").select("example_id")


@query("leak_audit", oracle=with_views(f"""
WITH {_D_SPLITS},
tr AS (SELECT DISTINCT {DUCK_NORM.format(x='c.gold_sql')} AS g, c.question AS q
       FROM cand c JOIN splits s USING (example_id) WHERE s.split = 'train'),
ts AS (SELECT DISTINCT {DUCK_NORM.format(x='c.gold_sql')} AS g, c.question AS q
       FROM cand c JOIN splits s USING (example_id) WHERE s.split = 'test')
SELECT (SELECT COUNT(*) FROM (SELECT g FROM tr INTERSECT SELECT g FROM ts)) AS shared_gold,
       (SELECT COUNT(*) FROM (SELECT q FROM tr INTERSECT SELECT q FROM ts)) AS shared_question"""))
def leak_audit(spark, sf_dir):
    """Overlap between train and held-out: shared normalised gold queries and
    shared question texts (JN-3)."""
    c = candidates(spark, sf_dir).select(
        "example_id", T.normalize_sql("gold_sql").alias("g"), F.col("question").alias("q"))
    sp = _splits(spark, sf_dir)
    tr = c.join(sp.where(F.col("split") == "train"), "example_id")
    ts = c.join(sp.where(F.col("split") == "test"), "example_id")
    g = tr.select("g").intersect(ts.select("g")).agg(F.count(F.lit(1)).alias("shared_gold"))
    q = tr.select("q").intersect(ts.select("q")).agg(F.count(F.lit(1)).alias("shared_question"))
    return g.crossJoin(q)  # two one-row aggregates


@query("dedupe_gold", oracle=with_views(f"""
SELECT {DUCK_NORM.format(x='gold_sql')} AS norm, MIN(example_id) AS example_id, COUNT(*) AS copies
FROM examples GROUP BY 1"""))
def dedupe_gold(spark, sf_dir):
    """One example per normalised gold query (SET-5)."""
    e = view(spark, sf_dir, "examples")
    return (e.groupBy(T.normalize_sql("gold_sql").alias("norm"))
            .agg(F.min("example_id").alias("example_id"), F.count(F.lit(1)).alias("copies")))


@query("limit_then_filter", oracle=with_views(f"""
WITH h AS (SELECT example_id, sql_context, gold_sql FROM examples ORDER BY example_id LIMIT {HEAD_N})
SELECT example_id FROM h WHERE strpos(upper(coalesce(sql_context, '')), 'CREATE TABLE') > 0"""))
def limit_then_filter(spark, sf_dir):
    """Take the first N, then drop non-runnable ones: scored n can be < N (SRT-2)."""
    e = view(spark, sf_dir, "examples")
    head = e.orderBy("example_id").limit(HEAD_N)
    return head.where(T.has_ddl("sql_context")).select("example_id")


def _lengths(spark, sf_dir):
    e = view(spark, sf_dir, "examples")
    m = chat.messages("sql_context", "question", "gold_sql")
    return e.select("example_id", T.word_tokens(chat.render(m)).alias("len"))


_D_RENDER = ("'<|im_start|>system' || chr(10) || 'You are a precise text-to-SQL engine. Given a SQLite schema and a question, "
             "reply with a single valid SQLite query that answers it. Output only the SQL. No explanation, no markdown, "
             "no commentary.' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '### Schema' || chr(10) || "
             "regexp_replace(sql_context, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || '### Question' || chr(10) || "
             "regexp_replace(question, '^\\s+|\\s+$', '', 'g') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || "
             "gold_sql || '<|im_end|>' || chr(10)")
_D_LEN = f"lens AS (SELECT example_id, len(regexp_extract_all({_D_RENDER}, '\\w+|[^\\w\\s]')) AS len FROM examples)"


@query("length_stats", oracle=with_views(f"""
WITH {_D_LEN},
o AS (SELECT len, ROW_NUMBER() OVER (ORDER BY len) - 1 AS pos, COUNT(*) OVER () AS n FROM lens)
SELECT n, MAX(CASE WHEN pos = greatest(0, floor(n * 0.5) - 1) THEN len END) AS p50,
          MAX(CASE WHEN pos = greatest(0, floor(n * 0.9) - 1) THEN len END) AS p90,
          MAX(CASE WHEN pos = greatest(0, floor(n * 0.99) - 1) THEN len END) AS p99,
          MAX(len) AS max
FROM o GROUP BY n"""))
def length_stats(spark, sf_dir):
    return C.value_picks(_lengths(spark, sf_dir), "len", [0.5, 0.9, 0.99])


@query("length_drop", oracle=with_views(f"WITH {_D_LEN} SELECT example_id, len FROM lens WHERE len <= {MAX_SEQ}"))
def length_drop(spark, sf_dir):
    return _lengths(spark, sf_dir).where(F.col("len") <= MAX_SEQ)


@query("length_gate", oracle=with_views(f"""
WITH {_D_LEN}
SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE len > {MAX_SEQ}) AS over,
       ROUND(CAST(COUNT(*) FILTER (WHERE len > {MAX_SEQ}) AS DOUBLE) / COUNT(*), 4) AS share,
       CAST(COUNT(*) FILTER (WHERE len > {MAX_SEQ}) AS DOUBLE) / COUNT(*) <= {TOLERATE} AS ok
FROM lens"""))
def length_gate(spark, sf_dir):
    """Over-cap count and share; ok when the share is within tolerance (FLT-5)."""
    ln = _lengths(spark, sf_dir)
    over = F.count_if(F.col("len") > MAX_SEQ)
    share = over.cast("double") / F.count(F.lit(1))
    return ln.agg(F.count(F.lit(1)).alias("n"), over.alias("over"),
                  F.round(share, 4).alias("share"), (share <= F.lit(TOLERATE)).alias("ok"))


_D_KEPT = f"lens2 AS (SELECT * FROM lens WHERE len <= {MAX_SEQ})"


@query("length_rewrite", oracle=with_views(f"""
WITH {_D_LEN}, {_D_KEPT}
SELECT example_id, len, (SELECT COUNT(*) FROM lens) AS n_before, (SELECT COUNT(*) FROM lens2) AS n_after, 2 AS version FROM lens2"""))
def length_rewrite(spark, sf_dir):
    """Drop rows over the cap from a stored table: a second version of it,
    made while the first is read, and its rows (SNK-3)."""
    t = VersionedTable(spark, IO.scratch(spark, "lengths"))
    t.write(_lengths(spark, sf_dir))
    before, after = t.rewrite(lambda d: d.where(F.col("len") <= MAX_SEQ))
    return t.read().select("example_id", "len", F.lit(before).cast("long").alias("n_before"), F.lit(after).cast("long").alias("n_after"),
                           F.lit(t.latest()["version"]).cast("int").alias("version"))


@query("keep_test_split", oracle=with_views(f"""
WITH {_D_SPLITS} SELECT example_id, (SELECT COUNT(*) FROM te) AS n FROM te"""))
def keep_test_split(spark, sf_dir):
    """A test split that is there already stays as it is when the splits are
    drawn again, from other rows even (SNK-4)."""
    c, pool = _pool(spark, sf_dir)
    t = VersionedTable(spark, IO.scratch(spark, "test-split"))
    t.keep(_held_out(spark, c, pool).select("example_id"))
    n = t.keep(c.select("example_id"))
    return t.read().select("example_id", F.lit(n).cast("long").alias("n"))
