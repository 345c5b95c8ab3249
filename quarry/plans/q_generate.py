"""Generated multi-level examples, one per ``customer`` row (GEN-1..5,
TXT-11, FLT-9, FLT-10, SET-1)."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import chat
from quarry.operators import catalog as K
from quarry.operators import counting as C
from quarry.operators import generate as G
from quarry.operators import records as R
from quarry.operators import sample as S
from quarry.plans import q_sample
from quarry.plans.registry import query
from quarry.plans.views import hexd as dhex
from quarry.plans.views import with_views
from quarry.session import cut_lineage, dealt
from quarry.sources.tables import load


TASK_SEEDS, TASK_RECORDS = 50_000, 20_000  # ids that one task makes facts or whole records of


def _seeds(spark, sf_dir):
    """The seeds of ``customer``, dealt by id once: all that is grouped by an id
    stays where its seed is, and a task holds the groups of few ids."""
    ids = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("gen_id"))
    return G.seeds(dealt(ids, TASK_SEEDS, "gen_id"), "gen_id")


# ---------------------------------------------------------------- DuckDB twin

def _lit(v):
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _dpick(values, idx: str) -> str:
    return "[" + ", ".join(_lit(v) for v in values) + f"][({idx}) + 1]"


def _dkey(tag: str, *cols: str) -> str:
    return "concat_ws('|', '" + tag + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"


def _dtemplate(text: str) -> str:
    parts = re.split(r"\{(\w+)\}", text)
    out = []
    for i, p in enumerate(parts):
        if i % 2 == 1:
            out.append(f"CAST({p} AS VARCHAR)")
        elif p:
            out.append(_lit(p))
    return "(" + " || ".join(out) + ")"


_K = _dkey("g", "gen_id")
_FIELDS = ",\n       ".join(f"{_dpick([d[j] for d in G.DOMAINS], 'd')} AS {name}"
                            for j, name in enumerate(G.FIELDS))
_D_SEEDS = f"""
s0 AS (SELECT c_custkey AS gen_id FROM customer),
s1 AS (SELECT gen_id, {dhex(_K, 1)} % {len(G.DOMAINS)} AS d,
              {_dpick(G.KINDS, f'{dhex(_K, 2)} % {len(G.KINDS)}')} AS kind,
              {_dpick([2, 2, 3], f'{dhex(_K, 3)} % 3')} AS n,
              {dhex(_K, 4)} < 10 AS three,
              {_dpick([3, 3, 4], f'{dhex(_K, 5)} % 3')} AS ng,
              {_dpick([3, 3, 4], f'{dhex(_K, 6)} % 3')} AS ns,
              {dhex(_K, 7)} % {len(G.GROUP_NAMES)} AS goff,
              {dhex(_K, 8)} % {len(G.SUB_NAMES)} AS soff,
              {_dpick(G.A_GRP, f'{dhex(_K, 9)} % {len(G.A_GRP)}')} AS ga,
              {_dpick(G.A_TOT, f'{dhex(_K, 10)} % {len(G.A_TOT)}')} AS ta,
              {_dpick(G.A_PCT, f'{dhex(_K, 11)} % {len(G.A_PCT)}')} AS pa,
              {_dpick(G.A_RNK, f'{dhex(_K, 12)} % {len(G.A_RNK)}')} AS ra,
              {dhex(_K, 13)} % 2 AS ph
       FROM s0),
s AS (SELECT *, {_FIELDS} FROM s1)"""

_Q_CASES = " ".join(f"WHEN kind = '{k}' AND ph = {i} THEN {_dtemplate(t)}"
                    for k, pool in G.PHRASES.items() for i, t in enumerate(pool))

_ROW = _dkey("r", "gen_id", "i", "j", "c")
_D_FACTS = f"""
f1 AS (SELECT gen_id, three, goff, soff, ns, unnest(range(1, ng + 1)) AS i FROM s),
f2 AS (SELECT gen_id, three, goff, soff, i, unnest(range(1, ns + 1)) AS j FROM f1),
f3 AS (SELECT *, unnest(CASE WHEN {dhex(_dkey('c', 'gen_id', 'i', 'j'), 1)} < 6 THEN [1, 2] ELSE [1] END) AS c FROM f2),
facts AS (
  SELECT gen_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(c AS INTEGER) AS c,
         {_dpick(G.GROUP_NAMES, f'(goff + i - 1) % {len(G.GROUP_NAMES)}')} AS grp,
         {_dpick(G.SUB_NAMES, f'(soff + j - 1) % {len(G.SUB_NAMES)}')} AS sub,
         CAST({dhex(_ROW, 1)} % 4 + 1 AS BIGINT) AS qty,
         CAST(CASE WHEN three THEN {_dpick(G.PRICES, f"{dhex(_dkey('p', 'gen_id', 'j'), 1)} % {len(G.PRICES)}")}
                   ELSE {_dpick(G.PRICES, f'{dhex(_ROW, 3)} % {len(G.PRICES)}')} END AS BIGINT) AS price,
         {dhex(_ROW, 2)} < 12 AS good
  FROM f3)"""

_D_GOLD = """
cells AS (SELECT gen_id, grp, sub, CAST(SUM(qty * price) AS BIGINT) AS total FROM facts WHERE good GROUP BY gen_id, grp, sub),
g2 AS (SELECT *, SUM(total) OVER (PARTITION BY gen_id, grp) AS gt, AVG(total) OVER (PARTITION BY gen_id, grp) AS gavg,
              RANK() OVER (PARTITION BY gen_id, grp ORDER BY total DESC) AS rk FROM cells),
gold AS (SELECT g2.gen_id, s.kind, g2.grp, g2.sub, g2.total,
                CASE WHEN s.kind IN ('share', 'topn') THEN ROUND(CAST(g2.total AS DOUBLE) * 100.0 / g2.gt, 4) END AS pct,
                CASE WHEN s.kind IN ('topn', 'rank') THEN g2.rk END AS rnk, s.n
         FROM g2 JOIN s USING (gen_id)
         WHERE s.kind IN ('share', 'rank') OR (s.kind = 'topn' AND g2.rk <= s.n)
            OR (s.kind = 'top1' AND g2.rk = 1) OR (s.kind = 'above_avg' AND g2.total > g2.gavg))"""

_D_CHECKS = """
pg AS (SELECT gen_id, grp, MIN(rnk) AS minr, SUM(pct) AS sp, MAX(kind) AS kind FROM gold GROUP BY gen_id, grp),
gok AS (SELECT gen_id, bool_and(minr IS NULL OR minr = 1) AS rank_ok,
               bool_and(kind <> 'share' OR abs(sp - 100) < 0.01) AS sum_ok FROM pg GROUP BY gen_id),
rws AS (SELECT gen_id, COUNT(*) AS rows,
               bool_and(pct IS NULL OR (pct > 0 AND pct <= 100.0001)) AS pct_ok,
               bool_and(rnk IS NULL OR kind <> 'topn' OR rnk <= n) AS topn_ok FROM gold GROUP BY gen_id),
checks AS (SELECT s.gen_id, s.kind, coalesce(r.rows, 0) AS rows, coalesce(r.pct_ok, TRUE) AS pct_ok,
                  coalesce(g.rank_ok, TRUE) AS rank_ok, coalesce(r.topn_ok, TRUE) AS topn_ok,
                  coalesce(g.sum_ok, TRUE) AS sum_ok
           FROM s LEFT JOIN rws r USING (gen_id) LEFT JOIN gok g USING (gen_id)),
verified AS (SELECT *, rows > 0 AND pct_ok AND rank_ok AND topn_ok AND sum_ok AS ok FROM checks)"""

_GEN = f"{_D_SEEDS},{_D_FACTS},{_D_GOLD},{_D_CHECKS}"


@query("gen_questions", oracle=with_views(f"""
WITH {_D_SEEDS}
SELECT gen_id, fact AS domain, kind, n, CASE {_Q_CASES} END AS question FROM s"""))
def gen_questions(spark, sf_dir):
    return G.questions(_seeds(spark, sf_dir))


@query("gen_facts", oracle=with_views(f"WITH {_D_SEEDS},{_D_FACTS} SELECT * FROM facts"))
def gen_facts(spark, sf_dir):
    return G.facts(_seeds(spark, sf_dir))


@query("gen_gold", oracle=with_views(f"WITH {_GEN} SELECT gen_id, kind, grp, sub, total, pct, rnk FROM gold"))
def gen_gold(spark, sf_dir):
    s = _seeds(spark, sf_dir)
    return G.gold(s, G.facts(s))


_BODY = {
    "share": " SELECT {ga}, sub, {ta}, {ta} * 100.0 / SUM({ta}) OVER (PARTITION BY {ga}) AS {pa} FROM agg",
    "topn": (", r AS (SELECT *, {ta} * 100.0 / SUM({ta}) OVER (PARTITION BY {ga}) AS {pa}, "
             "RANK() OVER (PARTITION BY {ga} ORDER BY {ta} DESC) AS {ra} FROM agg) "
             "SELECT * FROM r WHERE {ra} <= {n}"),
    "top1": " SELECT {ga}, sub, {ta} FROM agg t WHERE {ta} = (SELECT MAX({ta}) FROM agg u WHERE u.{ga} = t.{ga})",
    "rank": " SELECT {ga}, sub, {ta}, RANK() OVER (PARTITION BY {ga} ORDER BY {ta} DESC) AS {ra} FROM agg",
    "above_avg": " SELECT {ga}, sub, {ta} FROM agg t WHERE {ta} > (SELECT AVG({ta}) FROM agg u WHERE u.{ga} = t.{ga})",
}
_D_SQL = f"""
WITH {_D_SEEDS},
p AS (SELECT *,
        CASE WHEN three THEN {_dtemplate('FROM {fact} f JOIN {dim} d ON f.{dkey} = d.{dkey} JOIN {item} i ON f.{ikey} = i.{ikey}')}
             ELSE {_dtemplate('FROM {fact} f')} END AS frm,
        CASE WHEN three THEN {_dtemplate('d.{gcol}')} ELSE {_dtemplate('f.{gcol}')} END AS gx,
        CASE WHEN three THEN {_dtemplate('i.{scol}')} ELSE {_dtemplate('f.{scol}')} END AS sx,
        CASE WHEN three THEN {_dtemplate('SUM(f.{qty} * i.{price})')} ELSE {_dtemplate('SUM(f.{qty} * f.{price})')} END AS mx
      FROM s)
SELECT gen_id, kind,
       {_dtemplate("WITH agg AS (SELECT {gx} AS {ga}, {sx} AS sub, {mx} AS {ta} {frm} WHERE f.{status} = '{good}' GROUP BY {gx}, {sx})")}
       || CASE {' '.join(f"WHEN kind = '{k}' THEN {_dtemplate(t)}" for k, t in _BODY.items())} END AS gold_sql
FROM p"""


@query("gen_sql_text", oracle=with_views(_D_SQL))
def gen_sql_text(spark, sf_dir):
    return G.sql_text(_seeds(spark, sf_dir))


def _verified(spark, sf_dir):
    s = _seeds(spark, sf_dir)
    return G.checks(s, G.gold(s, G.facts(s)))


@query("gen_verified", oracle=with_views(f"WITH {_GEN} SELECT gen_id, kind, rows, ok FROM verified"))
def gen_verified(spark, sf_dir):
    return _verified(spark, sf_dir).select("gen_id", "kind", "rows", "ok")


@query("verify_multilevel", oracle=with_views(f"WITH {_GEN} SELECT gen_id FROM verified WHERE ok"))
def verify_multilevel(spark, sf_dir):
    """Ids of generated examples that pass every check (FLT-9)."""
    return _verified(spark, sf_dir).where("ok").select("gen_id")


@query("gen_kind_counts", oracle=with_views(f"""
WITH {_GEN}
SELECT kind, COUNT(*) FILTER (WHERE ok) AS kept, COUNT(*) AS attempts FROM verified GROUP BY kind"""))
def gen_kind_counts(spark, sf_dir):
    """Kept and attempted examples per kind (GEN-5 report)."""
    v = _verified(spark, sf_dir)
    return v.groupBy("kind").agg(F.count_if("ok").alias("kept"), F.count(F.lit(1)).alias("attempts"))


@query("holdout_nonempty", oracle=with_views(f"""
WITH {_GEN} SELECT gen_id, COUNT(*) AS rows FROM gold GROUP BY gen_id"""))
def holdout_nonempty(spark, sf_dir):
    """Cases whose reference answer returns rows, with the row count (FLT-10)."""
    s = _seeds(spark, sf_dir)
    g = G.gold(s, G.facts(s))
    return g.groupBy("gen_id").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 0)


def _combined(spark, sf_dir):
    """Ids of real (balanced pool) and verified synthetic examples, with a seeded key."""
    pool, _ = S.quota_rows(q_sample.candidates(spark, sf_dir), q_sample.quotas(spark, sf_dir), q_sample.SOURCES, q_sample.SEED)
    real = pool.select(F.lit("real").alias("origin"), F.col("example_id").alias("id"))
    syn = verify_multilevel(spark, sf_dir).select(F.lit("multilevel").alias("origin"), F.col("gen_id").alias("id"))
    return real.unionByName(syn).withColumn("key", S.shuffle_key(q_sample.SEED, "origin", "id"))


@query("combined_rows", oracle=with_views(f"""
WITH {q_sample._D_POOL}, {_GEN},
u AS (SELECT 'real' AS origin, example_id AS id FROM pool
      UNION ALL SELECT 'multilevel' AS origin, gen_id AS id FROM verified WHERE ok)
SELECT origin, id, ROW_NUMBER() OVER (ORDER BY md5('{q_sample.SEED}|' || origin || '|' || CAST(id AS VARCHAR)), id) AS position FROM u"""))
def combined_rows(spark, sf_dir):
    """Real and synthetic examples in one reshuffled order (SET-1)."""
    return C.ranks(cut_lineage(_combined(spark, sf_dir)), [], "key", "id", "position").drop("key")


@query("combine_sets", oracle=with_views(f"""
WITH {q_sample._D_POOL}, {_GEN},
u AS (SELECT 'real' AS origin, example_id AS id FROM pool
      UNION ALL SELECT 'multilevel' AS origin, gen_id AS id FROM verified WHERE ok),
c AS (SELECT origin, COUNT(*) AS n FROM u GROUP BY origin)
SELECT origin, n, ROUND(CAST(n AS DOUBLE) / SUM(n) OVER (), 4) AS share FROM c"""))
def combine_sets(spark, sf_dir):
    """Each part's share of the combined set (SET-1)."""
    u = _combined(spark, sf_dir)
    c = u.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("t"))  # one-row frame
    return c.crossJoin(tot).select("origin", "n", F.round(F.col("n").cast("double") / F.col("t"), 4)
                                   .alias("share"))


# ------------------------------------------------------------------ GEN-6 twin

_PK = _dkey("pl", "gen_id")
_D_PLACE = f"""
pf AS (SELECT s.*, {dhex(_PK, 1)} < 6 AS price_fact, {dhex(_PK, 2)} < 5 AS label_fact,
              {dhex(_PK, 3)} < 8 AS distract,
              NOT ({dhex(_PK, 2)} < 5) AND {dhex(_PK, 4)} < 6 AS two_hop
       FROM s),
pl AS (SELECT *, NOT price_fact AS price_item, NOT label_fact AND NOT two_hop AS label_dim FROM pf)"""


def _d_table(t: str) -> str:
    parts = []
    for i, (cond, text) in enumerate(G.PLACED_COLUMNS[t]):
        piece = _dtemplate(("" if i == 0 else ", ") + text)
        parts.append(piece if cond is None else f"(CASE WHEN {cond} THEN {piece} ELSE '' END)")
    return _dtemplate("CREATE TABLE " + G.TABLE_NAME[t] + " (") + " || " + " || ".join(parts) + " || ');'"


@query("gen_placement", oracle=with_views(f"""
WITH {_D_SEEDS},{_D_PLACE}
SELECT gen_id, CASE WHEN price_fact THEN 'fact' ELSE 'item' END AS price_on,
       CASE WHEN label_fact THEN 'fact' WHEN two_hop THEN 'area' ELSE 'dim' END AS label_on,
       distract AS distractor,
       concat_ws(chr(10), {_d_table('dim')}, {_d_table('item')}, {_d_table('fact')},
                 CASE WHEN two_hop THEN {_d_table('area')} END) AS ddl,
       CASE WHEN label_fact THEN {_dtemplate('f.{gcol}')} WHEN two_hop THEN {_dtemplate('a.{gcol}')}
            ELSE {_dtemplate('d.{gcol}')} END AS group_expr,
       CASE WHEN price_fact THEN {_dtemplate('SUM(f.{qty} * f.{price})')} ELSE {_dtemplate('SUM(f.{qty} * i.{price})')} END AS measure_expr,
       {_dtemplate('FROM {fact} f JOIN {dim} d ON f.{dkey} = d.{dkey} JOIN {item} i ON f.{ikey} = i.{ikey}')}
         || CASE WHEN two_hop THEN ' JOIN areas a ON d.area_id = a.area_id' ELSE '' END AS from_clause
FROM pl"""))
def gen_placement(spark, sf_dir):
    """Placement-randomised schemas: where each column lives and the joins a
    correct query needs (GEN-6)."""
    return G.placement(_seeds(spark, sf_dir))


def _d_catalog() -> str:
    sel = []
    for t, cols in G.PLACED_COLUMNS.items():
        for i, (cond, text) in enumerate(cols):
            name, typ = text.split(" ")[0], text.split(" ")[1]
            conds = [c for c in ([("two_hop" if t == "area" else None), cond]) if c]
            where = " AND ".join(conds) if conds else "TRUE"
            sel.append(f"SELECT gen_id AS context_id, {_dtemplate(G.TABLE_NAME[t])} AS tbl, {_dtemplate(name)} AS col, "
                       f"{i} AS ordinal, '{typ}' AS type, {1 if 'PRIMARY KEY' in text else 0} AS pk FROM pl WHERE {where}")
    return "\nUNION ALL\n".join(sel)


@query("gen_placement_shared", oracle=with_views(f"""
WITH {_D_SEEDS},{_D_PLACE},
cat AS ({_d_catalog()})
SELECT context_id, col, string_agg(DISTINCT tbl, ', ' ORDER BY tbl) AS tables
FROM cat GROUP BY context_id, col HAVING COUNT(DISTINCT tbl) > 1"""))
def gen_placement_shared(spark, sf_dir):
    """Column names a generated schema puts on several tables -- the
    distractors and join keys a model must qualify (GEN-6 with AGG-18)."""
    return K.shared_columns(G.placement_catalog(_seeds(spark, sf_dir)))


# ------------------------------------------------- whole records (GEN-2..5) twin
# the oracle makes every attempt of every example and keeps the first that passes

FIRST_N, FIRST_SEED = 400, 7

_A_SEEDS = _D_SEEDS.replace("gen_id", "gk").replace("s0 AS (SELECT c_custkey AS gk FROM customer)", f"""
s00 AS (SELECT c_custkey AS gen_id, CAST(a AS INTEGER) AS attempt,
               CASE WHEN a = 0 THEN CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) || '.' || CAST(a AS VARCHAR) END AS gk
        FROM customer, (SELECT unnest(range({R.ATTEMPTS})) AS a) t),
s0 AS (SELECT gk FROM s00)""")
_A_GEN = ",".join([_A_SEEDS] + [x.replace("gen_id", "gk") for x in (_D_FACTS, _D_GOLD, _D_CHECKS)])
_D_FIRST = f"""{_A_GEN},
fv AS (SELECT s00.gen_id, MIN(s00.attempt) AS attempt FROM s00 JOIN verified USING (gk) WHERE ok GROUP BY s00.gen_id),
won AS (SELECT fv.gen_id, fv.attempt, s.* FROM fv JOIN s00 USING (gen_id, attempt) JOIN s USING (gk))"""


def _d_either(star: str, flat: str) -> str:
    return f"CASE WHEN three THEN {_dtemplate(star)} ELSE {_dtemplate(flat)} END"


_D_NAMES = ", ".join(f"{_dpick(pool, f'{dhex(_dkey("h", "gk"), k)} % {len(pool)}')} AS {name}" for k, (name, pool) in enumerate(R.NAMES.items(), 1))
_D_FORMS = " ".join(f"WHEN kind = '{k}' AND form % {len(forms)} = {i} THEN {_dtemplate(t)}"
                    for k, forms in R.FORMS.items() for i, t in enumerate(forms))
_D_RECORDS = f"""{_D_FIRST},
parts AS (SELECT *, {', '.join(f'{_d_either(*p)} AS {name}' for name, p in R.PARTS.items())}, {_D_NAMES},
                 {dhex(_dkey('h', 'gk'), len(R.NAMES) + 1)} AS form FROM won),
numbered AS (SELECT f.*, ROW_NUMBER() OVER (PARTITION BY gk ORDER BY i, j, c) AS id FROM facts f SEMI JOIN won USING (gk)),
fr AS (SELECT n.gk, string_agg('(' || n.id || ', ' || CASE WHEN w.three THEN n.i || ', ' || n.j || ', ' || n.qty
                   ELSE '''' || n.grp || ''', ''' || n.sub || ''', ' || n.qty || ', ' || n.price END
                 || ', ''' || CASE WHEN n.good THEN w.good ELSE w.bad END || ''')', ', ' ORDER BY n.id) AS fact_rows
       FROM numbered n JOIN won w USING (gk) GROUP BY n.gk),
gr AS (SELECT gk, string_agg('(' || i || ', ''unit ' || i || ''', ''' || {_dpick(G.GROUP_NAMES, f'(goff + i - 1) % {len(G.GROUP_NAMES)}')} || ''')', ', ' ORDER BY i) AS dim_rows
       FROM (SELECT gk, goff, unnest(range(1, ng + 1)) AS i FROM won) GROUP BY gk),
ir AS (SELECT gk, string_agg('(' || j || ', ''thing ' || j || ''', ''' || {_dpick(G.SUB_NAMES, f'(soff + j - 1) % {len(G.SUB_NAMES)}')} || ''', '
                 || {_dpick(G.PRICES, f"{dhex(_dkey('p', 'gk', 'j'), 1)} % {len(G.PRICES)}")} || ')', ', ' ORDER BY j) AS item_rows
       FROM (SELECT gk, soff, unnest(range(1, ns + 1)) AS j FROM won) GROUP BY gk),
recs AS (
SELECT gen_id, attempt + 1 AS attempts, kind, fact AS domain, '{R.COMPLEXITY}' AS complexity, '{R.SOURCE}' AS source,
       CASE WHEN three THEN concat_ws(chr(10),
         {_dtemplate('CREATE TABLE {dim} ({dkey} INTEGER PRIMARY KEY, title TEXT, {gcol} TEXT);')},
         {_dtemplate('CREATE TABLE {item} ({ikey} INTEGER PRIMARY KEY, title TEXT, {scol} TEXT, {price} REAL);')},
         {_dtemplate('CREATE TABLE {fact} (id INTEGER PRIMARY KEY, {dkey} INTEGER, {ikey} INTEGER, {qty} INTEGER, {status} TEXT);')},
         {_dtemplate('INSERT INTO {dim} VALUES {dim_rows};')}, {_dtemplate('INSERT INTO {item} VALUES {item_rows};')},
         {_dtemplate('INSERT INTO {fact} VALUES {fact_rows};')})
       ELSE concat_ws(chr(10),
         {_dtemplate('CREATE TABLE {fact} (id INTEGER PRIMARY KEY, {gcol} TEXT, {scol} TEXT, {qty} INTEGER, {price} REAL, {status} TEXT);')},
         {_dtemplate('INSERT INTO {fact} VALUES {fact_rows};')}) END AS sql_context,
       CASE {_Q_CASES} END AS sql_prompt, {_dtemplate(R.CTE)} || CASE {_D_FORMS} END AS gold_sql
FROM parts JOIN fr USING (gk) LEFT JOIN gr USING (gk) LEFT JOIN ir USING (gk))"""


def _records(spark, sf_dir, **k):
    ids = load(spark, sf_dir, "customer").select("c_custkey")
    return R.records(dealt(ids, TASK_RECORDS), "c_custkey", **k)


@query("gen_records", oracle=with_views(f"""
WITH {_D_RECORDS}
SELECT *, 3 AS n_messages, {_lit(chat.SYSTEM_PROMPT)} AS system_turn,
       {_lit(chat.SCHEMA_HEAD)} || sql_context || {_lit(chat.QUESTION_HEAD)} || sql_prompt AS user_turn, gold_sql AS assistant_turn
FROM recs"""))
def gen_records(spark, sf_dir):
    """Whole records by rejection sampling: script, question, gold query and
    the three chat messages (GEN-2, GEN-4, GEN-5)."""
    r = _records(spark, sf_dir)
    turn = lambda i: F.element_at("messages", i)["content"]
    return r.select(*[c for c in r.columns if c not in ("messages", "answer")], F.size("messages").alias("n_messages"),
                    turn(1).alias("system_turn"), turn(2).alias("user_turn"), turn(3).alias("assistant_turn"))


@query("gen_answers", oracle=with_views(f"""
WITH {_D_FIRST},
ids AS (SELECT gk, grp, sub, COUNT(*) AS m FROM facts WHERE good GROUP BY gk, grp, sub)
SELECT w.gen_id, g.grp, g.sub, g.total, CASE WHEN w.kind = 'topn' THEN CASE WHEN w.three THEN 1 ELSE ids.m END END AS n_ids, g.pct, g.rnk
FROM won w JOIN gold g USING (gk) JOIN ids USING (gk, grp, sub)"""))
def gen_answers(spark, sf_dir):
    """Rows of every record's gold query, with its distinct count (GEN-3)."""
    # no answer is empty; ``explode`` would put a filter before itself that makes every answer once more
    return _records(spark, sf_dir).select("gen_id", F.explode_outer("answer").alias("a")).select("gen_id", "a.*")


_D_FIRST_N = f"""fn AS (
SELECT gen_id, ROW_NUMBER() OVER (ORDER BY md5('{FIRST_SEED}|' || CAST(gen_id AS VARCHAR)), gen_id) AS position, attempts, kind FROM recs
QUALIFY position <= {FIRST_N})"""


@query("gen_first_n", oracle=with_views(f"WITH {_D_RECORDS}, {_D_FIRST_N} SELECT * FROM fn"))
def gen_first_n(spark, sf_dir):
    """The first N valid examples, with their position (GEN-5)."""
    made = _records(spark, sf_dir).select("gen_id", "attempts", "kind")
    return R.first_records(made, FIRST_N, FIRST_SEED).select("gen_id", "position", "attempts", "kind")


@query("gen_yield", oracle=with_views(f"""
WITH {_D_RECORDS}, {_D_FIRST_N},
k AS (SELECT kind, COUNT(*) AS kept, CAST(SUM(attempts) AS BIGINT) AS attempts FROM fn GROUP BY kind)
SELECT ROW_NUMBER() OVER (ORDER BY kept DESC, kind) AS place, * FROM k"""))
def gen_yield(spark, sf_dir):
    """Kept examples and attempts of the first N by kind, most common first (GEN-5)."""
    made = _records(spark, sf_dir).select("gen_id", "attempts", "kind")
    k = (R.first_records(made, FIRST_N, FIRST_SEED).groupBy("kind")
         .agg(F.count(F.lit(1)).alias("kept"), F.sum("attempts").alias("attempts")))
    order = Window.orderBy(F.desc("kept"), "kind")  # a row for each kind
    return k.select(F.row_number().over(order).cast("long").alias("place"), "*")


_D_STRICT = _D_FIRST.replace("JOIN verified USING (gk) WHERE ok", """JOIN verified USING (gk)
       WHERE ok AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.gk = s00.gk AND g.kind IN ('topn', 'top1', 'rank')
                                GROUP BY g.grp HAVING COUNT(*) > COUNT(DISTINCT g.total))""")


@query("gen_strict", oracle=with_views(f"""
WITH {_D_STRICT}
SELECT w.gen_id, MAX(w.attempt) + 1 AS attempts, MAX(w.kind) AS kind, COUNT(*) AS n_rows, CAST(SUM(g.total) AS BIGINT) AS total
FROM won w JOIN gold g USING (gk) GROUP BY w.gen_id"""))
def gen_strict(spark, sf_dir):
    """Records whose ranked answers hold no ties, by as many attempts as that
    takes (GEN-5): attempts, kind, rows of the answer and their sum."""
    r = _records(spark, sf_dir, unambiguous=True)
    total = F.aggregate("answer", F.lit(0).cast("long"), lambda a, x: a + x["total"])
    return r.select("gen_id", "attempts", "kind", F.size("answer").cast("long").alias("n_rows"), total.alias("total"))
