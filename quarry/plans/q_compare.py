"""Result-set comparison over the derived ``result_rows`` (CMP-1, CMP-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import compare as C
from quarry.plans.registry import query
from quarry.plans.views import view, with_views
from quarry.sources.tables import load

_DUCK_KEYS = """
k AS (
  SELECT example_id, side, row_idx,
         coalesce(CAST(CAST(c_int AS DECIMAL(38,4)) AS VARCHAR), '␀') || chr(1) ||
         coalesce(CAST(CAST(ROUND(c_num, 4) AS DECIMAL(38,4)) AS VARCHAR), '␀') || chr(1) ||
         coalesce(regexp_replace(c_txt, '^\\s+|\\s+$', '', 'g'), '␀') AS row_key
  FROM result_rows)"""


def _keys(spark, sf_dir, with_pos: bool):
    rr = view(spark, sf_dir, "result_rows")
    if not with_pos:
        return C.keyed(rr, ["c_int", "c_num", "c_txt"])
    k = C.keyed(rr, ["c_int", "c_num", "c_txt"], keep=["row_idx"])
    return C.dense_positions(k, ["row_idx", "row_key"])


def _example_ids(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"))


@query("results_match_bag", bench=True, oracle=with_views(f"""
WITH {_DUCK_KEYS},
d AS (SELECT example_id, row_key, SUM(CASE WHEN side = 'gold' THEN 1 ELSE -1 END) AS d
      FROM k GROUP BY example_id, row_key),
m AS (SELECT example_id, MAX(ABS(d)) = 0 AS ok FROM d GROUP BY example_id)
SELECT o.o_orderkey AS example_id, coalesce(m.ok, TRUE) AS match
FROM orders o LEFT JOIN m ON o.o_orderkey = m.example_id"""))
def results_match_bag(spark, sf_dir):
    return C.match_bag(_keys(spark, sf_dir, False), _example_ids(spark, sf_dir))


@query("results_match_ordered", oracle=with_views(f"""
WITH {_DUCK_KEYS},
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY example_id, side ORDER BY row_idx, row_key) AS pos FROM k),
j AS (SELECT coalesce(g.example_id, q.example_id) AS example_id, g.row_key AS g, q.row_key AS q
      FROM (SELECT * FROM p WHERE side = 'gold') g
      FULL OUTER JOIN (SELECT * FROM p WHERE side = 'pred') q
        ON g.example_id = q.example_id AND g.pos = q.pos),
m AS (SELECT example_id, bool_and(g IS NOT DISTINCT FROM q) AS ok FROM j GROUP BY example_id)
SELECT o.o_orderkey AS example_id, coalesce(m.ok, TRUE) AS match
FROM orders o LEFT JOIN m ON o.o_orderkey = m.example_id"""))
def results_match_ordered(spark, sf_dir):
    return C.match_ordered(_keys(spark, sf_dir, True), _example_ids(spark, sf_dir))
