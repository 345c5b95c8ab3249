"""Round trips through files: JSON Lines, partitioned parquet, report JSON,
and cache fingerprints (SRC-1..4, SRC-7, SNK-1..4, AGG-21)."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from quarry.functions import chat
from quarry.operators import report as R
from quarry.plans.registry import query
from quarry.plans.views import hexd as dhex
from quarry.plans.views import view, with_views
from quarry.sources import io as IO

_D_SPLIT = f"CASE WHEN {dhex(chr(39) + 'split|' + chr(39) + ' || CAST(example_id AS VARCHAR)', 1)} < 2 THEN 'valid' ELSE 'train' END"


def _split_col():
    return F.when(F.conv(F.substring(F.md5(F.concat(F.lit("split|"), F.col("example_id").cast("string"))),
                                     1, 1), 16, 10).cast("int") < 2, "valid").otherwise("train")


def _records(spark, sf_dir):
    e = view(spark, sf_dir, "examples")
    return e.select("example_id", chat.messages("sql_context", "question", "gold_sql").alias("messages"),
                    "sql_context", F.col("question").alias("sql_prompt"), "gold_sql", "domain",
                    F.col("given_class").alias("complexity"), "source", F.col("ext_id").alias("id"),
                    _split_col().alias("split"))


@query("jsonl_roundtrip", oracle=with_views(f"""
SELECT example_id, {_D_SPLIT} AS split,
       '### Schema' || chr(10) || regexp_replace(sql_context, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10)
       || '### Question' || chr(10) || regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS user_turn,
       gold_sql AS answer, ext_id AS id
FROM examples"""))
def jsonl_roundtrip(spark, sf_dir):
    """Write train/valid JSON Lines, read both back with an explicit schema
    as one frame with a split column (SNK-1, SRC-2, SRC-3)."""
    recs = _records(spark, sf_dir)
    base = IO.scratch(spark, "jsonl")
    paths = {}
    for split in ("train", "valid"):
        paths[split] = os.path.join(base, split)
        IO.write_jsonl(recs.where(F.col("split") == split).drop("split"), paths[split], compression="gzip")
    back = IO.read_splits(spark, paths, IO.EXAMPLE_SCHEMA)
    return back.select("example_id", "split", chat.user_turn("messages").alias("user_turn"),
                       F.element_at("messages", -1).getField("content").alias("answer"), "id")


FIRST_N = 700


@query("jsonl_first_n", oracle=with_views(f"""
SELECT example_id, source FROM examples ORDER BY example_id LIMIT {FIRST_N}"""))
def jsonl_first_n(spark, sf_dir):
    """The first N records of a folder of JSON Lines files with blank lines,
    in the order of files and lines (SRC-2)."""
    recs = _records(spark, sf_dir).select("example_id", "source")
    path = IO.scratch(spark, "jsonl-first")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = (recs.repartitionByRange(parts, "example_id").sortWithinPartitions("example_id")
             .select(F.concat(F.to_json(F.struct(*recs.columns)), F.when(F.col("example_id") % 3 == 0, "\n").otherwise("")).alias("value")))
    lines.write.text(path)
    return IO.read_jsonl(spark, path, recs.schema, first_n=FIRST_N)


@query("scan_examples", oracle=with_views(f"""
SELECT example_id, gold_sql FROM examples WHERE {_D_SPLIT} = 'valid'"""))
def scan_examples(spark, sf_dir):
    """Load one named split from a split-partitioned dataset (SRC-1); only the
    split's folder is listed and scanned."""
    recs = _records(spark, sf_dir).select("example_id", "gold_sql", "split")
    path = IO.scratch(spark, "splits")
    IO.write_partitioned(recs, path, "split")
    return IO.read_split(spark, path, "valid").select("example_id", "gold_sql")


def _report(spark, sf_dir, dataset: str):
    """Nested report of base vs r1 in one row (SNK-2, AGG-21)."""
    o = view(spark, sf_dir, "outcomes")
    s = R.summarise(o)
    m = {r: s.where(F.col("run") == r).select(F.struct(*R.METRICS).alias(r)) for r in ("base", "r1")}
    counts = R.paired_counts(o).select(F.struct("*").alias("counts"))
    byc = (R.accuracy_by_class(o)
           .agg(F.map_from_entries(F.collect_list(F.struct("class", F.struct("n", "base", "tuned"))))
                .alias("by_complexity")))  # one entry per class: bounded
    samples = (R.report_samples(o).agg(F.array_sort(F.collect_list(F.struct("outcome", "k", "example_id")))
                                       .alias("samples")))  # at most 24 entries
    train = (view(spark, sf_dir, "examples").where(_split_col() == "train")
             .agg(F.count(F.lit(1)).alias("train_examples")))
    delta = [F.round(F.col(f"r1.{k}") - F.col(f"base.{k}"), 4).alias(k) for k in R.METRICS if k != "n"]
    n = o.where(F.col("run") == "base").agg(F.count(F.lit(1)).alias("n_examples"))
    one = (m["base"].crossJoin(m["r1"]).crossJoin(counts).crossJoin(byc).crossJoin(samples)
           .crossJoin(train).crossJoin(n))  # all one-row frames
    return one.select(F.lit(dataset).alias("dataset"), F.lit("greedy").alias("decoding"), "n_examples",
                      "train_examples", F.struct(F.col("base"), F.col("r1").alias("tuned"), F.struct(*delta).alias("deltas")).alias("metrics"),
                      "by_complexity", "counts", "samples")


@query("report_nested", oracle=with_views(f"""
WITH b AS (SELECT ROUND(AVG(CAST(exec_ok AS DOUBLE)), 4) AS a FROM outcomes WHERE run = 'base'),
t AS (SELECT ROUND(AVG(CAST(exec_ok AS DOUBLE)), 4) AS a FROM outcomes WHERE run = 'r1'),
p AS (SELECT x.class, CAST(x.exec_ok AS INT) AS a, CAST(y.exec_ok AS INT) AS b
      FROM outcomes x JOIN outcomes y ON x.example_id = y.example_id AND x.run = 'base' AND y.run = 'r1'),
c AS (SELECT least(COUNT(*), CASE WHEN a = 0 AND b = 1 THEN 14 WHEN a = 1 AND b = 1 THEN 4 ELSE 3 END) AS shown FROM p GROUP BY a, b)
SELECT 'derived-examples' AS dataset, (SELECT COUNT(*) FROM outcomes WHERE run = 'base') AS n_examples,
       (SELECT COUNT(*) FROM examples WHERE {_D_SPLIT} = 'train') AS train_examples, b.a AS base_accuracy, t.a AS tuned_accuracy,
       ROUND(t.a - b.a, 4) AS accuracy_delta, (SELECT CAST(COUNT(DISTINCT class) AS INTEGER) FROM p) AS classes,
       (SELECT CAST(SUM(shown) AS INTEGER) FROM c) AS samples
FROM b, t"""))
def report_nested(spark, sf_dir):
    """Write the nested report as JSON, read it back, flatten a few fields."""
    rep = _report(spark, sf_dir, "derived-examples")
    path = IO.scratch(spark, "report")
    rep.coalesce(1).write.mode("overwrite").json(path)  # a one-row frame
    back = spark.read.json(path)
    return back.select("dataset", "n_examples", "train_examples",
                       F.col("metrics.base.execution_accuracy").alias("base_accuracy"),
                       F.col("metrics.tuned.execution_accuracy").alias("tuned_accuracy"),
                       F.col("metrics.deltas.execution_accuracy").alias("accuracy_delta"),
                       F.size(F.map_keys(F.from_json(F.to_json("by_complexity"), "map<string,string>")))
                       .alias("classes"),
                       F.size("samples").alias("samples"))


@query("report_scan")
def report_scan(spark, sf_dir):
    """Scan a folder of report files; a placeholder without metrics is
    rejected and listed, the others are read (SRC-4)."""
    rep = _report(spark, sf_dir, "derived-examples")
    path = IO.scratch(spark, "reports")
    rep.coalesce(1).write.mode("overwrite").json(os.path.join(path, "run1"))
    placeholder = os.path.join(path, "placeholder")
    spark.createDataFrame([(json.dumps({"dataset": "pending", "n_examples": 0}),)], "v string") \
        .coalesce(1).write.mode("overwrite").text(placeholder)
    ok, bad = IO.read_reports(spark, os.path.join(path, "*"))
    return (ok.select(F.lit("accepted").alias("verdict"), "dataset", "n_examples")
            .unionByName(bad.select(F.lit("rejected").alias("verdict"), "dataset", "n_examples")))


_FP_COLS = ["example_id", "model", "raw"]


@query("fingerprint_diff", oracle=with_views("""
WITH h AS (SELECT source, CAST(('0x' || substr(sha256(coalesce(CAST(length(CAST(p.example_id AS VARCHAR)) AS VARCHAR) || ':' || CAST(p.example_id AS VARCHAR), '-') || coalesce(CAST(length(p.model) AS VARCHAR) || ':' || p.model, '-') || coalesce(CAST(length(p.raw) AS VARCHAR) || ':' || p.raw, '-')), 1, 15)) AS BIGINT) AS v
           FROM predictions p JOIN examples e ON p.example_id = e.example_id WHERE p.model = 'base'),
cur AS (SELECT COUNT(*) AS n, CAST(SUM(CAST(v AS DECIMAL(38,0))) AS VARCHAR) AS fp FROM h),
old AS (SELECT COUNT(*) AS n, CAST(SUM(CAST(v AS DECIMAL(38,0))) AS VARCHAR) AS fp FROM h WHERE source = 'gretel')
SELECT 'base_model' AS field, 'base' AS cached, 'base' AS current, FALSE AS changed
UNION ALL SELECT 'test_sha', old.fp, cur.fp, old.fp <> cur.fp FROM old, cur
UNION ALL SELECT 'n', CAST(old.n AS VARCHAR), CAST(cur.n AS VARCHAR), old.n <> cur.n FROM old, cur
UNION ALL SELECT 'max_tokens', '320', '256', TRUE"""))
def fingerprint_diff(spark, sf_dir):
    """Reuse cached base predictions only if the fingerprint is equal; report
    which fields changed (SRC-7).  Cached: a run over the first source only,
    with 320 max tokens; current: all examples, 256 max tokens."""
    p = view(spark, sf_dir, "predictions").where(F.col("model") == "base")
    e = view(spark, sf_dir, "examples").select("example_id", "source")
    h = p.join(e, "example_id")
    cur = IO.fingerprint(h, _FP_COLS)
    old = IO.fingerprint(h.where(F.col("source") == "gretel"), _FP_COLS)
    j = old.select(F.col("n").alias("on"), F.col("fp").alias("ofp")).crossJoin(cur)  # one-row frames
    rows = [F.struct(F.lit("base_model").alias("field"), F.lit("base").alias("cached"),
                     F.lit("base").alias("current"), F.lit(False).alias("changed")),
            F.struct(F.lit("test_sha").alias("field"), F.col("ofp").alias("cached"),
                     F.col("fp").alias("current"), (F.col("ofp") != F.col("fp")).alias("changed")),
            F.struct(F.lit("n").alias("field"), F.col("on").cast("string").alias("cached"),
                     F.col("n").cast("string").alias("current"), (F.col("on") != F.col("n")).alias("changed")),
            F.struct(F.lit("max_tokens").alias("field"), F.lit("320").alias("cached"),
                     F.lit("256").alias("current"), F.lit(True).alias("changed"))]
    return j.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
