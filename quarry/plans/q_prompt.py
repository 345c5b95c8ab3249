"""Source adapters, chat records, prompts, previews and request rules
(SRC-5, PRJ-1..10, FLT-2, FLT-8, JN-1, SRT-11, TXT-10, AGG-12, AGG-13, AGG-23)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import chat
from quarry.functions import text as T
from quarry.operators import catalog as K
from quarry.plans.q_catalog import _D_BLOCK
from quarry.plans.q_text import DUCK_CLASS
from quarry.plans.registry import query
from quarry.plans.views import view, with_views
from quarry.sources import adapters as A

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_D_SYS = ("'You are a precise text-to-SQL engine. Given a SQLite schema and a question, reply with a single "
          "valid SQLite query that answers it. Output only the SQL. No explanation, no markdown, no commentary.'")


def _d_user(ctx: str, q: str) -> str:
    return (f"'### Schema' || chr(10) || {_STRIP.format(x=ctx)} || chr(10) || chr(10) || '### Question' || chr(10) "
            f"|| {_STRIP.format(x=q)}")


_D_A = f"""a AS (
  SELECT sql_context, sql_prompt,
         regexp_replace({_STRIP.format(x='sql')}, ';+$', '') AS gold_sql,
         coalesce(domain, '') AS domain,
         coalesce(nullif(sql_complexity, ''), {DUCK_CLASS.format(x='sql')}) AS complexity,
         'gretel' AS source, id
  FROM source_a WHERE strpos(upper(coalesce(sql_context, '')), 'CREATE TABLE') > 0)"""

_D_B = f"""b AS (
  SELECT context AS sql_context, question AS sql_prompt, g AS gold_sql, '' AS domain,
         {DUCK_CLASS.format(x='g')} AS complexity, 'createcontext' AS source, CAST(NULL AS VARCHAR) AS id
  FROM (SELECT *, regexp_replace({_STRIP.format(x="coalesce(answer, '')")}, ';+$', '') AS g FROM source_b) s
  WHERE strpos(upper(coalesce(context, '')), 'CREATE TABLE') > 0 AND g <> '')"""


@query("adapt_source_a", oracle=with_views(f"WITH {_D_A} SELECT * FROM a"))
def adapt_source_a(spark, sf_dir):
    return A.adapt_a(view(spark, sf_dir, "source_a"))


@query("adapt_source_b", oracle=with_views(f"WITH {_D_B} SELECT * FROM b"))
def adapt_source_b(spark, sf_dir):
    return A.adapt_b(view(spark, sf_dir, "source_b"))


@query("source_union", oracle=with_views(f"""
WITH {_D_A}, {_D_B}
SELECT source, complexity, COUNT(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u
GROUP BY source, complexity"""))
def source_union(spark, sf_dir):
    raw = {"gretel": view(spark, sf_dir, "source_a"), "createcontext": view(spark, sf_dir, "source_b")}
    u = A.read_sources(["gretel", "createcontext"], raw)
    return u.groupBy("source", "complexity").agg(F.count(F.lit(1)).alias("n"))


def _messages(spark, sf_dir):
    e = view(spark, sf_dir, "examples")
    return e.select("example_id", chat.messages("sql_context", "question", "gold_sql").alias("messages"))


@query("to_messages", oracle=with_views(f"""
SELECT example_id, 3 AS n, 'system,user,assistant' AS roles, {_d_user('sql_context', 'question')} AS user_turn,
       gold_sql AS answer FROM examples"""))
def to_messages(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return m.select("example_id", F.size("messages").alias("n"),
                    F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
                    chat.user_turn("messages").alias("user_turn"),
                    F.element_at("messages", -1).getField("content").alias("answer"))


@query("prompt_only", oracle=with_views("""
SELECT example_id, 2 AS n, 'system,user' AS roles FROM examples"""))
def prompt_only(spark, sf_dir):
    m = _messages(spark, sf_dir).select("example_id", chat.prompt_only("messages").alias("p"))
    return m.select("example_id", F.size("p").alias("n"),
                    F.array_join(F.transform("p", lambda x: x["role"]), ",").alias("roles"))


_D_RENDER = ("'<|im_start|>system' || chr(10) || {sys} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || "
             "{user} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || gold_sql || '<|im_end|>' || chr(10)")


@query("render_chat", oracle=with_views(
    f"SELECT example_id, {_D_RENDER.format(sys=_D_SYS, user=_d_user('sql_context', 'question'))} AS text FROM examples"))
def render_chat(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return m.select("example_id", chat.render("messages").alias("text"))


@query("render_pairs", oracle=with_views(f"""
SELECT example_id,
       '<|im_start|>system' || chr(10) || {_D_SYS} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) ||
       {_d_user('sql_context', 'question')} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt
FROM examples"""))
def render_pairs(spark, sf_dir):
    e = view(spark, sf_dir, "examples")
    return e.select("example_id",
                    chat.render_prompt(chat.user_content("sql_context", "question")).alias("prompt"))


@query("enrich_prompt", oracle=with_views(f"""
WITH {_D_BLOCK},
en AS (SELECT e.example_id, {_d_user('e.sql_context', 'e.question')} AS u,
              {_STRIP.format(x='e.sql_context')} AS bare,
              CASE WHEN blk.block IS NULL THEN e.sql_context
                   ELSE regexp_replace(e.sql_context, '\\s+$', '') || chr(10) || chr(10) || blk.block END AS rich
       FROM examples e LEFT JOIN blk ON e.example_id = blk.context_id)
SELECT example_id,
       CASE WHEN strpos(u, bare) > 0
            THEN substr(u, 1, strpos(u, bare) - 1) || rich || substr(u, strpos(u, bare) + length(bare))
            ELSE u END AS user_turn
FROM en"""))
def enrich_prompt(spark, sf_dir):
    """Swap the bare schema inside the user turn for the enriched one, first
    occurrence only (PRJ-7)."""
    e = view(spark, sf_dir, "examples")
    rich = K.enrich_schema(e.select(F.col("example_id").alias("context_id"), "sql_context"),
                           view(spark, sf_dir, "catalog"))
    j = e.join(rich, e.example_id == rich.context_id)
    user = chat.user_content("sql_context", "question")
    return j.select("example_id", chat.replace_first(user, T.strip("sql_context"), F.col("enriched"))
                    .alias("user_turn"))


_D_HINT = """CASE WHEN strpos(lower(coalesce(c.err, '')), 'window function') > 0 THEN chr(10) || 'SQLite does not allow window functions in WHERE or HAVING. Compute the window expression in a subquery or CTE, then filter the outer query on its result.'
     WHEN strpos(lower(coalesce(c.err, '')), 'no such column') > 0 THEN chr(10) || 'One of the columns does not exist. Re-read the CREATE TABLE statements and use only the column names written there.'
     WHEN strpos(lower(coalesce(c.err, '')), 'no such table') > 0 THEN chr(10) || 'One of the tables does not exist. Use only the tables in the schema above.'
     WHEN strpos(lower(coalesce(c.err, '')), 'ambiguous column') > 0 THEN chr(10) || 'Qualify every column with its table alias.'
     ELSE '' END"""


@query("repair_prompt", oracle=with_views(f"""
SELECT c.example_id,
       '### Schema' || chr(10) || {_STRIP.format(x='e.sql_context')} || chr(10) || chr(10) ||
       '### Question' || chr(10) || {_STRIP.format(x='e.question')} || chr(10) || chr(10) ||
       '### Your previous answer' || chr(10) || c.sql || chr(10) || chr(10) ||
       '### It failed with this SQLite error' || chr(10) || c.err || chr(10) || chr(10) ||
       'Rewrite the query so it runs. Use only tables and columns that appear in the' || chr(10) || 'schema above.' || {_D_HINT} ||
       chr(10) || chr(10) || 'Output only the corrected SQL, and make it different from the previous answer.' AS prompt
FROM candidates c JOIN examples e ON c.example_id = e.example_id
WHERE c.phase = 'first' AND c.err IS NOT NULL AND NOT starts_with(c.err, 'only read')"""))
def repair_prompt(spark, sf_dir):
    """Fill the repair prompt for every first attempt that failed (PRJ-8)."""
    c = view(spark, sf_dir, "candidates").where(
        (F.col("phase") == "first") & F.col("err").isNotNull() & ~F.col("err").startswith("only read"))
    e = view(spark, sf_dir, "examples").select("example_id", "sql_context", "question")
    j = c.join(e, "example_id")
    return j.select("example_id", chat.repair_prompt("sql_context", "question", "sql", "err").alias("prompt"))


@query("align_predictions", oracle=with_views("""
SELECT e.example_id, b.raw AS base_raw, t.raw AS tuned_raw,
       b.raw IS NULL AS base_missing, t.raw IS NULL AS tuned_missing
FROM examples e
LEFT JOIN predictions b ON b.example_id = e.example_id AND b.model = 'base'
LEFT JOIN predictions t ON t.example_id = e.example_id AND t.model = 'tuned'"""))
def align_predictions(spark, sf_dir):
    """Key join of examples with both models' completions; a missing
    completion counts as not run instead of shifting later rows (JN-1)."""
    e = view(spark, sf_dir, "examples").select("example_id")
    p = view(spark, sf_dir, "predictions")
    b = p.where(F.col("model") == "base").select("example_id", F.col("raw").alias("base_raw"))
    t = p.where(F.col("model") == "tuned").select("example_id", F.col("raw").alias("tuned_raw"))
    return (e.join(b, "example_id", "left").join(t, "example_id", "left")
            .withColumn("base_missing", F.col("base_raw").isNull())
            .withColumn("tuned_missing", F.col("tuned_raw").isNull()))


FETCH_CAP, SHOW_CAP = 200, 50
NO_ROWS = "_query ran successfully and returned no rows_"  # fixed value
_NO_ROWS_SQL = f"'{NO_ROWS}'"


@query("result_preview", oracle=with_views(f"""
WITH k AS (SELECT example_id, row_idx, c_int, c_num, c_txt,
                  coalesce(CAST(c_int AS VARCHAR), '') || ' | ' ||
                  coalesce(CAST(CAST(c_num AS DOUBLE) AS VARCHAR), '') || ' | ' || coalesce(c_txt, '') AS cells
           FROM result_rows WHERE side = 'gold'),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY example_id ORDER BY row_idx, cells) - 1 AS pos FROM k),
f AS (SELECT * FROM p WHERE pos < {FETCH_CAP}),
m AS (
SELECT example_id, COUNT(*) AS row_count,
       '| c_int | c_num | c_txt |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
       string_agg('| ' || cells || ' |', chr(10) ORDER BY pos) FILTER (WHERE pos < {SHOW_CAP}) AS markdown
FROM f GROUP BY example_id)
SELECT e.example_id, coalesce(row_count, 0) AS row_count, coalesce(markdown, {_NO_ROWS_SQL}) AS markdown
FROM examples e LEFT JOIN m ON m.example_id = e.example_id"""))
def result_preview(spark, sf_dir):
    """Result table to Markdown: 200 rows fetched, 50 shown, NULL as empty,
    row_count = rows fetched (PRJ-9, PRJ-10, SRT-11)."""
    rr = view(spark, sf_dir, "result_rows").where(F.col("side") == "gold")
    cells = F.concat_ws(" | ", F.coalesce(F.col("c_int").cast("string"), F.lit("")),
                        F.coalesce(F.col("c_num").cast("double").cast("string"), F.lit("")), F.coalesce("c_txt", F.lit("")))
    k = rr.select("example_id", "side", "row_idx", cells.alias("cells"))
    w = Window.partitionBy("example_id").orderBy("row_idx", "cells")
    # constant bound after the window: WindowGroupLimit keeps 200 per task
    f = k.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < FETCH_CAP)
    shown = F.when(F.col("pos") < SHOW_CAP, F.struct("pos", F.concat(F.lit("| "), "cells", F.lit(" |")).alias("l")))
    g = f.groupBy("example_id").agg(F.count(F.lit(1)).alias("row_count"),
                                    F.array_sort(F.collect_list(shown)).alias("ls"))
    head = "| c_int | c_num | c_txt |\n| --- | --- | --- |\n"
    table = g.select("example_id", "row_count",
                     F.concat(F.lit(head), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("markdown"))
    return (view(spark, sf_dir, "examples").select("example_id").join(table, "example_id", "left")
            .select("example_id", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("markdown", F.lit(NO_ROWS)).alias("markdown")))


@query("format_report", oracle=with_views("""
WITH s AS (SELECT run, COUNT(*) AS n, COUNT(*) FILTER (WHERE exec_ok) AS k FROM outcomes GROUP BY run),
p AS (SELECT run, n, k, (1000 * k + n // 2) // n AS permille FROM s)
SELECT run, CAST(permille // 10 AS VARCHAR) || '.' || CAST(permille % 10 AS VARCHAR) || '%' AS accuracy,
       substr(run || ': ' || CAST(k AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ' examples ran and matched', 1, 24) AS detail
FROM p"""))
def format_report(spark, sf_dir):
    """Percent labels and details cut to n characters (TXT-10)."""
    o = view(spark, sf_dir, "outcomes")
    s = (o.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if("exec_ok").alias("k"))
         .withColumn("pm", F.expr("(1000 * k + n div 2) div n")))  # permille, half up
    acc = F.concat(F.expr("pm div 10").cast("string"), F.lit("."),
                   (F.col("pm") % 10).cast("string"), F.lit("%"))
    detail = F.concat(F.col("run"), F.lit(": "), F.col("k").cast("string"), F.lit(" of "),
                      F.col("n").cast("string"), F.lit(" examples ran and matched"))
    return s.select("run", acc.alias("accuracy"), F.substring(detail, 1, 24).alias("detail"))


@query("request_validate", oracle=with_views(f"""
WITH r AS (SELECT request_id, {_STRIP.format(x="coalesce(schema, '')")} AS s, {_STRIP.format(x="coalesce(question, '')")} AS q,
                  max_tokens, temperature FROM requests)
SELECT request_id,
       CASE WHEN s = '' OR q = '' THEN 400 WHEN length(s) > 20000 OR length(q) > 2000 THEN 413 ELSE 200 END AS status,
       CASE WHEN s = '' OR q = '' OR length(s) > 20000 OR length(q) > 2000 THEN NULL
            ELSE least(512, greatest(64, CAST(floor(coalesce(max_tokens, 320) + 0.5) AS BIGINT))) END AS tokens,
       CASE WHEN s = '' OR q = '' OR length(s) > 20000 OR length(q) > 2000 THEN NULL
            ELSE least(1.0, greatest(0.0, coalesce(temperature, 0.0))) END AS temperature
FROM r"""))
def request_validate(spark, sf_dir):
    """Both fields required (400), size limits (413), clamp tokens 64..512
    (default 320) and temperature 0..1 (default 0) (FLT-8)."""
    r = view(spark, sf_dir, "requests")
    s_ = T.strip(F.coalesce("schema", F.lit("")))
    q_ = T.strip(F.coalesce("question", F.lit("")))
    bad = (s_ == "") | (q_ == "")
    big = (F.length(s_) > 20000) | (F.length(q_) > 2000)
    status = F.when(bad, 400).when(big, 413).otherwise(200)
    # JavaScript Math.round: half rounds up
    tok = F.least(F.lit(512), F.greatest(F.lit(64), F.floor(F.coalesce(F.col("max_tokens"), F.lit(320)) + 0.5)))
    temp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("temperature"), F.lit(0.0))))
    ok = ~(bad | big)
    return r.select("request_id", status.alias("status"),
                    F.when(ok, tok.cast("long")).alias("tokens"),
                    F.when(ok, temp.cast("double")).alias("temperature"))


@query("e2e_scoreboard", oracle=with_views("""
SELECT kind, COUNT(*) AS total, COUNT(*) FILTER (WHERE correct) AS correct,
       COUNT(*) FILTER (WHERE executed) AS executed, COUNT(*) FILTER (WHERE repaired) AS repaired,
       CAST(COUNT(*) FILTER (WHERE correct) AS VARCHAR) || '/' || CAST(COUNT(*) AS VARCHAR) AS ct
FROM e2e_results WHERE status = 'ok' GROUP BY kind
UNION ALL
SELECT 'all' AS kind, COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'ok' AND correct) AS correct,
       COUNT(*) FILTER (WHERE status = 'ok' AND executed) AS executed,
       COUNT(*) FILTER (WHERE status = 'ok' AND repaired) AS repaired,
       CAST(COUNT(*) FILTER (WHERE status = 'ok' AND correct) AS VARCHAR) || '/' || CAST(COUNT(*) AS VARCHAR) AS ct
FROM e2e_results"""))
def e2e_scoreboard(spark, sf_dir):
    """Executed / correct / repaired by kind as c/t; failed requests are left
    out of the per-kind rows but counted in the overall n (AGG-12)."""
    r = view(spark, sf_dir, "e2e_results")
    ok = F.col("status") == "ok"

    def counts(df, ok_col):
        return [F.count(F.lit(1)).alias("total"),
                F.count_if(ok_col & F.col("correct")).alias("correct"),
                F.count_if(ok_col & F.col("executed")).alias("executed"),
                F.count_if(ok_col & F.col("repaired")).alias("repaired")]
    by_kind = r.where(ok).groupBy("kind").agg(*counts(r, F.lit(True)))
    overall = r.agg(*counts(r, ok)).select(F.lit("all").alias("kind"), "*")
    out = by_kind.unionByName(overall)
    return out.withColumn("ct", F.concat(F.col("correct").cast("string"), F.lit("/"),
                                         F.col("total").cast("string")))


@query("latency_by_kind", oracle=with_views("""
SELECT kind, MIN(seconds) AS min_s, MAX(seconds) AS max_s, ROUND(AVG(seconds), 4) AS avg_s
FROM e2e_results WHERE status = 'ok' GROUP BY kind"""))
def latency_by_kind(spark, sf_dir):
    """Latency range per kind (AGG-13)."""
    r = view(spark, sf_dir, "e2e_results").where(F.col("status") == "ok")
    return r.groupBy("kind").agg(F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"),
                                 F.round(F.avg("seconds"), 4).alias("avg_s"))


@query("enrichment_effect", oracle=with_views("""
SELECT model, ROUND(AVG(CASE WHEN prompt_kind = 'bare' THEN CAST(exec_ok AS DOUBLE) END), 4) AS bare,
       ROUND(AVG(CASE WHEN prompt_kind = 'enriched' THEN CAST(exec_ok AS DOUBLE) END), 4) AS enriched
FROM prompt_outcomes GROUP BY model"""))
def enrichment_effect(spark, sf_dir):
    """Accuracy per model with bare and enriched schema (AGG-23)."""
    po = view(spark, sf_dir, "prompt_outcomes")
    return (po.groupBy("model").pivot("prompt_kind", ["bare", "enriched"])
            .agg(F.round(F.avg(F.col("exec_ok").cast("double")), 4)))
