"""Schema catalog jobs (J6, GRD-1): join paths, shared column names, the
enrichment text block, and grounding of column references.

Catalog rows are ``(context_id, tbl, col, ordinal, type, pk)``, one per column
of every schema.  All per-context work is keyed by ``context_id``; a context
is one schema (tens of columns), so collecting one context's lines into an
array is bounded by the schema, never by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import tasks_for

# -- fixed values: lines of the enrichment block --------------------------------
HEAD_1 = "-- Column index. Each column belongs to exactly the table listed here;"
HEAD_2 = "-- qualify every column with its own table and do not move one between tables."
JOIN_HEAD = "-- Join paths:"
SHARED_HEAD = "-- These column names appear in several tables, so always qualify them:"
SAMPLE_HEAD = "-- Sample values:"
INDENT = "--   "
# -------------------------------------------------------------------------------

QUALIFIED_REF = r"\b([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)\b"
FROM_ITEM = r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z_][A-Za-z0-9_]*)(?:\s+(?:AS\s+)?([A-Za-z_][A-Za-z0-9_]*))?"

TASK_COLUMNS = 1_000_000  # rows of a catalog that one task of ``grounding_errors`` looks at


def join_paths(cat: DataFrame) -> DataFrame:
    """A column of table t that is the primary key of another table (JN-4)."""
    a = cat.select("context_id", F.col("tbl").alias("tbl"), "col")
    b = cat.where(F.col("pk") > 0).select("context_id", F.col("tbl").alias("other"), "col")
    return (a.join(b, ["context_id", "col"]).where(F.col("tbl") != F.col("other"))
            .select("context_id", "tbl", "col", "other").distinct())


def shared_columns(cat: DataFrame) -> DataFrame:
    """Column names found in more than one table, with the tables (AGG-18)."""
    g = cat.groupBy("context_id", "col").agg(F.array_sort(F.collect_set("tbl")).alias("tables"))
    return g.where(F.size("tables") > 1).select(
        "context_id", "col", F.array_join("tables", ", ").alias("tables"))


def _table_lines(cat: DataFrame) -> DataFrame:
    desc = F.concat(F.col("col"), F.when(F.coalesce(F.col("type"), F.lit("")) != "",
                                         F.concat(F.lit("("), F.col("type"), F.lit(")")))
                    .otherwise(F.lit("")))
    per = (cat.groupBy("context_id", "tbl")
           .agg(F.array_sort(F.collect_list(F.struct("ordinal", desc.alias("d")))).alias("cs"),
                F.array_sort(F.collect_list(F.when(F.col("pk") > 0, F.struct("ordinal", "col"))))
                .alias("pks")))
    line = F.concat(F.lit(INDENT), F.col("tbl"), F.lit(": "),
                    F.array_join(F.transform("cs", lambda x: x["d"]), ", "),
                    F.when(F.size("pks") > 0,
                           F.concat(F.lit("   [primary key: "),
                                    F.array_join(F.transform("pks", lambda x: x["col"]), ", "),
                                    F.lit("]"))).otherwise(F.lit("")))
    return per.select("context_id", "tbl", line.alias("line"))


def enrichment_block(cat: DataFrame) -> DataFrame:
    """(context_id, block): column index, join paths, shared-name warnings (AGG-19)."""
    tl = (_table_lines(cat).groupBy("context_id")
          .agg(F.array_sort(F.collect_list(F.struct("tbl", "line"))).alias("t")))
    jp = (join_paths(cat).select("context_id", F.concat(
        F.lit(INDENT), F.col("tbl"), F.lit("."), F.col("col"), F.lit(" = "),
        F.col("other"), F.lit("."), F.col("col")).alias("l"))
        .groupBy("context_id").agg(F.array_sort(F.collect_set("l")).alias("j")))
    sh = (shared_columns(cat).select("context_id", "col", F.concat(
        F.lit(INDENT), F.col("col"), F.lit(": "), F.col("tables")).alias("l"))
        .groupBy("context_id").agg(F.array_sort(F.collect_list(F.struct("col", "l"))).alias("s")))
    j = tl.join(jp, "context_id", "left").join(sh, "context_id", "left")
    parts = F.concat(
        F.array(F.lit(HEAD_1), F.lit(HEAD_2)),
        F.transform("t", lambda x: x["line"]),
        F.when(F.size(F.coalesce("j", F.array())) > 0,
               F.concat(F.array(F.lit(JOIN_HEAD)), F.col("j"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(F.coalesce("s", F.array())) > 0,
               F.concat(F.array(F.lit(SHARED_HEAD)), F.transform("s", lambda x: x["l"])))
        .otherwise(F.array().cast("array<string>")))
    return j.select("context_id", F.array_join(parts, "\n").alias("block"))


def enrich_schema(schemas: DataFrame, cat: DataFrame, schema_col: str = "sql_context",
                  samples: DataFrame | None = None) -> DataFrame:
    """Schema text plus its block; schemas without catalog rows (did not
    build, or no tables) are returned unchanged.  ``samples``
    (context_id, tbl, line) adds the sample-values section (WIN-9)."""
    b = enrichment_block(cat)
    if samples is not None:
        sl = (samples.groupBy("context_id")
              .agg(F.array_sort(F.collect_list(F.struct("tbl", "line"))).alias("sl")))  # one per table
        b = (b.join(sl, "context_id", "left")
             .select("context_id", F.concat_ws("\n", "block", F.lit(SAMPLE_HEAD),
                                               F.array_join(F.transform(F.coalesce("sl", F.array()),
                                                                        lambda x: x["line"]), "\n"))
                     .alias("block")))
        b = b.withColumn("block", F.regexp_replace("block", "\n$", ""))
    s = schemas.join(b, "context_id", "left")
    text = F.when(F.col("block").isNull(), F.col(schema_col)).otherwise(
        F.concat(F.regexp_replace(F.col(schema_col), r"\s+$", ""), F.lit("\n\n"), F.col("block")))
    return s.select("context_id", text.alias("enriched"))


def qualified_refs(sql: Column) -> Column:
    """Array of (alias, col) structs for every ``alias.col`` in the text."""
    aliases = F.regexp_extract_all(sql, F.lit(QUALIFIED_REF), 1)
    cols = F.regexp_extract_all(sql, F.lit(QUALIFIED_REF), 2)
    return F.arrays_zip(aliases.alias("alias"), cols.alias("col"))


def from_items(sql: Column) -> Column:
    """Array of (tbl, alias) for every ``FROM t [AS] a`` / ``JOIN t a``."""
    tbls = F.regexp_extract_all(sql, F.lit(FROM_ITEM), 1)
    als = F.regexp_extract_all(sql, F.lit(FROM_ITEM), 2)
    return F.arrays_zip(tbls.alias("tbl"), als.alias("alias"))


def grounding_errors(queries: DataFrame, cat: DataFrame) -> DataFrame:
    """References ``alias.col`` whose table does not have the column, and the
    tables that do own it (GRD-1).

    ``queries``: (context_id, query_id, sql).  An alias resolves through the
    query's FROM/JOIN items; a bare table name resolves to itself.  Queries and
    catalog are dealt by context once, over tasks that hold ``TASK_COLUMNS``
    columns of schemas or so, and all else stays there.
    """
    tasks = tasks_for(cat, TASK_COLUMNS)
    items = from_items(F.col("sql"))
    named = F.concat(F.transform(F.filter(items, lambda f: f["alias"] != ""), lambda f: F.struct(f["alias"].alias("alias"), f["tbl"].alias("tbl"))),
                     F.transform(items, lambda f: F.struct(f["tbl"].alias("alias"), f["tbl"].alias("tbl"))))
    q = (queries.where("context_id is not null and query_id is not null").select("context_id", "query_id", "sql").repartition(tasks, "context_id")
         .select("context_id", "query_id", qualified_refs(F.col("sql")).alias("refs"), named.alias("named"))
         .groupBy("context_id", "query_id")  # the texts of one query: few
         .agg(F.array_distinct(F.flatten(F.collect_list("refs"))).alias("refs"), F.array_distinct(F.flatten(F.collect_list("named"))).alias("named")))
    # only schemas that built: elsewhere every reference would be unknown
    schemas = (cat.where("context_id is not null").select("context_id", "tbl", "col").repartition(tasks, "context_id")
               .groupBy("context_id").agg(F.collect_set(F.struct("tbl", "col")).alias("cols")))
    found = (q.join(schemas, "context_id")
             .select("context_id", "query_id", "named", "cols", F.explode("refs").alias("r"))
             .select("context_id", "query_id", "cols", "r.*", F.explode("named").alias("f")).where(F.col("alias") == F.col("f.alias"))
             .select("context_id", "query_id", "cols", "alias", "col", F.col("f.tbl").alias("tbl")))
    own = lambda x: x["col"] == F.col("col")
    missing = found.where(~F.coalesce(F.exists("cols", lambda x: own(x) & (x["tbl"] == F.col("tbl"))), F.lit(False)))
    owners = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("cols", own), lambda x: x["tbl"]))), ", ")
    return missing.select("context_id", "query_id", "alias", "tbl", "col", F.coalesce(owners, F.lit("")).alias("owners")).distinct()
