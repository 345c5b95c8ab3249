"""Whole generated examples by rejection sampling (GEN-1..5, FLT-9).

An example is small: at most four groups by four subs with two rows each.  So
its rows, its answer and the checks on it are arrays within one row, and the
first attempt that passes is found by a fold that stops making attempts once
one has: no example is exploded, shuffled or tried again in another job.  Every
choice is a digit of a digest of the example's id and attempt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import chat
from quarry.operators import counting as C
from quarry.operators import generate as G
from quarry.operators.sample import shuffle_key
from quarry.session import cut_lineage

ATTEMPTS = 40
Choices = Column | dict[str, Column]  # a struct of ``choices``, or its columns
COMPLEXITY, SOURCE = "multi-level aggregation", "synthetic-multilevel"
FIRST_CTE = ["cells", "by_pair", "sums"]
SECOND_CTE = ["placed", "marked", "scaled"]
SUB_ALIAS = ["sub", "part_name", "inner_key"]
COUNT_ALIAS = ["n_ids", "id_count", "members"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hold(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with more columns that are worked out here and nowhere else: the
    optimizer would copy their expressions to every place they are used."""
    x = df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_held"))
    return x.select(*df.columns, "_held.*")


def attempt_key(gen_id: Column, attempt: Column) -> Column:
    """The text that an attempt's digests are made of."""
    plain = gen_id.cast("string")
    return F.when(attempt == 0, plain).otherwise(F.concat(plain, F.lit("."), attempt.cast("string")))


def _digit(tag: str, key: Column, k: int, *more: Column) -> Column:
    return G.hexd(G._key(tag, key, *more), k)


def choices(key: Column) -> Column:
    """The choices that rows and answer depend on, as a struct."""
    def picked(digest: Column) -> Column:
        d = lambda k: G.digit(digest, k)
        return F.struct(G._pick(G.KINDS, d(2) % len(G.KINDS)).alias("kind"), G._pick([2, 2, 3], d(3) % 3).cast("int").alias("n"), (d(4) < 10).alias("three"),
                        G._pick([3, 3, 4], d(5) % 3).cast("int").alias("ng"), G._pick([3, 3, 4], d(6) % 3).cast("int").alias("ns"))
    return let(F.md5(G._key("g", key)), picked)


def fact_groups(key: Column, c: Choices) -> Column:
    """For each group the pairs of its subs, (i, j, rows), and for each pair one
    or two rows (qty, price, good), three in four good; i, j are places of group
    and sub (GEN-2).  A digest is made once for all digits that are taken of it."""
    def row(i: Column, j: Column, copy: Column, items: Column) -> Column:
        def made(digest: Column) -> Column:
            price = F.when(c["three"], F.element_at(items, j)).otherwise(G._pick(G.PRICES, G.digit(digest, 3) % len(G.PRICES)))
            return F.struct((G.digit(digest, 1) % 4 + 1).cast("long").alias("qty"), price.cast("long").alias("price"), (G.digit(digest, 2) < 12).alias("good"))
        return let(F.md5(G._key("r", key, i, j, copy)), made)

    def pair(i: Column, j: Column, items: Column) -> Column:
        copies = F.when(_digit("c", key, 1, i, j) < 6, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        return F.struct(i.alias("i"), j.alias("j"), F.transform(copies, lambda copy: row(i, j, copy, items)).alias("rows"))

    groups, subs = F.sequence(F.lit(1), c["ng"]), F.sequence(F.lit(1), c["ns"])
    prices = F.when(c["three"], F.transform(subs, lambda j: G._pick(G.PRICES, _digit("p", key, 1, j) % len(G.PRICES))))
    return let(prices, lambda items: F.transform(groups, lambda i: F.transform(subs, lambda j: pair(i, j, items))))


def fact_rows(groups: Column) -> Column:
    """Array of (i, j, qty, price, good) from ``fact_groups``."""
    return F.flatten(F.transform(F.flatten(groups), lambda p: F.transform(p["rows"], lambda r: F.struct(
        p["i"].alias("i"), p["j"].alias("j"), r["qty"].alias("qty"), r["price"].alias("price"), r["good"].alias("good")))))


def _total(rows: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + value(r))


def answer_groups(groups: Column, c: Choices) -> Column:
    """For each group of ``fact_groups`` an array of (i, j, total, n_ids, pct,
    rnk): the result of the gold query, what its kind does not show being null
    (GEN-3)."""
    kind = c["kind"]

    def cell(p: Column) -> Column:
        return let(F.filter(p["rows"], lambda r: r["good"]), lambda own: F.struct(
            p["i"].alias("i"), p["j"].alias("j"), _total(own, lambda r: r["qty"] * r["price"]).alias("total"),
            # one dimension row a group, but every row of a flat table has its own id
            F.when(F.size(own) == 0, 0).when(c["three"], 1).otherwise(F.size(own)).cast("long").alias("n_ids")))

    def ranked(group: Column, total: Column, x: Column) -> Column:
        higher = F.aggregate(group, F.lit(1).cast("long"), lambda a, y: a + F.when(y["total"] > x["total"], 1).otherwise(0))
        return let(higher, lambda rank: F.struct(
            x["i"].alias("i"), x["j"].alias("j"), x["total"].alias("total"), F.when(kind == "topn", x["n_ids"]).alias("n_ids"),
            F.when(kind.isin("share", "topn"), F.round(x["total"].cast("double") * 100.0 / total, 4)).alias("pct"),
            F.when(kind.isin("topn", "rank"), rank).alias("rnk"),
            (kind.isin("share", "rank") | ((kind == "topn") & (rank <= c["n"])) | ((kind == "top1") & (rank == 1))
             | ((kind == "above_avg") & (x["total"] * F.size(group) > total))).alias("keep")))

    def shown(group: Column) -> Column:
        return let(_total(group, lambda y: y["total"]), lambda total: F.filter(
            F.transform(group, lambda x: ranked(group, total, x)), lambda x: x["keep"]))

    return F.transform(groups, lambda pairs: let(
        F.filter(F.transform(pairs, cell), lambda x: x["n_ids"] > 0), shown))


def passes(answers: Column, c: Choices, unambiguous: bool = False) -> Column:
    """The checks on ``answer_groups``: not empty; percents within (0, 100];
    ranks from 1 in every group and no higher than n; whole shares add up to 100.
    With ``unambiguous`` ranked rows of a group must not tie either."""
    kind = c["kind"]

    def row_ok(x: Column) -> Column:
        return ((x["pct"].isNull() | ((x["pct"] > 0) & (x["pct"] <= 100.0001)))
                & (x["rnk"].isNull() | (kind != "topn") | (x["rnk"] <= c["n"])))

    def group_ok(rows: Column) -> Column:
        shares = F.aggregate(rows, F.lit(0.0), lambda a, y: a + F.coalesce(y["pct"], F.lit(0.0)))
        ok = (F.forall(rows, row_ok) & (~kind.isin("topn", "rank") | F.exists(rows, lambda y: y["rnk"] == 1))
              & ((kind != "share") | (F.abs(shares - 100) < 0.01)))
        if unambiguous:
            distinct = F.size(F.array_distinct(F.transform(rows, lambda y: y["total"]))) == F.size(rows)
            ok = ok & (~kind.isin("topn", "top1", "rank") | distinct)
        return (F.size(rows) == 0) | ok

    return F.exists(answers, lambda rows: F.size(rows) > 0) & F.forall(answers, group_ok)


def first_valid(gen_id: Column, attempts: int = ATTEMPTS, unambiguous: bool = False) -> Column:
    """The first attempt (from 0) that passes, -1 if none of ``attempts`` does."""
    def good(a: Column) -> Column:
        return let(attempt_key(gen_id, a), lambda key: let(choices(key), lambda c: let(
            answer_groups(fact_groups(key, c), c), lambda answers: passes(answers, c, unambiguous))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(attempts - 1)), F.lit(-1),
                       lambda found, a: F.when(found >= 0, found).when(good(a), a).otherwise(F.lit(-1)))


def _named(c: Column, names: list[str], offset: str) -> Column:
    return G._pick(names, (F.col(offset) + c - 1) % len(names))


def _values(items: Column, text: Callable[[Column, Column], Column]) -> Column:
    return F.array_join(F.transform(items, text), ", ")


def script() -> Column:
    """Tables and rows of an example, as statements (GEN-2)."""
    q = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    row = lambda *parts: F.concat(F.lit("("), F.concat_ws(", ", *[p.cast("string") for p in parts]), F.lit(")"))
    group = lambda i: q(_named(i, G.GROUP_NAMES, "goff"))
    sub = lambda j: q(_named(j, G.SUB_NAMES, "soff"))
    state = lambda f: q(F.when(f["good"], F.col("good")).otherwise(F.col("bad")))
    price = lambda j: G._pick(G.PRICES, _digit("p", F.col("gk"), 1, j) % len(G.PRICES))
    fill = lambda table, values: F.concat(F.lit("INSERT INTO "), F.col(table), F.lit(" VALUES "), values, F.lit(";"))
    groups, subs = F.sequence(F.lit(1), F.col("ng")), F.sequence(F.lit(1), F.col("ns"))
    star = F.concat_ws(
        "\n", G.template("CREATE TABLE {dim} ({dkey} INTEGER PRIMARY KEY, title TEXT, {gcol} TEXT);"),
        G.template("CREATE TABLE {item} ({ikey} INTEGER PRIMARY KEY, title TEXT, {scol} TEXT, {price} REAL);"),
        G.template("CREATE TABLE {fact} (id INTEGER PRIMARY KEY, {dkey} INTEGER, {ikey} INTEGER, {qty} INTEGER, {status} TEXT);"),
        fill("dim", _values(groups, lambda i, _: row(i, q(F.concat(F.lit("unit "), i.cast("string"))), group(i)))),
        fill("item", _values(subs, lambda j, _: row(j, q(F.concat(F.lit("thing "), j.cast("string"))), sub(j), price(j)))),
        fill("fact", _values(F.col("facts"), lambda f, at: row(at + 1, f["i"], f["j"], f["qty"], state(f)))))
    flat = F.concat_ws(
        "\n", G.template("CREATE TABLE {fact} (id INTEGER PRIMARY KEY, {gcol} TEXT, {scol} TEXT, {qty} INTEGER, {price} REAL, {status} TEXT);"),
        fill("fact", _values(F.col("facts"), lambda f, at: row(at + 1, group(f["i"]), sub(f["j"]), f["qty"], f["price"], state(f)))))
    return F.when(F.col("three"), star).otherwise(flat)


# every kind's gold query, after the CTE of sums; two forms where there are two
CTE = ("WITH {c1} AS (SELECT {gx} AS {ga}, {sx} AS {sa}, {mx} AS {ta}, COUNT(DISTINCT {ix}) AS {na} {frm} "
       "WHERE f.{status} = '{good}' GROUP BY {gx}, {sx})")
_SHARE = "{ta} * 100.0 / SUM({ta}) OVER (PARTITION BY {ga}) AS {pa}"
_RANK = "RANK() OVER (PARTITION BY {ga} ORDER BY {ta} DESC) AS {ra}"
FORMS = {
    "share": [" SELECT {ga}, {sa}, {ta}, " + _SHARE + " FROM {c1} ORDER BY {ga}, {pa} DESC"],
    "topn": [", {c2} AS (SELECT {ga}, {sa}, {ta}, {na}, " + _SHARE + ", " + _RANK + " FROM {c1}) "
             "SELECT * FROM {c2} WHERE {ra} <= {n} ORDER BY {ga}, {ra}"],
    "top1": [", {c2} AS (SELECT {ga}, {sa}, {ta}, " + _RANK + " FROM {c1}) SELECT {ga}, {sa}, {ta} FROM {c2} WHERE {ra} = 1 ORDER BY {ga}",
             " SELECT {ga}, {sa}, {ta} FROM {c1} x WHERE {ta} = (SELECT MAX({ta}) FROM {c1} y WHERE y.{ga} = x.{ga}) ORDER BY {ga}"],
    "rank": [" SELECT {ga}, {sa}, {ta}, " + _RANK + " FROM {c1} ORDER BY {ga}, {ra}"],
    "above_avg": [", {c2} AS (SELECT {ga}, {sa}, {ta}, AVG({ta}) OVER (PARTITION BY {ga}) AS middle FROM {c1}) "
                  "SELECT {ga}, {sa}, {ta} FROM {c2} WHERE {ta} > middle ORDER BY {ga}, {ta} DESC",
                  " SELECT {ga}, {sa}, {ta} FROM {c1} x WHERE {ta} > (SELECT AVG({ta}) FROM {c1} y WHERE y.{ga} = x.{ga}) ORDER BY {ga}, {ta} DESC"],
}
# where the parts of a query come from: with and without dimension tables
PARTS = {
    "frm": ("FROM {fact} f JOIN {dim} d ON f.{dkey} = d.{dkey} JOIN {item} i ON f.{ikey} = i.{ikey}", "FROM {fact} f"),
    "gx": ("d.{gcol}", "f.{gcol}"), "sx": ("i.{scol}", "f.{scol}"),
    "mx": ("SUM(f.{qty} * i.{price})", "SUM(f.{qty} * f.{price})"), "ix": ("f.{dkey}", "f.id"),
}
NAMES = {"c1": FIRST_CTE, "c2": SECOND_CTE, "sa": SUB_ALIAS, "na": COUNT_ALIAS}  # in the order of the digits that pick them


def gold_sql() -> Column:
    """The gold query's text; needs the columns of ``PARTS`` and ``NAMES`` (GEN-4)."""
    tail = None
    for kind, forms in FORMS.items():
        for i, text in enumerate(forms):
            this = (F.col("kind") == kind) & (F.col("form") % len(forms) == i)
            tail = F.when(this, G.template(text)) if tail is None else tail.when(this, G.template(text))
    return F.concat(G.template(CTE), tail)


def records(df: DataFrame, id_col: str, attempts: int = ATTEMPTS, unambiguous: bool = False) -> DataFrame:
    """One record for each id of ``df`` that has a valid attempt: gen_id,
    attempts made, kind, domain, complexity, source, sql_context (a script with
    dimension, item and fact rows), sql_prompt, gold_sql, messages, and answer,
    the rows of the gold query (GEN-2..5).  Ids are whole numbers, not null."""
    d = hold(df.select(F.col(id_col).cast("long").alias("gen_id")), attempt=first_valid(F.col("gen_id"), attempts, unambiguous))
    d = hold(d.where("attempt >= 0"), gk=attempt_key(F.col("gen_id"), F.col("attempt")))
    # the digits that ``generate.seeds`` takes, of this attempt's key
    x = d.select("*", F.explode(F.array(let(F.md5(G._key("g", "gk")), lambda digest: F.struct(*G.choice_columns(digest))))).alias("_c"))
    s = G.with_fields(x.select(*d.columns, "_c.*"))
    for name, (star, flat) in PARTS.items():
        s = s.withColumn(name, F.when(F.col("three"), G.template(star)).otherwise(G.template(flat)))
    for k, (name, pool) in enumerate(NAMES.items(), 1):
        s = s.withColumn(name, G._pick(pool, _digit("h", F.col("gk"), k) % len(pool)))
    s = s.withColumn("form", _digit("h", F.col("gk"), len(NAMES) + 1))
    c = {k: F.col(k) for k in ("kind", "n", "three", "ng", "ns")}
    # plain columns: what a query does not read of them is not made
    s = s.withColumn("_groups", fact_groups(F.col("gk"), c))
    s = s.select("*", fact_rows(F.col("_groups")).alias("facts"), F.flatten(answer_groups(F.col("_groups"), c)).alias("_answer"))
    shown = F.transform("_answer", lambda x: F.struct(
        _named(x["i"], G.GROUP_NAMES, "goff").alias("grp"), _named(x["j"], G.SUB_NAMES, "soff").alias("sub"),
        x["total"].alias("total"), x["n_ids"].alias("n_ids"), x["pct"].alias("pct"), x["rnk"].alias("rnk")))
    s = s.select("gen_id", (F.col("attempt") + 1).alias("attempts"), "kind", F.col("fact").alias("domain"), F.lit(COMPLEXITY).alias("complexity"),
                 F.lit(SOURCE).alias("source"), script().alias("sql_context"), G.question_text().alias("sql_prompt"), gold_sql().alias("gold_sql"), shown.alias("answer"))
    return s.withColumn("messages", chat.messages("sql_context", "sql_prompt", "gold_sql"))


def first_records(made: DataFrame, n: int, seed: int) -> DataFrame:
    """The first ``n`` of the records in the order of a seeded shuffle of their
    ids, with that position (from 1) (GEN-5): cut and places come from counts.
    The records are stored once, as the counts read them again."""
    keyed = cut_lineage(made.withColumn("_key", shuffle_key(seed, "gen_id")))
    take = made.sparkSession.range(1).select(F.lit(n).alias("take"))
    return C.ranks(C.first_rows(keyed, take, [], "_key", "gen_id"), [], "_key", "gen_id", "position").drop("_key")
