"""The table pipeline: indicators, computed columns, SQL, filters, sorting, distinct; joins, pivots and merges.

Order-dependent operators take an ``order`` column list; without one a table has no defined order.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import expressions
from strataloom.operators.columns import resolve
from strataloom.plans.workspace import Workspace

#: Most distinct values that an indicator coding or a pivot makes into columns.
MOST_COLUMNS = 10_000


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _o(o) -> Column:
    return o if isinstance(o, Column) else _c(o)


def number(c: Column) -> Column:
    """The text as a number, or null."""
    return c.try_cast("double")


def mixed_key(c: Column) -> list[Column]:
    """Sort key of mixed text: numbers first by value, then other texts."""
    return [number(c).isNull(), number(c), c]


def equal_key(c: Column) -> Column:
    """Equality key of mixed text: numerically equal texts are the same."""
    return F.coalesce((number(c) + 0.0).cast("string"), F.concat(F.lit("s"), c))


# --- filters -----------------------------------------------------------------------------


def include_values(df: DataFrame, variable: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows whose value is included (less the excluded), or not excluded."""
    if include is not None:
        return df.where(_c(variable).isin([v for v in include if v not in set(exclude or ())]))
    return df.where(~F.coalesce(_c(variable).isin(list(exclude)), F.lit(False))) if exclude else df


def include_variables(df: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """All of several ``VAR`` (not blank) or ``VAR=v1,v2`` conditions; excluded ones negated."""
    for specs, keep in ((include, True), (exclude, False)):
        for spec in [specs] if isinstance(specs, str) else specs:
            name, _, values = spec.partition("=")
            name = df.columns[resolve(df.columns, name)[0]]
            if values:
                df = include_values(df, name, *((values.split(","), None) if keep else (None, values.split(","))))
            else:
                filled = F.coalesce(_c(name).cast("string") != "", F.lit(False))
                df = df.where(filled if keep else ~filled)
    return df


def filter_expr(df: DataFrame, exprs: str | list[str]) -> DataFrame:
    """Rows for which all expressions are true."""
    return reduce(lambda d, e: d.where(expressions.condition(d, e)), [exprs] if isinstance(exprs, str) else exprs, df)


def column_exprs(df: DataFrame, exprs: str | list[str]) -> DataFrame:
    """``VAR=EXPR`` columns in turn; later ones see earlier ones."""
    for spec in [exprs] if isinstance(exprs, str) else exprs:
        name, _, expr = spec.partition("=")
        df = df.withColumn(name.strip(), expressions.column(df, expr))
    return df


def query(df: DataFrame, queries: str | list[str], name: str = "data") -> DataFrame:
    """SQL over the table, which it calls ``name``; several queries chain. The session's own views keep their names."""
    for sql in [queries] if isinstance(queries, str) else queries:
        view = f"{name}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        first = f"{name} AS (SELECT * FROM {view})"
        others = re.match(r"(?is)\s*with\s+(recursive\s+)?", sql)
        df = df.sparkSession.sql(f"WITH {others[1] or ''}{first}, {sql[others.end():]}" if others else f"WITH {first} {sql}")
    return df


def indicators(
    df: DataFrame, variable: str, prefix: str | None = None, ref: list[str] = (), include: list[str] | None = None,
    exclude: list[str] = (), yes: str = "1", no: str = "0", missing: str = "",
) -> DataFrame:
    """A yes/no column for each value but the reference. Blank and excluded rows get ``missing``."""
    prefix = f"{variable}_" if prefix is None else prefix
    if include is not None:
        values = sorted(include)
    else:
        found = df.select(_c(variable).cast("string").alias("v")).where("v <> ''").distinct().limit(MOST_COLUMNS + 1).collect()
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"{variable} has more than {MOST_COLUMNS} values")
        values = sorted(r["v"] for r in found)
    values = [v for v in values if v not in set(exclude)]
    v = _c(variable).cast("string")
    known = F.coalesce(v.isin(values), F.lit(False))
    return df.select("*", *[
        F.when(~known, missing).when(v == x, yes).otherwise(no).alias(f"{prefix}{x}") for x in values if x not in set(ref)
    ])


def sort_table(df: DataFrame, keys, order: list[str] = ()) -> DataFrame:
    """Stable mixed sort by key columns (``*`` for all), ties in the order given."""
    at = resolve(df.columns, keys)
    return df.orderBy(*[k for i in at for k in mixed_key(_c(df.columns[i]).cast("string"))], *[_c(o) for o in order])


def uniq_table(df: DataFrame, keys=None, order: list[str] = (), consecutive: bool = False) -> DataFrame:
    """First row of each key in the given order. With ``consecutive`` only runs of equal keys collapse."""
    at = resolve(df.columns, keys)
    parts = [equal_key(_c(df.columns[i]).cast("string")) for i in at]
    if consecutive:
        return _uniq_runs(df, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]), order)
    if not order:
        keys = {f"__k{i}": p for i, p in enumerate(parts)}
        return df.withColumns(keys).dropDuplicates(list(keys)).drop(*keys)
    # The least order tuple carries its row: an aggregate combines before the shuffle, where a window could not.
    row = F.min(F.struct(*[_o(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[_c(c) for c in df.columns]).alias("row")))
    out = df.groupBy(*[p.alias(f"__k{i}") for i, p in enumerate(parts)]).agg(row.alias("__first"))
    return out.select("__first.row.*")


def _uniq_runs(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Rows whose key isn't that of the row before. Ranges of the order are looked at apart; each starts after the last key of the one before."""
    ranges = df.withColumn("__key", key).repartitionByRange(*[_c(o) for o in order]).withColumn("__range", F.spark_partition_id())
    ranges = Workspace(df.sparkSession, "uniq-runs").table(ranges, "ranges")
    by = [_c(o) for o in order]
    last = ranges.groupBy("__range").agg(F.max_by("__key", F.struct(*by)).alias("__last"))  # a row for each range
    last = last.select("__range", F.lag("__last").over(Window.orderBy("__range")).alias("__last"))
    before = F.lag("__key").over(Window.partitionBy("__range").orderBy(*by))
    out = ranges.withColumn("__before", before).join(F.broadcast(last), "__range")
    return out.where(~F.coalesce(F.coalesce("__before", "__last") == F.col("__key"), F.lit(False))).select(df.columns)


def cook(
    df: DataFrame, categorical: list[dict] = (), columnexpr=(), queries=(), includevar=(), excludevar=(), filterexpr=(), sort=None, uniq=None,
    order: list[str] = (),
) -> DataFrame:
    """The pipeline in its fixed order."""
    for spec in categorical:
        df = indicators(df, **spec)
    df = column_exprs(df, columnexpr)
    df = query(df, queries)
    df = include_variables(df, includevar, excludevar)
    df = filter_expr(df, filterexpr)
    if uniq is not None:  # the first in sorted order stays
        by = [k for i in resolve(df.columns, sort) for k in mixed_key(_c(df.columns[i]).cast("string"))] if sort is not None else []
        df = uniq_table(df, uniq, [*by, *order])
    return sort_table(df, sort, order) if sort is not None else df


# --- joins -------------------------------------------------------------------------------


def join_tables(
    left: DataFrame, right: DataFrame, key1: list[str] | None = None, key2: list[str] | None = None, how: str = "left", null: str | None = "",
    prefix1: str = "", prefix2: str = "", unique: bool = False, spread: int = 1,
) -> DataFrame:
    """Equi join by common or given keys; blank keys never match; missing right texts become ``null``. The sides are for the optimizer to arrange.

    With ``spread`` an inner join deals the right rows of each key out over so many groups, and copies the left rows to each: for few keys with many
    rows on both sides, whose pairs would be the work of few tasks.
    """
    if spread > 1 and how != "inner":
        raise ValueError("only inner joins are spread")
    key1 = key1 or key2 or [c for c in left.columns if c in set(right.columns)]
    key2 = key2 or key1
    blank = reduce(lambda a, b: a | b, [F.coalesce(_c(k).cast("string") == "", F.lit(True)) for k in key2])
    right = right.where(~blank)
    if unique:
        twice = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate key in the right table"))).otherwise(F.lit(True))
        checked = right.groupBy(*[_c(k) for k in key2]).agg(twice.alias("__unique"))
        right = right.join(checked, key2).where("__unique").drop("__unique")
    renamed = right.toDF(*[f"__r_{c}" for c in right.columns])
    on = [_c(a) == _c(f"__r_{b}") for a, b in zip(key1, key2)]
    if spread > 1:
        part = F.pmod(F.xxhash64(*renamed.columns), F.lit(spread)).cast("int")
        # A given number of partitions: the few bytes that meet would be put together in a few tasks.
        dealt = renamed.withColumn("__r_part", part).repartition(32 * spread, *[f"__r_{b}" for b in key2], "__r_part")
        copies = left.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).repartition(32 * spread, *key1, "__part")
        joined = copies.hint("shuffle_hash").join(dealt, [*on, _c("__part") == _c("__r_part")], how)
    else:
        joined = left.join(renamed, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    texts = {c for c, t in right.dtypes if t == "string"}
    rest = [c for c in right.columns if c not in key2]
    fill = lambda c: F.coalesce(_c(f"__r_{c}"), F.lit(null)) if null is not None and c in texts else _c(f"__r_{c}")
    return joined.select(*[_c(c).alias(prefix1 + c) for c in left.columns], *[fill(c).alias(prefix2 + c) for c in rest])


def merge_sorted(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of tables in key order."""
    return reduce(lambda a, b: a.unionByName(b), tables).orderBy(*keys)


def align(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """Outer merge by key: one column for each table, null where it lacks the key; keys repeated within a table go."""
    sides = []
    for i, t in enumerate(tables):
        once = t.groupBy(_c(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.first(_c(value)).alias(f"value_{i}"))
        sides.append(once.where("n = 1").drop("n"))
    return reduce(lambda a, b: a.join(b, "key", "full_outer"), sides)


def zip_exact(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows paired by position; unequal lengths raise. The positions are numbered in one task for each table."""
    number_rows = lambda d, o: d.withColumn("__n", F.row_number().over(Window.orderBy(*o)))
    joined = number_rows(a, order_a).withColumn("__a", F.lit(True)).join(number_rows(b, order_b).withColumn("__b", F.lit(True)), "__n", "full_outer")
    whole = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error(F.lit("tables of unequal length"))).otherwise(F.lit(True))
    return joined.where(whole).drop("__a", "__b", "__n")


# --- pivots ------------------------------------------------------------------------------


def xtab(df: DataFrame, row: str, col: str, aggregate: Column, columns: list | None = None) -> DataFrame:
    """A row for each row key, a column for each column key (given, or all distinct ones, sorted), the aggregate in the cells."""
    if columns is None:
        found = df.select(_c(col)).distinct().limit(MOST_COLUMNS + 1).collect()
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"{col} has more than {MOST_COLUMNS} values")
        columns = sorted((r[0] for r in found if r[0] is not None))
    return df.groupBy(_c(row)).pivot(col, columns).agg(aggregate)


def melt(df: DataFrame, row: str, columns: list[str], name: str = "column", value: str = "value") -> DataFrame:
    return df.unpivot([row], columns, name, value)


def tally(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*[_c(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))


def mapping(df: DataFrame, key: str, value: str, unique: bool = True) -> DataFrame:
    """Key to value; conflicting values raise, or with ``unique`` false are listed."""
    values = F.array_sort(F.collect_set(_c(value)))
    grouped = df.groupBy(_c(key).alias("key")).agg(values.alias("values"))
    if not unique:
        return grouped
    clash = F.when(F.size("values") > 1, F.raise_error(F.concat(F.lit("conflicting values of "), F.col("key").cast("string")))).otherwise(F.col("values")[0])
    return grouped.select("key", clash.alias("value"))


def numbered_chunks(df: DataFrame, size: int, partition: list[str], order: list[str]) -> DataFrame:
    """Batches of ``size`` consecutive rows within each partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("chunk", ((F.row_number().over(w) - 1) / size).cast("bigint"))


def check_sorted(df: DataFrame, partition: list[str], order: list[str], key: str) -> DataFrame:
    """Rows whose key is less than the one before."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("__before", F.lag(_c(key)).over(w)).where(_c(key) < F.col("__before")).drop("__before")
