"""The relational operators as thin DataFrame functions; Catalyst picks the physical ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dialect
from tidemark.session import materialize


def where(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which the predicate is exactly TRUE."""
    return df.filter(predicate)


def project(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(*columns)


def _on(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> Column:
    cond = None
    for a, b in on:
        c = left[a] == right[b]
        cond = c if cond is None else cond & c
    if cond is None:
        raise ValueError("a join needs at least one pair of columns")
    return cond


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi join, ``how`` inner, left, left_semi or left_anti.

    NULL keys match nothing: they drop out of inner and semi joins and survive left and anti ones.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    return left.join(right, _on(left, right, on), how)


def aggregate(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """Grouped (NULL is a group) or, without ``by``, global: one row even over no rows."""
    aggs = [c.alias(n) for n, c in aggregates.items()]
    return df.groupBy(*by).agg(*aggs) if aggs else df.select(*by).distinct()


def distinct_on(df: DataFrame, on: list[str], order_by: list[Column]) -> DataFrame:
    """The first row of each ``on`` group by ``order_by``; ties fall by the whole row.

    Asking for rank 1 lets Spark cut each group before the shuffle.
    """
    w = Window.partitionBy(*on).orderBy(*dialect.total_order(df, order_by))
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def top_k(df: DataFrame, order_by: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """ORDER BY ... LIMIT ... OFFSET with a total order; without ``limit`` the whole sorted rows."""
    out = df.orderBy(*dialect.total_order(df, order_by))
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def set_operation(left: DataFrame, right: DataFrame, kind: str, all_rows: bool = False) -> DataFrame:
    """UNION, EXCEPT or INTERSECT by position with the left names; ``all_rows`` keeps multiplicity."""
    if len(left.columns) != len(right.columns):
        raise ValueError(f"{kind} needs equally many columns")
    right = right.toDF(*left.columns)
    if kind == "union":
        return left.union(right) if all_rows else left.union(right).distinct()
    if kind == "except":
        return left.exceptAll(right) if all_rows else left.subtract(right)
    if kind == "intersect":
        return left.intersectAll(right) if all_rows else left.intersect(right)
    raise ValueError(kind)


# --- on multisets ------------------------------------------------------------------------------


def multiplicities(df: DataFrame, name: str = "n") -> DataFrame:
    """Each distinct row with the number of times it occurs."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(name))


def threshold(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """The multiset in which a row that occurs n times occurs ``change(n)`` times."""
    n = change(F.col("__n")).cast("int")
    return (
        multiplicities(df, "__n").withColumn("__m", n).filter("__m > 0")
        .withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__m")))).drop("__n", "__m", "__i")
    )


def _ranges(df: DataFrame, by: list[str], order_by: list[Column]) -> DataFrame:
    """The rows with ``__range``, the number of the sorted range they lie in; a group may lie in several."""
    placed = df.repartitionByRange(*[F.col(f"`{c}`") for c in by], *order_by)
    return materialize(placed.withColumn("__range", F.spark_partition_id()), "ranges")


def prefix_sum(df: DataFrame, by: list[str], order: str, value: str, name: str = "before") -> DataFrame:
    """Sum of ``value`` over the rows before, by ``order`` (unique in a group); 0 for the first.

    A parallel scan: rows are cut into sorted ranges, summed up within each, and every range starts
    from the sum of its group's ranges before, so a group may be of any size.
    """
    cols, at = [c for c in df.columns if c != name], [*by, "__range"]
    r = _ranges(df, by, [dialect.asc(order)])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    start = r.groupBy(*at).agg(F.sum(value).alias("__s")).select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(at)], F.sum("__s").over(earlier).alias("__start"))
    within = Window.partitionBy(*at).orderBy(dialect.asc(order)).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("__own", F.sum(value).over(within))
    j = r.join(start, reduce(lambda x, y: x & y, [F.col(f"`{c}`").eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(at)]), "left")
    return j.select(*[F.col(f"`{c}`") for c in cols], (F.coalesce("__start", F.lit(0)) + F.coalesce("__own", F.lit(0))).alias(name))


def numbered(df: DataFrame, order_by: list[Column], name: str = "n") -> DataFrame:
    """The position of each row in a total order of all rows, from 1; no task sorts more than a range."""
    cols, order = [c for c in df.columns if c != name], dialect.total_order(df, order_by)
    r = _ranges(df, [], order)
    r = r.withColumn("__own", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    start = r.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    return r.join(start, "__range").select(*[F.col(f"`{c}`") for c in cols], (F.col("__start") + F.col("__own")).alias(name))


def reduce_groups(
    df: DataFrame, by: list[str], reducer: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
    partial: Callable[[pd.DataFrame], pd.DataFrame] | None = None, salts: int = 64,
) -> DataFrame:
    """An arbitrary reducer per key over (row, multiplicity): rows are counted before they move, so
    a reducer gets each distinct row once with its ``n``.

    A reducer sees all of a key's distinct rows at once.  Where those may be many, ``partial`` cuts
    them down first, in ``salts`` parts of each key: it returns rows of the same columns, from which
    the reducer must give what it gives from all.
    """
    m = multiplicities(df)
    if partial is not None:
        salt = F.pmod(F.xxhash64(*[F.struct(F.col(f"`{c}`")) for c in df.columns]), F.lit(salts)).alias("__salt")
        m = m.groupBy(*[F.col(f"`{c}`") for c in by], salt).applyInPandas(lambda pdf: partial(pdf), m.schema)
    return m.groupBy(*by).applyInPandas(reducer, schema)


def join_function(df: DataFrame, array: Column, name: str) -> DataFrame:
    """Each row with every element that ``array`` computes from it."""
    return df.withColumn(name, F.explode(array))


def assert_empty(df: DataFrame) -> None:
    if rows := df.take(1):
        raise AssertionError(f"expected no rows, got {rows[0]}")


def assert_same(a: DataFrame, b: DataFrame) -> None:
    """Both hold the same multiset of rows."""
    assert_empty(a.exceptAll(b))
    assert_empty(b.exceptAll(a))


def inspect(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """Observed metrics of a plan (row count by default) without another pass."""
    m = metrics or {"rows": F.count(F.lit(1))}
    return df.observe(name, *[c.alias(k) for k, c in m.items()])


def arrange(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows placed and sorted by key once, kept for several joins or groupings on it.

    Kept on disk where memory is short; call ``unpersist`` when done.
    """
    placed = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return placed.sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
