"""Views kept current by delta rules.

A view is a tree of nodes.  ``full`` evaluates it over tables; ``delta`` gives the change of its
result from the old tables and their changes, touching only the keys that changed: linear nodes
map the change itself, joins use the bilinear rule, and grouped nodes recompute touched groups.
Tables and results are signed multisets (see ``deltas``).

``moves`` is the same for changes of many transactions at once: each row carries its ``_lsn``, and
so does each row of the result.  A joined row moves at the later of its two LSNs; a touched group is
evaluated once for each LSN that touches it, over what it holds then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.streaming import deltas as S
from tidemark.streaming.deltas import DIFF, LSN

Tables = dict[str, DataFrame]


class Node:
    def full(self, tables: Tables) -> DataFrame:
        raise NotImplementedError

    def change(self, old: Tables, change: Tables) -> DataFrame:
        """The unconsolidated change of the result."""
        raise NotImplementedError

    def moves(self, old: Tables, change: Tables) -> DataFrame:
        """The unconsolidated change of the result with the LSN of each row, from changes with LSNs."""
        raise NotImplementedError

    def timed(self) -> bool:
        """Whether the whole tree has ``moves``."""
        return type(self).moves is not Node.moves and all(c.timed() for c in self.__dict__.values() if isinstance(c, Node))

    def delta(self, old: Tables, change: Tables) -> DataFrame:
        """The net change: rows that cancel out never leak."""
        return S.consolidate(self.change(old, change))

    def new(self, old: Tables, change: Tables) -> Tables:
        return {n: S.concat(t, change[n]) if n in change else t for n, t in old.items()}

    def sources(self) -> set[str]:
        return set().union(*[c.sources() for c in self.__dict__.values() if isinstance(c, Node)])


@dataclass
class Source(Node):
    name: str

    def full(self, tables):
        return tables[self.name]

    def change(self, old, change):
        return change[self.name] if self.name in change else old[self.name].limit(0)

    def moves(self, old, change):
        c = self.change(old, change)
        return c if LSN in c.columns else c.withColumn(LSN, F.lit(None).cast("bigint"))

    def sources(self):
        return {self.name}


@dataclass
class Filter(Node):
    child: Node
    predicate: str | Column

    def full(self, tables):
        return self.child.full(tables).filter(self.predicate)

    def change(self, old, change):
        return self.child.change(old, change).filter(self.predicate)

    def moves(self, old, change):
        return self.child.moves(old, change).filter(self.predicate)


@dataclass
class Project(Node):
    child: Node
    columns: list[str | Column]

    def _map(self, df: DataFrame, *kept: str) -> DataFrame:
        return df.select(*[F.expr(c) if isinstance(c, str) else c for c in self.columns], DIFF, *kept)

    def full(self, tables):
        return self._map(self.child.full(tables))

    def change(self, old, change):
        return self._map(self.child.change(old, change))

    def moves(self, old, change):
        return self._map(self.child.moves(old, change), LSN)


@dataclass
class UnionAll(Node):
    left: Node
    right: Node

    def full(self, tables):
        return self.left.full(tables).union(self.right.full(tables))

    def change(self, old, change):
        return self.left.change(old, change).union(self.right.change(old, change))

    def moves(self, old, change):
        return _last(self.left.moves(old, change)).union(_last(self.right.moves(old, change)))


def _last(df: DataFrame) -> DataFrame:
    """Data columns, then diff, then LSN."""
    return df.select(*[F.col(f"`{c}`") for c in S.data_columns(df)], DIFF, LSN)


def _key(keys: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)])


def _versions(touched: DataFrame, keys: list[str]) -> DataFrame:
    """(__k, __at, __until): each LSN at which a key is touched, -1 for before, with the next one."""
    t = touched.select(_key(keys).alias("__k"), F.explode(F.array(F.lit(-1).cast("bigint"), LSN)).alias("__at")).distinct()
    return t.withColumn("__until", F.lead("__at").over(Window.partitionBy("__k").orderBy("__at")))


def _standing(base: DataFrame, moved: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """What the touched keys hold at each of their versions, as a multiset with that LSN."""
    cols = S.data_columns(base)
    rows = _last(base.withColumn(LSN, F.lit(-1).cast("bigint"))).union(_last(moved).toDF(*cols, DIFF, LSN))
    rows = rows.withColumn("__key", _key(keys).cast(versions.schema["__k"].dataType))
    v = versions.select("__k", "__at")
    j = rows.join(v, rows["__key"].eqNullSafe(v["__k"]) & (rows[LSN] <= v["__at"]))
    return S.consolidate(j.select(*[F.col(f"`{c}`") for c in cols], DIFF, F.col("__at").alias(LSN)))


def _steps(results: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """The result of each version comes at its LSN and goes at the next one's."""
    r = results.withColumn("__key", _key(keys).cast(versions.schema["__k"].dataType))
    j = r.join(versions, r["__key"].eqNullSafe(versions["__k"]) & (r[LSN] == versions["__at"]))
    step = lambda sign, at: F.when(F.col(at) >= 0, F.struct((F.col(DIFF) * sign).alias("d"), F.col(at).alias("at")))
    j = j.withColumn("__s", F.explode(F.array_compact(F.array(step(1, "__at"), step(-1, "__until")))))
    return j.select(*[F.col(f"`{c}`") for c in S.data_columns(results)], F.col("__s.d").alias(DIFF), F.col("__s.at").alias(LSN))


def _weighted_join(a: DataFrame, b: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    b = b.withColumnRenamed(DIFF, "__w")
    cond = reduce(lambda x, y: x & y, [a[x] == b[y] for x, y in on])
    return a.join(b, cond).withColumn(DIFF, F.col(DIFF) * F.col("__w")).drop("__w").select(
        *[c for c in a.columns if c != DIFF], *[c for c in b.columns if c != "__w"], DIFF
    )


def _at(df: DataFrame, name: str) -> DataFrame:
    return df.withColumnRenamed(LSN, name)


@dataclass
class Join(Node):
    """Inner equi join; the two sides have different column names."""

    left: Node
    right: Node
    on: list[tuple[str, str]]

    def full(self, tables):
        return _weighted_join(self.left.full(tables), self.right.full(tables), self.on)

    def change(self, old, change):
        dl, dr = self.left.change(old, change), self.right.change(old, change)
        lo, ro = self.left.full(old), self.right.full(old)
        # dL x R + L x dR + dL x dR, the last two as (L + dL) x dR
        return S.concat(_weighted_join(dl, ro, self.on), _weighted_join(S.concat(lo, dl), dr, self.on))

    def moves(self, old, change):
        dl, dr = _at(self.left.moves(old, change), "__l"), _at(self.right.moves(old, change), "__r")
        lo, ro = self.left.full(old), self.right.full(old)
        both = _weighted_join(dl, dr, self.on).withColumn(LSN, F.greatest("__l", "__r")).drop("__l", "__r")
        left = _weighted_join(dl, ro, self.on).withColumnRenamed("__l", LSN)
        return S.concat(left, _weighted_join(lo, dr, self.on).withColumnRenamed("__r", LSN), both)


@dataclass
class KeyedJoin(Node):
    """Left, semi or anti join: all rows of touched keys are done again."""

    left: Node
    right: Node
    on: list[tuple[str, str]]
    how: str  # left, left_semi, left_anti

    def _eval(self, a: DataFrame, b: DataFrame, extra: tuple = ()) -> DataFrame:
        a, b = S.consolidate(a), S.consolidate(b)
        on = [*self.on, *extra]
        if self.how == "left":
            b = b.withColumnRenamed(DIFF, "__w")
            cond = reduce(lambda x, y: x & y, [a[x] == b[y] for x, y in on])
            j = a.join(b, cond, "left").withColumn(DIFF, F.col(DIFF) * F.coalesce("__w", F.lit(1)))
            return j.select(*[c for c in a.columns if c != DIFF], *[c for c in b.columns if c != "__w"], DIFF)
        return R.join(a, b.drop(DIFF), on, self.how)

    def full(self, tables):
        return self._eval(self.left.full(tables), self.right.full(tables))

    def change(self, old, change):
        lk, rk = [a for a, _ in self.on], [b for _, b in self.on]
        dl, dr = self.left.change(old, change), self.right.change(old, change)
        touched = dl.select(*lk).union(dr.select(*rk)).distinct()
        lo = S.matches(self.left.full(old), touched, lk)
        ro = S.matches(self.right.full(old), touched.toDF(*rk), rk)
        return S.concat(self._eval(S.concat(lo, dl), S.concat(ro, dr)), S.negate(self._eval(lo, ro)))

    def moves(self, old, change):
        lk, rk = [a for a, _ in self.on], [b for _, b in self.on]
        dl, dr = self.left.moves(old, change), self.right.moves(old, change)
        touched = dl.select(*lk, LSN).union(dr.select(*rk, LSN))
        v = _versions(touched, lk)
        lo = S.matches(self.left.full(old), touched.select(*lk), lk)
        ro = S.matches(self.right.full(old), touched.select(*lk).toDF(*rk), rk)
        right = _at(_standing(ro, dr, v, rk), "__lsn")
        return _steps(self._eval(_standing(lo, dl, v, lk), right, ((LSN, "__lsn"),)).drop("__lsn"), v, lk)


@dataclass
class Rowwise(Node):
    """DISTINCT and set operations: a function of the multiplicities of a row on each side."""

    left: Node
    right: Node | None
    count: Callable[[Column, Column], Column]

    def _eval(self, a: DataFrame, b: DataFrame | None) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        sides = a.withColumns({"__l": F.col(DIFF), "__r": zero}).drop(DIFF)
        if b is not None:
            at = [F.col(LSN)] if LSN in a.columns else []
            sides = sides.select(*S.data_columns(a), *at, "__l", "__r").union(b.select(*S.data_columns(b), *at, zero, F.col(DIFF)))
        cols = [c for c in a.columns if c != DIFF]
        g = sides.groupBy(*cols).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
        return g.select(*cols, self.count(F.col("__l"), F.col("__r")).cast("bigint").alias(DIFF)).filter(F.col(DIFF) > 0)

    def full(self, tables):
        return self._eval(self.left.full(tables), self.right.full(tables) if self.right else None)

    def change(self, old, change):
        dl = self.left.change(old, change)
        cols = S.data_columns(dl)
        rename = lambda d: d.toDF(*cols, DIFF)
        dr = rename(self.right.change(old, change)) if self.right else None
        touched = dl.select(*cols) if dr is None else dl.select(*cols).union(dr.select(*cols))
        lo = S.matches(self.left.full(old), touched, cols)
        ro = S.matches(rename(self.right.full(old)), touched, cols) if self.right else None
        new = self._eval(S.concat(lo, dl), None if ro is None else S.concat(ro, dr))
        return S.concat(new, S.negate(self._eval(lo, ro)))

    def moves(self, old, change):
        dl = self.left.moves(old, change)
        cols = S.data_columns(dl)
        dr = _last(self.right.moves(old, change)).toDF(*cols, DIFF, LSN) if self.right else None
        touched = dl.select(*cols, LSN) if dr is None else dl.select(*cols, LSN).union(dr.select(*cols, LSN))
        v = _versions(touched, cols)
        left = _standing(S.matches(self.left.full(old), touched, cols), dl, v, cols)
        right = None
        if self.right:
            full = self.right.full(old).select(*S.data_columns(self.right.full(old)), DIFF).toDF(*cols, DIFF)
            right = _standing(S.matches(full, touched, cols), dr, v, cols)
        return _steps(self._eval(left, right), v, cols)


def distinct(child: Node) -> Node:
    return Rowwise(child, None, lambda l, r: F.when(l > 0, 1).otherwise(0))


def set_operation(left: Node, right: Node, kind: str, all_rows: bool = False) -> Node:
    if kind == "union":
        return UnionAll(left, right) if all_rows else distinct(UnionAll(left, right))
    rules = {
        ("except", True): lambda l, r: F.greatest(l - r, F.lit(0)),
        ("except", False): lambda l, r: F.when((l > 0) & (r <= 0), 1).otherwise(0),
        ("intersect", True): lambda l, r: F.least(l, r),
        ("intersect", False): lambda l, r: F.when((l > 0) & (r > 0), 1).otherwise(0),
    }
    return Rowwise(left, right, rules[kind, all_rows])


@dataclass
class Grouped(Node):
    """A node whose result is a function of each group of ``by``: touched groups are done again.

    ``evaluate`` gets plain rows and the columns to group by.
    """

    child: Node
    by: list[str]
    evaluate: Callable[[DataFrame, list[str]], DataFrame]

    def _eval(self, df: DataFrame) -> DataFrame:
        at = [LSN] if LSN in df.columns else []
        return S.seed(self.evaluate(S.expand(S.consolidate(df)), [*self.by, *at]))

    def full(self, tables):
        return self._eval(self.child.full(tables))

    def change(self, old, change):
        d = self.child.change(old, change)
        lo = S.matches(self.child.full(old), d, self.by) if self.by else self.child.full(old)
        return S.concat(self._eval(S.concat(lo, d)), S.negate(self._eval(lo)))

    def timed(self):
        return bool(self.by) and self.child.timed()

    def moves(self, old, change):
        d = self.child.moves(old, change)
        v = _versions(d, self.by)
        return _steps(self._eval(_standing(S.matches(self.child.full(old), d, self.by), d, v, self.by)), v, self.by)


def aggregate(child: Node, by: list[str], **aggregates: Column) -> Node:
    return Grouped(child, by, lambda df, keys: R.aggregate(df, keys, **aggregates))


@dataclass
class Summed(Node):
    """COUNT and SUM by group from the change and the group's sums so far.

    A view keeps those (``accumulated``) in parts that add up, so no base row is read again; without
    them they are summed up from the tables.  ``sums`` are expressions over the child's columns; a
    group is there while its count isn't 0.
    """

    child: Node
    by: list[str]
    sums: dict[str, str] = field(default_factory=dict)
    count: str = "n"

    def _held(self) -> list[str]:
        return [self.count, *self.sums, *[f"__{n}" for n in self.sums]]

    def _sum(self, df: DataFrame, *at: str) -> DataFrame:
        parts = [F.sum(F.expr(e) * F.col(DIFF)).alias(n) for n, e in self.sums.items()]
        filled = [F.sum(F.when(F.expr(e).isNotNull(), F.col(DIFF)).otherwise(0)).alias(f"__{n}") for n, e in self.sums.items()]
        return df.groupBy(*self.by, *at).agg(F.sum(DIFF).alias(self.count), *parts, *filled)

    def _rows(self, g: DataFrame, *at: str) -> DataFrame:
        values = [F.when(F.col(f"__{n}") > 0, F.col(n)).alias(n) for n in self.sums]
        return S.seed(g.filter(F.col(self.count) > 0).select(*self.by, self.count, *values, *at))

    def full(self, tables):
        return self._rows(self._sum(self.child.full(tables)))

    def accumulated(self, tables: Tables) -> DataFrame:
        """The sums of each group; those of a change, added to those of the tables before, are those after."""
        return self._sum(self.child.full(tables))

    def _add(self, sums: DataFrame, *at: str) -> DataFrame:
        return sums.groupBy(*self.by, *at).agg(*[F.sum(c).alias(c) for c in self._held()])

    def change(self, old, change):
        d = self.child.change(old, change)
        now = self._sum(S.matches(self.child.full(old), d, self.by) if self.by else self.child.full(old))
        both = self._add(now.unionByName(self._sum(d)))
        return S.concat(self._rows(both), S.negate(self._rows(now)))

    def moves(self, old, change, held: DataFrame | None = None):
        d = self._sum(self.child.moves(old, change), LSN)
        if held is None:
            now = self._sum(S.matches(self.child.full(old), d, self.by) if self.by else self.child.full(old))
        else:
            now = self._add(S.matches(held, d, self.by) if self.by else held)
        w = Window.partitionBy(*self.by).orderBy(LSN)
        both = now.withColumn(LSN, F.lit(-1).cast("bigint")).unionByName(d)
        # of an LSN, a group has one row: the sums up to it are its state then
        state = F.struct(F.col(self.count), *[F.when(F.col(f"__{n}") > 0, F.col(n)).alias(n) for n in self.sums])
        g = both.withColumns({c: F.sum(c).over(w) for c in self._held()})
        g = g.select(*self.by, LSN, F.when(F.col(self.count) > 0, state).alias("__now"))
        g = g.withColumn("__was", F.lag("__now").over(w)).filter((F.col(LSN) >= 0) & ~F.col("__was").eqNullSafe(F.col("__now")))
        step = lambda sign, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(sign).cast("bigint").alias("d"), F.col(c).alias("s")))
        g = g.withColumn("__s", F.explode(F.array_compact(F.array(step(-1, "__was"), step(1, "__now")))))
        return g.select(*self.by, "__s.s.*", F.col("__s.d").alias(DIFF), LSN)


def distinct_on(child: Node, on: list[str], order_by: list[Column]) -> Node:
    return Grouped(child, on, lambda df, keys: R.distinct_on(df, keys, order_by))


def top_k(child: Node, order_by: list[Column], limit: int | None, offset: int = 0) -> Node:
    """The whole view is one group."""
    return Grouped(child, [], lambda df, keys: R.top_k(df, order_by, limit, offset))


@dataclass
class Recomputed(Node):
    """Any function of the tables, evaluated before and after (fixpoints; the fallback for all)."""

    tables_used: set[str]
    evaluate: Callable[[Tables], DataFrame]

    def full(self, tables):
        return S.seed(self.evaluate({n: S.expand(S.consolidate(t)) for n, t in tables.items()}))

    def change(self, old, change):
        return S.concat(self.full(self.new(old, change)), S.negate(self.full(old)))

    def sources(self):
        return self.tables_used


def recomputed_delta(node: Node, old: Tables, change: Tables) -> DataFrame:
    """The change by evaluating the view before and after: right for every node, used as its test."""
    return S.difference(node.full(node.new(old, change)), node.full(old))
