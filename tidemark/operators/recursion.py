"""Recursive queries: a driver loop over distributed rounds.

Each round is written to the shared folder, so lineage stays short and a lost executor costs one
round.  Only the frontier is joined again, never the whole result.  Rows met before lie hashed by
digest in buckets, so a round exchanges its new rows only, whatever has been met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import discard, materialize, scratch
from tidemark.sources.store import Store


class RecursionLimitError(RuntimeError):
    """A recursion went on after its greatest number of rounds."""


def rounds(limit: int | None) -> Iterator[int]:
    """0, 1, 2 ... for a loop that leaves by itself; beyond ``limit`` (None: never) an error."""
    n = 0
    while limit is None or n < limit:
        yield n
        n += 1
    raise RecursionLimitError(f"not finished after {limit} rounds")


class Met:
    """The rows met so far, each once by ``keys`` (null equals null), and what is new of others.

    Rows are told apart by two 64-bit digests: among 10^12 rows the chance that any two share both
    is about 10^-15.  ``fan`` parts are folded into one.
    """

    DIGESTS = ["__h1", "__h2"]

    def __init__(self, spark: SparkSession, keys: list[str], fan: int = 16) -> None:
        self.store, self.keys, self.fan = Store(spark, scratch(spark, "met")), keys, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.parts: list[dict] = []

    def _read(self, parts: list[dict]) -> DataFrame:
        return self.store.read_buckets(parts, self.DIGESTS, self.DIGESTS)

    def _write(self, df: DataFrame) -> dict:
        return self.store.write_buckets(df, "rows", self.DIGESTS, self.DIGESTS, self.buckets)

    def add(self, rows: DataFrame) -> DataFrame:
        """The rows that weren't met before, now written down."""
        cols = rows.columns
        parts = [x for c in self.keys for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]  # a digest skips nulls
        digest = {h: F.xxhash64(F.lit(i), *parts) for i, h in enumerate(self.DIGESTS)}
        new = rows.withColumns(digest).dropDuplicates(self.DIGESTS)
        if self.parts:
            new = new.join(self._read(self.parts).select(*self.DIGESTS), self.DIGESTS, "left_anti")
        part = self._write(new.select(*cols, *self.DIGESTS))
        self.parts.append(part)
        if len(self.parts) > self.fan:
            old, self.parts = self.parts[:-1], [self._write(self._read(self.parts[:-1])), part]
            for p in old:
                self.store.delete(p["path"])
        return self.store.spark.read.schema(rows.schema).parquet(part["path"])

    def rows(self) -> DataFrame:
        return self._read(self.parts).drop(*self.DIGESTS)


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], union_all: bool = False, max_rounds: int | None = None) -> DataFrame:
    """``WITH RECURSIVE r AS (base UNION [ALL] step(r))``.

    With UNION, rows met before are dropped in each round, so cyclic data ends; with UNION ALL it
    never does, unless ``max_rounds`` stops it with ``RecursionLimitError``.  An empty base gives no
    rows.
    """
    spark, names = base.sparkSession, base.columns
    if union_all:
        store, paths = Store(spark, scratch(spark, "fixpoint")), []
        new = base
        for _ in rounds(max_rounds):
            paths.append(store.write_part(new, "round"))
            frontier = spark.read.schema(base.schema).parquet(paths[-1])
            if not frontier.take(1):
                return spark.read.schema(base.schema).parquet(*paths)
            new = step(frontier).toDF(*names)
    met, new = Met(spark, names), base
    for _ in rounds(max_rounds):
        frontier = met.add(new)
        if not frontier.take(1):
            return met.rows()
        new = step(frontier).toDF(*names)


def iterate(start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int | None = None) -> DataFrame:
    """Apply ``step`` to the whole collection until nothing changes."""
    now = materialize(start, "iterate")
    for _ in rounds(max_rounds):
        new = materialize(step(now).select(*start.columns), "iterate")
        if not new.exceptAll(now).take(1) and not now.exceptAll(new).take(1):
            return new
        discard(now)
        now = new
