"""Per-key results when a few keys hold most rows.

Algebraic aggregates are combined in each map task's hash table (which spills when full), and only
one partial state per key and task is shuffled; the number of rows behind a key no longer
matters.  ``split_hot`` cuts keys that need ordered processing into ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import canon
from tidemark.session import materialize


def combine(df: DataFrame, keys: dict[str, Column], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregate by computed keys with map-side combining; null keys form one group.

    ``aggregates`` must be algebraic (count, sum, min, max, avg ...); an empty input gives no rows.
    """
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*[c.alias(k) for k, c in aggregates.items()])


def share_of_total(counts: DataFrame, count: str, share: str = "share") -> DataFrame:
    """Adds each row's share of the sum of ``count`` (a scalar subquery, no join)."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(share, F.try_divide(F.col(count), total))


def table_totals(wal_updates: DataFrame) -> DataFrame:
    """Rows, inserts, deletes and LSN range of each table of the log, as it stands."""
    spelled = combine(
        wal_updates,
        {"spelled": F.col("table_name")},
        {
            "n_rows": F.count(F.lit(1)),
            "n_added": F.count(F.when(F.col("diff") > 0, 1)),
            "n_removed": F.count(F.when(F.col("diff") < 0, 1)),
            "first_lsn": F.min("wal_time"),
            "last_lsn": F.max("wal_time"),
        },
    )
    return combine(
        spelled,
        {"table_name": canon.table_name(F.col("spelled"))},
        {c: F.sum(c) for c in ("n_rows", "n_added", "n_removed")}
        | {"first_lsn": F.min("first_lsn"), "last_lsn": F.max("last_lsn")},
    )


def heavy_tables(wal_updates: DataFrame, least_share: float = 0.05) -> DataFrame:
    """Tables that hold at least ``least_share`` of all rows."""
    # a row a table; the sum over them doesn't read the log again
    shares = share_of_total(materialize(table_totals(wal_updates), "table-totals"), "n_rows")
    return shares.filter((F.col("share") >= least_share) & F.col("table_name").isNotNull()).select("table_name")


def transaction_totals(wal_updates: DataFrame) -> DataFrame:
    """Distinct changes of each transaction (by commit LSN), as it stands in the log.

    Repeats are told by (``wal_time``, ``seq``); both levels combine before they shuffle, so a
    transaction with a third of all rows is spread by ``seq`` first.
    """
    changes = combine(
        wal_updates,
        {"wal_time": F.col("wal_time"), "seq": F.col("seq")},
        {"diff": F.max("diff"), "copies": F.count(F.lit(1))},
    )
    return combine(
        changes,
        {"wal_time": F.col("wal_time")},
        {"n_changes": F.count(F.lit(1)), "net": F.sum("diff"), "n_rows": F.sum("copies")},
    )


def split_hot(df: DataFrame, keys: list[str], order: str, hot_rows: int, ranges: int = 256) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys with their range number ``__blk``).

    Keys with more than ``hot_rows`` rows are cut into ``ranges`` ranges of ``order`` at its
    quantiles, so one key's rows never meet in one task.  ``order`` must be unique in a key.  The
    second part is None where no key is hot; ``df`` should be cheap to read again.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows).select(*keys)
    counts = materialize(counts, "hot-keys")
    if not counts.take(1):
        return df, None
    hot_rows_df = df.join(counts, keys, "left_semi")
    cuts = hot_rows_df.groupBy(*keys).agg(
        F.percentile_approx(order, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 100 * ranges).alias("__cut")
    )
    blocks = hot_rows_df.join(cuts, keys).withColumn(
        "__blk", F.size(F.filter("__cut", lambda b: b < F.col(order)))
    )
    return df.join(counts, keys, "left_anti"), blocks.drop("__cut")
