"""Messages delivered more than once: exactly one copy of each comes out.

Plan: rank the deliveries of a message by arrival and keep the first.  As only rank 1 is asked
for, Spark limits each group before the shuffle, so a message repeated in a third of all rows sends
one row per map task.  New batches are anti-joined against the identifiers stored so far; the store
is hashed by identifier as the ranked batch is, so it isn't moved.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import canon
from tidemark.session import scratch
from tidemark.sources.store import Store

MESSAGE = ["subscription_id", "lsn", "chunk_index"]


def _unknown(identity: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in identity])


def first_copies(deliveries: DataFrame, identity: list[str], arrival: list[str], nulls: bool = True) -> DataFrame:
    """One row per identity: the one that arrived first.

    Ties in ``arrival`` are broken by a digest of the whole row, so any two runs keep equal rows.
    Rows with a null in the identity can't be told apart from anything: all of them are kept
    (``nulls`` false: there are none).  Other columns pass through, an empty input gives an empty
    result.
    """
    rank, own = "__rank", "__own"
    while {rank, own} & set(deliveries.columns):
        rank, own = rank + "_", own + "_"
    if nulls:
        deliveries = deliveries.withColumn(own, F.when(_unknown(identity), F.monotonically_increasing_id()))
    keys = [F.col(f"`{c}`") for c in identity] + ([F.col(own)] if nulls else [])
    w = Window.partitionBy(*keys).orderBy(
        *[F.col(f"`{c}`").asc_nulls_last() for c in arrival], F.xxhash64(*[F.col(f"`{c}`") for c in deliveries.columns if c != own])
    )
    return deliveries.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank, own)


class MessageLog:
    """Exactly-once intake: batches in, each message stored once, whatever is delivered again.

    The store is the set of identifiers: one part per batch, hashed by identity into buckets.  A
    batch that was committed isn't taken again; one that failed left nothing and may be.  Messages
    with a null in their identity can't be told apart and are all stored, in parts of their own.
    """

    def __init__(self, spark: SparkSession, root: str, identity: list[str], arrival: list[str]) -> None:
        self.store, self.identity, self.arrival = Store(spark, root), identity, arrival

    def _known(self, m: dict) -> DataFrame | None:
        parts = [p["known"] for _, p in sorted(m["parts"].items())]
        return self.store.read_buckets(parts, self.identity, self.identity) if parts else None

    def stored(self) -> DataFrame | None:
        """All messages, None before the first batch."""
        m = self.store.manifest()
        known = self._known(m)
        if known is None:
            return None
        rest = self.store.spark.read.schema(known.schema).parquet(*[p["unknown"] for p in m["parts"].values()])
        return known.unionByName(rest)

    def append(self, batch_id: int, batch: DataFrame, seen: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Store what is new in a batch; ``seen`` takes out messages that were had before the log began."""
        m = self.store.manifest()
        if str(batch_id) in m["parts"]:
            return
        unknown = _unknown(self.identity)
        known = batch.filter(~unknown)
        new = first_copies(known if seen is None else seen(known), self.identity, self.arrival, nulls=False)
        if (old := self._known(m)) is not None:
            new = new.join(old.select(*self.identity), self.identity, "left_anti").select(*[F.col(f"`{c}`") for c in batch.columns])
        buckets = m.get("buckets") or int(self.store.spark.conf.get("spark.sql.shuffle.partitions"))
        part = {
            "known": self.store.write_buckets(new, f"batch-{batch_id}", self.identity, self.identity, buckets),
            "unknown": self.store.write_part(batch.filter(unknown), f"unknown-{batch_id}"),
        }
        self.store.commit(m | {"buckets": buckets, "parts": m["parts"] | {str(batch_id): part}})


def messages(diff_payloads: DataFrame) -> DataFrame:
    """Deliveries with canonical identity columns; the other columns as they came."""
    return diff_payloads.withColumns(
        {"subscription_id": canon.ident(F.col("subscription_id")), "lsn": canon.lsn(F.col("lsn"))}
    )


def latest_states(sub_states: DataFrame) -> DataFrame:
    """One row per subscription: the state saved last, 0 for "nothing yet"."""
    return (
        sub_states.withColumn("subscription_id", canon.ident(F.col("subscription_id")))
        .groupBy("subscription_id")
        .agg(
            F.max(
                F.struct(
                    F.col("saved_at"),
                    F.coalesce("last_seen_lsn", F.lit(0)).alias("last_seen_lsn"),
                    F.coalesce("last_acked_lsn", F.lit(0)).alias("last_acked_lsn"),
                )
            ).alias("s")
        )
        .select("subscription_id", "s.last_seen_lsn", "s.last_acked_lsn")
    )


def arrivals(df: DataFrame, column: str, batches: int) -> list[DataFrame]:
    """``df`` cut into ``batches`` ranges of an arrival number (of a scan: row groups are skipped);
    rows without one are in the last."""
    low, high = df.agg(F.min(column), F.max(column)).first()  # reads one narrow column
    if low is None:
        return [df]
    cuts = [low + (high - low) * i // batches for i in range(1, batches)]
    at = F.col(column)
    parts = [df.filter((at > a) & (at <= b)) for a, b in zip(cuts, cuts[1:])]
    return [df.filter(at <= cuts[0]), *parts, df.filter((at > cuts[-1]) | at.isNull())] if cuts else [df]


def intake(diff_payloads: DataFrame, sub_states: DataFrame, batches: int = 2) -> MessageLog:
    """A log that took the deliveries batch by batch.

    ``last_seen_lsn`` stands for the identifiers stored before the log began: it covers all of a
    subscription's messages up to it.
    """
    mark = "__mark"
    while mark in diff_payloads.columns:
        mark += "_"
    marks = latest_states(sub_states).select("subscription_id", F.col("last_seen_lsn").alias(mark))

    def seen(d: DataFrame) -> DataFrame:
        return d.join(marks, "subscription_id", "left").filter(F.col("lsn") > F.coalesce(mark, F.lit(0))).select(
            *[F.col(f"`{c}`") for c in d.columns]
        )

    spark = diff_payloads.sparkSession
    log = MessageLog(spark, scratch(spark, "messages"), MESSAGE, ["delivery_id"])
    for i, part in enumerate(arrivals(diff_payloads, "delivery_id", batches)):
        log.append(i, messages(part), seen)
    return log


def exactly_once(diff_payloads: DataFrame, sub_states: DataFrame) -> DataFrame:
    """The deliveries to process: first copies of messages not delivered before the log began.

    A message whose subscription, LSN or chunk is null is kept.
    """
    return intake(diff_payloads, sub_states).stored()


def superfluous(diff_payloads: DataFrame, sub_states: DataFrame) -> DataFrame:
    """``delivery_id`` of every delivery that ``exactly_once`` leaves out: no group of copies is
    formed for it, however many a message has."""
    kept = exactly_once(diff_payloads.select("delivery_id", *MESSAGE), sub_states).select("delivery_id")
    return diff_payloads.select("delivery_id").join(kept, "delivery_id", "left_anti")
