"""Queries of problems 1 to 5 over the tables of the change log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import path, table
from tidemark.functions import canon
from tidemark.operators import dedupe, history, incremental, skew
from tidemark.operators.lsm import LsmTable
from tidemark.queries.delivery_sql import ORACLE as ORACLE
from tidemark.session import materialize, scratch
from tidemark.sources import changelog
from tidemark.sources.store import Store


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.superfluous(table(spark, sf, "diff_payloads"), table(spark, sf, "sub_states"))


def p1_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The exactly-once stream itself."""
    return dedupe.exactly_once(table(spark, sf, "diff_payloads"), table(spark, sf, "sub_states")).select(
        "delivery_id", "subscription_id", "lsn", "chunk_index", "row_batch"
    )


def p1_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The store of messages after three batches, the second one delivered twice."""
    d = dedupe.messages(table(spark, sf, "diff_payloads").select("delivery_id", *dedupe.MESSAGE))
    log = dedupe.MessageLog(spark, scratch(spark, "messages"), dedupe.MESSAGE, ["delivery_id"])
    parts = dedupe.arrivals(d, "delivery_id", 3)
    for i in (0, 1, 1, 2):
        if i < len(parts):
            log.append(i, parts[i])
    return log.stored()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    h = history.full_history(*[table(spark, sf, t) for t in ("wal_updates", "row_changes", "wal_transactions", "relations")])
    return h.select("table_name", "row_key", "valid_from", "valid_to")


def p2_refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """The same history from a first load without every fourth transaction's changes and every
    fourth commit record, and those as a late batch."""
    wal, rc, tx, rel = (table(spark, sf, t) for t in ("wal_updates", "row_changes", "wal_transactions", "relations"))
    store = history.HistoryStore(spark, scratch(spark, "history"))
    for batch, late in (("first", False), ("late", True)):
        part = lambda df, lsn, salt=0: df.filter((F.pmod(F.xxhash64(lsn, F.lit(salt)), F.lit(4)) == 0) == late)  # noqa: B023, E731
        events = history.history_events(part(wal, "wal_time"), part(rc, "commit_lsn"), rel)
        store.refresh(batch, events, part(tx, "commit_lsn", 1).select("commit_lsn"))
    return store.read().select("table_name", "row_key", "valid_from", "valid_to")


def change_table(spark: SparkSession, sf: str, payload: bool = False) -> LsmTable:
    """A merge table of all committed changes: the typed log is one run (two with the rows' contents), the signed log two by arrival."""
    wal, rc, tx, rel = (table(spark, sf, t) for t in ("wal_updates", "row_changes", "wal_transactions", "relations"))
    lsm = LsmTable(spark, scratch(spark, "lsm"), ["table_name", "row_key"], ["lsn", "seq"], carried=("row_image", *canon.ISSUE_COLUMNS) if payload else ())
    even = F.coalesce(F.col("seq") % 2 == 0, F.lit(False))  # changes of one row lie in both runs
    for run, part in (("typed-1", rc.filter(even)), ("typed-2", rc.filter(~even))) if payload else (("typed", rc),):
        lsm.append(run, changelog.committed(changelog.change_events(part, payload), tx))
    for i, part in enumerate(dedupe.arrivals(wal, "batch_id", 2)):
        lsm.append(f"signed-{i}", changelog.committed(changelog.wal_events(part, rel, payload=payload), tx))
    return lsm


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return change_table(spark, sf).read().select("table_name", "row_key", "lsn")


def p3_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The current rows themselves: typed ones put together from the last told value of each column."""
    rows = change_table(spark, sf, payload=True).read()
    fields = [F.concat(F.lit(f'"{c}":'), F.col(c)) for c in canon.ISSUE_COLUMNS]  # an untold one is left out
    typed = F.concat(F.lit("{"), F.concat_ws(",", F.concat(F.lit('"id":'), F.col("row_key")), *fields), F.lit("}"))
    return rows.select("table_name", "row_key", "lsn", F.when(F.col("table_name") == changelog.ISSUES, typed).otherwise(F.col("row_image")).alias("row_image"))


def p3_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The same after the runs were merged into one."""
    lsm = change_table(spark, sf)
    lsm.compact()
    return lsm.read().select("table_name", "row_key", "lsn")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    tables = [table(spark, sf, t) for t in ("sub_states", "subscribe_requests", "ack_requests")]
    return incremental.pending_messages(path(sf, "diff_payloads"), *tables).select("subscription_id", "lsn", "chunk_index")


class _Stopped(Exception):
    """A run ended on purpose, after its result was written and before its commit."""


def _stopped(store: Store, run: Callable[[], object]) -> None:
    def stop(manifest: dict) -> None:
        raise _Stopped

    commit, store.commit = store.commit, stop
    try:
        run()
    except _Stopped:
        pass
    finally:
        store.commit = commit


def p4_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of messages that arrive in two lots, each processed once: one run stops before its commit, one finds only touched files."""
    d = table(spark, sf, "diff_payloads").select("delivery_id", "batch_id", *dedupe.MESSAGE)
    source = scratch(spark, "files")
    runs = incremental.FileManifest(spark, scratch(spark, "file-runs"))
    keep = lambda df: dedupe.messages(df).select("delivery_id", *dedupe.MESSAGE)
    late = F.coalesce(F.col("batch_id") % 2 == 1, F.lit(False))
    d.filter(~late).write.parquet(f"{source}/first")
    runs.run(source, keep)
    d.filter(late).write.parquet(f"{source}/late")
    _stopped(runs.store, lambda: runs.run(source, keep))
    runs.run(source, keep)
    runs.store.touch(source)
    runs.run(source, keep)
    return runs.read()


def p4_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two consumer runs over a growing listing of messages, each message processed once; the second run stops once before its commit."""
    listing = materialize(incremental.message_listing(table(spark, sf, "diff_payloads")), "listing")
    middle = listing.agg(F.expr("(min(batch_id) + max(batch_id)) div 2")).first()[0] or 0
    runs = incremental.MessageRuns(spark, scratch(spark, "runs"))
    keep = lambda df: df.select("subscription_id", "lsn", "chunk_index")
    runs.run("first", listing.filter(F.col("batch_id") <= middle), keep)
    _stopped(runs.store, lambda: runs.run("second", listing, keep))
    for _ in range(2):  # the second time it is committed
        runs.run("second", listing, keep)
    return runs.read()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return skew.heavy_tables(table(spark, sf, "wal_updates"))


def p5_tables(spark: SparkSession, sf: str) -> DataFrame:
    return skew.table_totals(table(spark, sf, "wal_updates"))


def p5_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return skew.transaction_totals(table(spark, sf, "wal_updates"))



QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p1_batches, p2_found, p2_refreshed, p3_found, p3_rows, p3_compacted, p4_found, p4_files, p4_runs, p5_found, p5_tables, p5_transactions)}
