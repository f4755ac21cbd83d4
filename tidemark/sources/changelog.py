"""The change log as uniform row events, and the committed transactions that make them count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import canon

ISSUES = "public.issues"


def committed(events: DataFrame, wal_transactions: DataFrame, lsn: str = "lsn") -> DataFrame:
    """Events whose LSN is a commit LSN; all others never took effect.

    A semi join: a hot transaction is on the left side, which AQE splits.
    """
    done = wal_transactions.select(F.col("commit_lsn").alias(lsn)).dropna()
    return events.join(done, lsn, "left_semi")


def known_tables(wal_updates: DataFrame, relations: DataFrame, keep_history: bool = False) -> DataFrame:
    """Updates with canonical ``table_name`` and the ``key_type`` of their relation.

    ``relations`` is the catalog (a fixed 45 rows in the test data); Spark broadcasts it by size.
    """
    rel = relations.filter("keep_history") if keep_history else relations
    rel = rel.select(
        F.lower(F.concat_ws(".", "schema_name", "rel_name")).alias("table_name"), "key_type", "key_column"
    )
    return wal_updates.withColumn("table_name", canon.table_name(F.col("table_name"))).join(rel, "table_name")


def wal_events(wal_updates: DataFrame, relations: DataFrame, hashed: bool = False, keep_history: bool = False, payload: bool = False) -> DataFrame:
    """(table_name, row_key, lsn, seq, alive[, state][, row_image]) of signed updates.

    ``state`` is the digest of the row's values, 0 for a removal.  Rows without key, LSN or sign
    can't be placed and are left out.
    """
    wal = wal_updates.select("table_name", "row_image", F.col("wal_time").alias("lsn"), "seq", "diff")
    e = known_tables(wal, relations, keep_history).withColumn(
        "row_key", canon.row_key(F.col("row_image"), F.col("key_type"))
    )
    alive = F.col("diff") > 0
    cols = ["table_name", "row_key", "lsn", "seq", alive.alias("alive")]
    if hashed:
        cols.append(
            F.when(alive, canon.image_hash(F.col("row_image"), F.col("table_name"))).otherwise(F.lit(0)).cast("bigint").alias("state")
        )
    if payload:
        cols.append(F.when(alive, F.col("row_image")).alias("row_image"))
    return e.select(*cols).dropna(subset=["row_key", "lsn", "seq", "alive"])


def change_kind(op: Column, old: Column, new: Column) -> Column:
    """``I``, ``U`` or ``D`` from any spelling of ``op``; without one, the images tell it."""
    first = F.upper(F.substring(canon.ident(op), 1, 1))
    told = F.when(new.isNull(), "D").when(old.isNull(), "I").otherwise("U")
    return F.when(first.isin("I", "U", "D"), first).otherwise(told)


def _images() -> list[Column]:
    """Both images, parsed once, and what tells where a column's value stands."""
    image = lambda c: F.try_parse_json(canon.plain_numbers(F.col(c)))
    full = F.coalesce(F.size(F.json_object_keys("old_row")) > 1, F.lit(False))
    return [image("old_row").alias("ov"), image("new_row").alias("nv"), full.alias("full"), F.col("unchanged_cols")]


def _told() -> Column:
    text = lambda v, x: F.coalesce(F.to_json(F.try_variant_get(F.col(v), f"$.{x}", "variant")), F.lit("null"))
    kept = lambda x: F.coalesce(F.array_contains("unchanged_cols", x), F.lit(False))
    told = [F.when(~kept(x), text("nv", x)).when(F.col("full"), text("ov", x)).alias(x) for x in canon.ISSUE_COLUMNS]
    return F.struct(*told).alias("told")


def change_events(row_changes: DataFrame, payload: bool = False) -> DataFrame:
    """(table_name, row_key, lsn, seq, alive[, columns of the row]) of typed changes.

    With ``payload``, each of ``canon.ISSUE_COLUMNS`` is JSON text, null where the change doesn't
    tell it: a column in ``unchanged_cols`` is told by a full old image only.

    An update that moves the key also removes the row under its old key, just before.
    """
    kind = change_kind(F.col("op"), F.col("old_row"), F.col("new_row"))
    key = lambda c: canon.row_key(F.col(c), F.lit("int8"))
    c = row_changes.select(
        F.col("commit_lsn").alias("lsn"), "seq", kind.alias("kind"), key("old_row").alias("old_key"),
        key("new_row").alias("new_key"), *(_images() if payload else []),
    )
    if payload:
        c = c.select("lsn", "seq", "kind", "old_key", "new_key", _told())
    gone = F.when(
        F.col("old_key").isNotNull() & ((F.col("kind") == "D") | (F.col("old_key") != F.col("new_key"))),
        F.struct(F.col("old_key").alias("row_key"), F.lit(False).alias("alive")),
    ).when(
        (F.col("kind") == "D") & F.col("new_key").isNotNull(),
        F.struct(F.col("new_key").alias("row_key"), F.lit(False).alias("alive")),
    )
    here = F.when(
        (F.col("kind") != "D") & F.col("new_key").isNotNull(),
        F.struct(F.col("new_key").alias("row_key"), F.lit(True).alias("alive")),
    )
    e = c.withColumn("e", F.explode(F.array_compact(F.array(gone, here))))
    cols = [F.lit(ISSUES).alias("table_name"), F.col("e.row_key").alias("row_key"), "lsn", "seq", F.col("e.alive").alias("alive")]
    if payload:
        cols += [F.when(F.col("e.alive"), F.col(f"told.{x}")).alias(x) for x in canon.ISSUE_COLUMNS]
    return e.select(*cols).dropna(subset=["row_key", "lsn", "seq"])
