"""Signed multisets: rows with a BIGINT ``_diff`` (and, on change streams, ``_lsn``).

A table is a multiset whose rows have ``_diff`` 1; a change is one with positive and negative
rows.  All functions keep to algebraic aggregates, so hot rows and keys are combined map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.changelog import change_kind

DIFF, LSN = "_diff", "_lsn"


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (DIFF, LSN)]


def seed(df: DataFrame, lsn: int | None = None) -> DataFrame:
    """A snapshot as +1 updates, at ``lsn`` if given."""
    out = df.withColumn(DIFF, F.lit(1).cast("bigint"))
    return out if lsn is None else out.withColumn(LSN, F.lit(lsn).cast("bigint"))


def negate(df: DataFrame) -> DataFrame:
    return df.withColumn(DIFF, -F.col(DIFF))


def concat(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def delay(df: DataFrame, by: int) -> DataFrame:
    """The same changes at later log positions."""
    return df.withColumn(LSN, F.col(LSN) + by)


def consolidate(df: DataFrame) -> DataFrame:
    """One row per distinct row (and LSN) with its net ``_diff``; those that cancel out are dropped.

    Nulls are values; an empty input gives no rows.
    """
    keys = [c for c in df.columns if c != DIFF]
    return df.groupBy(*keys).agg(F.sum(DIFF).alias(DIFF)).filter(F.col(DIFF) != 0)


def expand(df: DataFrame) -> DataFrame:
    """Plain rows of a multiset: a row of ``_diff`` n occurs n times (not at all below 1)."""
    return df.filter(F.col(DIFF) > 0).withColumn(DIFF, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(DIFF)))).drop(DIFF)


def explode_weighted(df: DataFrame, items: Column, name: str) -> DataFrame:
    """Each row with every element of ``items``, an array of struct(value, weight); weights multiply."""
    e = df.withColumn("__e", F.explode(items))
    return e.withColumns({name: F.col("__e.value"), DIFF: F.col(DIFF) * F.col("__e.weight")}).drop("__e")


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """What turns the multiset ``old`` into ``new``."""
    return consolidate(concat(new, negate(old)))


def matches(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``columns`` are among ``keys``, where NULL equals NULL."""
    k = keys.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(columns)]).distinct()
    cond = reduce(lambda a, b: a & b, [df[f"`{c}`"].eqNullSafe(k[f"__k{i}"]) for i, c in enumerate(columns)])
    return df.join(k, cond, "left_semi")


def kind() -> Column:
    """I, U, D, T or C (a COMMIT row) from any spelling of ``op``; without one, the images tell it."""
    op = F.upper(F.trim("op"))
    return F.when(op == "COMMIT", "C").when(F.substring(op, 1, 1) == "T", "T").otherwise(change_kind(F.col("op"), F.col("old"), F.col("new")))


def _parsed(changes: DataFrame, schema: T.StructType) -> DataFrame:
    """(lsn, seq, kind, old, new, told, kept): typed images, the fields the old one holds, the columns the new one leaves out."""
    image = lambda c: F.from_json(c, schema, {"mode": "FAILFAST"}).alias(c)
    none = F.array().cast("array<string>")
    return changes.select("lsn", "seq", kind().alias("kind"), image("old"), image("new"),
                          F.coalesce(F.json_object_keys("old"), none).alias("told"), F.coalesce("unchanged_cols", none).alias("kept")).filter("kind NOT IN ('T', 'C')")


def is_untold(schema: T.StructType) -> Column:
    """Whether a raw change needs more than its images: an update or delete without a full old one."""
    none = F.array().cast("array<string>")
    return (kind().isin("U", "D")) & (F.size(F.coalesce(F.json_object_keys("old"), none)) < len(schema))


def _completed(c: DataFrame, schema: T.StructType, base: DataFrame, key: list[str]) -> DataFrame:
    """Images with the columns they leave out: from the row's earlier changes, else from ``base``.

    An entry per change and row tells what the row holds after it: each value in a struct, null
    where it stays as it was, with ``known`` false where the images don't tell it (the row is gone,
    or came from another key).
    """
    cols = schema.fieldNames()
    name = {x: "`" + x.replace("`", "``") + "`" for x in cols}
    text = {x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in cols}
    kind = {x: schema[x].dataType.simpleString() for x in cols}
    ident = lambda v: f"struct({', '.join(f'{v}.{name[k]} AS k{i}' for i, k in enumerate(key))})"
    # expressions as text: there are several for each column, and text is one call to the JVM
    c = c.selectExpr("*", f"CASE WHEN old IS NOT NULL THEN {ident('old')} ELSE {ident('new')} END AS __at", f"CASE WHEN new IS NOT NULL THEN {ident('new')} END AS __to")
    c = c.selectExpr("*", "coalesce(__at <> __to, FALSE) AS __moved").selectExpr(
        "*", "explode(array_compact(array(struct(__at AS k, TRUE AS own), CASE WHEN __moved THEN struct(__to AS k, FALSE AS own) END))) AS __e"
    )

    def after(i: int, x: str) -> str:
        lost, told = f"struct(FALSE AS known, CAST(NULL AS {kind[x]}) AS value)", lambda v: f"struct(TRUE AS known, {v}.{name[x]} AS value)"
        return (
            f"CASE WHEN kind = 'D' OR (__moved AND __e.own) THEN {lost} WHEN new IS NOT NULL AND NOT array_contains(kept, {text[x]}) THEN {told('new')} "  # the row left this key
            f"WHEN array_contains(told, {text[x]}) THEN {told('old')} WHEN __moved THEN {lost} END AS __a{i}"
        )

    b = (base if DIFF in base.columns else seed(base)).select(*[F.col(name[x]) for x in cols], DIFF)
    b = b.selectExpr("*", f"struct({', '.join(f'{name[k]} AS k{i}' for i, k in enumerate(key))}) AS __k")
    b = consolidate(b.join(c.select(F.col("__e.k").alias("__k")).distinct(), "__k", "left_semi")).filter(F.col(DIFF) > 0)
    b = b.selectExpr("__k", f"struct({', '.join(name.values())}) AS __base")
    c = c.selectExpr("lsn", "seq", "kind", "old", "new", "told", "kept", "__e.k AS __k", "__e.own AS __own", *[after(i, x) for i, x in enumerate(cols)])
    over = "OVER (PARTITION BY __k ORDER BY lsn, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    c = c.selectExpr("*", *[f"last_value(__a{i}) IGNORE NULLS {over} AS __s{i}" for i in range(len(cols))]).filter("__own").join(b, "__k", "left")

    def earlier(i: int, x: str) -> str:
        missing = f"CAST(raise_error(concat('no earlier value of ', {text[x]}, ' for change ', CAST(struct(lsn, seq) AS STRING))) AS {kind[x]})"
        return f"CASE WHEN coalesce(__s{i}.known, FALSE) THEN __s{i}.value WHEN __s{i} IS NULL AND __base IS NOT NULL THEN __base.{name[x]} ELSE {missing} END"

    held = lambda i, x: f"CASE WHEN array_contains(told, {text[x]}) THEN old.{name[x]} ELSE {earlier(i, x)} END"
    old = ", ".join(f"{held(i, x)} AS {name[x]}" for i, x in enumerate(cols))
    new = ", ".join(f"CASE WHEN array_contains(kept, {text[x]}) THEN {held(i, x)} ELSE new.{name[x]} END AS {name[x]}" for i, x in enumerate(cols))
    return c.selectExpr("lsn", "seq", "kind", f"CASE WHEN kind <> 'I' THEN struct({old}) END AS old", f"CASE WHEN new IS NOT NULL THEN struct({new}) END AS new")


def from_changes(changes: DataFrame, schema: T.StructType, base: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """Signed rows of a typed change log (op, old, new as JSON text, lsn): an insert adds its new row,
    a delete takes its old one, an update does both.  A null op is told by the images.

    A column in ``unchanged_cols`` is taken from the old image.  With ``base``, the table before
    these changes (plain or signed) with its ``key``, what the images leave out comes from the row's
    earlier changes, else from ``base``; without, such a column is an error, and rows without image
    for a side add nothing.
    """
    c = _parsed(changes, schema)
    if base is not None:
        c = _completed(c, schema, base, key)
    else:
        lost = lambda x: F.raise_error(F.lit(f"unchanged column {x} is not in the old image")).cast(schema[x].dataType)
        new = F.struct(*[
            F.when(F.array_contains("kept", x), F.when(F.array_contains("told", x), F.col(f"old.{x}")).otherwise(lost(x))).otherwise(F.col(f"new.{x}")).alias(x)
            for x in schema.fieldNames()
        ])
        c = c.withColumn("new", F.when(F.col("new").isNotNull() & (F.size("kept") > 0), new).otherwise(F.col("new")))
    sides = F.array_compact(F.array(
        F.when(F.col("old").isNotNull() & (F.col("kind") != "I"), F.struct(F.col("old").alias("r"), F.lit(-1).cast("bigint").alias(DIFF))),
        F.when(F.col("new").isNotNull() & (F.col("kind") != "D"), F.struct(F.col("new").alias("r"), F.lit(1).cast("bigint").alias(DIFF))),
    ))
    return c.select(F.col("lsn").alias(LSN), F.explode(sides).alias("e")).select("e.r.*", f"e.{DIFF}", LSN)


def truncation(table: DataFrame, lsn: int) -> DataFrame:
    """A TRUNCATE as retractions of every row of ``table`` (plain or signed)."""
    t = table if DIFF in table.columns else seed(table)
    return negate(t).withColumn(LSN, F.lit(lsn).cast("bigint"))


def fence(changes: DataFrame, snapshot_lsn: int, lsn: str = LSN) -> DataFrame:
    """Changes that the snapshot doesn't hold yet."""
    return changes.filter(F.col(lsn) > snapshot_lsn)


def reconcile(mirror: DataFrame, snapshot: DataFrame, lsn: int) -> DataFrame:
    """One transaction that brings a mirror to a fresh snapshot."""
    return difference(seed(snapshot), seed(mirror)).withColumn(LSN, F.lit(lsn).cast("bigint"))


def resolve_unchanged(changes: DataFrame, columns: list[str], base: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Fill columns left out of new images: from the old image, else from ``base`` by key, else NULL.

    ``changes`` has structs ``old`` and ``new`` and the array ``unchanged_cols``.
    """
    c = changes
    if base is not None:
        b = base.select(F.col(key).alias("__key"), F.struct(*[F.col(x) for x in columns]).alias("__base"))
        c = c.join(b, F.col(f"new.{key}") == F.col("__key"), "left")
    fallback = (lambda x: F.col(f"__base.{x}")) if base is not None else (lambda x: F.lit(None))
    kept = lambda x: F.coalesce(F.array_contains("unchanged_cols", x), F.lit(False))
    new = F.col("new")
    for x in columns:
        new = new.withField(x, F.when(kept(x), F.coalesce(F.col(f"old.{x}"), fallback(x))).otherwise(F.col(f"new.{x}")))
    return c.withColumn("new", new).select(*changes.columns)


def upsert(stream: DataFrame, key: list[str], value: str, time: str) -> DataFrame:
    """The current (key, value) of a stream of optional values; NULL removes, ties take the greatest value."""
    order = F.struct(F.col(time), F.col(value).isNotNull(), F.col(value))
    return stream.groupBy(*key).agg(F.max_by(value, order).alias(value)).filter(F.col(value).isNotNull())


def replay(captured: DataFrame, identity: list[str]) -> DataFrame:
    """A captured diff stream without the repeats and whatever the order it was read in."""
    return captured.dropDuplicates(identity)


def upquery(base: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``base`` with the wanted keys (a semi join; Spark broadcasts few keys by size)."""
    return base.join(wanted.select(F.col(wanted.columns[0]).alias(key)).distinct(), key, "left_semi")


def pair(delta: DataFrame, keys: list[str]) -> DataFrame:
    """(lsn, op, old, new) of a signed change: a removal and an addition of one key at one LSN are an
    update, what is left over is a delete or an insert.  Keys are compared as typed values.
    """
    cols = data_columns(delta)
    rows = consolidate(delta).withColumn("__n", F.abs(DIFF)).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
    image = F.struct(*[F.col(f"`{c}`") for c in cols])
    w = Window.partitionBy(LSN, *keys, F.signum(DIFF)).orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in cols if _orderable(delta, c)], "__i")
    r = rows.select(LSN, F.struct(*keys).alias("__key"), F.col(DIFF), image.alias("__row"), F.row_number().over(w).alias("__rn"))
    return (
        r.groupBy(LSN, "__key", "__rn")
        .agg(F.max(F.when(F.col(DIFF) < 0, F.col("__row"))).alias("old"), F.max(F.when(F.col(DIFF) > 0, F.col("__row"))).alias("new"))
        .select(
            F.col(LSN).alias("lsn"),
            F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update").alias("op"), "old", "new",
        )
    )


def _orderable(df: DataFrame, c: str) -> bool:
    return not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))


def apply_diffs(view: DataFrame, diffs: DataFrame, keys: list[str]) -> DataFrame:
    """A client's rows: the snapshot with all diff events folded in, by key.

    Of the events of a key at one LSN, an insert or update counts after a delete.
    """
    cols = view.columns
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    start = view.select(F.struct(*keys).alias("k"), F.lit(-1).cast("bigint").alias("lsn"), F.lit(1).alias("alive"), row.alias("row"))
    gone = diffs.filter("old IS NOT NULL").select(F.struct(*[F.col(f"old.`{k}`") for k in keys]).alias("k"), "lsn", F.lit(0).alias("alive"), F.col("old").alias("row"))
    here = diffs.filter("new IS NOT NULL").select(F.struct(*[F.col(f"new.`{k}`") for k in keys]).alias("k"), "lsn", F.lit(1).alias("alive"), F.col("new").alias("row"))
    last = start.union(gone).union(here).groupBy("k").agg(F.max_by(F.struct("alive", "row"), F.struct("lsn", "alive")).alias("e"))
    return last.filter("e.alive = 1").select("e.row.*")


def capture(diffs: DataFrame, path: str) -> None:
    """Append a diff stream's rows to a folder, from which ``replay`` gives each diff once."""
    diffs.write.mode("append").option("compression", "zstd").parquet(path)


class InputSession:
    """Updates made by hand, for tests and small feeds: buffered at a time, given out by ``flush``."""

    def __init__(self, spark: SparkSession, schema: T.StructType | str) -> None:
        self.spark = spark
        self.schema = spark.createDataFrame([], schema).schema
        self.time, self._buffer = 0, []

    def update_at(self, row: tuple, time: int, diff: int) -> None:
        if time < self.time:
            raise ValueError(f"time {time} is past")
        self._buffer.append((*row, diff, time))

    def update(self, row: tuple, diff: int) -> None:
        self.update_at(row, self.time, diff)

    def insert(self, row: tuple) -> None:
        self.update(row, 1)

    def remove(self, row: tuple) -> None:
        self.update(row, -1)

    def advance_to(self, time: int) -> None:
        if time < self.time:
            raise ValueError(f"time {time} is past")
        self.time = time

    def flush(self) -> DataFrame:
        """The updates at times before the present one, consolidated; later ones stay buffered."""
        ready = [r for r in self._buffer if r[-1] < self.time]
        self._buffer = [r for r in self._buffer if r[-1] >= self.time]
        schema = T.StructType([*self.schema.fields, T.StructField(DIFF, T.LongType()), T.StructField(LSN, T.LongType())])
        return consolidate(self.spark.createDataFrame(ready, schema))
