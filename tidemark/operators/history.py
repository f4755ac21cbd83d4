"""History of changing rows: every version with the period in which it was valid.

Raw changes are kept per row; a late or corrected change, or a late commit, makes the operator fetch
all raw changes of the touched rows only (from the buckets those lie in), carry told values over
them, rebuild all their intervals and swap those chains in at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import canon
from tidemark.operators.dedupe import arrivals
from tidemark.operators.skew import split_hot
from tidemark.session import materialize, scratch
from tidemark.sources import changelog
from tidemark.sources.store import Store

KEYS = ["table_name", "row_key"]
#: The digest of a row of which only the key is known.
UNKNOWN = -1


def _neighbours(df: DataFrame, order: str, before: dict[str, str], after: dict[str, str], blocked: bool) -> DataFrame:
    """Adds the previous row's ``before`` and the next row's ``after`` columns (new name → column).

    With ``blocked``, each range of a hot key is a window of its own; the values at its ends come
    from a table with one row per range.
    """
    keys = KEYS + (["__blk"] if blocked else [])
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumns({n: F.lag(c).over(w) for n, c in before.items()} | {n: F.lead(c).over(w) for n, c in after.items()})
    if not blocked:
        return out
    ends = df.groupBy(*keys).agg(
        *[F.max_by(c, order).alias(f"__last_{c}") for c in dict.fromkeys(before.values())],
        *[F.min_by(c, order).alias(f"__first_{c}") for c in dict.fromkeys(after.values())],
    )
    wb = Window.partitionBy(*KEYS).orderBy("__blk")
    ends = ends.select(
        *keys,
        *[F.lag(f"__last_{c}").over(wb).alias(f"__in_{n}") for n, c in before.items()],
        *[F.lead(f"__first_{c}").over(wb).alias(f"__in_{n}") for n, c in after.items()],
    )
    names = [*before, *after]
    return (
        out.join(ends, keys, "left")
        .withColumns({n: F.coalesce(n, f"__in_{n}") for n in names})
        .drop(*[f"__in_{n}" for n in names])
    )


def _chains(changes: DataFrame, blocked: bool = False) -> DataFrame:
    """Versions from one row per key and LSN (state at the end of that transaction)."""
    c = _neighbours(changes, "lsn", {"__prev": "state"}, {}, blocked)
    older = F.when(F.col("__prev").isNull() & F.col("first_old").isNotNull(), F.struct(F.lit(0).cast("bigint").alias("lsn"), F.col("first_old").alias("state")))
    before = F.coalesce("__prev", "first_old", F.lit(0))
    moved = F.when(F.col("state") != before, F.struct("lsn", "state"))
    keep = KEYS + (["__blk"] if blocked else [])
    points = c.select(*keep, F.explode(F.array_compact(F.array(older, moved))).alias("p")).select(*keep, "p.lsn", "p.state")
    v = _neighbours(points, "lsn", {}, {"__next": "lsn"}, blocked)
    return v.filter(F.col("state") != 0).select(
        *KEYS, F.col("lsn").alias("valid_from"), F.coalesce("__next", F.lit(-1).cast("bigint")).alias("valid_to"), "state"
    )


def build_chains(changes: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """All versions of all rows in ``changes`` (one row per key and LSN).

    A version is a longest run of equal states; deletes end it, a later insert begins another.  An
    empty input gives no rows.  Keys with more than ``hot_rows`` changes are built in ranges.
    """
    cold, hot = split_hot(changes, KEYS, "lsn", hot_rows)
    out = _chains(cold)
    return out if hot is None else out.unionByName(_chains(hot, blocked=True))


class HistoryStore:
    """Raw changes, commits and version chains of rows.

    An event (``KEYS``, lsn, seq, old_state) holds a ready ``state``, or ``alive`` and the digests
    ``v_<column>`` of ``columns`` it tells: those are stored as they came, and each rebuild carries
    told values over all batches.  Changes without a commit so far wait in parts of their own.

    Log parts lie in folders by bucket of the row, several files where one row has very many
    changes.  Chains are never rewritten by a batch: a batch adds the new chains of the rows it
    touches, and the latest chain of a row counts.  ``fan`` parts are folded into one, with more
    buckets where they have outgrown ``bucket_bytes``.
    """

    def __init__(
        self, spark: SparkSession, root: str, buckets: int | None = None, hot_rows: int = 1_000_000,
        columns: tuple[str, ...] = canon.ISSUE_COLUMNS, fan: int = 8, bucket_bytes: int = 256 << 20,
    ) -> None:
        self.store, self.hot_rows, self.columns, self.fan, self.bucket_bytes = Store(spark, root), hot_rows, columns, fan, bucket_bytes
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # --- parts ---------------------------------------------------------------------------------

    def _parts(self, m: dict, kind: str) -> list[str]:
        return [p["path"] for _, p in sorted(m["parts"].items()) if p["kind"] == kind]

    def _event_schema(self) -> str:
        cols = "".join(f", v_{c} bigint" for c in self.columns)
        return f"table_name string, row_key string, lsn bigint, seq int, old_state bigint, alive boolean, state bigint{cols}, batch bigint"

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        spark = self.store.spark
        if not paths:
            return spark.createDataFrame([], schema)
        names = [c.split()[0] for c in schema.split(", ")]
        return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(p).select(*names) for p in paths])

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, name: str, by: tuple[str, ...], order: list[str], buckets: int) -> str:
        """Rows of a bucket meet in few tasks, of a very large one in several (AQE splits it)."""
        df = df.withColumn("bucket", self._bucket(buckets)).hint("rebalance", "bucket")
        return self.store.write_part(df.sortWithinPartitions(*by, *order), name, by)

    # --- batches -------------------------------------------------------------------------------

    def log(self, m: dict | None = None, touched: DataFrame | None = None) -> DataFrame:
        """The committed events of the touched rows (of all for None), one for each key, LSN and
        seq: of several batches the latest counts."""
        m = m or self.store.manifest()
        schema = self._event_schema() + ", bucket int"
        paths = self._parts(m, "log")
        raw = self._read(paths, schema)
        if touched is not None:
            hit = [r[0] for r in touched.select(self._bucket(m["buckets"])).distinct().collect()]  # at most as many as buckets
            raw = raw.filter(F.col("bucket").isin(hit)) if len(hit) < m["buckets"] else raw
            raw = raw.join(touched, KEYS, "left_semi")
        if len(paths) > 1:
            rest = [c for c in raw.columns if c not in (*KEYS, "lsn", "seq", "bucket")]
            raw = raw.groupBy(*KEYS, "lsn", "seq").agg(F.max_by(F.struct(*rest), "batch").alias("e")).select(*KEYS, "lsn", "seq", "e.*")
        return raw.drop("bucket")

    def changes(self, raw: DataFrame) -> DataFrame:
        """One row per key and LSN, untold values carried over; ``raw`` should be cheap to read again."""
        ready = raw.filter("alive IS NULL").select(*KEYS, "lsn", "seq", "state", "old_state")
        told = filled(raw.filter("alive IS NOT NULL").drop("state", "batch"), self.hot_rows)
        return ready.unionByName(told).groupBy(*KEYS, "lsn").agg(
            F.max_by("state", "seq").alias("state"), F.min_by("old_state", "seq").alias("first_old")
        )

    def rebuild(self, m: dict | None = None, touched: DataFrame | None = None) -> DataFrame:
        """Chains of the touched rows from all their raw changes (of every row for None)."""
        raw = self.log(m, touched)
        if touched is not None:
            raw = materialize(raw, "touched")
        return build_chains(materialize(self.changes(raw), "changes"), self.hot_rows)

    def refresh(self, batch_id: str, events: DataFrame, commits: DataFrame | None = None) -> None:
        """Store a batch, rebuild the chains of the rows it touches and swap them in.

        ``commits`` (lsn) are the transactions known to be committed from now on: events of others
        wait for theirs, and a commit touches the rows of the events that waited for it.  Without
        ``commits`` every event counts.  Everything is written beside the live parts; one manifest
        replacement shows all of it, so a failure at any point changes nothing and the batch may be
        run again.  A batch that was committed isn't taken again.
        """
        m = self.store.manifest()
        if batch_id in m.get("done", []):
            return
        at, spark = m["version"], self.store.spark
        m = {"buckets": self.buckets} | m | {"done": [*m.get("done", []), batch_id]}
        parts = {n: p for n, p in m["parts"].items() if p["kind"] != "waiting"}
        want = {"alive": "boolean", "state": "bigint", "old_state": "bigint"} | {f"v_{c}": "bigint" for c in self.columns}
        events = events.withColumns({c: F.lit(None).cast(t) for c, t in want.items() if c not in events.columns})
        events = events.withColumn("batch", F.lit(at).cast("bigint")).select(*[c.split()[0] for c in self._event_schema().split(", ")])
        if commits is None:
            events = events.withColumn("waits", F.lit(False))
        else:
            path = self.store.write_part(commits.toDF("lsn").dropna().distinct(), f"commits-{batch_id}")
            parts[f"commit-{at:06d}"] = {"kind": "commit", "path": path}
            events = events.unionByName(self._read(self._parts(m, "waiting"), self._event_schema()))
            known = self._read(self._parts({"parts": parts}, "commit"), "lsn bigint").distinct().withColumn("__known", F.lit(True))
            events = events.join(known, "lsn", "left").withColumn("waits", F.col("__known").isNull()).drop("__known")
        path = self._write(events, f"log-{batch_id}", ("waits", "bucket"), [*KEYS, "lsn", "seq"], m["buckets"])
        for kind, waits in (("log", "false"), ("waiting", "true")):
            if self.store.exists(f"{path}/waits={waits}"):
                parts[f"{kind}-{at:06d}"] = {"kind": kind, "path": f"{path}/waits={waits}"}
        m = m | {"parts": parts}
        if f"log-{at:06d}" in parts:
            mine = self._read([parts[f"log-{at:06d}"]["path"]], self._event_schema())
            touched = materialize(mine.select(*KEYS).distinct(), "touched-rows")
            chains = self.rebuild(m, touched).unionByName(touched, allowMissingColumns=True).withColumn("batch", F.lit(at).cast("bigint"))
            path = self._write(chains, f"chains-{batch_id}", ("bucket",), [*KEYS, "valid_from"], m["buckets"])
            parts[f"chain-{at:06d}"] = {"kind": "chain", "path": path}
        self.store.commit(m)
        if max(len(self._parts(m, k)) for k in ("log", "chain", "commit")) > self.fan:
            self.compact()

    def _chains(self, m: dict) -> DataFrame:
        """The latest chain of each row, with the mark (a row without ``valid_from``) that it was touched."""
        schema = "table_name string, row_key string, valid_from bigint, valid_to bigint, state bigint, batch bigint"
        paths = self._parts(m, "chain")
        chains = self._read(paths, schema)
        if len(paths) < 2:
            return chains
        latest = chains.filter("valid_from IS NULL").groupBy(*KEYS).agg(F.max("batch").alias("batch"))
        return chains.join(latest, [*KEYS, "batch"], "left_semi").select(*chains.columns)

    def read(self) -> DataFrame:
        """All chains; no rows before the first refresh that built some."""
        return self._chains(self.store.manifest()).filter("valid_from IS NOT NULL").drop("batch")

    def compact(self) -> None:
        """Fold all parts of a kind into one."""
        m = self.store.manifest()
        buckets, old = m["buckets"], m["parts"]
        while sum(self.store.size(p) for p in self._parts(m, "log")) > buckets * self.bucket_bytes:
            buckets *= 2
        parts = {n: p for n, p in old.items() if p["kind"] == "waiting"}
        tag = f"{m['version']:06d}"
        log = self.log(m).select(*[c.split()[0] for c in self._event_schema().split(", ")])
        parts[f"log-{tag}"] = {"kind": "log", "path": self._write(log, "log-compacted", ("bucket",), [*KEYS, "lsn", "seq"], buckets)}
        path = self._write(self._chains(m), "chains-compacted", ("bucket",), [*KEYS, "valid_from"], buckets)
        parts[f"chain-{tag}"] = {"kind": "chain", "path": path}
        if commits := self._parts(m, "commit"):
            path = self.store.write_part(self._read(commits, "lsn bigint").distinct(), "commits-compacted")
            parts[f"commit-{tag}"] = {"kind": "commit", "path": path}
        self.store.commit(m | {"buckets": buckets, "parts": parts})
        for n in old.keys() - parts.keys():
            self.store.delete(old[n]["path"])


def issue_events(row_changes: DataFrame, columns: tuple[str, ...] = canon.ISSUE_COLUMNS) -> DataFrame:
    """Events of typed changes, with a digest ``v_<column>`` of each column where the change tells it.

    A column in ``unchanged_cols`` is told by a full old image only, else it stays null here and
    ``filled`` takes it from the row's earlier changes.  ``old_state`` is the digest of the old
    image, ``UNKNOWN`` if that holds only the key, null without one.
    """
    kind = changelog.change_kind(F.col("op"), F.col("old_row"), F.col("new_row"))
    key = lambda c: canon.row_key(F.col(c), F.lit("int8"))
    text = lambda v, c: F.xxhash64(F.coalesce(F.to_json(F.try_variant_get(F.col(v), f"$.{c}", "variant")), F.lit("null")))
    kept = lambda c: F.coalesce(F.array_contains("unchanged_cols", c), F.lit(False))
    c = row_changes.select(
        F.col("commit_lsn").alias("lsn"), "seq", "unchanged_cols", kind.alias("kind"),
        key("old_row").alias("old_key"), key("new_row").alias("new_key"),
        F.coalesce(F.size(F.json_object_keys("old_row")) > 1, F.lit(False)).alias("full"),
        F.try_parse_json(canon.plain_numbers(F.col("old_row"))).alias("ov"),
        F.try_parse_json(canon.plain_numbers(F.col("new_row"))).alias("nv"),
    ).select(
        "lsn", "seq", "kind", "old_key", "new_key", "full",
        *[text("ov", x).alias(f"o_{x}") for x in columns],
        *[F.when(~kept(x), text("nv", x)).alias(f"n_{x}") for x in columns],
    )
    cols = lambda v: [v(x).alias(f"v_{x}") for x in columns]
    none = lambda x: F.lit(None).cast("bigint")
    new_cols = cols(lambda x: F.coalesce(F.col(f"n_{x}"), F.when(F.col("full"), F.col(f"o_{x}"))))
    old_hash = F.when(F.col("full"), _state([F.col(f"o_{x}") for x in columns])).when(
        F.col("old_key").isNotNull(), F.lit(UNKNOWN).cast("bigint")
    )
    deleted = F.col("kind") == "D"
    moved = F.coalesce(F.col("old_key") != F.col("new_key"), F.lit(False))
    gone_key = F.when(deleted, F.coalesce("old_key", "new_key")).when(moved, F.col("old_key"))
    gone = F.when(
        gone_key.isNotNull(),
        F.struct(gone_key.alias("row_key"), F.lit(False).alias("alive"), old_hash.alias("old_state"), *cols(none)),
    )
    here = F.when(
        ~deleted & F.col("new_key").isNotNull(),
        F.struct(F.col("new_key").alias("row_key"), F.lit(True).alias("alive"), F.when(~moved, old_hash).alias("old_state"), *new_cols),
    )
    e = c.select("lsn", "seq", F.explode(F.array_compact(F.array(gone, here))).alias("e"))
    return e.select(F.lit(changelog.ISSUES).alias("table_name"), "lsn", "seq", "e.*").dropna(subset=["row_key", "lsn", "seq"])


def _state(columns: list[Column]) -> Column:
    h = F.xxhash64(*columns)
    return F.when(h.isin(0, UNKNOWN), F.lit(1).cast("bigint")).otherwise(h)


def filled(events: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """States of ``issue_events``: an untold column has the row's last told value.

    ``events`` should be cheap to read again.  Hot rows are filled in ranges, each of which starts
    with the values that the ranges before it end with.
    """
    columns = [c for c in events.columns if c.startswith("v_")]
    cold, hot = split_hot(events, KEYS, "lsn", hot_rows)
    upto = lambda keys: Window.partitionBy(*keys).orderBy("lsn", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = cold.withColumns({c: F.last(c, ignorenulls=True).over(upto(KEYS)) for c in columns})
    if hot is not None:
        keys = [*KEYS, "__blk"]
        ends = hot.groupBy(*keys).agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("lsn", "seq"))).alias(c) for c in columns]
        )
        earlier = Window.partitionBy(*KEYS).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
        starts = ends.select(*keys, *[F.last(c, ignorenulls=True).over(earlier).alias(f"in_{c}") for c in columns])
        hot = hot.withColumns({c: F.last(c, ignorenulls=True).over(upto(keys)) for c in columns}).join(starts, keys, "left")
        out = out.unionByName(hot.withColumns({c: F.coalesce(c, f"in_{c}") for c in columns}).select(*out.columns))
    state = F.when(F.col("alive"), _state([F.col(c) for c in columns])).otherwise(F.lit(0).cast("bigint"))
    return out.select(*KEYS, "lsn", "seq", state.alias("state"), "old_state")


def history_events(wal_updates: DataFrame, row_changes: DataFrame, relations: DataFrame) -> DataFrame:
    """Events of all tables that keep history, committed or not: signed ones with the state they
    leave, typed ones with the values they tell (``HistoryStore`` carries those over)."""
    signed = changelog.wal_events(wal_updates, relations, hashed=True, keep_history=True)
    signed = signed.select(*KEYS, "lsn", "seq", "state", F.lit(None).cast("bigint").alias("old_state"))
    return signed.unionByName(issue_events(row_changes), allowMissingColumns=True)


def full_history(
    wal_updates: DataFrame, row_changes: DataFrame, wal_transactions: DataFrame, relations: DataFrame, hot_rows: int = 1_000_000, batches: int = 2
) -> DataFrame:
    """(table_name, row_key, valid_from, valid_to, state) from a store that took the log batch by
    batch, as it arrived: in the first every row is touched, the others rebuild what they touch."""
    store = HistoryStore(wal_updates.sparkSession, scratch(wal_updates.sparkSession, "history"), hot_rows=hot_rows)
    wal, rc = arrivals(wal_updates, "batch_id", batches), arrivals(row_changes, "batch_id", batches)
    commits = wal_transactions.select("commit_lsn")
    for i in range(batches):
        part = lambda x, df: x[i] if i < len(x) else df.limit(0)  # noqa: B023, E731
        events = history_events(part(wal, wal_updates), part(rc, row_changes), relations)
        store.refresh(f"b{i}", events, commits if i == 0 else commits.limit(0))
    return store.read()
