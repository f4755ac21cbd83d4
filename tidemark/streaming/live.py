"""Live views: a change log read by Structured Streaming, kept results, ordered diffs, subscriptions.

Base tables are signed parts (a seed and one part per batch), so a batch appends and never rewrites;
``compact`` folds the parts.  All transactions of a batch go through one plan that carries their
LSNs (``Node.moves``), and of sums the view keeps the accumulators, so a batch costs the same
number of jobs and parts however many transactions it holds.  A batch is shown by one manifest
replacement, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections import Counter, deque
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.session import materialize
from tidemark.sources.store import Store
from tidemark.streaming import deltas as S
from tidemark.streaming.ivm import Node, Summed

#: A typed change: op is I, U, D, T (truncate) or COMMIT (no row: its LSN is complete); images are JSON text.
CHANGE = "table STRING, xid BIGINT, lsn BIGINT, seq BIGINT, op STRING, old STRING, new STRING, unchanged_cols ARRAY<STRING>"


class Reason(str, Enum):
    LSN_COMPACTED = "LsnCompacted"
    SCHEMA_CHANGED = "SchemaChanged"
    BACKPRESSURE = "Backpressure"
    SLOT_RECREATED = "SlotRecreated"
    PERMISSIONS_CHANGED = "PermissionsChanged"


class SchemaDriftError(ValueError):
    """A table no longer has the columns it was registered with."""


class LateChangeError(ValueError):
    """A change at or below the view's position that the view has never had."""


class DrainingQuery(StreamingQuery):
    """A query over all that a folder holds now: once it ends, so does the transaction held back."""

    def __init__(self, query: StreamingQuery, view: LiveView) -> None:
        super().__init__(query._jsq)
        self._view = view

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        ended = super().awaitTermination(timeout)
        if ended is not False:
            self._view.settle()
        return ended


class LiveView:
    """One view over some tables, with its result, its diffs and its position in the log.

    ``keys`` identify a row of the view, ``table_keys`` one of each table: changes whose images
    leave something out need those.
    """

    def __init__(
        self, spark: SparkSession, root: str, node: Node, schemas: dict[str, T.StructType], keys: list[str] | None = None,
        table_keys: dict[str, list[str]] | None = None, max_parts: int = 64,
    ) -> None:
        self.spark, self.node, self.schemas, self.keys, self.table_keys = spark, node, schemas, keys, table_keys or {}
        self.store, self.max_parts = Store(spark, root), max_parts

    # --- state ---------------------------------------------------------------------------------

    @property
    def lsn(self) -> int:
        return self.store.manifest().get("lsn", -1)

    @property
    def earliest(self) -> int:
        """Diffs above this position are still there."""
        return self.store.manifest().get("earliest", -1)

    def _parts(self, prefix: str) -> list[str]:
        return [p for n, p in sorted(self.store.manifest()["parts"].items()) if n.startswith(prefix)]

    def table(self, name: str) -> DataFrame:
        return self._base(name, self.store.manifest()["parts"])

    def _base(self, name: str, parts: dict[str, str]) -> DataFrame:
        """A table as a signed multiset; LSNs of its changes aren't read."""
        schema = T.StructType([*self.schemas[name].fields, T.StructField(S.DIFF, T.LongType())])
        return self.spark.read.schema(schema).parquet(*[p for n, p in sorted(parts.items()) if n.startswith(f"base-{name}-")])

    def _held(self, parts: dict[str, str]) -> DataFrame | None:
        """The accumulators of a view of sums, in parts that add up."""
        paths = [p for n, p in sorted(parts.items()) if n.startswith("sums-")]
        return self.spark.read.parquet(*paths) if paths else None

    def result(self) -> DataFrame:
        """The rows of the view at ``lsn``."""
        return S.expand(self._net())

    def _net(self) -> DataFrame:
        """The view as a signed multiset: its seed and all diffs since (whose LSN isn't read)."""
        schema = T.StructType.fromJson(self.store.manifest()["schema"])
        return S.consolidate(self.spark.read.schema(schema).parquet(*self._parts("view-")))

    def diffs(self, after: int = -1) -> DataFrame | None:
        """(_lsn, row columns, _diff) of all transactions after a position; None if there were none."""
        parts = self._parts("diff-")
        return self.spark.read.parquet(*parts).filter(F.col(S.LSN) > max(after, self.earliest)) if parts else None

    def events(self, after: int = -1) -> DataFrame | None:
        """(lsn, op, old, new): diffs paired by the view's key (by the whole row without one)."""
        d = self.diffs(after)
        return None if d is None else S.pair(d, self.keys or S.data_columns(d))

    # --- changes -------------------------------------------------------------------------------

    def seed(self, tables: dict[str, DataFrame], lsn: int = 0) -> None:
        """Start from a snapshot of all tables at one position."""
        base = {n: self._checked(n, t) for n, t in tables.items()}
        parts = {f"base-{n}-seed": self.store.write_part(S.consolidate(S.seed(t)), f"base-{n}-seed") for n, t in base.items()}
        loaded = {n: self.spark.read.parquet(parts[f"base-{n}-seed"]) for n in base}
        view = S.consolidate(self.node.full(loaded))
        parts["view-seed"] = self.store.write_part(view, "view-seed")
        if isinstance(self.node, Summed):
            parts["sums-seed"] = self.store.write_part(self.node.accumulated(loaded), "sums-seed")
        m = self.store.manifest()
        self.store.commit(m | {"parts": parts, "lsn": lsn, "earliest": lsn, "seeded": lsn, "batches": [], "streams": {}, "schema": view.schema.jsonValue()})

    def _checked(self, name: str, df: DataFrame) -> DataFrame:
        want = [(f.name, f.dataType) for f in self.schemas[name]]
        if [(f.name, f.dataType) for f in df.schema] != want:
            raise SchemaDriftError(f"{name}: {df.schema.simpleString()}")
        return df

    def _signed(self, changes: DataFrame, name: str, old: DataFrame, untold: bool) -> DataFrame:
        """Signed rows with LSNs of a table's changes without TRUNCATE."""
        mine = changes.filter(F.col("table") == name)
        return S.from_changes(mine, self.schemas[name], old, self.table_keys[name]) if untold else S.from_changes(mine, self.schemas[name])

    def _emptied(self, changes: DataFrame, name: str, lsn: int, old: DataFrame) -> DataFrame:
        """The same for one LSN with a TRUNCATE: what comes after it begins with an empty table."""
        mine = changes.filter(F.col("table") == name)
        last = mine.filter(S.kind() == "T").agg(F.max("seq")).first()[0]
        after = mine if last is None else mine.filter(F.col("seq") > last)
        base, key = old if last is None else old.limit(0), self.table_keys.get(name)
        d = S.from_changes(after, self.schemas[name], base, key) if key else S.from_changes(after, self.schemas[name])
        return d if last is None else S.concat(S.truncation(old, lsn), d)

    def _unseen(self, changes: DataFrame, m: dict) -> DataFrame:
        """Changes the view hasn't had, told by (lsn, seq); those in the seed are had as well."""
        new = changes.filter(F.col("lsn") > m["lsn"])
        again = changes.filter((F.col("lsn") <= m["lsn"]) & (F.col("lsn") > m.get("seeded", m["lsn"])))
        if again.take(1):
            seen = [p for n, p in sorted(m["parts"].items()) if n.startswith("seen-")]
            late = again.join(self.spark.read.schema("lsn bigint, seq bigint").parquet(*seen), ["lsn", "seq"], "left_anti") if seen else again
            if row := late.first():
                raise LateChangeError(f"change ({row.lsn}, {row.seq}) of {row.table} came after the view reached {m['lsn']}")
        return new

    def apply(self, changes: DataFrame, batch_id: str | int, more: bool = False, stream: str | None = None) -> int:
        """Apply committed changes the view hasn't had; returns the number of their transactions.

        A transaction is all changes of one LSN and gives one diff.  Repeated changes (same LSN and
        seq) count once; other changes at or below ``lsn`` are an error.  With ``more``, changes of
        the last LSN may still come: it is held back until a higher LSN, its COMMIT or ``settle``.
        Batches of a ``stream`` are numbered upwards, others have ids of their own.
        """
        m = self.store.manifest()
        if batch_id in m["batches"] or (stream is not None and batch_id <= m["streams"].get(stream, -1)):
            return 0
        commit = F.coalesce(F.upper(F.trim("op")) == "COMMIT", F.lit(False))
        held = [p for n, p in m["parts"].items() if n.startswith("held-")]
        changes = changes.unionByName(self.spark.read.schema(CHANGE).parquet(*held)) if held else changes
        mine = changes.filter(F.col("table").isin(*self.node.sources()) & ~commit).dropDuplicates(["lsn", "seq"])
        tag = f"{m['version']:08d}"
        parts = {n: p for n, p in m["parts"].items() if not n.startswith("held-")}
        seen = self.store.write_part(self._unseen(mine, m), f"seen-{tag}")
        new = self.spark.read.schema(CHANGE).parquet(seen)
        names = sorted(self.node.sources())
        emptied = F.sort_array(F.collect_set(F.when(S.kind() == "T", F.col("lsn"))))  # TRUNCATEs are few
        lost = [F.max((F.col("table") == x) & S.is_untold(self.schemas[x])) if x in self.table_keys else F.lit(False) for x in names]
        facts = [F.count_distinct("lsn"), F.max("lsn"), emptied, F.array(*[F.coalesce(c, F.lit(False)) for c in lost])]
        n, top, cut, untold = new.agg(*facts).first()
        if more and n:
            last = changes.agg(F.max("lsn"), F.max(F.when(commit, F.col("lsn")))).first()
            if top == last[0] != last[1]:
                parts[f"held-{tag}"] = self.store.write_part(new.filter(F.col("lsn") == top), f"held-{tag}")
                new = new.filter(F.col("lsn") < top)
                n, top, cut, untold = new.agg(*facts).first()
        if n:
            parts[f"seen-{tag}"] = seen
            spans, at = [], m["lsn"]
            for lsn in cut:
                spans += [(at + 1, lsn - 1, False), (lsn, lsn, True)]
                at = lsn
            for i, (lo, hi, truncates) in enumerate([*spans, (at + 1, top, False)] if at < top else spans):
                if lo <= hi:
                    part = new.filter((F.col("lsn") >= lo) & (F.col("lsn") <= hi)) if spans else new
                    self._advance(part, hi, truncates, untold, parts, f"{tag}-{i}")
        done = {"streams": m["streams"] | {stream: batch_id}} if stream is not None else {"batches": [*m["batches"], batch_id]}
        self.store.commit(m | {"parts": parts, "lsn": max(m["lsn"], top or -1)} | done)
        if not n:
            self.store.delete(seen)
        for p in held:
            self.store.delete(p)
        if sum(x.startswith(("base-", "view-")) for x in parts) > self.max_parts:
            self.compact(m["earliest"])
        return n

    def _advance(self, changes: DataFrame, hi: int, truncates: bool, untold: list[bool], parts: dict[str, str], tag: str) -> None:
        """Write what the changes up to ``hi`` do to tables, sums and view; name it in ``parts``."""
        names = sorted(self.node.sources())
        old, change = {n: self._base(n, parts) for n in names}, {}
        for i, n in enumerate(names):
            signed = self._emptied(changes, n, hi, old[n]) if truncates else self._signed(changes, n, old[n], untold[i])
            name = f"base-{n}-{tag}"
            parts[name] = self.store.write_part(S.consolidate(signed), name)
            change[n] = self.spark.read.schema(T.StructType([*self.schemas[n].fields, T.StructField(S.LSN, T.LongType()), T.StructField(S.DIFF, T.LongType())])).parquet(parts[name])
        if isinstance(self.node, Summed) and self.node.timed():
            held = self._held(parts)
            parts[f"sums-{tag}"] = self.store.write_part(self.node.accumulated({n: c.drop(S.LSN) for n, c in change.items()}), f"sums-{tag}")
            moves = self.node.moves(old, change, held)  # net as it is
        elif self.node.timed():
            moves = S.consolidate(self.node.moves(old, change))
        else:
            moves = self._one_by_one(old, change)
        # one part serves as diff and, without its LSNs, as a change of the kept result
        parts[f"diff-{hi:020d}-{tag}"] = parts[f"view-{tag}"] = self.store.write_part(moves, f"diff-{tag}")

    def _one_by_one(self, old: dict[str, DataFrame], change: dict[str, DataFrame], at_once: int = 8) -> DataFrame:
        """The same for views that are evaluated as a whole (a global top-k, a fixpoint): a plan a transaction."""
        lsns = sorted({r[0] for c in change.values() for r in c.select(S.LSN).distinct().collect()})
        done: list[DataFrame] = []
        for i in range(0, len(lsns), at_once):
            some = []
            for lsn in lsns[i : i + at_once]:
                before = {n: S.concat(old[n], c.filter(F.col(S.LSN) < lsn).drop(S.LSN)) for n, c in change.items()}
                now = {n: c.filter(F.col(S.LSN) == lsn).drop(S.LSN) for n, c in change.items()}
                some.append(self.node.delta(before, now).withColumn(S.LSN, F.lit(lsn).cast("bigint")))
            done.append(materialize(S.concat(*some), "moves"))
        return S.concat(*done)

    def run(self, log_dir: str, checkpoint: str, available_now: bool = True, files_per_batch: int = 16) -> StreamingQuery:
        """Stream a folder of change files (Parquet, schema ``CHANGE``) into the view.

        Files are taken in the order of their modification times, which must not step back in LSNs;
        a transaction may lie in files of several batches.  With ``available_now`` the folder's last
        transaction is complete; else it is shown after the next one or its COMMIT.
        """
        stream = self.spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).parquet(log_dir)
        writer = stream.writeStream.foreachBatch(lambda df, i: self.apply(df, i, True, checkpoint) and None).option("checkpointLocation", checkpoint)
        return DrainingQuery(writer.trigger(availableNow=True).start(), self) if available_now else writer.start()

    def settle(self) -> int:
        """Apply the transaction that is held back, as complete."""
        m = self.store.manifest()
        if not any(n.startswith("held-") for n in m["parts"]):
            return 0
        return self.apply(self.spark.createDataFrame([], CHANGE), f"settled-{m['version']}")

    def compact(self, keep_after: int) -> None:
        """Fold base and view parts into one each and drop diffs up to ``keep_after``."""
        m = self.store.manifest()
        parts = {n: p for n, p in m["parts"].items() if n.startswith("diff-") and int(n.split("-")[1]) > keep_after}
        parts |= {n: p for n, p in m["parts"].items() if n.startswith("held-")}
        tag = f"c{m['version']}"
        if seen := self._parts("seen-"):
            parts[f"seen-{tag}"] = self.store.write_part(self.spark.read.schema("lsn bigint, seq bigint").parquet(*seen).sort("lsn", "seq"), f"seen-{tag}")
        if (held := self._held(m["parts"])) is not None:
            parts[f"sums-{tag}"] = self.store.write_part(self.node._add(held), f"sums-{tag}")
        for n in self.node.sources():
            parts[f"base-{n}-{tag}"] = self.store.write_part(S.consolidate(self.table(n)), f"base-{n}-{tag}")
        parts[f"view-{tag}"] = self.store.write_part(self._net(), f"view-{tag}")
        self.store.commit(m | {"parts": parts, "earliest": max(m["earliest"], min(keep_after, m["lsn"]))})
        for p in set(m["parts"].values()) - set(parts.values()):
            self.store.delete(p)


@dataclass
class Message:
    """What a subscriber gets: ``initial`` rows, ``diff`` events (insert, update, delete), a ``resync``
    with fresh rows, or an ``error`` after which nothing more comes."""

    kind: str
    lsn: int
    rows: DataFrame | None = None
    reason: Reason | None = None
    error: str | None = None


@dataclass
class Subscription:
    id: str
    view: LiveView
    last_sent: int = -1
    last_acked: int = -1
    pending: int = 0


@dataclass
class Hub:
    """Subscriptions over live views: snapshot, diffs, acknowledgement, resume and backpressure."""

    bound: int = 256
    coalesce: bool = False
    subscriptions: dict[str, Subscription] = field(default_factory=dict)
    metrics: Counter = field(default_factory=Counter)

    def subscribe(self, sub_id: str, view: LiveView, resume_lsn: int | None = None) -> Message:
        """A new subscriber gets the rows at the view's position; a resumed one what it missed, if the
        diffs are still there."""
        self.metrics["subscribes"] += 1
        sub = self.subscriptions[sub_id] = Subscription(sub_id, view)
        if resume_lsn is None:
            return self._fresh(sub, "initial")
        if resume_lsn < view.earliest:
            return self._fresh(sub, "resync", Reason.LSN_COMPACTED)
        sub.last_sent = sub.last_acked = resume_lsn
        return self.poll(sub_id) or Message("diff", view.lsn)

    def _fresh(self, sub: Subscription, kind: str, reason: Reason | None = None) -> Message:
        sub.last_sent, sub.pending = sub.view.lsn, 0
        if reason:
            self.metrics[f"resync:{reason.value}"] += 1
        return Message(kind, sub.last_sent, sub.view.result(), reason)

    def poll(self, sub_id: str) -> Message | None:
        """The events since the last message, in order; more unacknowledged transactions than
        ``bound`` make a resync, or one coalesced change."""
        sub = self.subscriptions[sub_id]
        if sub.view.lsn <= sub.last_sent:
            return None
        d = sub.view.diffs(sub.last_sent)
        behind = sub.pending + (d.select(S.LSN).distinct().count() if d is not None else 0)
        if behind > self.bound:
            if not self.coalesce:
                return self._fresh(sub, "resync", Reason.BACKPRESSURE)
            d = S.consolidate(d.drop(S.LSN)).withColumn(S.LSN, F.lit(sub.view.lsn).cast("bigint"))
            behind = sub.pending + 1
        rows = None if d is None else S.pair(d, sub.view.keys or S.data_columns(d))
        sub.last_sent, sub.pending = sub.view.lsn, behind
        self.metrics["diffs"] += 1
        return Message("diff", sub.last_sent, rows)

    def ack(self, sub_id: str, lsn: int) -> None:
        """Acknowledgements only move forward, and not beyond what was sent."""
        sub = self.subscriptions[sub_id]
        if sub.last_acked < lsn <= sub.last_sent:
            sub.last_acked, sub.pending = lsn, 0 if lsn == sub.last_sent else sub.pending

    def frontier(self, view: LiveView) -> int:
        """The least position all subscribers of a view have acknowledged: older diffs may go."""
        return min([s.last_acked for s in self.subscriptions.values() if s.view is view], default=view.lsn)

    def compact(self, view: LiveView) -> None:
        view.compact(self.frontier(view))

    def reseed(self, view: LiveView, tables: dict[str, DataFrame], lsn: int, schemas: dict[str, T.StructType] | None = None) -> list[tuple[str, Message]]:
        """Begin a view anew from a snapshot: after its tables have other columns (``schemas``), or
        after the log's slot was lost; every subscriber is sent fresh rows with the reason."""
        if schemas:
            view.schemas = view.schemas | schemas
        view.seed(tables, lsn)
        return self.resync_all(view, Reason.SCHEMA_CHANGED if schemas else Reason.SLOT_RECREATED)

    def lag(self, head_lsn: int) -> dict[str, int]:
        """How far each subscriber's acknowledgement is behind the head of the log."""
        return {s.id: max(0, head_lsn - max(s.last_acked, s.view.earliest)) for s in self.subscriptions.values()}

    def fail(self, view: LiveView, error: Exception) -> list[tuple[str, Message]]:
        """Tell every subscriber of a view that it has stopped, and let them go."""
        ids = [s.id for s in self.subscriptions.values() if s.view is view]
        self.metrics["errors"] += len(ids)
        for i in ids:
            self.unsubscribe(i)
        return [(i, Message("error", view.lsn, error=f"{type(error).__name__}: {error}")) for i in ids]

    def resync_all(self, view: LiveView, reason: Reason) -> list[tuple[str, Message]]:
        return [(s.id, self._fresh(s, "resync", reason)) for s in self.subscriptions.values() if s.view is view]

    def unsubscribe(self, sub_id: str) -> None:
        self.subscriptions.pop(sub_id, None)


class MaterializedKeys:
    """Which keys of a partial view are there: hit, pending (asked for) or miss."""

    def __init__(self) -> None:
        self._state: dict[tuple, str] = {}

    def lookup(self, key: tuple) -> str:
        found = self._state.get(key, "miss")
        self._state.setdefault(key, "pending")
        return found

    def fill(self, key: tuple) -> None:
        self._state[key] = "hit"

    def evict(self, key: tuple) -> None:
        self._state.pop(key, None)


class PartialView:
    """The rows of a view for the keys asked for so far, one column each; others aren't kept.

    A missing key is fetched by an upquery on the view; keys that the view's diffs have touched since
    are fetched again.  ``limit`` keys are kept at most, the longest unused ones go first.
    """

    def __init__(self, view: LiveView, key: str, limit: int = 10_000) -> None:
        self.view, self.key, self.limit, self.lsn = view, key, limit, view.lsn
        self.keys = MaterializedKeys()
        self._part: dict[object, DataFrame] = {}  # a part serves all keys it was fetched for

    def _refresh(self) -> None:
        if self.view.lsn > self.lsn and self._part:
            spark, kind = self.view.spark, self.view.result().schema[self.key].dataType
            kept = spark.createDataFrame([(k,) for k in self._part], T.StructType([T.StructField(self.key, kind)]))
            moved = kept.join(self.view.diffs(self.lsn).select(self.key), self.key, "left_semi")  # as many as are kept
            for r in moved.collect():
                self._part.pop(r[0], None)
                self.keys.evict((r[0],))
        self.lsn = self.view.lsn

    def get(self, *wanted: object) -> DataFrame:
        """The rows with the wanted keys at the view's position."""
        self._refresh()
        missing = [k for k in dict.fromkeys(wanted) if self.keys.lookup((k,)) != "hit"]
        result = self.view.result()
        one = lambda ks: result.sparkSession.createDataFrame([(k,) for k in ks], T.StructType([result.schema[self.key]]))
        if missing:
            rows = materialize(S.upquery(result, self.key, one(missing)), "partial")
            for k in missing:
                self._part[k] = rows
                self.keys.fill((k,))
        for k in wanted:
            self._part[k] = self._part.pop(k)
        while len(self._part) > max(self.limit, len(wanted)):
            gone = next(iter(self._part))
            self._part.pop(gone)
            self.keys.evict((gone,))
        parts = {id(self._part[k]): self._part[k] for k in wanted}
        asked = one(dict.fromkeys(wanted))
        mine = [p.join(one([k for k in dict.fromkeys(wanted) if self._part[k] is p]), self.key, "left_semi") for p in parts.values()]
        return S.concat(*mine) if mine else S.upquery(result, self.key, asked)


class ProgressMetrics(StreamingQueryListener):
    """Counts batches and rows of streaming queries, with the last batch's duration and quantiles of
    the last ``window`` durations."""

    def __init__(self, window: int = 1024) -> None:
        self.counts: Counter = Counter()
        self.durations: deque[int] = deque(maxlen=window)

    def quantile(self, q: float) -> float | None:
        """The duration in milliseconds that a share ``q`` of the batches doesn't exceed."""
        d = sorted(self.durations)
        return d[min(len(d) - 1, int(q * len(d)))] if d else None

    def onQueryStarted(self, event) -> None:
        self.counts["started"] += 1

    def onQueryProgress(self, event) -> None:
        self.counts["batches"] += 1
        self.counts["rows"] += event.progress.numInputRows
        self.counts["last_ms"] = event.progress.batchDuration
        self.durations.append(event.progress.batchDuration)

    def onQueryIdle(self, event) -> None:
        self.counts["idle"] += 1

    def onQueryTerminated(self, event) -> None:
        self.counts["terminated"] += 1

