"""Applying a stream of inserts, updates and deletes: a log-structured merge table.

Changes are appended as runs: within a run only the last change of each key stays (combined map
side, so a hot key costs one row per task), hashed by key into buckets and sorted by key and
sequence there.  A read merges the runs bucket by bucket: bucket i of all runs is one task, nothing
is exchanged, and Spark's sorter (a merge sort of natural runs, also over what it spills) merges k
sorted runs into one pass in which the change with the greatest sequence wins and tombstones drop
out.  Runs may repeat and overlap in any way, as merging keeps a maximum.  Compaction is levelled:
``fan`` runs of a level become one run of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import Store


class LsmTable:
    """``keys`` identify a row, ``sequence`` orders its changes, ``alive`` false is a tombstone.

    A change may leave ``carried`` columns null, which means untold: the row keeps the last value
    told since its last tombstone.  Runs hold each with the sequence that told it.
    """

    def __init__(
        self, spark: SparkSession, root: str, keys: list[str], sequence: list[str], alive: str = "alive", fan: int = 8,
        carried: tuple[str, ...] = (), bucket_bytes: int = 256 << 20,
    ) -> None:
        self.store, self.keys, self.sequence, self.alive, self.fan = Store(spark, root), keys, sequence, alive, fan
        self.carried, self.bucket_bytes = carried, bucket_bytes

    def _last(self, changes: DataFrame) -> DataFrame:
        """The last change per key.  Equal sequences are repeats; a tombstone never hides a row of
        the same sequence (an update's removal and insertion share it)."""
        held = [*self.carried, "__gone"] if self.carried else []
        rest = [c for c in changes.columns if c not in self.keys and c not in held]
        order: Column = F.struct(*self.sequence, self.alive)
        if set(rest) == {*self.sequence, self.alive}:
            picked = F.max(order)
        else:
            picked = F.max_by(F.struct(*rest), order)
        last = changes.groupBy(*self.keys).agg(picked.alias("__c"), *[F.max(c).alias(c) for c in held])
        return last.select(*self.keys, *[F.col(f"__c.`{c}`").alias(c) for c in rest], *held)

    def _told(self, changes: DataFrame) -> DataFrame:
        """Carried columns, and the place of a tombstone, with their sequence."""
        if not self.carried:
            return changes
        at = [F.col(c) for c in self.sequence]
        changes = changes.withColumns({c: F.lit(None).cast("string") for c in self.carried if c not in changes.columns})
        told = {c: F.when(F.col(c).isNotNull(), F.struct(F.struct(*at).alias("at"), F.col(c).alias("value"))) for c in self.carried}
        return changes.withColumns(told | {"__gone": F.when(~F.col(self.alive), F.struct(*at))})

    def _write(self, run: DataFrame, name: str, buckets: int, level: int) -> dict:
        return self.store.write_buckets(run, name, self.keys, self.keys + self.sequence, buckets) | {"level": level}

    def append(self, run_id: str, changes: DataFrame) -> None:
        """Append a run, unless one of that id has been; changes without key or sequence can't be placed."""
        m = self.store.manifest()
        if run_id in m.get("done", []):
            return
        buckets = m.get("buckets") or int(self.store.spark.conf.get("spark.sql.shuffle.partitions"))
        run = self._write(self._last(self._told(changes.dropna(subset=self.keys + self.sequence))), f"run-{run_id}", buckets, 0)
        self.store.commit(m | {"buckets": buckets, "parts": m["parts"] | {run_id: run}, "done": [*m.get("done", []), run_id]})
        self._settle()

    def _settle(self) -> None:
        """Merge full levels, lowest first."""
        level = 0
        while True:
            m = self.store.manifest()
            full = [n for n, p in m["parts"].items() if p["level"] == level]
            if len(full) >= self.fan:
                self._merge_runs(m, full, level + 1, m["buckets"])
            elif not any(p["level"] > level for p in m["parts"].values()):
                return
            level += 1

    def _merge_runs(self, m: dict, names: list[str], level: int, buckets: int) -> None:
        """Tombstones stay, as late changes may still arrive below them."""
        name = f"level{level}-{m['version']}"
        run = self._write(self._merged([m["parts"][n] for n in names]), name, buckets, level)
        self.store.commit(m | {"buckets": buckets, "parts": {n: p for n, p in m["parts"].items() if n not in names} | {name: run}})
        for n in names:
            self.store.delete(m["parts"][n]["path"])

    def runs(self) -> list[str]:
        return sorted(self.store.manifest()["parts"])

    def _merged(self, parts: list[dict]) -> DataFrame:
        runs = self.store.read_buckets(parts, self.keys, self.keys + self.sequence)
        return self._last(runs.sortWithinPartitions(*self.keys, *self.sequence)) if len(parts) > 1 else runs

    def read(self) -> DataFrame:
        """The current rows with the sequence of their last change."""
        parts = self.store.manifest()["parts"]
        if not parts:
            raise ValueError("no run has been appended yet")
        rows = self._merged([p for _, p in sorted(parts.items())]).filter(F.col(self.alive)).drop(self.alive)
        since = lambda c: F.col("__gone").isNull() | (F.col(f"{c}.at") >= F.col("__gone"))
        return rows.withColumns({c: F.when(since(c), F.col(f"{c}.value")) for c in self.carried}).drop("__gone")

    def compact(self) -> None:
        """Merge all runs into one, with more buckets where they have outgrown ``bucket_bytes``."""
        m = self.store.manifest()
        buckets, total = m["buckets"], sum(self.store.size(p["path"]) for p in m["parts"].values())
        while total > buckets * self.bucket_bytes:
            buckets *= 2
        self._merge_runs(m, list(m["parts"]), 1 + max(p["level"] for p in m["parts"].values()), buckets)
