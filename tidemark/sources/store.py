"""A versioned folder of Parquet parts with an atomically replaced manifest.

Works on any Hadoop file system the session can reach.  Readers only see parts that the manifest
names, and no part is ever written twice (each has a name of its own), so a writer that fails at any
point leaves nothing visible and may simply run again.  One writer at a time: a commit over a
manifest that has moved on is refused.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class StaleManifestError(RuntimeError):
    """Another writer committed in between."""


class Store:
    """``root/_manifest.json`` names the live parts; parts are immutable Parquet folders."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        p = self._path(f"{self.root}/_manifest.json")
        old = self._path(f"{self.root}/_manifest.old")
        if not self._fs.exists(p):
            if not self._fs.exists(old):
                return {"version": 0, "parts": {}}
            p = old  # a writer stopped between the two renames
        stream = self._fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """Replace the manifest that ``manifest`` was made from: write aside, move the old one away, rename into place."""
        if manifest["version"] != self.manifest()["version"]:
            raise StaleManifestError(self.root)
        manifest = manifest | {"version": manifest["version"] + 1}
        tmp = self._path(f"{self.root}/_manifest.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        live, old = self._path(f"{self.root}/_manifest.json"), self._path(f"{self.root}/_manifest.old")
        if self._fs.exists(live):
            self._fs.delete(old, False)
            self._fs.rename(live, old)
        if not self._fs.rename(tmp, live):
            raise OSError(f"cannot commit {live}")
        self._fs.delete(old, False)

    def fresh(self, name: str) -> str:
        """A path no part has had."""
        return f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"

    def write_part(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> str:
        """Write a part under a fresh path, in folders of the columns ``by``; it is seen once a manifest names it."""
        path = self.fresh(name)
        w = df.write.option("compression", "zstd")
        (w.partitionBy(*by) if by else w).parquet(path)
        return path

    def write_buckets(self, df: DataFrame, name: str, keys: list[str], sort: list[str], buckets: int) -> dict:
        """Write a part whose rows are hashed by ``keys`` into one file a bucket, each sorted.

        Rows that are already hashed by ``keys`` into as many partitions aren't moved again.
        """
        spark, path = self.spark, self.fresh(name)
        if buckets != int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.repartition(buckets, *keys)
        table = f"tidemark_{uuid.uuid4().hex}"
        w = df.write.format("parquet").option("compression", "zstd").option("path", path)
        try:
            w.bucketBy(buckets, *keys).sortBy(*sort).saveAsTable(table)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {table}")  # the files stay
        return {"path": path, "buckets": buckets, "schema": df.schema.jsonValue()}

    def read_buckets(self, parts: list[dict], keys: list[str], sort: list[str]) -> DataFrame:
        """Several parts of ``write_buckets`` as one: bucket i of all of them is one task, so groups,
        windows and joins on ``keys`` need no exchange, and a sort meets runs that are sorted already.
        (Parts with another number of buckets are joined to them by a union, behind an exchange.)"""
        counts = sorted({p["buckets"] for p in parts})
        return reduce(DataFrame.unionByName, [self._bucketed([p for p in parts if p["buckets"] == n], keys, sort) for n in counts])

    def _bucketed(self, parts: list[dict], keys: list[str], sort: list[str]) -> DataFrame:
        """One table with a partition a part: only the catalog can tell Spark of buckets.  The entry
        has no files of its own."""
        spark, table = self.spark, f"tidemark_{uuid.uuid4().hex}"
        names = lambda cols: ", ".join(f"`{c}`" for c in cols)
        columns = T.StructType.fromJson(parts[0]["schema"]).toDDL()
        spark.sql(
            f"CREATE TABLE {table} ({columns}, __part INT) USING parquet PARTITIONED BY (__part) CLUSTERED BY ({names(keys)}) "
            f"SORTED BY ({names(sort)}) INTO {parts[0]['buckets']} BUCKETS LOCATION '{self.root}'"
        )
        spark.sql(f"ALTER TABLE {table} ADD " + " ".join(f"PARTITION (__part = {i}) LOCATION '{p['path']}'" for i, p in enumerate(parts)))
        return spark.table(table).drop("__part")

    def size(self, path: str) -> int:
        """Bytes below ``path``."""
        return self._fs.getContentSummary(self._path(path)).getLength()

    def vacuum(self) -> None:
        """Delete what failed writers and replaced parts have left: folders that the manifest doesn't name."""
        named = json.dumps(self.manifest())
        for f in self._fs.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if f.isDirectory() and f"/{name}" not in named:
                self._fs.delete(f.getPath(), True)

    def listing(self, path: str) -> list[tuple[str, int, int]]:
        """(path, size, modification time) of the data files below ``path``."""
        out, it = [], self._fs.listFiles(self._path(path), True)
        while it.hasNext():
            f = it.next()
            p = f.getPath().toString()
            if p.endswith(".parquet"):
                out.append((p, f.getLen(), f.getModificationTime()))
        return sorted(out)

    def checksum(self, path: str) -> str | None:
        """The checksum of a file's content that the file system keeps, if it does."""
        c = self._fs.getFileChecksum(self._path(path))
        return None if c is None else c.toString()

    def touch(self, path: str) -> None:
        """New modification times for the data files below ``path``."""
        for p, _, mtime in self.listing(path):
            self._fs.setTimes(self._path(p), mtime + 60_000, -1)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def is_folder(self, path: str) -> bool:
        return self._fs.getFileStatus(self._path(path)).isDirectory()

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))
