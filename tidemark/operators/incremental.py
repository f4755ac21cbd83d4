"""Processing only new or changed records, each once, whatever fails in between.

A manifest says what is done.  For files it holds path, size and checksum of each input; for
messages it holds the LSN intervals that successful runs have finished.  A run takes the listing
minus the manifest, writes its result under its own id, and only then commits the manifest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import canon
from tidemark.operators.dedupe import latest_states, messages
from tidemark.session import materialize, scratch
from tidemark.sources.store import Store

MAX_LSN = (1 << 63) - 1


class LostInputError(RuntimeError):
    """A file was replaced, but others of its batch are gone, so the batch can't be done again."""


FILE = "path string, size bigint, checksum string"


class FileManifest:
    """Runs a batch function over the input files that no successful run has had.

    A file is told by path, size and a checksum of its content: one that was touched or copied over
    itself isn't new, one that was replaced is, whatever its time, and its batch is done again in
    place of the earlier result.  Results of files that were deleted stay.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.store = Store(spark, root)

    def done(self) -> DataFrame:
        """(path, size, checksum, batch) of the files that committed batches have had."""
        spark, parts = self.store.spark, self.store.manifest()["parts"]
        read = lambda p: spark.read.schema(FILE + ", batch string").parquet(*p) if p else spark.createDataFrame([], FILE + ", batch string")
        return read([p["files"] for p in parts.values()])

    def _listed(self, folder: str) -> DataFrame:
        """(path, size, checksum) of the data files.

        The file system's own checksum is taken where it keeps one.  Else the executors compute it:
        two sums of row digests by position, so a large file is read by several tasks and never
        held in memory.
        """
        store, spark = self.store, self.store.spark
        files = [(p, n, store.checksum(p)) for p, n, _ in store.listing(folder)]
        listed = spark.createDataFrame(files, FILE)
        unread = [p for p, _, c in files if c is None]
        if not unread:
            return listed
        df = spark.read.parquet(*unread)
        cols = [F.to_json(F.struct(c.name)) if _unhashable(c.dataType) else F.col(f"`{c.name}`") for c in df.schema]
        row = [F.col("_metadata.row_index"), *cols]
        # both names without the slashes behind the scheme, and unescaped
        plain = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^([a-z0-9]+:)/+", "$1/")
        sums = df.select(plain(F.col("_metadata.file_path")).alias("p"), *[F.xxhash64(F.lit(i), *row).cast("decimal(38,0)").alias(f"h{i}") for i in (1, 2)])
        sums = sums.groupBy("p").agg(F.concat_ws("-", F.sum("h1"), F.sum("h2")).alias("c"))
        named = listed.withColumn("p", F.regexp_replace("path", "^([a-z0-9]+:)/+", "$1/")).join(sums, "p", "left")
        return named.select("path", "size", F.coalesce("checksum", "c", F.lit("empty")).alias("checksum"))

    def run(self, folder: str, process: Callable[[DataFrame], DataFrame]) -> str | None:
        """Process what is new under ``folder``; returns the batch id, None if nothing is new.

        The listing is anti-joined with the manifest.  The batch id follows from the files, so a
        run after a failure is the same batch; the manifest is replaced last.
        """
        if not self.store.listing(folder):
            return None
        spark, m = self.store.spark, self.store.manifest()
        listed, done = materialize(self._listed(folder), "listing"), self.done()
        fresh = listed.join(done, ["path", "size", "checksum"], "left_anti")
        stale = [r[0] for r in done.join(fresh, "path", "left_semi").select("batch").distinct().collect()]
        if stale:
            again = done.filter(F.col("batch").isin(stale))
            if lost := again.join(listed, "path", "left_anti").first():
                raise LostInputError(lost.path)
            fresh = listed.join(again, "path", "left_semi").union(fresh).distinct()
        paths = sorted(r.path for r in fresh.select("path").collect())  # a scan's files are listed on the driver anyway
        if not paths:
            return None
        batch = fresh.agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("path", "size", "checksum")))), 256)).first()[0][:16]
        # columns in the names of folders stay columns
        reader = spark.read.option("basePath", folder) if self.store.is_folder(folder) else spark.read
        part = {
            "path": self.store.write_part(process(reader.parquet(*paths)), f"batch-{batch}"),
            "files": self.store.write_part(fresh.withColumn("batch", F.lit(batch)), f"files-{batch}"),
        }
        self.store.commit(m | {"parts": {n: p for n, p in m["parts"].items() if n not in stale} | {batch: part}})
        return batch

    def read(self) -> DataFrame:
        """The results of all committed batches."""
        return self.store.spark.read.parquet(*sorted(p["path"] for p in self.store.manifest()["parts"].values()))


def _unhashable(t: T.DataType) -> bool:
    return "map" in t.simpleString() or "variant" in t.simpleString()


def message_manifest(sub_states: DataFrame, subscribe_requests: DataFrame, ack_requests: DataFrame) -> DataFrame:
    """(subscription_id, lo, hi, upto_batch): messages with lo < LSN <= hi that first came in a
    batch up to ``upto_batch`` are done.

    A run counts if its status is ``ok`` and something was acked under its request id; repeated
    requests are one run.  A saved ``last_acked_lsn`` covers everything up to it in any batch.
    """
    saved = latest_states(sub_states).filter(F.col("last_acked_lsn") > 0).select(
        "subscription_id", F.lit(-1).cast("bigint").alias("lo"), F.col("last_acked_lsn").alias("hi"),
        F.lit(MAX_LSN).alias("upto_batch"),
    )
    runs = subscribe_requests.filter(canon.ident(F.col("run_status")) == "ok").select(
        "request_id", canon.ident(F.col("subscription_id")).alias("subscription_id"),
        F.coalesce("resume_lsn", F.lit(-1)).alias("lo"), F.col("last_batch_id").alias("upto_batch"),
    ).distinct()
    acked = ack_requests.dropna(subset=["request_id", "lsn"]).groupBy("request_id").agg(F.max("lsn").alias("hi"))
    done = runs.join(acked, "request_id").select("subscription_id", "lo", "hi", "upto_batch")
    return saved.unionByName(done).filter(F.col("lo") < F.col("hi")).dropna()


def pending(listing: DataFrame, manifest: DataFrame, fan: int = 256) -> DataFrame:
    """Rows of ``listing`` (subscription_id, lsn, batch_id, ...) that the manifest doesn't cover.

    The LSNs of a subscription are cut into ranges, one for every ``fan`` / 8 intervals, so
    ordinary subscriptions have one.  A range holds the few intervals that begin or end in it, and
    the greatest batch of all that span it wholly.  Those are found by dyadic blocks of ranges: an
    interval lies in O(log) blocks and a range in O(log) blocks, so a subscription with very many
    intervals costs no pairs.  A row is held against its own range only; AQE splits the join where
    one subscription has many rows.  Rows with a null key, LSN or batch are never done.
    """
    sub = "subscription_id"
    shape = (
        manifest.groupBy(sub).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("lo") >= 0, F.col("lo")).otherwise(F.col("hi"))).alias("from_lsn"),
            F.max("hi").alias("to_lsn"),
        )
        .withColumn("k", F.ceil(F.col("n") * 8 / fan))
        .select(
            sub, "k", "from_lsn", F.ceil((F.col("to_lsn") - F.col("from_lsn") + 1) / F.col("k")).cast("bigint").alias("width"),
            F.ceil(F.log2(F.col("k") + 2)).cast("int").alias("levels"),
        )
    )
    shape = materialize(shape, "shape")  # a row a subscription, used in four places
    # range 0 lies below from_lsn; only intervals from the start reach it, and span it
    place = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) - F.col("from_lsn")) / F.col("width")) + 1).cast("bigint")
    m = manifest.join(shape, sub).withColumns({"i": place("lo"), "j": place("hi")})
    ends = (
        m.withColumn("range", F.explode(F.array_distinct(F.array("i", "j")))).filter("range > 0")
        .groupBy(sub, "range").agg(F.collect_set(F.struct("lo", "hi", "upto_batch")).alias("parts"))
    )
    block = lambda c, t: F.call_function("shiftright", F.col(c), F.col(t))
    spans = (
        m.withColumn("l", F.when(F.col("lo") < 0, F.lit(0)).otherwise(F.col("i") + 1)).filter("l < j")
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("levels"))))
        .withColumns({"a": -F.expr("shiftright(-l, t)"), "b": block("j", "t")}).filter("a < b")
        .withColumn("block", F.explode(F.array_compact(F.array(
            F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1)
        ))))
        .groupBy(sub, "t", "block").agg(F.max("upto_batch").alias("whole"))
    )
    whole = (
        shape.withColumn("range", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k"))))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("levels")))).withColumn("block", block("range", "t"))
        .join(spans, [sub, "t", "block"]).groupBy(sub, "range").agg(F.max("whole").alias("whole"))
    )
    ranges = ends.join(whole, [sub, "range"], "full")
    # internal columns get names that the listing can't have
    ranges = ranges.select(sub, F.col("range").alias("__range"), F.struct("whole", "parts").alias("__held"))
    at = shape.select(sub, F.struct("from_lsn", "width").alias("__at"))
    where = F.greatest(F.lit(0), F.floor((F.col("lsn") - F.col("__at.from_lsn")) / F.col("__at.width")) + 1).cast("bigint")
    placed = listing.join(at, sub, "left").withColumn("__range", where)
    covered = (F.col("lsn").isNotNull() & F.coalesce(F.col("batch_id") <= F.col("__held.whole"), F.lit(False))) | F.exists(
        F.coalesce("__held.parts", F.array().cast("array<struct<lo:bigint,hi:bigint,upto_batch:bigint>>")),
        lambda p: (p["lo"] < F.col("lsn")) & (F.col("lsn") <= p["hi"]) & (F.col("batch_id") <= p["upto_batch"]),
    )
    return placed.join(ranges, [sub, "__range"], "left").filter(~F.coalesce(covered, F.lit(False))).select(*[F.col(f"`{c}`") for c in listing.columns])


def message_listing(diff_payloads: DataFrame) -> DataFrame:
    """(subscription_id, lsn, chunk_index, batch_id): each message with the batch it first came in."""
    return messages(diff_payloads.select("subscription_id", "lsn", "chunk_index", "batch_id")).groupBy(
        "subscription_id", "lsn", "chunk_index"
    ).agg(F.min("batch_id").alias("batch_id")).dropna(subset=["subscription_id", "lsn", "chunk_index"])


class MessageRuns:
    """Consumer runs over a growing listing of messages: each message is processed by one run.

    The result of a run and the intervals it finishes are written under its id; the manifest names
    both at once.  A run that fails before that leaves nothing and may be repeated; a run that was
    committed isn't done again.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.store = Store(spark, root)

    def manifest(self) -> DataFrame:
        parts = [p["done"] for p in self.store.manifest()["parts"].values()]
        schema = "subscription_id string, lo bigint, hi bigint, upto_batch bigint"
        return self.store.spark.read.schema(schema).parquet(*parts) if parts else self.store.spark.createDataFrame([], schema)

    def adopt(self, run_id: str, done: DataFrame) -> None:
        """Take over intervals (as in ``message_manifest``) that earlier runs have finished elsewhere."""
        m = self.store.manifest()
        if run_id not in m["parts"]:
            part = {"done": self.store.write_part(done, f"done-{run_id}")}
            self.store.commit(m | {"parts": m["parts"] | {run_id: part}})

    def run(self, run_id: str, listing: DataFrame, process: Callable[[DataFrame], DataFrame]) -> bool:
        """Process what no run has finished of ``listing`` (subscription_id, lsn, batch_id, ...: all
        messages received so far); False if the run was committed before.

        The listing is written down once: what grows in meanwhile is neither processed nor done.
        """
        m = self.store.manifest()
        if run_id in m["parts"]:
            return False
        listing = materialize(listing, "listing")
        path = self.store.write_part(process(pending(listing, self.manifest())), f"run-{run_id}")
        done = listing.dropna(subset=["subscription_id", "lsn", "batch_id"]).groupBy("subscription_id").agg(
            F.lit(-1).cast("bigint").alias("lo"), F.max("lsn").cast("bigint").alias("hi"), F.max("batch_id").cast("bigint").alias("upto_batch")
        )
        done = self.store.write_part(done, f"done-{run_id}")
        self.store.commit(m | {"parts": m["parts"] | {run_id: {"path": path, "done": done}}})
        return True

    def read(self, run_id: str | None = None) -> DataFrame:
        """The results of a committed run, or of all."""
        parts = self.store.manifest()["parts"]
        paths = sorted(p["path"] for n, p in parts.items() if "path" in p and run_id in (None, n))
        return self.store.spark.read.parquet(*paths)


def pending_messages(folder: str, sub_states: DataFrame, subscribe_requests: DataFrame, ack_requests: DataFrame) -> DataFrame:
    """(subscription_id, lsn, chunk_index, batch_id) of the messages a consumer run that starts now gets.

    ``folder`` has the files of ``diff_payloads``: those that weren't listed yet (by manifest) are
    read into the listing, and the run takes the listing minus what earlier runs have finished.
    """
    spark = sub_states.sparkSession
    files = FileManifest(spark, scratch(spark, "files"))
    files.run(folder, message_listing)
    runs = MessageRuns(spark, scratch(spark, "runs"))
    runs.adopt("earlier", message_manifest(sub_states, subscribe_requests, ack_requests))
    listing = files.read().groupBy("subscription_id", "lsn", "chunk_index").agg(F.min("batch_id").alias("batch_id"))
    runs.run("now", listing, lambda df: df)
    return runs.read("now")
