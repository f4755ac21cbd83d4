"""Session factory and the shared scratch folder."""

from __future__ import annotations

import io
import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with AQE on; settings already made by the cluster are kept."""
    b = SparkSession.builder.appName("tidemark")
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests on one machine) a local folder is made and set, so a
    cluster never gets a machine-local path.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = "file://" + tempfile.mkdtemp(prefix="tidemark-", dir=os.environ.get("TMPDIR"))
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, under the application's id."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them become unusable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete intermediate tables made by ``materialize`` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        root = f"/tidemark/{spark.sparkContext.applicationId}/"
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if root in folder:  # never a table of anyone else's
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application.

    Functions that run in workers import the package; a session that was started without it on the
    workers' path gets it as a zip in the shared folder.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    path = f"{shared_dir(spark)}/tidemark/{sc.applicationId}/tidemark.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
