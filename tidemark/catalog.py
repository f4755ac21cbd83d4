"""Tables of a data folder as DataFrames and, for SQL, as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings relations "
    "wal_transactions wal_updates row_changes diff_payloads sub_states subscribe_requests "
    "ack_requests mixture_targets"
).split()

#: Primary keys, used by keyed views and diff pairing.
KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
}


def path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(path(sf_dir, name))


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views over the Parquet tables; only the named ones are touched."""
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
