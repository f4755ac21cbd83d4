"""Outgoing rows: wire text with a checked schema, and statements for a local replica."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_rows(df: DataFrame, name: str = "payload") -> DataFrame:
    """Each row as JSON text with all fields, nulls included."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))


def decode_rows(df: DataFrame, schema: T.StructType, name: str = "payload") -> DataFrame:
    """Rows of ``encode_rows``; text with other fields or types is an error."""
    fields = F.array_sort(F.json_object_keys(name))
    want = sorted(schema.fieldNames())
    checked = F.when(fields == F.array(*[F.lit(x) for x in want]), F.col(name)).otherwise(
        F.raise_error(F.concat(F.lit("wrong fields: "), F.coalesce(F.col(name), F.lit("NULL"))))
    )
    return df.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


_TYPES = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def create_table_sql(table: str, schema: T.StructType, key: list[str]) -> str:
    """DDL of a local replica table."""
    if not key:
        raise ValueError("a replica table needs a key")
    cols = [f"{_quoted(f.name)} {_TYPES.get(f.dataType.simpleString(), 'TEXT')}{'' if f.nullable else ' NOT NULL'}" for f in schema]
    return f"CREATE TABLE IF NOT EXISTS {_quoted(table)} ({', '.join(cols)}, PRIMARY KEY ({', '.join(map(_quoted, key))}))"


def upsert_statement(table: str, schema: T.StructType, key: list[str]) -> str:
    names = schema.fieldNames()
    rest = [n for n in names if n not in key]
    action = "UPDATE SET " + ", ".join(f"{_quoted(n)} = excluded.{_quoted(n)}" for n in rest) if rest else "NOTHING"
    return (
        f"INSERT INTO {_quoted(table)} ({', '.join(map(_quoted, names))}) VALUES ({', '.join('?' * len(names))}) "
        f"ON CONFLICT ({', '.join(map(_quoted, key))}) DO {action}"
    )


def delete_statement(table: str, key: list[str]) -> str:
    return f"DELETE FROM {_quoted(table)} WHERE " + " AND ".join(f"{_quoted(k)} = ?" for k in key)
