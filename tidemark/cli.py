"""python -m tidemark.cli: check rules and queries, try permissions, print client types and the catalog.

Tables are the Parquet files of a folder.
"""

from __future__ import annotations

import argparse
import json
import pathlib
import sys

from pyspark.sql import SparkSession

from tidemark.plans.ast import SqlError
from tidemark.plans.permissions import Guarded, RuleError, RuleSet, User, load_toml
from tidemark.plans.prepared import QueryError, Registry
from tidemark.plans.typegen import module
from tidemark.session import get_session


def _tables(spark: SparkSession, folder: str) -> dict:
    return {p.stem: spark.read.parquet(str(p)) for p in sorted(pathlib.Path(folder).glob("*.parquet"))}


def _rules(path: str, tables: dict) -> RuleSet:
    rules, fields = load_toml(pathlib.Path(path).read_text())
    return RuleSet(rules, {n: t.columns for n, t in tables.items()}, fields)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--tables", required=True, help="folder of Parquet tables")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate", help="check a rules file and a file of named queries")
    v.add_argument("--rules")
    v.add_argument("--queries")
    e = sub.add_parser("eval", help="run a query as a user")
    e.add_argument("--rules", required=True)
    e.add_argument("--user", default="{}", help="JSON object of user fields")
    e.add_argument("sql")
    t = sub.add_parser("typegen", help="TypeScript types of named queries")
    t.add_argument("queries")
    sub.add_parser("catalog", help="tables and columns as JSON")
    a = p.parse_args(argv)
    spark = get_session("local[*]")
    tables = _tables(spark, a.tables)
    registry = Registry(spark, {n: x.schema for n, x in tables.items()})
    try:
        if a.command == "validate":
            rules = len(_rules(a.rules, tables).rules) if a.rules else 0
            names = registry.register_file(pathlib.Path(a.queries).read_text()) if a.queries else []
            print(f"{rules} rules, {len(names)} queries")
        elif a.command == "eval":
            rules = _rules(a.rules, tables)
            for row in Guarded(spark, tables.get, rules, User(rules.fields, json.loads(a.user))).sql(a.sql).toJSON().collect():
                print(row)
        elif a.command == "typegen":
            registry.register_file(pathlib.Path(a.queries).read_text())
            print(module({n: registry.result_schema(n) for n in registry.queries}), end="")
        else:
            print(json.dumps({n: {f.name: f.dataType.simpleString() for f in x.schema} for n, x in tables.items()}, indent=1))
    except (RuleError, QueryError, SqlError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
