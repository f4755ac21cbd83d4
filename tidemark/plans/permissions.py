"""Row-level permission rules: every scan of a guarded table is filtered before anything else.

A table without rules is visible; several rules on one table widen what is seen.  ``latest`` keeps
the newest version of each key before the filter, so a hidden new version also hides the old ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans import ast, parser
from tidemark.plans.engine import Engine

MODES = ("row_visibility", "subscribe", "both")
FIELD_TYPES = ("bool", "int", "float", "text", "timestamp", "uuid", "jsonb", "enum")
MAX_PREDICATE_DEPTH = 32


class RuleError(ValueError):
    """A rule set or a user context that can't be used; ``code`` says why."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Latest:
    key: tuple[str, ...]
    version: str


@dataclass(frozen=True)
class Rule:
    name: str
    table: str
    predicate: str
    mode: str = "both"
    latest: Latest | None = None


def _literal(name: str, kind: str, value: Any) -> tuple:
    """A user value as a typed literal."""
    ok = {
        "bool": lambda v: isinstance(v, bool), "int": lambda v: isinstance(v, int) and not isinstance(v, bool),
        "float": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "text": lambda v: isinstance(v, str),
        "enum": lambda v: isinstance(v, str), "uuid": lambda v: isinstance(v, str) and re.fullmatch(r"\{?([0-9a-fA-F]{4}-?){8}\}?", v),
        "timestamp": lambda v: isinstance(v, (str, datetime)), "jsonb": lambda v: isinstance(v, str),
    }
    if value is None:
        return ("lit", "null", None)
    if not ok[kind](value):
        raise RuleError("TypeMismatch", f"$user.{name} isn't {kind}")
    if kind == "bool":
        return ("lit", "bool", value)
    if kind == "int":
        return ("lit", "int", value)
    if kind == "float":
        return ("lit", "float", repr(float(value)))
    if kind == "uuid":
        h = re.sub(r"[{}-]", "", value).lower()
        return ("lit", "str", f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}")
    return ("lit", "timestamp" if kind == "timestamp" else "str", str(value))


@dataclass
class User:
    """Values of the declared fields; lists serve ``= ANY($user.field)``."""

    fields: dict[str, str]
    values: dict[str, Any]

    def __post_init__(self) -> None:
        for name in self.values:
            if name not in self.fields:
                raise RuleError("UnknownUserField", name)

    def literal(self, name: str) -> tuple:
        if name not in self.fields:
            raise RuleError("UnknownUserField", name)
        if name not in self.values:
            raise RuleError("MissingUserField", name)
        value, kind = self.values[name], self.fields[name]
        if isinstance(value, (list, tuple)):
            if kind == "jsonb" or any(isinstance(v, (list, tuple)) for v in value):
                raise RuleError("TypeMismatch", f"$user.{name}")
            return ("array", [_literal(name, kind, v) for v in value])
        return _literal(name, kind, value)

    def key(self, names: set[str]) -> str:
        """Length-prefixed bindings of the fields used, so that no two users share a key by accident."""
        parts = [f"{n}={self.literal(n)!r}" for n in sorted(names)]
        return "".join(f"{len(p)}:{p}" for p in parts)


def _depth(e) -> int:
    return 1 + max((_depth(x) for x in e if isinstance(x, (tuple, list))), default=0) if isinstance(e, (tuple, list)) else 0


class RuleSet:
    """Validated rules over known tables (name → column names) and declared user fields."""

    def __init__(self, rules: list[Rule], tables: dict[str, list[str]], fields: dict[str, str]) -> None:
        self.rules, self.fields = list(rules), dict(fields)
        self._tables = tables
        #: Tells one set of rules from any other: plans shared under one version aren't under another.
        self.version = hashlib.sha256(repr((sorted(map(repr, rules)), sorted(fields.items()))).encode()).hexdigest()[:16]
        for name, kind in fields.items():
            if kind not in FIELD_TYPES:
                raise RuleError("UnknownFieldType", f"{name}: {kind}")
        seen: dict[tuple[str, str], str] = {}
        self.trees: dict[str, tuple] = {}
        latest: dict[str, Latest | None] = {}
        for r in rules:
            if r.name in self.trees:
                raise RuleError("DuplicateRule", r.name)
            if r.mode not in MODES:
                raise RuleError("UnknownMode", r.mode)
            if r.table not in tables:
                raise RuleError("UnknownTable", r.table)
            tree = parser.parse_predicate(r.predicate)
            if _depth(tree) > MAX_PREDICATE_DEPTH:
                raise RuleError("TooDeep", r.name)
            for x in ast.expressions(tree):
                if x[0] == "col" and x[1][-1] not in tables[r.table]:
                    raise RuleError("UnknownColumn", f"{r.table}.{x[1][-1]}")
                if x[0] == "user" and x[1] not in fields:
                    raise RuleError("UnknownUserField", x[1])
            if (r.table, repr(tree)) in seen:
                raise RuleError("AmbiguousRule", f"{r.name} and {seen[r.table, repr(tree)]}")
            seen[r.table, repr(tree)] = r.name
            if r.latest:
                if r.mode == "subscribe":
                    raise RuleError("LatestOnSubscribe", r.name)
                for c in (*r.latest.key, r.latest.version):
                    if c not in tables[r.table]:
                        raise RuleError("UnknownColumn", f"{r.table}.{c}")
            if r.mode != "subscribe":
                if latest.setdefault(r.table, r.latest) != r.latest:
                    raise RuleError("LatestMismatch", r.table)
            self.trees[r.name] = tree
        self.latest = latest

    def swap(self, rules: list[Rule]) -> RuleSet:
        """Other rules over the same tables and user fields, checked as a whole; this set stays as it is."""
        return RuleSet(rules, self._tables, self.fields)

    def of(self, table: str, *modes: str) -> list[Rule]:
        return [r for r in self.rules if r.table == table and r.mode in modes]

    def user_fields(self, tables: set[str]) -> set[str]:
        return {x[1] for r in self.rules if r.table in tables for x in ast.expressions(self.trees[r.name]) if x[0] == "user"}

    def guard(self, spark: SparkSession, table: str, df: DataFrame, user: User) -> DataFrame:
        """Base rows → latest version per key → rows some rule lets through."""
        rules = self.of(table, "row_visibility", "both")
        if not rules:
            return df
        if newest := self.latest.get(table):
            df = latest_versions(df, list(newest.key), newest.version)
        return filter_rows(spark, df, [self.trees[r.name] for r in rules], user)

    def may_subscribe(self, spark: SparkSession, table: str, user: User) -> bool:
        """False if all rules that gate subscribing fold to FALSE for this user, whatever the row."""
        rules = self.of(table, "subscribe", "both")
        return not rules or any(fold(self.trees[r.name], user) is not False for r in rules)


def latest_versions(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the greatest version of each key (ranked before the shuffle, so keys may be hot)."""
    w = Window.partitionBy(*key).orderBy(F.col(version).desc_nulls_last())
    return df.withColumn("__v", F.row_number().over(w)).filter("__v = 1").drop("__v")


def filter_rows(spark: SparkSession, df: DataFrame, trees: list[tuple], user: User) -> DataFrame:
    """Rows for which at least one predicate is TRUE."""
    any_tree = trees[0]
    for t in trees[1:]:
        any_tree = ("bin", "or", any_tree, t)
    engine = Engine(spark, lambda name: df, bind=lambda e: user.literal(e[1]))
    q = ast.Query(ast.Select([(("star", None), None)], ast.Table("guarded", "guarded"), where=_unqualified(any_tree)))
    return engine.run(q)


def _unqualified(e):
    if isinstance(e, tuple):
        return ("col", e[1][-1:]) if e and e[0] == "col" else tuple(_unqualified(x) for x in e)
    return [_unqualified(x) for x in e] if isinstance(e, list) else e


def fold(e: tuple, user: User) -> bool | None:
    """TRUE or FALSE if the predicate doesn't depend on the row; None if it may."""
    kind = e[0]
    if kind == "lit":
        return e[2] if e[1] == "bool" else False if e[1] == "null" else None
    if kind == "user":
        value = user.literal(e[1])
        return fold(value, user) if value[0] == "lit" else None
    if kind == "not":
        inner = fold(e[1], user)
        return None if inner is None else not inner
    if kind == "bin" and e[1] in ("and", "or"):
        a, b, stop = fold(e[2], user), fold(e[3], user), e[1] == "or"
        if stop in (a, b):
            return stop
        return not stop if a is not None and b is not None else None
    if kind == "any":
        array = user.literal(e[3][1]) if e[3][0] == "user" else e[3]
        return False if array == ("array", []) else None
    if kind == "bin" and e[1] in ("=", "<>", "<", "<=", ">", ">="):
        sides = [user.literal(x[1]) if x[0] == "user" else x for x in e[2:4]]
        if all(x[0] == "lit" for x in sides):
            a, b = (x[2] for x in sides)
            if a is None or b is None:
                return False
            try:
                return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e[1]]
            except TypeError:
                return None
    return None


@dataclass
class Guarded:
    """Queries of one user over guarded tables; the only way to read them."""

    spark: SparkSession
    tables: Callable[[str], DataFrame | None]
    rules: RuleSet
    user: User
    _cache: dict[str, DataFrame] = field(default_factory=dict)

    def _table(self, name: str) -> DataFrame | None:
        df = self.tables(name)
        return None if df is None else self.rules.guard(self.spark, name, df, self.user)

    def run(self, q: ast.Query, bind: Callable[[tuple], tuple] | None = None) -> DataFrame:
        for t in ast.tables(q):
            if not self.rules.may_subscribe(self.spark, t, self.user):
                raise RuleError("SubscribeDenied", t)
        return Engine(self.spark, self._table, bind).run(q)

    def sql(self, text: str) -> DataFrame:
        return self.run(parser.parse(text))


def load_toml(text: str) -> tuple[list[Rule], dict[str, str]]:
    """Rules and user fields of a file with ``[[user_context]]`` and ``[[rule]]`` tables."""
    import tomllib

    doc = tomllib.loads(text)
    doc = doc.get("permissions", doc)
    fields = {f["name"]: f["type"] for f in doc.get("user_context", [])} | doc.get("user_schema", {})
    rules = []
    for r in doc.get("rule", doc.get("rules", [])):
        newest = r.get("latest")
        rules.append(Rule(r["name"], r["table"], r["predicate"], r.get("mode", "both"), Latest(tuple(newest["key"]), newest["version"]) if newest else None))
    return rules, fields
