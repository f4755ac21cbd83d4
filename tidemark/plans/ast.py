"""Syntax trees of the served SELECT dialect.

Expressions are tuples whose first item names the form; queries are dataclasses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


class SqlError(ValueError):
    """A query outside the served surface; ``code`` names what was refused."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


@dataclass
class Table:
    name: str
    alias: str


@dataclass
class Derived:
    query: Query
    alias: str
    lateral: bool = False
    columns: list[str] = field(default_factory=list)


@dataclass
class Join:
    kind: str  # inner, left, lateral, left lateral
    left: object
    right: object
    on: tuple | None = None


@dataclass
class Select:
    items: list[tuple[tuple, str | None]]
    source: object
    where: tuple | None = None
    group: list[tuple] = field(default_factory=list)
    having: tuple | None = None
    distinct: bool = False
    distinct_on: list[tuple] = field(default_factory=list)


@dataclass
class SetOp:
    op: str
    all_rows: bool
    left: object
    right: object


@dataclass
class Cte:
    name: str
    columns: list[str]
    query: Query


@dataclass
class Query:
    body: object
    ctes: list[Cte] = field(default_factory=list)
    recursive: bool = False
    order: list[tuple[tuple, bool, bool | None]] = field(default_factory=list)  # expression, ascending, nulls first
    limit: int | tuple | None = None
    offset: int | tuple = 0


def expressions(node) -> Iterator[tuple]:
    """All expressions of a tree, outer ones first, those of nested queries included."""
    if isinstance(node, tuple):
        if node and isinstance(node[0], str):
            yield node
        for x in node:
            yield from expressions(x)
    elif isinstance(node, list):
        for x in node:
            yield from expressions(x)
    elif hasattr(node, "__dataclass_fields__"):
        for f in node.__dataclass_fields__:
            yield from expressions(getattr(node, f))


def nodes(node) -> Iterator[object]:
    """All query nodes (dataclasses) of a tree."""
    if hasattr(node, "__dataclass_fields__"):
        yield node
        for f in node.__dataclass_fields__:
            yield from nodes(getattr(node, f))
    elif isinstance(node, (list, tuple)):
        for x in node:
            yield from nodes(x)


def tables(query: Query) -> set[str]:
    """Names of the base tables a query reads (not of its own CTEs)."""
    own = {n.name for n in nodes(query) if isinstance(n, Cte)}
    return {n.name for n in nodes(query) if isinstance(n, Table)} - own
