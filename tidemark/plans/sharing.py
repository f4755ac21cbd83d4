"""One running plan for all subscribers that ask for the same thing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from tidemark.plans import parser
from tidemark.plans.permissions import RuleSet, User


def normalised(sql: str) -> str:
    """Query text without comments, blanks and letter case of words; literals stay as they are."""
    return " ".join(f"'{t}'" if k == "str" else f'"{t}"' if k == "qid" else t for k, t in parser.tokenize(sql)).rstrip("; ")


def sharing_key(sql: str, bindings: dict[str, Any], rules: RuleSet | None = None, user: User | None = None) -> tuple:
    """Equal keys have equal results: text, parameter values, and what the rules make of the user."""
    key: tuple = (normalised(sql), tuple(sorted((k, repr(v)) for k, v in bindings.items())))
    if rules is None or user is None:
        return key
    from tidemark.plans import ast

    tables = ast.tables(parser.parse(sql))
    return (*key, rules.version, user.key(rules.user_fields(tables) & set(user.values)))


@dataclass
class SharedPlans:
    """Plans by key with a count of their users; the last one to leave stops the plan."""

    start: Callable[[tuple], Any]
    stop: Callable[[Any], None] = lambda plan: None
    plans: dict[tuple, list] = field(default_factory=dict)

    def acquire(self, key: tuple) -> Any:
        entry = self.plans.get(key) or self.plans.setdefault(key, [self.start(key), 0])
        entry[1] += 1
        return entry[0]

    def release(self, key: tuple) -> None:
        entry = self.plans[key]
        entry[1] -= 1
        if entry[1] == 0:
            del self.plans[key]
            self.stop(entry[0])
