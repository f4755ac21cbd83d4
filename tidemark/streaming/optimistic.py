"""A client's own writes before the server confirms them, as functions on keyed rows."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class LocalWrites:
    """Rows from the server by key, and staged writes replayed over them in order."""

    base: dict = field(default_factory=dict)
    staged: list[tuple[str, object, dict | None, dict | None]] = field(default_factory=list)

    def stage(self, write_id: str, key, row: dict | None) -> None:
        """Write ``row`` under ``key`` (None deletes); what was seen then decides conflicts later."""
        self.staged.append((write_id, key, row, self.view().get(key)))

    def view(self) -> dict:
        out = dict(self.base)
        for _, key, row, _ in self.staged:
            if row is None:
                out.pop(key, None)
            else:
                out[key] = row
        return out

    def server(self, key, row: dict | None) -> list[str]:
        """Take in a row from the server.  A staged write that equals it is confirmed and leaves; other
        writes of that key that were made on another row are conflicts, whose ids are returned."""
        before = self.base.get(key)
        if row is None:
            self.base.pop(key, None)
        else:
            self.base[key] = row
        mine = [w for w in self.staged if w[1] == key]
        if mine and mine[0][2] == row:
            self.staged.remove(mine[0])
            return []
        return [w[0] for w in mine if w[3] == before and before != row]

    def rollback(self, write_id: str) -> None:
        self.staged = [w for w in self.staged if w[0] != write_id]
