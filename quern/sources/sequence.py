"""Sequences: a value is durable before it is handed out, and never handed out twice."""

from __future__ import annotations

from quern.functions.sqltypes import SqlError
from quern.sources.store import Files


class Sequences:
    """High-water marks in files created exclusively, one per reserved run of values; runs are kept in memory."""

    def __init__(self, files: Files):
        self.files = files

    def create(self, name: str) -> None:
        if not self.files.create(f"sequences/{name}/{0:020d}.json", {}):
            raise SqlError(f"{name} exists already")

    def exists(self, name: str) -> bool:
        return self.files.exists(f"sequences/{name}")

    def drop(self, name: str) -> None:
        self.files.delete(f"sequences/{name}")

    def reserve(self, name: str, n: int = 1) -> range:
        """The next n values; safe against other processes, and not undone by a rollback."""
        if not self.exists(name):
            raise SqlError(f"no sequence {name}")
        while True:
            marks = self.files.names(f"sequences/{name}")
            last = int([m for m in marks if m.endswith(".json")][-1].removesuffix(".json"))
            if last + n >= 1 << 63:
                raise SqlError(f"sequence {name} is exhausted")
            if self.files.create(f"sequences/{name}/{last + n:020d}.json", {}):
                for m in marks[:-1]:
                    self.files.delete(f"sequences/{name}/{m}")
                return range(last + 1, last + n + 1)
