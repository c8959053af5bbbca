"""The projects that have been indexed: a small JSON file, rewritten as a whole."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path


class Registry:
    def __init__(self, path: str):
        self.path = Path(path)

    def load(self) -> dict[str, dict]:
        """Projects by name; none where the file is missing or unreadable."""
        try:
            data = json.loads(self.path.read_text())
        except (OSError, ValueError):
            return {}
        return data.get("projects", {}) if isinstance(data, dict) else {}

    def _save(self, projects: dict[str, dict]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        beside = self.path.with_suffix(".tmp")
        beside.write_text(json.dumps({"projects": projects}, indent=2) + "\n")
        beside.replace(self.path)

    def register(self, name: str, root: str, store: str, at: str | None = None) -> None:
        """Adds a project or replaces what is known of it."""
        self._save(self.load() | {name: {"root": str(Path(root).resolve()), "store": store, "last_indexed": at or datetime.now(UTC).isoformat()}})

    def unregister(self, name: str) -> bool:
        projects = self.load()
        there = projects.pop(name, None) is not None
        if there:
            self._save(projects)
        return there

    def list(self) -> list[dict]:
        return [{"name": n, **p} for n, p in sorted(self.load().items())]

    def find(self, wanted: str) -> dict | None:
        """By name, else by whole path, else by the last part of the path."""
        projects = self.list()
        path = str(Path(wanted).resolve())
        tests = (lambda p: p["name"] == wanted, lambda p: p["root"] == path, lambda p: Path(p["root"]).name == wanted)
        return next((p for fits in tests for p in projects if fits(p)), None)
