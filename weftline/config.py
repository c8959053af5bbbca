"""Settings with their defaults and ranges."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A setting that doesn't hold; `fix` says what would."""

    def __init__(self, message: str, fix: str = ""):
        super().__init__(f"{message}. {fix}" if fix else message)
        self.fix = fix


class LimitError(ConfigError):
    """More of something than the settings allow."""


@dataclass
class SearchConfig:
    limit: int = 10
    rrf_k: int = 2
    expand_below: float = 0.65
    test_demotion: float = 0.80
    debug_demotion: float = 0.95
    importance_boost: float = 0.25
    grep_merge: int = 100
    reranker: str = "none"
    terminology: str = ""


@dataclass
class IndexConfig:
    max_file_bytes: int = 1 << 20
    chunk_tokens: int = 4000
    overlap_tokens: int = 200
    batch_tokens: int = 100_000
    max_chunks: int | None = None
    max_chunks_of: dict[str, int] = field(default_factory=dict)
    extensions: list[str] = field(default_factory=lambda: ["py", "ts", "tsx", "js", "jsx", "md"])
    ignore: list[str] = field(default_factory=list)
    neighbours: int = 20
    enrich: bool = False


@dataclass
class Config:
    search: SearchConfig = field(default_factory=SearchConfig)
    index: IndexConfig = field(default_factory=IndexConfig)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Config:
        out = cls(SearchConfig(**_known(SearchConfig, data.get("search"))), IndexConfig(**_known(IndexConfig, data.get("index"))))
        if problems := out.problems():
            raise ConfigError("; ".join(problems), "Correct these settings")
        return out

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        """Defaults where the file is missing or empty."""
        import yaml

        p = Path(path)
        return cls.from_dict((yaml.safe_load(p.read_text()) if p.exists() else None) or {})

    def problems(self) -> list[str]:
        s, i, out = self.search, self.index, []
        for name, ok in (
            ("search.limit", s.limit > 0), ("search.rrf_k", s.rrf_k > 0), ("search.expand_below", 0 <= s.expand_below), ("search.test_demotion", 0 < s.test_demotion <= 1),
            ("search.debug_demotion", 0 < s.debug_demotion <= 1), ("search.importance_boost", s.importance_boost >= 0), ("index.max_file_bytes", i.max_file_bytes > 0), ("index.chunk_tokens", i.chunk_tokens > 0),
            ("index.overlap_tokens", 0 <= i.overlap_tokens < i.chunk_tokens),
        ):
            if not ok:
                out.append(f"{name} is out of range")
        return out


def _known(kind: type, data: dict[str, Any] | None) -> dict[str, Any]:
    names = {f.name for f in fields(kind)}
    if odd := set(data or {}) - names:
        raise ConfigError(f"unknown settings {sorted(odd)}", f"Known are {sorted(names)}")
    return data or {}
