"""Settings of the engine and of each source, read from one TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """``folder``: the tables; ``store``: where updates go; ``sources``: settings by source, lower-cased names."""

    folder: str
    store: str | None = None
    zone: str = "UTC"
    limit: int = 20
    sources: dict[str, dict[str, object]] = field(default_factory=dict)

    def enabled(self) -> list[str]:
        """Sources that are not switched off."""
        return [name for name, values in self.sources.items() if values.get("enabled", True)]


def parse_settings(text: str, home: str = "~") -> Settings:
    """Settings of a TOML text. Unknown keys, a missing folder and a limit below 1 are errors; ``~`` stands for ``home``."""
    raw = tomllib.loads(text)
    known = {"folder", "store", "zone", "limit", "sources"}
    if strange := sorted(set(raw) - known):
        raise ValueError(f"unknown settings: {', '.join(strange)}")
    if not isinstance(raw.get("folder"), str) or not raw["folder"].strip():
        raise ValueError("the settings name no folder")
    limit = raw.get("limit", 20)
    if not isinstance(limit, int) or limit < 1:
        raise ValueError("a limit must be at least 1")
    at = lambda path: str(Path(home).expanduser()) + path[1:] if path.startswith("~") else path
    sources = {name.strip().lower(): dict(values) for name, values in raw.get("sources", {}).items()}
    return Settings(at(raw["folder"].strip()), at(raw["store"]) if raw.get("store") else None, raw.get("zone", "UTC"), limit, sources)


def read_settings(path: str) -> Settings:
    """Settings of a file."""
    return parse_settings(Path(path).read_text(encoding="utf-8"))
