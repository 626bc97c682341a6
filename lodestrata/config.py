"""Settings of the jobs, read from JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """Where a job reads and writes, and its parameters."""

    input: str = ""
    dictionary: str = ""
    output: str = ""
    annual_panel: str = ""
    alpha: float = 1.0
    taxonomy_size: int = 655
    history_start: str = "1985Q1"
    formal_start: str = "1994Q1"
    min_group_patents: int = 10
    ngram_low: int = 2
    ngram_high: int = 4
    hash_buckets: int = 65_536
    window_quarters: int = 8

    def as_dict(self) -> dict:
        return asdict(self)


def load_config(path: str | Path, root: str | Path | None = None) -> Config:
    """Settings of a JSON file; relative paths are taken from ``root`` (its folder by default), unknown keys refused."""
    path = Path(path)
    given = json.loads(path.read_text(encoding="utf-8"))
    known = {f.name for f in fields(Config)}
    if extra := sorted(set(given) - known):
        raise ValueError(f"unknown settings: {', '.join(extra)}")
    base = Path(root) if root else path.parent
    for key in ("input", "dictionary", "output", "annual_panel"):
        if given.get(key) and "://" not in given[key] and not Path(given[key]).is_absolute():
            given[key] = str((base / given[key]).resolve())
    return Config(**given)
