"""Settings: environment over INI file over default, checked at once."""

from __future__ import annotations

import configparser
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    reports_dir: str = "reports"
    index_dir: str = "index"
    images_dir: str = "images"
    top_k: int = 10
    suggestions: int = 5
    cache_entries: int = 512
    cache_seconds: int = 300
    shared_results: str = ""
    shuffle_partitions: int = 200

    @classmethod
    def load(cls, path: str | None = None, env: Mapping[str, str] = os.environ, section: str = "folioscan") -> Settings:
        """Raises ValueError for a value that is not a number where one is needed, or is not positive, or is empty."""
        ini = configparser.ConfigParser()
        if path:
            ini.read(path)
        values = {}
        for f in fields(cls):
            raw = env.get(f"FOLIOSCAN_{f.name.upper()}") or ini.get(section, f.name, fallback=None)
            if raw is None:
                continue
            if isinstance(f.default, int):
                if not raw.strip().isdigit() or int(raw) <= 0:
                    raise ValueError(f"{f.name} must be a positive number")
                values[f.name] = int(raw)
            elif raw.strip():
                values[f.name] = raw.strip()
            else:
                raise ValueError(f"{f.name} must not be empty")
        return cls(**values)
