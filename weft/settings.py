"""What a user's tool keeps between runs: recent entries, a log, versions."""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass, field

RECENT = 8


@dataclass
class Settings:
    last_folder: str = ""
    recent_folders: list[str] = field(default_factory=list)
    recent_schemes: list[str] = field(default_factory=list)

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, ensure_ascii=False, indent=2)

    @classmethod
    def load(cls, path: str) -> Settings:
        """Defaults where the file is missing or broken; unknown entries are dropped."""
        try:
            with open(path, encoding="utf-8") as f:
                data = json.load(f)
            return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})
        except (OSError, ValueError, AttributeError):
            return cls()


def remember(items: list[str], value: str) -> list[str]:
    """value first, then the others, RECENT at most."""
    return [value, *(x for x in items if x != value)][:RECENT]


def log(path: str, message: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(f"[{int(time.time())}] {message}\n")


def version(text: str) -> tuple[int, int, int] | None:
    """First three numbers of "v1.2.3"; None if they are not there."""
    parts = text.strip().lstrip("v").split(".")[:3]
    return tuple(map(int, parts)) if len(parts) == 3 and all(p.isascii() and p.isdigit() for p in parts) else None


def is_newer(remote: str, current: str) -> bool:
    found, own = version(remote), version(current)
    return found is not None and (own is None or found > own)
