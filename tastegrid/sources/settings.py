"""Folders of a project, found from a marker file."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path


def project_root(start: Path, marker: str = "pyproject.toml") -> Path:
    """The nearest folder at or above ``start`` that holds the marker."""
    for folder in (start, *start.parents):
        if (folder / marker).exists():
            return folder
    raise FileNotFoundError(f"no {marker} at or above {start}")


@dataclass(frozen=True)
class Folders:
    root: Path

    @property
    def raw(self) -> Path:
        return self.root / "data" / "raw"

    @property
    def processed(self) -> Path:
        return self.root / "data" / "processed"

    @property
    def external(self) -> Path:
        return self.root / "data" / "external"
