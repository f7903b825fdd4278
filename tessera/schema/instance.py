"""Checks of an instance's settings before it is used."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

DIMENSIONS = 768


def warnings_of(folder: str | None, identity: Mapping | None, dimensions: int, expected: int = DIMENSIONS) -> list[str]:
    """What is amiss with an instance; nothing here stops it. Without a folder there is nothing to check."""
    if not folder:
        return []
    if not Path(folder).is_dir():
        return [f"no such folder: {folder}"]
    found = []
    if not (Path(folder) / "identity.toml").is_file():
        found.append("identity.toml is missing, so directions stay unknown")
    if not identity or not any(identity.values()):
        found.append("no own addresses are given, so directions stay unknown")
    if dimensions != expected:
        found.append(f"vectors have {dimensions} dimensions, not {expected}")
    return found
