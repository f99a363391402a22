"""Helpers for tables that bring their own columns."""

from __future__ import annotations

from collections.abc import Iterable


def spare_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores put in front until no column is called so (letter case aside)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name
