"""Paths for file streams."""

from __future__ import annotations


def one_or_many(path: str) -> str:
    """A path as a pattern that matches it alone: file streams take folders and patterns, but not a single file."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[]{}") else f"{path[:-1]}[{path[-1]}]"
