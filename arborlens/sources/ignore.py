"""Ignore patterns: names, whole paths, shell globs and directory prefixes."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import functions as F

from ..schema import CONFIG_DIR, IGNORE_FILE

#: Paths that are never scanned.
DEFAULTS = (
    "node_modules", "vendor", "__pycache__", ".git", "build", "target", CONFIG_DIR, "arborlens_graph.html", ".venv", "venv", "env", ".env", "dist", "out",
    ".vscode", ".idea", ".cache", "tmp", "testdata", "test_cache", "test-cache", ".test_cache", "*.test", "*.out", "*.coverprofile", "profile.cov", "go.work", "go.work.sum",
)


def glob_regex(pattern: str) -> str | None:
    """A glob as a regular expression of a whole path; ``*`` and ``?`` stay inside a segment; None if malformed."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", k + 2)
            if end < 0:
                return None
            body = pattern[k + 1 : end]
            negated = body.startswith("^")
            body = re.sub(r"([\[\]&~|])", r"\\\1", body[negated:])
            out.append(f"[{'^' if negated else ''}{body}]")
            k = end
        elif c == "\\":
            if k + 1 == len(pattern):
                return None
            k += 1
            out.append(re.escape(pattern[k]))
        else:
            out.append(re.escape(c))
        k += 1
    return "^" + "".join(out) + "$"


def read_patterns(text: str) -> list[str]:
    return [p for line in text.splitlines() if (p := line.strip()) and not p.startswith("#") and (p := p.strip("/"))]


def load_patterns(root: str) -> list[str]:
    """Defaults and the lines of the first that exists: the ignore file, <config>/ignore, <config>ignore."""
    for name in (IGNORE_FILE, f"{CONFIG_DIR}/ignore", f"{CONFIG_DIR}ignore"):
        path = os.path.join(root, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                return [*DEFAULTS, *read_patterns(f.read())]
    return list(DEFAULTS)


def matcher(patterns: list[str]):
    """The same test as ``ignored`` for one path, by a function; for walks on the driver."""
    names, globs = frozenset(patterns), [re.compile(g) for p in patterns if (set(p) & set("*?[\\")) and (g := glob_regex(p))]
    above = tuple(p + "/" for p in patterns if "/" in p)

    def test(path: str) -> bool:
        segments = path.split("/")
        return not names.isdisjoint(segments) or path in names or path.startswith(above) or any(g.search(path) or any(map(g.search, segments)) for g in globs)

    return test


def _matches(regex: str):
    return lambda segment: segment.rlike(regex)


def ignored(path, patterns: list[str] | None = None):
    """Whether a relative path is ignored: some pattern equals a segment or the path, globs either, or is a folder above it."""
    patterns = list(DEFAULTS) if patterns is None else patterns
    segments = F.split(path, "/")
    names = F.array(*[F.lit(p) for p in patterns])
    globs = [g for p in patterns if (set(p) & set("*?[\\")) and (g := glob_regex(p))]
    tests = [F.arrays_overlap(segments, names), path.isin(*patterns)]
    tests += [path.rlike(g) | F.exists(segments, _matches(g)) for g in globs]
    tests += [path.startswith(p + "/") for p in patterns if "/" in p]
    return reduce(lambda a, b: a | b, tests)
