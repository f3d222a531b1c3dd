"""Source trees as a partitioned data source that prunes before it reads.

``spark.read.format("sourcetree").option("root", folder)`` reads the source files below a folder that driver and
executors both see; with ``option("ref", revision)`` it reads them from a git revision of it.  Ignored folders
are never entered, and no ignored file is opened or read from git, however large.  The options ``paths``,
``prefix`` and ``max_size`` keep more folders from being entered and files from being opened.  They are
options and no pushed filters, because Spark 4.1 keeps what was pushed into a Python source for later queries
over the same DataFrame, which would then miss rows.
"""

from __future__ import annotations

import json
import os
import re
import stat
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import EXTENSIONS
from .ignore import load_patterns, matcher

SCHEMA = "path string, content binary, size long, last_modified long"
ARROW = pa.schema([("path", pa.string()), ("content", pa.binary()), ("size", pa.int64()), ("last_modified", pa.int64())])
#: Bytes of content in one batch of rows; a larger file is a batch of its own.
BATCH = 8 << 20


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(SourceTree)


def checked_ref(ref: str) -> str:
    """A git revision that can't be taken for an option or more than one argument."""
    if not re.fullmatch(r"[\w./@^~][\w./@^~-]*", ref):
        raise ValueError(f"not a revision: {ref!r}")
    return ref


class SourceTree(DataSource):
    """Options: ``root``; ``ref``, a git revision; ``patterns``, a JSON list in place of the root's ignore file;
    ``extensions``, a JSON list (lower case); ``paths``, a JSON list of the only files wanted; ``prefix``, how all
    paths wanted begin; ``max_size`` in bytes; ``partitions``, how many folders at least are dealt out (128)."""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        root = re.sub(r"^file:(//)?(?=/)", "", o["root"]).rstrip("/") or "/"
        listed = lambda name, default: json.loads(o[name]) if name in o else default
        patterns = listed("patterns", None)
        size = int(o["max_size"]) if "max_size" in o else None
        rules = Rules(load_patterns(root) if patterns is None else patterns, tuple(listed("extensions", EXTENSIONS)), listed("paths", None), o.get("prefix", ""), size)
        if "ref" in o:
            return _GitReader(root, rules, int(o.get("partitions", 128)), checked_ref(o["ref"]))
        return _FolderReader(root, rules, int(o.get("partitions", 128)))


class Rules:
    """Which folders are entered and which files are opened."""

    def __init__(self, patterns: list[str], extensions: tuple[str, ...], paths: list[str] | None = None, prefix: str = "", max_size: int | None = None):
        self.given = patterns, extensions, paths, prefix, max_size
        self.extensions, self.prefix, self.max_size = extensions, prefix, max_size
        self.ignored = matcher(patterns)
        self.paths = None if paths is None else frozenset(paths)
        self.above = frozenset(p[:k] for p in paths or () for k, c in enumerate(p) if c == "/")

    def __reduce__(self):
        return Rules, self.given

    def enters(self, folder: str) -> bool:
        """Whether a folder (relative, without a slash at its end) can hold files that are wanted."""
        inside = folder + "/"
        if not (inside.startswith(self.prefix) or self.prefix.startswith(inside)) or (self.paths is not None and folder not in self.above):
            return False
        return not self.ignored(folder)

    def named(self, path: str) -> bool:
        """Whether a file is wanted as far as its path tells."""
        if os.path.splitext(path)[1].lower() not in self.extensions or not path.startswith(self.prefix) or (self.paths is not None and path not in self.paths):
            return False
        return not self.ignored(path)

    def reached(self, path: str, known: dict[str, bool]) -> bool:
        """Whether a walk would come to a file: each folder above it is entered.  ``known`` keeps what was found out."""
        folder = path.rpartition("/")[0]
        if not folder:
            return True
        if folder not in known:
            known[folder] = self.reached(folder, known) and self.enters(folder)
        return known[folder]

    def sized(self, size: int) -> bool:
        return self.max_size is None or size <= self.max_size


@dataclass
class Part(InputPartition):
    """Folders of one task: ``whole`` with all below them, ``own`` with their own files alone."""

    whole: list[str]
    own: list[str]

    def __init__(self, whole: list[str], own: list[str]):
        super().__init__(None)
        self.whole, self.own = whole, own


class _Reader(DataSourceReader):
    """Opens folders from the root down until there are enough to deal out; what lies below them is walked by tasks."""

    def __init__(self, root: str, rules: Rules, wanted: int):
        self.root, self.rules, self.wanted = root, rules, wanted

    def folders(self, folder: str) -> list[str]:
        """The folders directly in a folder ('' is the root) that can hold wanted files."""
        raise NotImplementedError

    def partitions(self) -> list[Part]:
        whole, own = [""], []
        while whole and len(whole) + len(own) < self.wanted:
            level, deeper = whole, []
            for f in level:
                deeper.extend(self.folders(f))
                own.append(f)
            whole = deeper
        n = max(1, min(self.wanted, len(whole) + len(own)))
        return [Part(whole[k::n], own[(n - 1 - k) :: n]) for k in range(n)]

    def files(self, part: Part) -> Iterator[tuple[str, bytes, int, int]]:
        raise NotImplementedError

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self.files(part):
            if rows and held + row[2] > BATCH:
                yield self._batch(rows)
                rows, held = [], 0
            rows.append(row)
            held += row[2]
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class _FolderReader(_Reader):
    """Files of a folder.  Links to files are read, links to folders are not entered; what goes meanwhile is left out."""

    def _list(self, folder: str) -> tuple[list[str], list[os.DirEntry]]:
        folders, files = [], []
        at = folder + "/" if folder else ""
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        if self.rules.enters(at + e.name):
                            folders.append(at + e.name)
                    elif self.rules.named(at + e.name):
                        files.append(e)
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            if not folder:
                raise
        return sorted(folders), sorted(files, key=lambda e: e.name)

    def folders(self, folder: str) -> list[str]:
        return self._list(folder)[0]

    def files(self, part: Part) -> Iterator[tuple[str, bytes, int, int]]:
        waiting = [(f, True) for f in part.whole] + [(f, False) for f in part.own]
        while waiting:
            folder, below = waiting.pop()
            folders, files = self._list(folder)
            if below:
                waiting.extend((f, True) for f in folders)
            for e in files:
                try:
                    s = e.stat()
                    if stat.S_ISREG(s.st_mode) and self.rules.sized(s.st_size):
                        with open(e.path, "rb") as f:
                            content = f.read()
                        yield os.path.relpath(e.path, self.root), content, len(content), int(s.st_mtime)
                except OSError:
                    continue


class _GitReader(_Reader):
    """Files of a git revision.  A task lists the names below its folders and asks git for the contents of the kept ones, one by one."""

    def __init__(self, root: str, rules: Rules, wanted: int, ref: str):
        super().__init__(root, rules, wanted)
        self.ref = ref

    def _git(self, *args: str) -> list[str]:
        return ["git", "-C", self.root, *args]

    def _names(self, folder: str, below: bool) -> Iterator[tuple[str, str, int, str]]:
        """(kind, object, size, path) of a folder's entries, or of all files below it; read from git as a stream."""
        command = self._git("ls-tree", "-z", "-l", "--full-tree", *(["-r"] if below else []), self.ref, "--", *([folder + "/"] if folder else []))
        with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
            rest = b""
            while block := run.stdout.read(1 << 20):
                *lines, rest = (rest + block).split(b"\0")
                for line in lines:
                    head, path = line.decode("utf-8", "surrogateescape").split("\t", 1)
                    mode, kind, name, size = head.split()
                    if mode != "120000":  # a link's content is a path
                        yield kind, name, int(size) if size != "-" else 0, path
            error = run.stderr.read().decode("utf-8", "replace")
        if run.returncode:
            raise RuntimeError(f"git could not list {self.ref}: {error.strip()}")

    def folders(self, folder: str) -> list[str]:
        return [p for kind, _, _, p in self._names(folder, False) if kind == "tree" and self.rules.enters(p)]

    def files(self, part: Part) -> Iterator[tuple[str, bytes, int, int]]:
        known: dict[str, bool] = {}
        with subprocess.Popen(self._git("cat-file", "--batch"), stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
            for folder, below in [(f, True) for f in part.whole] + [(f, False) for f in part.own]:
                for kind, name, size, path in self._names(folder, below):
                    if kind != "blob" or not self.rules.named(path) or not self.rules.sized(size) or not self.rules.reached(path, known):
                        continue
                    run.stdin.write(name.encode() + b"\n")
                    run.stdin.flush()
                    run.stdout.readline()
                    content = run.stdout.read(size)
                    run.stdout.read(1)
                    yield path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), content, size, 0
