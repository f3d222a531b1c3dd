"""Source trees as DataFrames: a distributed scan, versions from git, boundary rules and references."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..schema import CONFIG_DIR, EXTENSIONS, IGNORE_FILE, RULES_FILE
from .ignore import DEFAULTS, glob_regex, ignored
from .tree import checked_ref, register


def _tree(spark: SparkSession, root: str, patterns: list[str] | None, **options: str) -> DataFrame:
    register(spark)
    if patterns is not None:
        options["patterns"] = json.dumps(patterns)
    files = spark.read.format("sourcetree").options(root=root if "://" in root else os.path.abspath(root), **options).load()
    return files.select("path", "content", F.sha2("content", 256).alias("hash"), "last_modified")


def _remote(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """A tree on a file system that only Spark reaches.  Tests of the path are tests of the file's metadata, so
    Spark decides them while it plans the scan, and no ignored file is opened.  Spark's own listing leaves out
    empty files and names that begin with a dot or an underscore."""
    at = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9+.-]+:(//[^/]*)?(?=/)", "")
    path = F.try_url_decode(F.regexp_replace(F.substring(at, len(re.sub(r"^[a-z0-9+.-]+://[^/]*", "", root.rstrip("/"))) + 2, 1 << 30), r"\+", "%2B"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = files.where(extension(path).isin(*EXTENSIONS)).where(~ignored(path, patterns))
    for glob in (g for p in patterns if "/" in p and (g := glob_regex(p))):  # a folder that a glob names
        kept = kept.where(~path.rlike(glob.removesuffix("$") + "/"))
    return kept.select(path.alias("path"), "content", F.sha2("content", 256).alias("hash"), F.col("modificationTime").cast("long").alias("last_modified"))


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(path relative to root, content, hash, last_modified) of the source files that are not ignored.

    Ignored folders are not entered and ignored files are not opened.  Of a root on another file system than
    that of the machines, ``patterns`` must be given: its ignore file is not read.
    """
    if "://" in root and not root.startswith("file://"):
        return _remote(spark, root, list(DEFAULTS) if patterns is None else patterns)
    return _tree(spark, root, patterns)


def scan_paths(spark: SparkSession, root: str, paths: list[str], patterns: list[str] | None = None) -> DataFrame:
    """The same of the given files alone, those that exist; nothing else is read."""
    return _tree(spark, root, patterns, paths=json.dumps(paths))


def scan_git(spark: SparkSession, root: str, ref: str, patterns: list[str] | None = None) -> DataFrame:
    """The same for a git revision: folders are dealt to tasks, which list and read their own files."""
    return _tree(spark, root, patterns, ref=checked_ref(ref))


def boundary_rules(root: str) -> list[tuple[str, str]]:
    """The (from, to) rules of a workspace; none without a file, and an error for a malformed one."""
    path = os.path.join(root, CONFIG_DIR, RULES_FILE)
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [(r.get("from_pattern", ""), r.get("to_pattern", "")) for r in json.load(f)]


def init(root: str) -> None:
    """Make the configuration folder and a starter ignore file where they are missing."""
    os.makedirs(os.path.join(root, CONFIG_DIR), exist_ok=True)
    path = os.path.join(root, IGNORE_FILE)
    if not os.path.exists(path):
        with open(path, "w", encoding="utf-8") as f:
            f.write("# One pattern a line: a name, a path or a glob.\n")
