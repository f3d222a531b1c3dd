"""The pruning source: what is entered, what is opened, what is pushed down."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from arborlens.sources import tree, workspace
from arborlens.sources.ignore import DEFAULTS

FILES = {
    "a.go": "a",
    "Top.PY": "b",
    "notes.txt": "not source",
    "src/b.py": "c",
    "src/deep/er/c.ts": "d",
    "src/node_modules/x.js": "ignored",
    "node_modules/y/z.js": "ignored",
    ".git_like/d.java": "e",
    "gen/api_pb.go": "ignored",
    "gen/api.go": "f",
    "docs/old/e.py": "ignored",
    "docs/new/e.py": "g é\n",
    "empty.py": "",
    "lib/x1/gone/a.py": "ignored",
    "lib/y1/a.py": "j",
    "pkg/__init__.py": "i",
    "sp ace/ü 1.js": "h",
}
IGNORE = "# own\n*_pb.go\n/docs/old/\nlib/x?\n"
KEPT = {p: t for p, t in FILES.items() if not t.startswith(("ignored", "not "))}


@pytest.fixture()
def root(tmp_path):
    for p, text in FILES.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text, encoding="utf-8")
    (tmp_path / ".arborignore").write_text(IGNORE)
    return tmp_path


def read(df):
    rows = df.collect()
    got = {r.path: bytes(r.content).decode() for r in rows}
    assert len(got) == len(rows)
    return got


def source(spark, root, **options):
    tree.register(spark)
    return spark.read.format("sourcetree").options(root=str(root), **options).load()


@pytest.mark.parametrize("parts", [1, 3, 128])
def test_scan_of_a_folder(spark, root, parts):
    df = source(spark, root, partitions=str(parts))
    assert read(df) == KEPT
    assert read(workspace.scan(spark, str(root))) == read(workspace.scan(spark, f"file://{root}")) == KEPT
    hashes = {r.path: r.hash for r in workspace.scan(spark, str(root)).collect()}
    assert hashes["a.go"] == "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"


def test_ignored_files_are_never_opened(spark, root):
    """Sparse files of 3 GB, which no row could hold, and one that nobody may read."""
    for p in ("node_modules/huge.js", "src/huge_pb.go", "docs/old/huge.py", "huge.bin"):
        with open(root / p, "wb") as f:
            f.truncate(3 << 30)
    assert read(workspace.scan(spark, str(root))) == KEPT
    with open(root / "src/huge.py", "wb") as f:
        f.truncate(3 << 30)
    assert read(source(spark, root, max_size="1000000")) == KEPT
    assert read(source(spark, root, paths='["src/b.py"]')) == {"src/b.py": "c"}
    assert read(workspace.scan_paths(spark, str(root), ["src/b.py", "gen/api.go", "gone.py", "gen/api_pb.go"])) == {"src/b.py": "c", "gen/api.go": "f"}
    assert read(workspace.scan_paths(spark, str(root), [])) == {}


def entered(root, **options):
    reader = tree.SourceTree({"root": str(root), **options}).reader(None)
    seen = []
    of = reader.folders
    reader.folders = lambda f: (seen.append(f), of(f))[1]
    reader.partitions()
    return set(seen)


def test_folders_that_are_entered(root):
    assert entered(root) == {"", "src", "src/deep", "src/deep/er", ".git_like", "gen", "docs", "docs/new", "sp ace", "pkg", "lib", "lib/y1"}
    assert entered(root, prefix="src/de") == {"", "src", "src/deep", "src/deep/er"}
    assert entered(root, paths='["docs/new/e.py", "a.go"]') == {"", "docs", "docs/new"}
    assert entered(root, paths="[]") == {""}


def test_options_agree_with_filters(spark, root):
    whole = source(spark, root)
    for options, where in [({"prefix": "src/"}, "path like 'src/%'"), ({"paths": '["a.go", "x"]'}, "path in ('a.go', 'x')"), ({"max_size": "1"}, "size <= 1"), ({"extensions": '[".go", ".ts"]'}, "path like '%.go' or path like '%.ts'")]:
        assert read(source(spark, root, **options)) == read(whole.where(where)) != {}, where
    assert read(whole) == KEPT  # nothing of the filters before stays


def test_scan_of_a_revision(spark, root):
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    os.symlink("a.go", root / "link.go")
    git("add", "-A")
    git("commit", "-qm", "one")
    (root / "a.go").write_text("changed")
    git("rm", "-q", "src/b.py")
    git("add", "-A")
    git("commit", "-qm", "two")
    for parts in ("1", "4", "128"):
        assert read(source(spark, root, ref="HEAD~1", partitions=parts)) == KEPT
    assert read(workspace.scan_git(spark, str(root), "HEAD")) == {k: v for k, v in KEPT.items() if k != "src/b.py"} | {"a.go": "changed"}
    assert read(source(spark, root, ref="HEAD~1", prefix="docs/")) == {"docs/new/e.py": KEPT["docs/new/e.py"]}
    for bad in ("-x", "a b", "a;b", "", "--output=x"):
        with pytest.raises(ValueError):
            workspace.scan_git(spark, str(root), bad)
    with pytest.raises(Exception, match="could not list"):
        workspace.scan_git(spark, str(root), "nowhere").collect()


def test_many_folders_and_empty_roots(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"d{k % 30}" / f"e{k}").mkdir(parents=True)
        (tmp_path / f"d{k % 30}" / f"e{k}" / "f.py").write_text(str(k))
    df = source(spark, tmp_path, partitions="16")
    assert len(read(df)) == 300 and df.rdd.getNumPartitions() == 16
    (tmp_path / "d0" / "none").mkdir()
    assert read(source(spark, tmp_path / "d0" / "none")) == {}
    with pytest.raises(Exception, match="No such file"):
        source(spark, tmp_path / "gone").collect()


def test_remote_roots_are_pruned_by_metadata(spark, root):
    """Through another scheme; Spark opens no file whose path is out, so one that can't be a row does no harm."""
    with open(root / "node_modules/huge.js", "wb") as f:
        f.truncate(3 << 30)
    got = read(workspace._remote(spark, f"file://{root}", [*DEFAULTS, "*_pb.go", "docs/old", "lib/x?"]))
    assert got == {p: t for p, t in KEPT.items() if t and not any(x[0] in "._" for x in p.split("/"))}
