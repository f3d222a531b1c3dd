"""The jobs on copies of small inputs: growing input, reruns, runs that were broken off, dates."""

import json
import re
from collections import defaultdict
from hashlib import sha256
from pathlib import Path

import duckdb
import pytest

from jobs import copied_passages, health_history
from jobs.common import command
from jobs.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string"


def brute(rows, window=3):
    places = defaultdict(list)
    for doc, text, _, source in rows:
        lines = [(i + 1, s) for i, x in enumerate((text or "").split("\n")) if (s := re.sub(r"^ | $", "", re.sub(r"[ \t\r\f\x0b]+", " ", x)))]
        for k in range(max(len(lines) - window + 1, 1)) if lines else ():
            places[source, sha256("\n".join(s for _, s in lines[k : k + window]).encode()).hexdigest()].append((doc, lines[k][0]))
    return {(s, d): (len(p), len({doc for doc, _ in p}), *min(p)) for (s, d), p in places.items() if len(p) > 1}


def result(spark, out):
    rows = copied_passages.report(spark, out).collect()
    got = {(r.source, r.digest): (r.n_places, r.n_docs, r.first_doc, r.first_line) for r in rows}
    assert len(got) == len(rows)
    return got


FIRST = [
    (1, "a\nb\nc\nd", "en", "x"),
    (2, " a \n\n b\nc\t\nz", "en", "x"),
    (3, "one line", "en", "x"),
    (4, None, "en", "x"),
    (5, "", "en", None),
    (6, "a\nb\nc", "en", None),
    (7, "a\nb\nc", "en", "y"),
]
SECOND = [(8, "a\nb\nc", "en", "y"), (9, "q\nq\nq\nq\nq", "en", "z"), (10, "one  line", "en", "x"), (11, "\n \n", "en", "")]


def test_copied_passages_of_growing_input(spark, tmp_path):
    docs, out, check = f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/check"
    job = lambda **more: copied_passages.run(spark, docs, out, check, parts=4, spread=2, **more)
    put = lambda rows: spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(docs)
    put(FIRST)
    assert job()["documents"] == len(FIRST)
    assert result(spark, out) == brute(FIRST)
    files = sorted(str(p) for p in Path(out).rglob("*.parquet"))
    assert job() == {"documents": 0, "parts": 0, "rows": 0}
    assert sorted(str(p) for p in Path(out).rglob("*.parquet")) == files

    put(SECOND)
    put([SECOND[0]])
    done = job(files_per_batch=1)
    assert done["documents"] == len(SECOND) + 1 and done["parts"] < 4 + 1
    assert result(spark, out) == brute(FIRST + SECOND + [SECOND[0]])


def test_a_run_broken_off_after_the_stream_is_made_good(spark, tmp_path):
    docs, out, check = f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/check"
    spark.createDataFrame(FIRST, DOCS).write.parquet(docs)
    copied_passages._settle(spark, out, (3, 4, "[]"))
    copied_passages._take(spark, docs, out, check, 3, 4, 2, None, ())
    assert result(spark, out) == {}
    assert copied_passages.run(spark, docs, out, check, parts=4)["documents"] == 0
    assert result(spark, out) == brute(FIRST)


def test_only_touched_partitions_are_made_anew(spark, tmp_path):
    docs, out, check = f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/check"
    spark.createDataFrame([(k, "a\nb\nc", "en", f"s{k % 40}") for k in range(80)], DOCS).write.parquet(docs)
    job = lambda: copied_passages.run(spark, docs, out, check, parts=16)
    first = job()
    assert first["parts"] > 8 and first["rows"] == 40
    spark.createDataFrame([(100, "a\nb\nc", "en", "s7")], DOCS).write.mode("append").parquet(docs)
    second = job()
    assert second["documents"] == 1 and second["parts"] == 1 and second["rows"] < 20


def test_ignored_documents_and_empty_input(spark, tmp_path):
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    spark.createDataFrame([], DOCS).write.parquet(docs)
    assert copied_passages.run(spark, docs, out, f"{tmp_path}/c", ignore=["y"]) == {"documents": 0, "parts": 0, "rows": 0}
    assert copied_passages.report(spark, out).collect() == []
    spark.createDataFrame(FIRST + SECOND, DOCS).write.mode("append").parquet(docs)
    copied_passages.run(spark, docs, out, f"{tmp_path}/c", ignore=["y"])
    assert result(spark, out) == brute([r for r in FIRST + SECOND if r[3] != "y"])


def test_settings_belong_to_the_output(spark, tmp_path):
    spark.createDataFrame(FIRST, DOCS).write.parquet(f"{tmp_path}/docs")
    job = lambda **more: copied_passages.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/c", **more)
    job(window=2)
    assert result(spark, f"{tmp_path}/out") == brute(FIRST, 2)
    with pytest.raises(ValueError, match="begun with"):
        job(window=3)
    assert job(window=2)["documents"] == 0


def test_a_hot_source_and_passage(spark, tmp_path):
    rows = [(k, "same\nlines\nhere", "en", "hot") for k in range(3000)] + [(5000 + k, f"own {k}", "en", "hot") for k in range(50)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/docs")
    copied_passages.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/c")
    assert result(spark, f"{tmp_path}/out") == brute(rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_twin(spark, duck, name):
    from collections import Counter

    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    df = QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    want = Counter(str([row[names.index(c)] for c in cols]) for row in r.fetchall())
    assert want and Counter(str([r[c] for c in cols]) for r in df.collect()) == want
    assert before == {k: spark.conf.get(k, None) for k in before}


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_health_history_over_dates(spark, tmp_path):
    out = f"{tmp_path}/out"
    shown = lambda date, status: {(r.finding, r.subject, r.file_path, r.detail) for r in health_history.report(spark, out).where(f"as_of = '{date}' and status = '{status}'").collect()}
    first = health_history.run(spark, str(SF), out, "2026-01-05", [("ASIA", "EUROPE")])
    assert first["new"] == first["n"] > 0 and first["before"] is None
    later = health_history.run(spark, str(SF), out, "2026-01-12", [("CHINA", "")])
    assert later["before"] == "2026-01-05" and later["known"] > 0
    old_rules, new_rules = shown("2026-01-12", "gone"), shown("2026-01-12", "new")
    assert old_rules and {x[1] for x in old_rules if x[0] == "boundary violation"} == {"ASIA -> EUROPE"}
    assert {x[1] for x in new_rules if x[0] == "boundary violation"} <= {"CHINA -> "}
    again = health_history.run(spark, str(SF), out, "2026-01-12", [("CHINA", "")])
    assert again == later and shown("2026-01-12", "gone") == old_rules
    back = health_history.run(spark, str(SF), out, "2026-01-05", [("ASIA", "EUROPE")])
    assert back == first
    third = health_history.run(spark, str(SF), out, "2026-01-19", [("CHINA", "")])
    assert third["gone"] == third["new"] == 0 and third["known"] == later["n"] - later["gone"]


def test_command_line(spark, tmp_path, monkeypatch):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"documents": "d", "output": "o", "window": 2}))
    seen, stopped = {}, []

    def job(spark, documents, output, window=3, ignore=()):
        seen.update(documents=documents, output=output, window=window, ignore=ignore)
        return {"n": 1}

    class Session:
        builder = None

        def stop(self):
            stopped.append(1)

    class Builder:
        appName = lambda self, n: self
        getOrCreate = lambda self: Session()

    Session.builder = Builder()
    monkeypatch.setattr("jobs.common.SparkSession", Session)
    assert command(job, "t", [str(config), "--window", "5", "--ignore", '["x"]', "--output", "p"]) == {"n": 1}
    assert seen == {"documents": "d", "output": "p", "window": 5, "ignore": ["x"]} and stopped == [1]
    config.write_text('{"nothing": 1}')
    with pytest.raises(SystemExit):
        command(job, "t", [str(config)])


def test_the_shipped_configurations_name_the_jobs_options():
    import inspect

    for job in (copied_passages, health_history):
        options = json.loads((Path(job.__file__).with_suffix(".json")).read_text())
        inspect.signature(job.run).bind(None, **options)


def test_the_command_line_runs_a_job(spark, tmp_path):
    """In a process of its own, twice: the log says what was read and written."""
    import os
    import subprocess
    import sys

    spark.createDataFrame(FIRST, DOCS).write.parquet(f"{tmp_path}/docs")
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"documents": f"{tmp_path}/docs", "output": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/c", "parts": 4}))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    root = Path(copied_passages.__file__).parent.parent
    said = [subprocess.run([sys.executable, "-m", "jobs.copied_passages", str(config), "--spread", "2"], cwd=root, env=env, capture_output=True, text=True, timeout=300, check=True).stderr for _ in range(2)]
    assert "read 7 new documents" in said[0] and "read 0 new documents" in said[1] and "wrote 0 rows of 0 partitions" in said[1]
    assert result(spark, f"{tmp_path}/out") == brute(FIRST)
