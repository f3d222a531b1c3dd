"""Every registered query of the library against its DuckDB twin on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from arborlens.plans.catalogue import ORACLES, QUERIES, flagship

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    got = Counter(str([r[c] for c in cols]) for r in df.collect())
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == Counter(str([row[names.index(c)] for c in cols]) for row in r.fetchall())


def test_report_and_flagship(spark):
    assert "## 5. Metrics" in QUERIES["markdown_report"](spark, str(SF)).first().report
    assert flagship(spark, str(SF)).count() > 0
