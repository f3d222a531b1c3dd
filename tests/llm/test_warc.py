import gzip
import hashlib
import io

import pytest

from arborlens.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, refers_to long"


def pages():
    big, other = "é" * 600 + "<p>x</p>\r\n\r\nWARC/1.1\r\n", "y" * 1000
    rows = [(k, f"http://h/{k}", big) for k in (3, 9, 4, -7)] + [(20, "u", other), (21, "u", other + "z"), (22, None, None), (23, "", ""), (24, "a b\r\nWARC-Type: x", "short"), (25, "v", "short")]
    rows += [(30, "w", "q" * 2000), (30, "w", "q" * 2000), (31, "w", "q" * 2000), (None, "n", "r" * 1500), (None, "n", "r" * 1500), (40, "m", "r" * 1500), (50, "long", "l" * 3_000_000)]
    return [(*r, "clash", 1) for r in rows]


def want(rows):
    best = {}
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    out = []
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        again = len(b) >= 1000 and b in best and i != best[b]
        out.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[b] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages()
    got = warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(((str(r.page_id), *r[1:]) for r in got), key=str) == want(rows)


def test_archives(spark, tmp_path):
    rows = pages()
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/a", file_bytes=2000)
    back = warc.read_warc(spark, f"file://{tmp_path}/a").collect()
    assert {bytes(r.payload).decode() for r in back if r.record_type == "response"} == {r[2] or "" for r in rows}
    assert all(r.payload is None for r in back if r.record_type == "revisit")
    assert {r.page_id for r in back} == {r[0] for r in rows}
    file = next((tmp_path / "a").glob("*.gz"))
    head, _ = next(warc.records(io.BytesIO(gzip.decompress(file.read_bytes()))))
    assert head["warc-record-id"].startswith("<urn:uuid:") and "warc-date" in head
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"no archive")))


def test_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
