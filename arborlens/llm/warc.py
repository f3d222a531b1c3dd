"""WARC archives: revisit resolution, deduplicated writing with fresh headers, reading back."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

CRLF, FILE_BYTES = "\r\n", 128 << 20
READ_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """``(id, digest, refers_to)`` of the records that revisit another one.

    Of the records with equal payloads of ``min_bytes`` bytes or more, those with the largest id stay
    responses, the others revisit it.  Headers only are shuffled by digest; ids of a digest meet in one
    aggregate row.  A null id never is the largest unless all are null, then all stay responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    headers = pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= min_bytes)
    best = headers.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return headers.join(best, "digest").where(~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "digest", "refers_to").distinct()


def _record_id(col):
    """A URN that holds the id: 64 bits as a version-8 UUID, and its own one for a missing id."""
    h = F.lpad(F.lower(F.hex(F.coalesce(col, F.lit(0)))), 16, "0")
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(13, 3), F.lit("-8"), cut(16, 1), F.lit("00-00000000000"), F.when(col.isNull(), "1").otherwise("0"), F.lit(">"))


def _id_of(urn: str) -> int | None:
    h = urn.strip("<>").rpartition(":")[2].split("-")
    x = int(h[0] + h[1] + h[2][1:] + h[3][1], 16)
    return None if h[4][-1] == "1" else x - (1 << 64) if x >> 63 else x


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write one WARC/1.1 record per row to gzip files under ``path``, any folder Spark can write to.

    Responses hold an HTTP header and the payload; revisits (see ``resolve_revisits``) hold the HTTP header
    and name the response's record id.  Every header is made anew.  Null payloads are empty, a null url is
    written as an empty one, and white space in a url is percent-encoded.  A file takes as many records as
    have ``file_bytes`` bytes of payload on average.  Other columns are not read.
    """
    n, total = pages.agg(F.count("*"), F.sum(F.octet_length(payload_col))).first()
    records_per_file = max(1, min(1_000_000, n * file_bytes // max(1, total or 0)))
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    revisits = resolve_revisits(pages, id_col, payload_col, min_bytes)
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\s\p{Cntrl}]", "%20").alias("_url"), payload.alias("_payload"), F.sha1(payload.cast("binary")).alias("_digest"))
    rows = rows.join(revisits.alias("r"), F.col("_id").eqNullSafe(F.col("r.id")) & (F.col("_digest") == F.col("r.digest")), "left")
    again = F.col("refers_to").isNotNull()
    size = F.octet_length("_payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF * 2))
    body = F.when(again, http).otherwise(F.concat(http, "_payload"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _record_id(F.col("_id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), F.col("_url"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("_digest"),
        F.when(again, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _record_id(F.col("refers_to")))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2),
    )
    # A record ends with two line ends, which the text writer sets after each row.
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record; a truncated or malformed record raises."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("the archive ends inside a header")
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(n := int(fields["content-length"]))
        if len(block) != n:
            raise ValueError("the archive ends inside a record")
        yield fields, block


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The response and revisit records under ``path``: ``READ_SCHEMA``, payload null for revisits.

    Each response's payload is checked against its digest.  Files are read whole, one at a time, and
    unpacked record by record.  ``payloads=False`` leaves the payload column null.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for f, block in records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)):
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if response := f["warc-type"] == "response":
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"the payload of {f['warc-record-id']} does not match its digest")
                        n = len(payload)
                    else:
                        n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    rows.append((_id_of(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], n, digest, _id_of(f["warc-refers-to"]) if "warc-refers-to" in f else None, payload if response and payloads else None))
                    held += len(payload)
                    if held > 16 << 20 or len(rows) >= 5000:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in READ_SCHEMA.split(", ")])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(parse, READ_SCHEMA)


def archive_round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and read their records back."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_bytes=min_bytes)
    return read_warc(pages.sparkSession, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
