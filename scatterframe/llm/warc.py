"""WARC archives written and read by Spark, with segmented records and chunked transfer framing.

Writing: each page gives one record.  Of records with equal payloads of at
least ``least`` bytes, that with the largest id is the ``response`` and the
others are ``revisit`` records without a payload; shorter payloads are all
responses.  Payloads are sent in HTTP chunks, and a record block above
``segment`` bytes is cut into one record and ``continuation`` records.  A record
and its closing blank lines are one line of Spark's text writer, whose line
separator is the record separator of the format.

Reading: files are read whole (their size is bounded by ``per_file`` records)
and cut by Content-Length.  Continuation records are grouped by the record they
belong to, ordered by segment number and checked against the total length;
then the HTTP block is split and its chunks are decoded.  A record with a
missing segment, a wrong length or broken framing raises an error.

Defined results: a null payload is an empty one, which gives a response record
of length 0.  A null id is kept, counts as the smallest and then is a revisit of
the largest id, if there is one.  Rows with the largest id and equal payloads
are all responses; repeated rows are all written and read back.  An empty table
gives no records.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized

SEPARATOR = "\r\n\r\n"
LEAST = 1000
SEGMENT = 64 << 10
CHUNK = 8 << 10
PER_FILE = 500
DATE = "2020-01-01T00:00:00Z"


def _cuts(data: bytes, step: int) -> list[bytes]:
    """Pieces of about ``step`` bytes, never cut inside a character of UTF-8 text."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + step)
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, step: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cuts(payload, step)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if len(out[-1]) != size or body[at : at + 2] != b"\r\n":
            raise ValueError("broken chunk framing")
        at += 2


def _record(kind: str, name: str, block: bytes, **fields) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines) + SEPARATOR + block.decode("utf-8", "surrogateescape")


def records_of(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers: int | None, number: int, segment: int = SEGMENT) -> Iterator[str]:
    """The record of a page, and its continuations."""
    name = f"<urn:page:{'null' if page_id is None else page_id}:{number}>"
    uri = None if uri is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in uri)
    common = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest}", "Page_ID": page_id}
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        block = f"{head}Content-Length: {len(payload)}{SEPARATOR}".encode()
        yield _record("revisit", name, block, **common, Refers_To_Page=refers)
        return
    block = f"{head}Transfer-Encoding: chunked{SEPARATOR}".encode() + chunked(payload)
    parts = _cuts(block, segment)
    yield _record("response", name, parts[0], **common, WARC_Segment_Number=1 if len(parts) > 1 else None)
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        yield _record("continuation", f"{name[:-1]}:{k}>", part, WARC_Segment_Origin_ID=name, WARC_Segment_Number=k, WARC_Segment_Total_Length=total)


def write_archive(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = LEAST, segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(uri).alias("uri"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    sizes = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(sized(sizes.where("n > 1").select("digest", "keeper"), 80), "digest", "left").withColumn("number", F.monotonically_increasing_id())

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, u, p, d, k, n in zip(b["id"], b["uri"], b["payload"], b["digest"], b["keeper"], b["number"]):
                i, k = (None if pd.isna(x) else int(x) for x in (i, k))
                out += records_of(i, u, bytes(p), d, None if k is None or k == i else k, n, segment)
            yield pd.DataFrame({"value": out}, dtype=object)

    rows.mapInPandas(emit, "value string").write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(block) != size or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        at += 4
        yield fields, block


PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_RAW = "origin string, number int, total long, head string, block binary"


def _page(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda k: int(fields[k]) if k in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    head, body = block.split(b"\r\n\r\n", 1)
    http = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    if fields["WARC-Type"] == "revisit":
        return number("Page-ID"), int(http["Content-Length"]), digest, "revisit", number("Refers-To-Page"), None
    payload = unchunked(body) if http.get("Transfer-Encoding") == "chunked" else body
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload's digest is wrong")
    return number("Page-ID"), len(payload), digest, "response", None, payload


def _frame(rows: list[tuple], payload: bool) -> pd.DataFrame:
    names = [c.split()[0] for c in PAGE.split(", ")]
    out = pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})
    return out if payload else out.drop(columns="payload")


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each page, with the payload if asked for."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = PAGE if payload else PAGE.rsplit(", ", 1)[0]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = []
                for fields, block in parse(bytes(data)):
                    segment = "WARC-Segment-Number" in fields
                    row = (None,) * 6 if segment else _page(fields, block)
                    if segment:
                        origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
                        rows.append(row + (origin, int(fields["WARC-Segment-Number"]), int(fields.get("WARC-Segment-Total-Length", -1)), "\n".join(f"{k}: {v}" for k, v in fields.items()), block))
                    else:
                        rows.append(row + (None,) * 5)
                out = _frame([r[:6] for r in rows], payload)
                for k, name in enumerate(["origin", "number", "total", "head", "block"], 6):
                    out[name] = pd.Series([r[k] for r in rows], dtype="Int64" if name in ("number", "total") else object)
                yield out

    def join(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("number").drop_duplicates("number")
        block, total = b"".join(map(bytes, parts["block"])), int(parts["total"].iloc[-1])
        if list(parts["number"]) != list(range(1, len(parts) + 1)) or len(block) != total:
            raise ValueError(f"segments of {key[0]} are missing")
        fields = dict(x.split(": ", 1) for x in parts["head"].iloc[0].split("\n"))
        return _frame([_page(fields, block)], payload)

    rows = files.mapInPandas(cut, f"{schema}, {_RAW}")
    names = [c.split()[0] for c in schema.split(", ")]
    whole = rows.where("origin is null").select(*names)
    cut_up = rows.where("origin is not null").select("origin", "number", "total", "head", "block")
    return whole.union(cut_up.groupBy("origin").applyInPandas(join, schema))
