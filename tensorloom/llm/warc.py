"""WARC archives as seekable Zstandard bundles.

`write_bundles` turns pages into WARC/1.1 records.  Records are grouped into independent Zstandard frames of about 64 KB,
frames into bundles of about 4 MB; a bundle ends in a seek table (a skippable frame of sizes, in the public seekable
format), and an index maps each record to bundle, frame and place within the frame.  Bundles are rows of a table that
Spark writes to the shared folder, so they survive lost executors and need no local files; each is also a complete
.warc.zst file, since all Zstandard readers skip the seek table.

Of records with equal payloads of REVISIT_BYTES or more, those of the largest page_id are responses, others revisits
that refer to it; smaller ones are responses.  Null html: an empty payload.  Null page_ids: less than all others; a group
of null ids alone has responses only.  Repeated page_ids: all rows of the largest are responses.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

REVISIT_BYTES = 1000
FRAME_BYTES, BUNDLE_BYTES = 1 << 16, 4 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_BUNDLE = "bundle long, data binary, records array<struct<record_id:string,frame:int,offset:long,length:long>>"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_RECORD_TYPES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, number: str) -> bytes:
    """One WARC record.  Line ends in a url are escaped; the payload of a revisit is left out."""
    kind = "response" if refers_to is None else "revisit"
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{number}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload)), "Content-Type": "text/html",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": str(refers_to)}
        payload = b""
    head["Content-Length"] = str(len(payload))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + payload + b"\r\n\r\n"


def bundle_of(records: list[tuple[str, bytes]]) -> tuple[bytes, list[dict]]:
    """Frames, seek table, and the index of the records."""
    z, out, sizes, index, now = zstandard.ZstdCompressor(level=3), [], [], [], []

    def close() -> None:
        raw = b"".join(now)
        c = z.compress(raw)
        out.append(c)
        sizes.append((len(c), len(raw)))
        now.clear()

    size = 0
    for name, r in records:
        if now and size + len(r) > FRAME_BYTES:
            close()
            size = 0
        index.append({"record_id": name, "frame": len(out), "offset": size, "length": len(r)})
        now.append(r)
        size += len(r)
    if now:
        close()
    table_ = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return b"".join(out) + struct.pack("<II", SKIPPABLE, len(table_)) + table_, index


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, read from the footer."""
    n, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    sizes = struct.iter_unpack("<II", data[len(data) - 9 - 8 * n : len(data) - 9])
    out, at = [], 0
    for c, d in sizes:
        out.append((at, c, d))
        at += c
    return out


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    start, c, d = frame
    return zstandard.ZstdDecompressor().decompress(data[start : start + c], max_output_size=max(d, 1))


def parse(r: bytes) -> dict:
    head, _, rest = r.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    payload = rest[: int(h["Content-Length"])]
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't have its digest")
    number = lambda x: int(x) if x else None
    return {"page_id": number(h["X-Page-ID"]), "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": number(h.get("X-Refers-To-Page-ID")), "url": h["WARC-Target-URI"], "payload": payload if h["WARC-Type"] == "response" else None}


def _write(batches):
    part, seq, n, now, size = TaskContext.get().partitionId(), 0, 0, [], 0

    def close():
        data, index = bundle_of(now)
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq]), pa.array([data], pa.binary()), pa.array([index], pa.list_(_INDEX))], names=["bundle", "data", "records"])

    for b in batches:
        for i in range(0, b.num_rows, 256):
            for row in b.slice(i, 256).to_pylist():
                number = f"{part}-{n}"
                r = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], number)
                n += 1
                now.append((number, r))
                size += len(r)
                if size >= BUNDLE_BYTES:
                    yield close()
                    seq, now, size = seq + 1, [], 0
    if now:
        yield close()


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The table of bundles: bundle, data (a .warc.zst file), records (the index)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # only groups of two rows or more need to be told to others: few rows, and the group's row count is summed first
    groups = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null").select("d", "largest")
    groups = materialize(groups, "revisits")
    told = rows.join(groups, (F.col("digest") == F.col("d")) & (F.octet_length("payload") >= REVISIT_BYTES), "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("largest")), None).otherwise(F.col("largest"))
    return materialize(told.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(_write, _BUNDLE), "bundles")


def _read(batches):
    for b in batches:
        for i in range(b.num_rows):
            data, index = b.column("data")[i].as_py(), b.column("records")[i].as_py()
            frames = seek_table(data)
            at, raw, rows = -1, b"", []
            for x in index:
                if x["frame"] != at:
                    at, raw = x["frame"], read_frame(data, frames[x["frame"]])
                rows.append(parse(raw[x["offset"] : x["offset"] + x["length"]]))
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_TYPES)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record, by the index: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    return bundles.select("data", "records").mapInArrow(_read, _RECORD)


def fetch(bundles: DataFrame, record_ids: list[str]) -> DataFrame:
    """Some records by id: only their frames are unpacked."""
    want = F.filter("records", lambda r: r.record_id.isin(record_ids))
    return bundles.withColumn("records", want).where(F.size("records") > 0).select("data", "records").mapInArrow(_read, _RECORD)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_bundles(write_bundles(table(spark, sf_dir, "pages")))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT h, max(page_id) AS largest FROM d WHERE n >= {REVISIT_BYTES} GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, d.h AS payload_digest,
  CASE WHEN largest IS NULL OR page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM d LEFT JOIN g ON d.h = g.h AND n >= {REVISIT_BYTES}
"""

__all__ = ["bundle_of", "fetch", "op8", "parse", "read_bundles", "read_frame", "record", "seek_table", "write_bundles"]
