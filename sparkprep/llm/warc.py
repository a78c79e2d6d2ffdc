"""WARC archives: a writer with segments and revisits, and a reader that reassembles them.

The writer makes one record per row: an HTTP response with chunked transfer framing, or a revisit where an earlier page
has the same payload. Blocks longer than a segment become a first record and continuations. Files are written by Spark's
text sink, whose line separator is the mark that ends a record, each file compressed as a whole. The reader walks records
by their Content-Length, groups continuations by the id of their origin, orders them by segment number, verifies the
total length and decodes the chunks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import python_columns, stored

VERSION = "WARC/1.1"
END = "\r\n\r\n"
UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f  ]")
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cuts(raw: bytes, size: int) -> list[bytes]:
    """UTF-8 bytes in parts of at most size bytes (4 at least), never inside a character; none for no bytes."""
    out, at, size = [], 0, max(4, size)
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in cuts(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body (chunk extensions and trailers are skipped), or None if its framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            many = int(body[at:line].split(b";")[0].strip() or b"x", 16) if line >= 0 else -1
        except ValueError:
            many = -1
        if many < 0 or line + 2 + many > len(body):
            return None
        if many == 0:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + many])
        at = line + 2 + many
        if body[at : at + 2] != b"\r\n":
            return None
        at += 2


def payload_of(block: bytes | None) -> bytes | None:
    """The payload of an HTTP message, or None if it cannot be read."""
    if block is None:
        return None
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None
    framed = any(re.match(rb"(?i)transfer-encoding:\s*chunked\s*$", h) for h in head.split(b"\r\n"))
    return unchunked(body) if framed else body


def _record(fields: dict, block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n{block.decode()}"


def records(page: str | None, url: str | None, payload: bytes, first: str | None, row: str, segment: int, chunk: int) -> Iterator[str]:
    """The records of one page, without the mark that ends each; first is the page it revisits."""
    name = f"<urn:uuid:{uuid.UUID(hashlib.md5(row.encode()).hexdigest())}>"
    fields = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": name,
        "WARC-Date": DATE,
        "WARC-Target-URI": UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else None,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Page-ID": page,
        "Content-Type": "application/http;msgtype=response",
    }
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": first}
        yield _record(fields, head + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = cuts(block, segment)
    for k, part in enumerate(parts, 1):
        if len(parts) > 1:
            fields["WARC-Segment-Number"] = k
        if k > 1:
            own = f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{row}/{k}'.encode()).hexdigest())}>"
            fields = {"WARC-Type": "continuation", "WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Segment-Number": k, "WARC-Segment-Origin-ID": name}
            if k == len(parts):
                fields["WARC-Segment-Total-Length"] = len(block)
        yield _record(fields, part)


def write(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, segment: int = 32_768, chunk: int = 8_192, file_records: int = 2_000
) -> None:
    """Archives of all rows below the path: gzip files of at most file_records records.

    A record's block is at most `segment` bytes, whatever the payload, so a file unpacks to at most file_records times that
    and a header each: some 66 MB with the defaults, which is what a reading task holds.

    Of rows with equal payloads of at least `least` bytes those with the smallest id are responses (an id that is repeated
    with the same payload gives as many responses), the others revisits of that id. A null html is an empty payload, a
    null url leaves the field out; a null id comes after all others.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("bytes", F.length("payload").cast("long"))
    same = rows.where(F.col("bytes") >= least).groupBy("sha", "bytes")
    same = same.agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    same = stored(same.drop("n"), "equal-payloads")  # small where copies are few; Spark sees its size and picks the join
    rows = rows.join(same, ["sha", "bytes"], "left").withColumn("row", F.monotonically_increasing_id())

    def made():
        def batch(b):
            at, out = [], []
            for i, (page, url, raw, first, row) in enumerate(zip(*(b.column(c).to_pylist() for c in ("page", "url", "payload", "first", "row")))):
                first = None if first is None or first == page else str(first)
                for r in records(None if page is None else str(page), url, raw, first, f"{page}/{row}", segment, chunk):
                    at.append(i), out.append(r)
            return at, {"value": out}

        return batch

    out = python_columns(rows, made, [], "value string")
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    """(fields with lower-case names, block) of every record of an archive, plain or in gzip members."""
    if raw[:2] == b"\x1f\x8b":
        parts = []
        while raw:
            one = zlib.decompressobj(31)
            parts.append(one.decompress(raw))
            raw = one.unused_data
        raw = b"".join(parts)
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.index(b"\r\n\r\n", at)
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (h.partition(":") for h in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]))
        start = end + 4
        at = start + int(fields["content-length"])
        yield fields, raw[start:at]


FIELDS = "record_id string, record_type string, page_id long, refers_to long, claimed string, segment int, total long, claimed_bytes long, block binary"


def read(spark: SparkSession, path: str, segments: bool) -> DataFrame:
    """The records of all archives below a path (files up to 2 GB): those in segments, or all others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")

    def walked():
        def batch(b):
            out = {x.split()[0]: [] for x in FIELDS.split(",")}
            for raw in b.column("content"):
                for f, block in parse(raw.as_py()):
                    if ("warc-segment-number" in f) != segments:
                        continue
                    whole = lambda k, f=f: int(f[k]) if k in f else None
                    size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", block) if f["warc-type"] == "revisit" else None
                    row = (
                        f.get("warc-segment-origin-id") or f["warc-record-id"], f["warc-type"], whole("x-page-id"), whole("x-refers-to-page-id"),
                        f.get("warc-payload-digest", "").rpartition(":")[2] or None, whole("warc-segment-number"), whole("warc-segment-total-length"),
                        int(size[1]) if size else None, block,
                    )
                    for column, value in zip(out.values(), row):
                        column.append(value)
            n = len(out["block"])
            return [0] * n, out

        return batch

    return python_columns(files, walked, [], FIELDS)


def reassembled(parts: DataFrame) -> DataFrame:
    """One row per segmented record, its segments joined in order.

    A record whose segments are not numbered 1, 2, ... up to one with the total length, or do not add up to it, has a null block.
    """
    one = F.struct("segment", "block")
    got = parts.groupBy("record_id").agg(
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_type", "page_id", "refers_to", "claimed")],
        F.max("total").alias("total"),
        F.max("claimed_bytes").alias("claimed_bytes"),
        F.sum(F.length("block")).alias("found"),
        F.array_sort(F.collect_list(one)).alias("parts"),
    )
    whole = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    joined = F.unhex(F.concat_ws("", F.transform("parts", lambda p: F.hex(p["block"]))))
    got = got.withColumn("block", F.when(whole & (F.col("found") == F.col("total")), joined)).withColumn("segment", F.lit(1))
    return got.select(*[x.split()[0] for x in FIELDS.split(",")])


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, intact, payload) of all archives below a path.

    Responses carry their payload; intact says that it could be reassembled and decoded and has the digest its header
    names. Revisits carry no payload; size and digest are those of the payload they stand for.
    """

    def decoded():
        def batch(b):
            out = {"payload_bytes": [], "payload_digest": [], "intact": [], "payload": []}
            for kind, block, claimed, many in zip(*(b.column(c).to_pylist() for c in ("record_type", "block", "claimed", "claimed_bytes"))):
                own = None if kind == "revisit" else payload_of(block)
                found = None if own is None else digest(own)
                row = (many, claimed, True, None) if kind == "revisit" else (None if own is None else len(own), found or claimed, own is not None and found == claimed, own)
                for column, value in zip(out.values(), row):
                    column.append(value)
            return out

        return batch

    both = read(spark, path, False).unionByName(reassembled(read(spark, path, True)))
    new = "payload_bytes long, payload_digest string, intact boolean, payload binary"
    return python_columns(both, decoded, ["page_id", "record_type", "refers_to"], new)
