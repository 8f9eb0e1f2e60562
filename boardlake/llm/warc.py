"""WARC archives: write pages as records, read them back by reassembling segments.

A page becomes a ``response`` record with its body in HTTP chunked framing, or a ``revisit`` of
the page that has the same payload. Blocks longer than a segment continue in ``continuation``
records. Reading groups those by origin identifier, orders them by segment number, verifies the
total length and decodes the framing. Archives are written and read by Spark's own file sources, so
any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Records in a file: a reader holds one file, at most RECORDS_PER_FILE * (SEGMENT_BYTES + headers).
RECORDS_PER_FILE = 4096
OUT_BYTES = 4 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PARSED = ("record_id string, record_type string, page_id {id}, url string, refers_to {id}, payload_digest string, "
           "segment int, origin string, total long, block binary")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(body[i:i + size]), body[i:i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes | None:
    """The body of a chunked message (extensions and trailers are skipped); None if it is broken."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(framed[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        if end + 2 + n + 2 > len(framed) or framed[end + 2 + n:end + 4 + n] != b"\r\n":
            return None
        out.append(framed[end + 2:end + 2 + n])
        at = end + 4 + n


def payload_of(block: bytes) -> bytes | None:
    """The body of an HTTP message block, with chunked framing decoded; None if it is broken."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def records(page_id, url: str | None, html: str | None, refers_to, unique: str, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page."""
    payload = (html or "").encode()
    name = f"<urn:x-page:{page_id}#{unique}>"
    safe = None if url is None else "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url)
    common = [("WARC-Target-URI", safe), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), *common], _HTTP)
        return
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common], block)
        return
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}-{n}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n),
                       ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part)


def _to_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        out, size = [], 0
        for i in range(b.num_rows):
            row = [b.column(c)[i].as_py() for c in ("id", "url", "html", "refers_to")]
            n += 1
            for r in records(*row, f"{part}-{n}"):
                out.append(r)
                size += len(r)
            if size > OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write one record per row of ``pages`` (more where it is segmented) below ``path``.

    Of rows with equal payloads of ``least`` bytes or more, those with the smallest key are
    responses and the others revisit it. One key may have several payloads: each is judged by itself. A null payload is empty; rows
    without a key revisit one that has a key if there is one, else they are responses; null urls have no target field. Payloads of
    any length are written whole. Only the named columns are read. An empty table writes no record.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(body.cast("binary")).alias("digest"), (F.octet_length(body) >= least).alias("long"))
    marked = stage(rows.filter("long").select("id", "digest"), "digests")
    first = stage(marked.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND refers_to IS NOT NULL"), "repeated-payloads")
    # Two written tables meet, so a payload that holds a third of all rows is split while it is joined.
    again = marked.join(first.select("digest", "refers_to"), "digest").filter(~F.col("id").eqNullSafe(F.col("refers_to")))
    again = stage(again.select(F.col("id").alias("i"), F.col("digest").alias("d"), "refers_to").distinct(), "revisits")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")) & F.col("long")
    told = rows.join(again, same, "left").select("id", "url", "html", "refers_to")
    out = told.mapInArrow(_to_records, "record binary")
    # The text sink writes the bytes of a string as they are; records end with two line ends.
    (out.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive, plain or gzip."""
    if archive[:2] == b"\x1f\x8b":
        parts = []
        while archive[:2] == b"\x1f\x8b":  # one member per record or one for all
            d = zlib.decompressobj(31)
            parts.append(d.decompress(archive) + d.flush())
            archive = d.unused_data
        archive = b"".join(parts)
    at = 0
    while (at := archive.find(b"WARC/", at)) >= 0:
        end = archive.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields.get("content-length", "0"))
        yield fields, archive[end + 4:end + 4 + n]
        at = end + 4 + n


def _parse_files(batches: Iterator[pa.RecordBatch], cast) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "page_id", "url", "refers_to", "payload_digest", "segment", "origin", "total", "block"]
    for b in batches:
        shape = None
        for content in b.column("content"):
            out, size = [], 0
            for f, block in parse(content.as_buffer().to_pybytes()):
                ref = f.get("warc-refers-to")
                out.append((f.get("warc-record-id"), f.get("warc-type"), cast(f.get("warc-page-id")), f.get("warc-target-uri"),
                            cast(ref[len("<urn:x-page:"):-1]) if ref else None, (f.get("warc-payload-digest") or ":").partition(":")[2] or None,
                            int(f["warc-segment-number"]) if "warc-segment-number" in f else None, f.get("warc-segment-origin-id"),
                            int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block))
                size += len(block)
                if size > OUT_BYTES:
                    yield _batch(out, names, cast)
                    out, size = [], 0
            yield _batch(out, names, cast)


def _batch(rows: list[tuple], names: list[str], cast) -> pa.RecordBatch:
    ident = pa.int64() if cast is int_or_none else pa.string()
    kinds = [pa.string(), pa.string(), ident, pa.string(), ident, pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def int_or_none(x: str | None) -> int | None:
    return None if x is None else int(x)


def text_or_none(x: str | None) -> str | None:
    return x


def _decode(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size, start = [], 0, 0
            for i, (parts, total, kind) in enumerate(zip(b.column("blocks"), b.column("total").to_pylist(), b.column("record_type").to_pylist())):
                block = b"".join(parts.as_py())
                body = payload_of(block) if kind != "revisit" and (total is None or total == len(block)) else None
                out.append((None if body is None else len(body), None if body is None else digest(body), body if with_payload else None, kind == "revisit" or body is not None))
                size += len(body or b"")
                if size > OUT_BYTES or i == b.num_rows - 1:
                    cols = [b.column(c).slice(start, len(out)) for c in ("page_id", "url", "record_type", "refers_to", "payload_digest")]
                    new = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out])]
                    yield pa.RecordBatch.from_arrays(cols + new, ["page_id", "url", "record_type", "refers_to", "stated_digest", "payload_bytes", "payload_digest", "payload", "complete"])
                    out, size, start = [], 0, i + 1

    return run


def read(spark: SparkSession, path: str, key_type: str = "bigint", with_payload: bool = True) -> DataFrame:
    """One row per response and revisit record of the archives below ``path``: page_id, url, record_type,
    refers_to, stated_digest, payload_bytes, payload_digest, payload and ``complete``.

    ``complete`` is false where a segment is missing, the total length differs or the framing is
    broken; bytes, digest and payload are then null. Revisits have none of their own. One file and
    one page's segments are held in memory at a time.
    """
    cast = int_or_none if key_type == "bigint" else text_or_none
    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(lambda it: _parse_files(it, cast), _PARSED.format(id=key_type))
    found = found.filter(F.col("record_type").isin("response", "revisit", "continuation"))
    cols = ["page_id", "url", "record_type", "refers_to", "payload_digest"]
    whole = found.filter("segment IS NULL").select(*cols, F.array("block").alias("blocks"), F.lit(None).cast("long").alias("total"))
    parts = found.filter("segment IS NOT NULL").withColumn("origin", F.coalesce("origin", "record_id"))
    head = F.col("segment") == 1
    one = lambda c: F.max(F.when(head, F.col(c))).alias(c)
    # The segments of one page: as large as that page.
    joined = parts.groupBy("origin").agg(*[one(c) for c in cols], F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("p"), F.max("total").alias("total"))
    joined = joined.filter(F.col("record_type").isNotNull()).select(*cols, F.col("p.block").alias("blocks"), F.coalesce("total", F.lit(-1)).alias("total"))
    shape = f"page_id {key_type}, url string, record_type string, refers_to {key_type}, stated_digest string, payload_bytes long, payload_digest string, payload binary, complete boolean"
    return whole.unionByName(joined).mapInArrow(_decode(with_payload), shape)


def round_trip(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` below ``path``, read the archives back and resolve revisits: (key, payload_bytes,
    payload_digest, record_type, refers_to, complete), one row per page."""
    spark = pages.sparkSession
    write(pages, path, key, url, html)
    kind = pages.schema[key].dataType.simpleString()
    back = stage(read(spark, path, "bigint" if kind in ("bigint", "int", "smallint", "tinyint") else "string", False).drop("payload", "url"), "archive-rows")
    own = back.filter("record_type = 'response'")
    target = own.filter("page_id IS NOT NULL").dropDuplicates(["page_id", "payload_digest"]).select(F.col("page_id").alias("t"), F.col("payload_bytes").alias("tb"), F.col("payload_digest").alias("td"))
    target = stage(target, "responses")
    seen = back.filter("record_type = 'revisit'").join(target, (F.col("refers_to") == F.col("t")) & (F.col("stated_digest") == F.col("td")), "left")
    seen = seen.select("page_id", F.col("tb").alias("payload_bytes"), F.col("td").alias("payload_digest"), "record_type", "refers_to",
                       F.col("td").isNotNull().alias("complete"))
    return own.select(*seen.columns).unionByName(seen).withColumnRenamed("page_id", key)
