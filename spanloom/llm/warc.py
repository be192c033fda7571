"""WARC archives: writing pages as records, and reading records back with their segments joined.

Archives are written by Spark's text sink, a record a row: the sink ends every row by the two line ends that end a
WARC record, so its files are plain (gzipped) WARC on any file system that Spark can write. A payload is framed
as an HTTP response with chunked transfer coding; a block of over SEGMENT bytes goes on in continuation records.
A file holds at most FILE_RECORDS records, so reading one whole takes bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, small, tidy, work_dir

SEGMENT, CHUNK, FILE_RECORDS = 32_768, 8_192, 400
#: Smaller payloads are always stored.
LEAST_REVISIT = 1000
#: So many repeated payloads, of some 60 bytes each, are broadcast.
FEW_REPEATED = 500_000
_END = b"\r\n"
_DATE = "2024-01-01T00:00:00Z"  # records carry no clock, so that equal pages give equal archives


# ---------------------------------------------------------------- one record


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer coding of a payload."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, _END]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The payload in a chunked frame; ValueError if the frame is broken or goes on after its end."""
    out, i = [], 0
    while True:
        stop = framed.find(_END, i)
        size = framed[i:stop].split(b";")[0].strip() if stop >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("no chunk size")
        n, i = int(size, 16), stop + 2
        if n == 0:
            break
        if framed[i + n : i + n + 2] != _END:
            raise ValueError("a chunk is cut short")
        out.append(framed[i : i + n])
        i += n + 2
    while not framed.startswith(_END, i):  # trailers
        stop = framed.find(_END, i)
        if stop < 0:
            raise ValueError("the frame has no end")
        i = stop + 2
    if i + 2 != len(framed):
        raise ValueError("bytes after the frame")
    return b"".join(out)


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def _safe(url: str | None) -> str:
    """A url as a header value: no line ends or blanks at its ends; a missing one is empty."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url or "").strip()


def record_name(page_id: int, payload: bytes) -> str:
    """The id of the record that others with its payload refer to."""
    return f"<urn:page:{page_id}:{hashlib.sha1(payload).hexdigest()}>"


def records_of(
    row: int, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, known: bool = False, segment: int = SEGMENT
) -> list[bytes]:
    """The records of a page. row names it, as page ids may repeat or be null, but where others refer to it.

    refers_to: the page whose payload this one repeats. known: one row holds that payload under that id (of a revisit), or under
    this page's own, and others repeat it; so its record has the name they give.
    """
    digest, uri = _digest(payload), _safe(url)
    name = record_name(page_id, payload) if known and refers_to is None else f"<urn:page-row:{row}>"
    common = [("WARC-Record-ID", name), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest)]
    common += [("WARC-X-Page-ID", "" if page_id is None else page_id), ("WARC-X-Payload-Length", len(payload)), ("WARC-X-No-URL", int(url is None))]
    if refers_to is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-X-Refers-To-Page", refers_to)]
        more += [("WARC-Refers-To", record_name(refers_to, payload))] * known
        return [_record([("WARC-Type", "revisit"), *common, *more, ("Content-Type", "application/http;msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), *common, ("WARC-Block-Digest", _digest(parts[0])), ("Content-Type", "application/http;msgtype=response")]
    out = [_record(first + [("WARC-Segment-Number", 1)] * (len(parts) > 1), parts[0])]
    for k, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", uri)]
        own += [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), ("WARC-Block-Digest", _digest(part))]
        out.append(_record(own + [("WARC-Segment-Total-Length", len(block))] * (k == len(parts)), part))
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive; ValueError where it is broken."""
    i = 0
    while i < len(data):
        if data.startswith(_END, i):
            i += 2
            continue
        stop = data.find(b"\r\n\r\n", i)
        if stop < 0 or not data.startswith(b"WARC/", i):
            raise ValueError(f"no record at byte {i}")
        lines = data[i:stop].decode("utf-8").split("\r\n")[1:]
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        n, i = int(fields["content-length"]), stop + 4
        if i + n > len(data):
            raise ValueError("the last record is cut short")
        yield fields, data[i : i + n]
        i += n


# ---------------------------------------------------------------- Spark


def write(pages: DataFrame, path: str, id_col: str = "page_id", html_col: str = "html") -> None:
    """Writes the pages as gzipped archives below path.

    Null pages have empty payloads. Of pages with equal payloads of at least LEAST_REVISIT bytes those of the
    largest id are stored and the others revisit them, by the record's name if one row has that id; rows with null
    ids are stored. Smaller payloads, such as the empty one, meet no other. Repeated payloads are known by id and digest
    alone; the table of them is broadcast if it has at most FEW_REPEATED rows, which are counted.
    """
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages["url"], F.coalesce(pages[html_col], F.lit("")).alias("html"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    large = F.octet_length("html") >= LEAST_REVISIT
    named = rows.where(large).select("id", F.sha1("html").alias("sha1")).where("id is not null")
    named = named.groupBy("sha1", "id").agg(F.count(F.lit(1)).alias("rows"))
    twice = named.groupBy("sha1").agg(F.max("id").alias("stored"), F.sum("rows").alias("times"), F.max_by("rows", "id").alias("holders")).where("times > 1")
    twice = small(kept(twice.select("sha1", "stored", (F.col("holders") == 1).alias("known")), f"{work_dir(pages.sparkSession)}/twice"), FEW_REPEATED)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("stored", "long"), ("known", "boolean"))]
    keyed = rows.where(large).withColumn("sha1", F.sha1("html")).join(twice, "sha1", "left").drop("sha1")
    keyed = keyed.unionByName(rows.where(~large).select("*", *nothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                out: list[bytes] = []
                for page, url, text, row, stored, known in zip(*(c.to_pylist() for c in batch.slice(i, 200).columns), strict=True):
                    again = stored is not None and page is not None and page != stored
                    out += records_of(row, page, url, text.encode("utf-8", "surrogatepass"), stored if again else None, bool(known) and page is not None)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = keyed.select("id", "url", "html", "row", "stored", "known").mapInArrow(tidy(run), "record binary")
    writer = records.select(F.col("record").cast("string").alias("value")).write.mode("overwrite")
    writer.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_FIELDS = "name string, page_id long, url string, kind string, refers_to long, digest string, payload_bytes long, segment int, total long, block binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _FIELDS.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    for batch in batches:
        for value in batch.column(0):
            data, rows, held = value.as_py(), [], 0
            for f, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                if f.get("warc-block-digest", _digest(block)) != _digest(block):
                    raise ValueError(f"the block of {f['warc-record-id']} is not what was written")
                if f["warc-type"] == "continuation":
                    total = f.get("warc-segment-total-length")
                    row = (f["warc-segment-origin-id"], *[None] * 6, int(f["warc-segment-number"]), int(total) if total else None, block)
                else:
                    page, ref = f["warc-x-page-id"], f.get("warc-x-refers-to-page")
                    url = None if f["warc-x-no-url"] == "1" else f["warc-target-uri"]
                    length, number = int(f["warc-x-payload-length"]), int(f.get("warc-segment-number", 0))
                    row = (
                        f["warc-record-id"],
                        int(page) if page else None,
                        url,
                        f["warc-type"],
                        int(ref) if ref else None,
                        f["warc-payload-digest"],
                        length,
                        number,
                        None,
                        block,
                    )
                rows.append(row)
                held += len(block)
                if held > 8_000_000:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)


def _opened(with_payload: bool):
    """Takes the frame off whole blocks and compares payloads with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, payloads = [], []
            for name, kind, digest, length, block in zip(*(batch.column(k).to_pylist() for k in (0, 3, 5, 6, 7)), strict=True):
                if kind == "revisit":
                    digests.append(base64.b32decode(digest[5:]).hex())
                    payloads.append(None)
                    continue
                head, _, body = block.partition(b"\r\n\r\n")
                payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                if _digest(payload) != digest or len(payload) != length:
                    raise ValueError(f"the payload of {name} is not what was written")
                digests.append(hashlib.sha1(payload).hexdigest())
                payloads.append(payload if with_payload else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in (1, 2)),
                    batch.column(6),
                    pa.array(digests, pa.string()),
                    *(batch.column(k) for k in (3, 4)),
                    pa.array(payloads, pa.binary()),
                ],
                ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
            )

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per page of the archives below path: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Segments are grouped by the record they continue, put in order of their numbers, and must be all there and
    have the stated total length; blocks and payloads must match their digests, else the read fails. Only
    segmented records are shuffled. The payload of a revisit is null, its length and digest are the original's.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    parts = files.mapInArrow(tidy(_segments), _FIELDS)
    whole = parts.where("segment = 0").drop("segment", "total")
    order = F.sort_array(F.collect_list(F.struct("segment", "block")))
    joined = parts.where("segment > 0").groupBy("name").agg(
        *(F.max(c).alias(c) for c in ("page_id", "url", "kind", "refers_to", "digest", "payload_bytes", "total")), order.alias("parts")
    )
    block = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["block"]))
    numbers = F.transform("parts", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    sound = numbers & (F.length("block") == F.col("total")) & F.col("kind").isNotNull()
    refused = F.raise_error(F.concat(F.lit("segments are missing or do not have the stated length: "), F.col("name"))).cast("binary")
    joined = joined.withColumn("block", block).withColumn("block", F.when(sound, F.col("block")).otherwise(refused))
    columns = whole.columns
    return whole.unionByName(joined.select(*columns)).mapInArrow(
        tidy(_opened(with_payload)), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages into archives in the shared folder and reads them back, without the payloads.

    A row a page: page_id, payload_bytes, payload_digest, record_type, refers_to; nulls, repeated rows and empty tables as in ``write``.
    """
    path = f"{work_dir(pages.sparkSession)}/warc"
    write(pages, path)
    return read(pages.sparkSession, path, with_payload=False).drop("payload").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS stored FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN stored END AS refers_to FROM q
"""
