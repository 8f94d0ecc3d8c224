"""WARC archives with segmented records: writing pages, reading archives, reassembling segments.

A captured page is an HTTP response whose body is framed in chunks. Blocks longer than a segment are written as a first
record and continuation records, each a row of its own, so no file or task holds more than a bounded number of bounded
rows. Reading parses the files of a folder by content length, groups the segments of a record by the identifier of their
origin, orders them by number, verifies the total length and decodes the chunked framing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import columns_apart

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
#: With segments of SEGMENT_BYTES a file holds at most about 64 MB before compression.
RECORDS_PER_FILE = 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD_END = b"\r\n\r\n"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked message; ValueError if the framing is broken."""
    at, parts = 0, []
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(framed[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        body = framed[end + 2 : end + 2 + size]
        if len(body) != size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        parts.append(body)
        at = end + 4 + size


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record but for the two line ends that close it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record."""
    at = 0
    while at < len(data):
        end = data.find(RECORD_END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ValueError(f"the record at byte {at} is cut short")
        yield headers, block
        at = end + 4 + length + 4


def _uri(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def _records(segment_bytes: int):
    def pieces(page: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None, revisit: bool, text_hash: int) -> Iterator[bytes]:
        own = f"<urn:page:{'null' if page is None else page}:{text_hash & (2**64 - 1):016x}>"
        payload = (html or "").encode()
        shared = [("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
        kind = [("Content-Type", "application/http; msgtype=response")]
        if revisit:
            head = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
            yield record(head + shared + [("WARC-Refers-To", f"<urn:page:{refers_to}:{text_hash & (2**64 - 1):016x}>")] + kind, HTTP)
            return
        block = HTTP + chunked(payload)
        head = [("WARC-Type", "response"), ("WARC-Record-ID", own)]
        if len(block) <= segment_bytes:
            yield record(head + shared + kind, block)
            return
        starts = range(0, len(block), segment_bytes)
        yield record(head + shared + [("WARC-Segment-Number", "1")] + kind, block[:segment_bytes])
        for number, start in enumerate(starts[1:], 2):
            more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{number}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(number))]
            if start == starts[-1]:
                more.append(("WARC-Segment-Total-Length", str(len(block))))
            yield record(more, block[start : start + segment_bytes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for piece in pieces(*row):
                    out.append(piece)
                    size += len(piece)
                    if size > 1 << 23:
                        yield _as_text(out)
                        out, size = [], 0
            if out:
                yield _as_text(out)

    return run


def _as_text(pieces: list[bytes]) -> pa.RecordBatch:
    """The pieces in a string column as they are; the text writer passes bytes through."""
    raw = pa.array(pieces, pa.binary())
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), len(raw), raw.buffers(), raw.null_count)], ["value"])


def write_warc(pages: DataFrame, path: str, least_bytes: int = 1000, segment_bytes: int = SEGMENT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each page into gzip files under path.

    Of pages with equal payloads of at least least_bytes bytes, that with the largest id is a response and the others are
    revisits that refer to it; all other pages are responses. A null html is an empty payload. A null url is written as an
    empty one. Pages without an id are responses; rows that repeat an id and a payload are of one kind.
    """
    rows = columns_apart(pages, id_col, url_col, html_col).toDF("page", "url", "html").withColumn("page", F.col("page").cast("long"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # short payloads get keys of their own, which the join tells apart, so that they don't meet in one task
    strong = F.when(F.octet_length(payload) >= least_bytes, F.unhex(F.sha2(payload, 256))).otherwise(F.coalesce(F.col("page").cast("string"), F.col("url")).cast("binary"))
    rows = rows.withColumns({"digest": F.sha1(payload), "strong": strong, "long": F.octet_length(payload) >= least_bytes})
    held = rows.where("long and page is not null").groupBy("strong").agg(F.max("page").alias("leader"), F.count("*").alias("n"))
    held = held.where("n > 1").drop("n").withColumnRenamed("strong", "_strong")
    joined = rows.join(held, (rows["strong"] == held["_strong"]) & rows["long"], "left")
    revisit = F.coalesce(F.col("page") < F.col("leader"), F.lit(False))
    records = joined.select("page", "url", "html", "digest", F.col("leader").alias("refers_to"), revisit.alias("revisit"), F.xxhash64("html").alias("text_hash"))
    text = records.mapInArrow(_records(segment_bytes), "value string")
    text.write.option("lineSep", RECORD_END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


FIELDS = "record_id string, record_type string, origin_id string, segment int, total long, target_uri string, refers_to string, digest string, payload_length long, block binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            for headers, block in parse(gzip.decompress(content) if name.endswith(".gz") else content):
                get = headers.get
                number = lambda key: int(get(key)) if get(key) else None
                digest = get("warc-payload-digest")
                rows.append((get("warc-record-id"), get("warc-type"), get("warc-segment-origin-id") or get("warc-record-id"), number("warc-segment-number"), number("warc-segment-total-length"),
                             get("warc-target-uri"), get("warc-refers-to"), digest and digest.removeprefix("sha1:"), number("warc-payload-length"), block))
                if len(rows) >= 256:
                    yield _fields(rows)
                    rows = []
            if rows:
                yield _fields(rows)


def _fields(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path, segments apart. Each file is read as a whole by one task; write_warc bounds
    its files, and archives from elsewhere should be of a size that an executor can hold."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parsed, FIELDS)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads, lengths, digests, errors = [], [], [], []
        columns = [batch.column(c).to_pylist() for c in ("record_type", "digest", "payload_length", "blocks", "error")]
        for kind, digest, length, blocks, error in zip(*columns, strict=True):
            body = None
            if error is None and kind == "response":
                head, _, body = b"".join(blocks).partition(RECORD_END)
                try:
                    body = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                except ValueError as broken:
                    body, error = None, str(broken)
            payloads.append(body)
            lengths.append(length if body is None else len(body))
            digests.append(digest if body is None else hashlib.sha1(body).hexdigest())
            if error is None and body is not None and digest is not None and digests[-1] != digest:
                error = "the payload has another digest"
            errors.append(error)
        kept = [batch.column(c) for c in ("record_id", "record_type", "target_uri", "refers_to")]
        made = [pa.array(payloads, pa.binary()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string()), pa.array(errors, pa.string())]
        yield pa.RecordBatch.from_arrays(kept + made, ["record_id", "record_type", "target_uri", "refers_to", "payload", "payload_bytes", "payload_digest", "error"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under path, segments reassembled: record_id, record_type, target_uri, refers_to (the
    identifier), payload (null for revisits), payload_bytes, payload_digest (of the payload; as recorded for revisits), error.

    error says what is wrong with a capture whose segments are missing or don't have the recorded total length, whose
    chunks are broken or whose digest differs; its payload is null if it could not be decoded. Only segmented records are
    shuffled, by the identifier of their origin. Records that were written twice, segments and all, are read twice.
    """
    rows = read_records(spark, path)
    whole = rows.where("segment is null").select("record_id", "record_type", "target_uri", "refers_to", "digest", "payload_length", F.array("block").alias("blocks"), F.lit(None).cast("string").alias("error"))
    parts = rows.where("segment is not null").groupBy("origin_id").agg(
        F.max(F.struct(F.col("segment") == 1, "record_type", "target_uri", "refers_to", "digest", "payload_length")).alias("first"),
        F.max("total").alias("total"), F.max("segment").alias("last"), F.count_if(F.col("segment") == 1).alias("copies"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("found"))
    # equal records share their segments; one of each number is enough
    found = F.filter("found", lambda x, i: (i == 0) | (F.get(F.col("found"), i - 1)["segment"] != x["segment"]))
    parts = parts.withColumn("found", found)
    length = F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"]))
    wrong = F.when((F.col("copies") == 0) | (F.size("found") != F.col("last")), "segments are missing").when(F.col("total").isNull() | (length != F.col("total")), "the segments don't have the total length")
    parts = parts.withColumns({"blocks": F.transform("found", lambda x: x["block"]), "error": wrong})
    parts = parts.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.greatest(F.col("copies"), F.lit(1)).cast("int"))))
    parts = parts.select(F.col("origin_id").alias("record_id"), "first.record_type", "first.target_uri", "first.refers_to", "first.digest", "first.payload_length", "blocks", "error")
    schema = "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, error string"
    return whole.unionByName(parts).mapInArrow(_decoded, schema)


def page_of(identifier: str) -> Column:
    """The page id inside the record identifiers of write_warc in a column."""
    return F.try_element_at(F.split(identifier, ":"), F.lit(3)).try_cast("long")
