"""Web archives: writing, reading and segment reassembly (operator 11).

Writing.  Every page is an HTTP response in chunked framing inside a WARC/1.1 record.  A block longer than
the segment size is cut: its first part stays in the ``response`` record, each further part is a
``continuation`` record that names the origin's record id and its segment number, and the last one states the
total length.  A payload of at least MIN_REVISIT bytes that another page holds too is written once, by the page of the largest
id (ties: one of them); the others are ``revisit`` records that refer to it.  The text writer commits the
files on whatever file system the path names; records are its lines, so no file passes through a task's local disk.

Reading.  The gzip files are read as text cut at the version mark, one task a file, and a record ends where its
stated length ends: marks inside a page are put back.  Continuations are grouped by origin identifier, ordered
by segment number, checked for gaps and against the total length, joined, and freed of their chunks; the
payload's digest is compared with the one stated.  What fails keeps its row, with a null payload and a status.

Null html is the empty payload, a null url or id leaves its header out, repeated rows are records of their own, an
empty table gives an archive without records.  Control characters of urls are percent-encoded.  One payload must fit into one value.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import scratch_path

#: Bytes of a block in one record, bytes of a transfer chunk, shortest payload that is worth a revisit.
SEGMENT_BYTES, CHUNK_BYTES, MIN_REVISIT = 8 << 10, 2 << 10, 1000
DATE = "1970-01-01T00:00:00Z"
#: A key with at least one in so many of all rows is joined by broadcast; there are at most as many such keys.
HEAVY_SHARE = 1000
#: Bytes of blocks in an Arrow batch.
BATCH_BYTES = 4 << 20

# Fixed values of the formats.
VERSION_MARK = "WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _lookup(rows: DataFrame, key: str, table: DataFrame, n_rows: int) -> DataFrame:
    """Left join with a table of (key, uses, value struct): heavy keys, at most HEAVY_SHARE of them, by broadcast."""
    heavy = table.where(F.col("uses") * HEAVY_SHARE >= n_rows).select(F.col(key), F.col("value").alias("__heavy"))
    light = table.where(F.col("uses") * HEAVY_SHARE < n_rows).select(F.col(key).alias("__key"), F.col("value").alias("__light"))
    rows = rows.join(F.broadcast(heavy), key, "left")
    # rows that are done or ask nothing get keys that match nothing and spread
    rows = rows.withColumn("__key", F.when(F.col("__heavy").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    return rows.join(light, "__key", "left").withColumn("value", F.coalesce("__heavy", "__light")).drop("__key", "__heavy", "__light")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _clean(value: Column) -> Column:
    for c in "\r\n\0":
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return value


def _pieces(data: Column, size: int) -> Column:
    """Binary cut into parts of at most ``size`` bytes; none for empty data."""
    n = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _chunked(payload: Column, size: int) -> Column:
    """The payload in chunked transfer framing, as raw text."""
    pieces = F.filter(_pieces(payload, size), lambda p: F.octet_length(p) > 0)
    framed = F.transform(pieces, lambda p: F.concat(F.lower(F.hex(F.octet_length(p))), F.lit("\r\n"), p.cast("string"), F.lit("\r\n")))
    return F.concat(F.array_join(framed, ""), F.lit("0\r\n\r\n"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Gzip archives of all pages under ``path``."""
    spark = pages.sparkSession
    src = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("page_id"), _clean(F.col(url_col).cast("string")).alias("url"),
                       F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    src = src.withColumn("same", F.when(F.octet_length("payload") >= MIN_REVISIT, F.concat(F.sha2("payload", 256), F.sha1("payload"))))
    kept = scratch_path(spark, "warc-copies")
    per_page = src.where(F.col("same").isNotNull()).groupBy("same", "page_id").agg(F.count("*").alias("rows"))
    (per_page.groupBy("same").agg(F.sum("rows").alias("uses"), F.max(F.struct("page_id", "rows")).alias("value")).where(F.col("uses") > 1).write.parquet(kept))
    copies = spark.read.parquet(kept)
    tied = copies.where(F.col("value.rows") > 1).select("same", F.col("value.page_id").alias("top"))
    if not tied.isEmpty():  # rows of one id and payload: one of them is chosen, so all must have numbers that stay
        staged = scratch_path(spark, "warc-rows")
        src.write.parquet(staged)
        src = spark.read.parquet(staged)
        chosen = (src.where(F.col("same").isNotNull()).groupBy("same", "page_id").agg(F.max("rid").alias("rid"), F.count("*").alias("rows")).where(F.col("rows") > 1)
                  .join(tied.withColumnRenamed("same", "tied"), (F.col("same") == F.col("tied")) & F.col("page_id").eqNullSafe(F.col("top"))).select("same", "rid"))
    else:
        chosen = copies.select("same", F.lit(None).cast("long").alias("rid")).limit(0)
    copies = copies.join(chosen, "same", "left").select("same", "uses", F.struct("value.page_id", "rid").alias("value"))
    rows = _lookup(src, "same", copies, pages.count())
    salt = F.lit(path.rsplit("/", 1)[-1])
    copied, keeper_id = F.col("value").isNotNull(), F.concat_ws("|", F.lit("copies"), F.col("same"))
    keeps = F.col("page_id").eqNullSafe(F.col("value.page_id")) & F.coalesce(F.col("value.rid") == F.col("rid"), F.lit(True))
    revisit = copied & ~keeps
    own = F.when(copied & keeps, keeper_id).otherwise(F.concat_ws("|", F.lit("row"), F.col("rid").cast("string")))
    block = F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), _chunked(F.col("payload"), chunk_bytes)))
    rows = rows.select("page_id", "url", own.alias("rid"), revisit.alias("revisit"), keeper_id.alias("keeper"),
                       F.sha1("payload").alias("sha"), block.cast("binary").alias("block"))
    rows = rows.select("*", F.octet_length("block").alias("total"), F.posexplode(_pieces(F.col("block"), segment_bytes)).alias("k", "part"))
    first, last = F.col("k") == 0, (F.col("k") + 1) * segment_bytes >= F.col("total")
    cut = F.col("total") > segment_bytes
    kind = F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    record = F.concat(
        F.lit(VERSION_MARK + "1\r\n"), _header("WARC-Type", kind), _header("WARC-Record-ID", _uuid(salt, F.col("rid"), F.col("k").cast("string"))),
        _header("WARC-Date", F.lit(DATE)), _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Segment-Number", F.when(cut, F.col("k") + 1)),
        _header("WARC-Segment-Origin-ID", F.when(~first, _uuid(salt, F.col("rid"), F.lit("0")))),
        _header("WARC-Segment-Total-Length", F.when(cut & last, F.col("total"))),
        _header("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("sha")))),
        _header("WARC-Profile", F.when(F.col("revisit"), F.lit(REVISIT_PROFILE))),
        _header("WARC-Refers-To", F.when(F.col("revisit"), _uuid(salt, F.col("keeper"), F.lit("0")))),
        _header("X-Page-ID", F.when(first, _clean(F.col("page_id").cast("string")))),
        _header("Content-Type", F.when(first, F.lit("application/http;msgtype=response"))),
        _header("Content-Length", F.octet_length("part")), F.lit("\r\n"), F.col("part").cast("string"), F.lit("\r\n\r"))  # the writer ends the line
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _parse_head(data: bytes) -> tuple[dict[str, str], int, int] | None:
    """Headers (names in lower case) and where the block starts and ends, or None as long as the headers are not over."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers, name = {}, None
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            headers[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            headers[name] = value.strip()
    size = headers.get("content-length", "")
    return headers, end + 4, end + 4 + (int(size) if size.isdecimal() else 0)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """headers map, block binary, complete boolean: every record of the gzip archives under ``path``."""
    lines = spark.read.option("lineSep", VERSION_MARK).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_()]
        held, size, file = [], 0, None
        parts, have, found = [], 0, None  # the record that is open: its bytes so far, and its headers once they are whole

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], ["headers", "block", "complete"])

        def broken() -> tuple:
            return [("warc-type", "unreadable")], b"".join(parts), False

        for b in batches:
            for name, value in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
                if name != file:
                    if parts:
                        held.append(broken())
                    file, parts, have, found = name, [], 0, None
                    if not value:  # nothing before the first mark of a file
                        continue
                if parts:  # the mark stood inside a record that is not over yet
                    parts.append(VERSION_MARK.encode())
                    have += len(VERSION_MARK)
                parts.append(value)
                have += len(value)
                found = found or _parse_head(b"".join(parts))
                if found and have >= found[2]:
                    headers, start, stop = found
                    held.append((list(headers.items()), b"".join(parts)[start:stop], True))
                    size, parts, have, found = size + stop - start, [], 0, None
                if size >= BATCH_BYTES:
                    yield batch()
                    held, size = [], 0
        if parts:
            held.append(broken())
        if held:
            yield batch()

    return lines.mapInArrow(run, "headers map<string,string>, block binary, complete boolean")


def unchunk(body: bytes) -> bytes | None:
    """The data of a chunked body; None where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        size = body[at:end].split(b";", 1)[0].strip()
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n = int(size, 16)
        at = end + 2
        if n == 0:  # trailers, if any, end with an empty line
            return b"".join(parts) if body.find(b"\r\n", at) >= 0 else None
        if body[at + n:at + n + 2] != b"\r\n":
            return None
        parts.append(body[at:at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP message; None where its framing is broken."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None
    fields = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return unchunk(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def _same_digest(stated: str | None, payload: bytes) -> bool:
    """Whether a labelled SHA-1 digest in hex or base32 is the payload's; other algorithms are taken on trust."""
    name, _, value = (stated or "").partition(":")
    if name.lower() != "sha1":
        return True
    sha = hashlib.sha1(payload).digest()
    return value.lower() == sha.hex() or value.upper() == base64.b32encode(sha).decode()


def reassemble(records: DataFrame) -> DataFrame:
    """record_id, type, page_id, url, refers_to, digest, payload, status: one row per response or revisit record.

    Status is ok, or the first thing that is wrong: missing segment, wrong length, bad framing, bad digest, unreadable."""
    def h(name: str) -> Column:
        return F.col("headers")[name]
    rows = records.select("headers", "block", "complete", h("warc-record-id").alias("record_id"),
                          F.coalesce(h("warc-segment-origin-id"), h("warc-record-id")).alias("origin"),
                          h("warc-segment-number").try_cast("int").alias("number"), h("warc-segment-total-length").try_cast("long").alias("total"))
    is_cut = F.col("number").isNotNull() & F.col("origin").isNotNull() & F.col("complete")
    whole = rows.where(~is_cut).select("headers", F.array("block").alias("parts"), F.when(~F.col("complete"), "unreadable").alias("fault"))
    part = F.struct("number", "block")
    groups = rows.where(is_cut).groupBy("origin").agg(
        F.sort_array(F.collect_set(part)).alias("segments"), F.max("total").alias("total"), F.max_by("headers", -F.col("number")).alias("headers"))
    numbers = F.col("segments")["number"]
    gap = (F.array_max(numbers) != F.size("segments")) | (F.array_min(numbers) != 1) | F.col("total").isNull()
    length = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s["block"]))
    joined = groups.select("headers", F.col("segments")["block"].alias("parts"),
                           F.when(gap, "missing segment").when(length != F.col("total"), "wrong length").alias("fault"))
    rows = whole.unionByName(joined).select(
        h("warc-record-id").alias("record_id"), h("warc-type").alias("type"), h("x-page-id").alias("page_id"), h("warc-target-uri").alias("url"),
        h("warc-refers-to").alias("refers_to"), h("warc-payload-digest").alias("digest"), "parts", "fault")
    rows = rows.where(F.col("type").isin("response", "revisit", "continuation", "unreadable"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, status = [], []
            for kind, parts, fault, digest in zip(*(b.column(c).to_pylist() for c in ("type", "parts", "fault", "digest")), strict=True):
                payload = None
                if kind == "response" and not fault:
                    payload = http_payload(b"".join(parts))
                    fault = "bad framing" if payload is None else None if _same_digest(digest, payload) else "bad digest"
                payloads.append(None if fault else payload)
                status.append(fault or "ok")
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("record_id", "type", "page_id", "url", "refers_to", "digest")],
                                              pa.array(payloads, pa.binary()), pa.array(status, pa.string())],
                                             ["record_id", "type", "page_id", "url", "refers_to", "digest", "payload", "status"])

    return rows.mapInArrow(run, "record_id string, type string, page_id string, url string, refers_to string, digest string, payload binary, status string")


def page_digests(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives alone.

    A revisit takes the length and digest of the response it refers to; both are null where that is missing or broken."""
    found = reassemble(read_records(spark, path)).select(
        "record_id", F.col("type").alias("record_type"), F.col("page_id").try_cast(id_type).alias("page_id"), F.col("refers_to").alias("origin"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    kept = scratch_path(spark, "warc-digests")
    found.write.parquet(kept)
    found = spark.read.schema(found.schema).parquet(kept)
    uses = found.where(F.col("origin").isNotNull()).groupBy("origin").agg(F.count("*").alias("uses"))
    asked = found.select(F.col("record_id").alias("origin"), F.struct("page_id", "payload_bytes", "payload_digest").alias("value")).join(uses, "origin")
    rows = _lookup(found, "origin", asked, found.count())
    return rows.select("page_id", F.coalesce("payload_bytes", "value.payload_bytes").alias("payload_bytes"),
                       F.coalesce("payload_digest", "value.payload_digest").alias("payload_digest"), "record_type",
                       F.col("value.page_id").alias("refers_to"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return page_digests(spark, path)


#: Reading back what was written changes nothing, so the whole result can be said of the pages alone.
OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS d, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
FROM q
"""
