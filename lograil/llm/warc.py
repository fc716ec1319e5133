"""WARC archives with revisit records.

Headers (id, digest, size) are shuffled by payload digest; the response of each digest is found by an aggregate, and revisit records
are joined to it. Archives are written by Spark's text sink, one gzip member for each record, so output is committed by Spark whole or
not at all, in any store; they are read back file by file, by content length. A file and its largest record must fit in a task; no text is cut.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.llm.common import small_batches

END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def hex_sha1(payload: Column) -> Column:
    return F.sha1(payload.cast("binary"))


def base32(digits: Column) -> Column:
    """Bare upper-case base32 of 40 hexadecimal digits: five digits make four letters."""
    letters = []
    for g in range(8):
        bits = F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), (F.shiftright(bits, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1), F.lit(1)) for k in range(4)]
    return F.concat(*letters)


def resolve(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload_bytes, sha1, payload_digest, record_type, refers_to, refers_to_url): no payloads.

    Of equal payloads of min_bytes or more, the one with the largest id is response and the others revisit it; rows that repeat that id
    are responses too. A null payload is empty, a null url an empty one. A row of a null id is a response unless another has its payload. Other columns are ignored, whatever their names;
    no rows give no headers.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    heads = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.octet_length(payload).cast("long").alias("payload_bytes"), hex_sha1(payload).alias("sha1"))
    first = heads.filter(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("o"))
    out = heads.join(first, "sha1", "left").withColumn("payload_digest", base32(F.col("sha1")))
    revisit = F.col("o.page_id").isNotNull() & ~F.col("o.page_id").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= min_bytes)
    return out.select("page_id", "url", "payload_bytes", "sha1", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("o.page_id")).alias("refers_to"), F.when(revisit, F.col("o.url")).alias("refers_to_url"))


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(record): one WARC record of each row of pages, without its end."""
    heads = resolve(pages, min_bytes, id_col, url_col, payload_col)
    # The payload travels with the id, url and digest of its own row; repeated rows meet once each.
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    heads = heads.groupBy("page_id", "sha1").agg(F.first(F.struct(F.col("payload_digest").alias("_digest"), "payload_bytes", "record_type", "refers_to", "refers_to_url")).alias("h")).select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "h.*")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"), hex_sha1(payload).alias("sha1"))
    rows = rows.join(heads, rows["page_id"].eqNullSafe(heads["_id"]) & (rows["sha1"] == heads["_sha1"]))
    one_line = lambda c: F.regexp_replace(c, r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    revisit = F.col("record_type") == "revisit"
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    line = lambda name, c: F.concat(F.lit(f"\r\n{name}: "), c)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), line("WARC-Record-ID", record_id(F.col("page_id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))), F.when(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id").cast("string"))).otherwise(""),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", record_id(F.col("refers_to"))), line("WARC-Refers-To-Target-URI", one_line(F.col("refers_to_url"))), line("WARC-Refers-To-Date", F.lit(date)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", size.cast("string")), F.lit(END),
    )
    return rows.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload"))).alias("record"))


#: Bytes of compressed records that are put together into one row of the text sink, and rows of a file: a file has about FILE_ROWS * BLOB_BYTES bytes, plus one record.
BLOB_BYTES, FILE_ROWS = 4 << 20, 16


def member(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, compress: bool = True, **columns) -> str:
    """Writes archives below path: gzip, one member for each record, or plain text.

    Records go through Spark's text sink, so they are committed whole or not at all, in any store. Compressed, a row of the sink is a run of whole members, and
    what the sink writes after each row is an empty member, which adds nothing to the archive. Files are bounded by bytes, not by records, but hold one record at least.
    Plain files end each record by the sink's line separator.
    """
    rows = records(pages, min_bytes, **columns)
    if not compress:
        rows.write.option("lineSep", END).text(path)
        return path

    def run(batches):
        held, size = [], 0
        for b in batches:
            out = []
            for record in b.column(0).cast(pa.binary()):
                held.append(member(record.as_py() + END.encode()))
                size += len(held[-1])
                if size >= BLOB_BYTES:
                    out.append(b"".join(held))
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["members"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])

    small_batches(pages.sparkSession)
    blobs = rows.mapInArrow(run, "members binary").select(F.col("members").cast("string").alias("value"))
    blobs.write.option("lineSep", member(b"").decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_ROWS).text(path)
    return path


def unpacked(data: memoryview, step: int = 1 << 16):
    """The bytes of an archive, piece by piece: all members of a gzip file, one after the other, or the file as it is."""
    if bytes(data[:2]) != b"\x1f\x8b":
        for at in range(0, len(data), step):
            yield bytes(data[at : at + step])
        return
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= len(data):
                raise ValueError("archive ends inside a member")
            piece = data[at : at + step]
            yield z.decompress(piece)
            at += len(piece) - len(z.unused_data)


def parsed(data: memoryview):
    """(head, block) of each record of an archive: header fields by lower-case name, and the bytes of the block. Holds one record at a time."""
    pieces, held = unpacked(data), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        stop = held.find(b"\r\n\r\n")
        while stop < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("archive ends inside a header")
            stop = held.find(b"\r\n\r\n", max(seen - 3, 0))
        lines = held[:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = stop + 4
        end = begin + int(head["content-length"])
        if not fill(end + 4) or held[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} has no end")
        yield head, bytes(held[begin:end])
        del held[: end + 4]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response, resource and revisit of the archives below path: (record_id, record_type, target_uri, page_id, digest, payload_bytes, refers_to_id).

    Reads gzip files of one member or of many, and plain ones. Content lengths bound the records, so payloads may hold anything. A payload's digest and size are taken
    from its bytes and must be those of its header, if that has a SHA-1; a revisit has its header's digest and no size. Records of other types (warcinfo, request, metadata) are passed over.
    """

    def run(batches):
        for b in batches:
            rows = []
            for content in b.column(0):
                for head, block in parsed(memoryview(content.as_buffer())):
                    kind = head["warc-type"]
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    named, size = head.get("warc-payload-digest", ""), None
                    digest = named.removeprefix("sha1:") or None
                    if kind != "revisit":
                        body = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
                        size, own = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                        if named.startswith("sha1:") and own != digest:
                            raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
                        digest = own
                    rows.append((head["warc-record-id"], kind, head.get("warc-target-uri"), int(head["x-page-id"]) if "x-page-id" in head else None, digest, size, head.get("warc-refers-to")))
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["record_id", "record_type", "target_uri", "page_id", "digest", "payload_bytes", "refers_to_id"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, record_type string, target_uri string, page_id long, digest string, payload_bytes long, refers_to_id string")


def resolved(archived: DataFrame) -> DataFrame:
    """Records read from archives with revisits joined to their responses: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    originals = archived.filter("record_type = 'response'").groupBy(F.col("record_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.first("page_id").alias("_page"), F.first("payload_bytes").alias("_bytes"))
    out = archived.join(originals, (F.col("refers_to_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return out.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"))


def fresh_path(base: str) -> str:
    return f"{base.rstrip('/')}/lograil/warc-{uuid.uuid4().hex}"
