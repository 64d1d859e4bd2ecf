"""Operator 7: WARC archives, written and read back with segment reassembly.

Writing. Each page becomes a response record: an HTTP head and the payload in chunked transfer
framing. A block over `segment_bytes` is cut: the first record holds segment 1, continuation records
hold the rest, name the first by WARC-Segment-Origin-ID and are numbered; the last gives the total
length. Of pages with equal payloads of at least 100 bytes, that with the smallest id is written in
full and the others are revisit records with the HTTP head alone. Records go through Spark's own text
writer, one per line, with the two line ends that close a record as the line separator: what lands
on disk are plain (gzipped) WARC files, in whatever store the path names.

Reading. Files are read as whole binaries (their size is bounded at writing), parsed record by record
by Content-Length, and only the segmented records are shuffled: they are grouped by origin, ordered
by segment number, checked for gaps and against the total length, and joined. Then the chunked
framing is decoded. A broken group or framing fails the job.

Chunks and segments are cut between characters, so each record is valid text.

Defined results: null html is an empty payload; rows with equal page_id and payload are written as
often as they stand and are all response if theirs is the smallest id; a null page_id ranks last; an
empty table gives no rows; other columns are left out."""

from __future__ import annotations

import functools
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, remove, shelve, table, text_batches

#: Shorter payloads are never revisited.
LEAST_SHARED = 100
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 2_000
END = "\r\n\r\n"
_URN = "<urn:uuid:{}>"


def _text_cuts(block: bytes, size: int) -> list[bytes]:
    """Parts of at most `size` bytes that begin at characters."""
    cuts, at = [], 0
    while len(block) - at > size:
        end = at + size
        while block[end] & 0xC0 == 0x80:
            end -= 1
        cuts.append(block[at:end])
        at = end
    return [*cuts, block[at:]]


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in _text_cuts(payload, size) if p]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """Decodes chunked transfer framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not n:
            return b"".join(out)
        out.append(body[at : at + n])
        if len(out[-1]) != n or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += n + 2


def _record(kind: str, rid: str, block: bytes, **fields: object) -> str:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": "2000-01-01T00:00:00Z", **{k: v for k, v in fields.items() if v is not None}, "Content-Length": len(block)}
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n" + block.decode()


def records_of(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, nth: str, segment_bytes: int) -> Iterator[str]:
    """The records of one page; `nth` makes record ids of equal rows differ."""
    rid = _URN.format(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest} {nth}"))
    url = " ".join((url or "about:blank").split())
    common = {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Page": page_id}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\nX-Payload-Bytes: %d\r\n\r\n" % len(payload)
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record("revisit", rid, head, **common, **{"WARC-Profile": profile, "WARC-Refers-To-Page": refers_to, "Content-Type": "application/http;msgtype=response"})
        return
    block = head + chunked(payload)
    first, *rest = _text_cuts(block, segment_bytes)
    yield _record("response", rid, first, **common, **{"Content-Type": "application/http;msgtype=response", "WARC-Segment-Number": 1 if rest else None})
    for n, part in enumerate(rest, 2):
        own = _URN.format(uuid.uuid5(uuid.NAMESPACE_URL, f"{rid} {n}"))
        yield _record("continuation", own, part, **{"WARC-Segment-Origin-ID": rid, "WARC-Segment-Number": n, "WARC-Segment-Total-Length": len(block) if n == len(rest) + 1 else None, "WARC-Target-URI": url})


def _to_records(batches: Iterator[pa.RecordBatch], segment_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch, htmls in text_batches(batches, "html", 4_000_000):
        ids, urls, digests, firsts, nth = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "nth"))
        out = [r for i, u, h, d, f, n in zip(ids, urls, htmls, digests, firsts, nth, strict=True) for r in records_of(i, u, h, d, f, str(n), segment_bytes)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes the archives of (page_id, url, html) rows to a folder."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    firsts = pages.where(F.col("n") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("digest", "first")
    # pages meet the shared digests by digest: if those are too many to be sent along, pages move, and a hot digest is split
    met = pages.join(firsts, "digest", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    met = met.select("page_id", "url", "html", "digest", refers.alias("refers_to"), F.monotonically_increasing_id().alias("nth"))
    out = met.mapInArrow(functools.partial(_to_records, segment_bytes=segment_bytes), "value string")
    out.write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of a file."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:head_end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        block = data[head_end + 4 : head_end + 4 + n]
        at = head_end + 4 + n + 4
        if len(block) != n or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("broken record")
        yield fields, block


_READ = "kind string, record_id string, origin string, segment int, total long, page_id long, uri string, digest string, refers_to long, block binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "record_id", "origin", "segment", "total", "page_id", "uri", "digest", "refers_to", "block"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    num = lambda f, k: int(f[k]) if f.get(k, "None") != "None" else None
    for batch in batches:
        for data in batch.column("content"):
            raw = data.as_py()
            raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            rows: list[tuple] = []
            size = 0
            for f, block in parse(raw):
                origin = f.get("warc-segment-origin-id") or (f["warc-record-id"] if "warc-segment-number" in f else None)
                digest = f.get("warc-payload-digest", "").rpartition(":")[2] or None
                rows.append((f["warc-type"], f["warc-record-id"], origin, num(f, "warc-segment-number"), num(f, "warc-segment-total-length"), num(f, "warc-page"), f.get("warc-target-uri"), digest, num(f, "warc-refers-to-page"), block))
                size += len(block)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads, sizes = [], []
        for kind, block in zip(batch.column("kind").to_pylist(), batch.column("block").to_pylist(), strict=True):
            head, _, body = block.partition(b"\r\n\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
            if kind == "revisit":
                payloads.append(None)
                sizes.append(int(fields[b"x-payload-bytes"]))
            else:
                payloads.append(dechunk(body) if fields.get(b"transfer-encoding") == b"chunked" else body)
                sizes.append(len(payloads[-1]))
        digests = [d if p is None else hashlib.sha256(p).hexdigest() for p, d in zip(payloads, batch.column("digest").to_pylist(), strict=True)]
        if any(d and d != x for d, x in zip(batch.column("digest").to_pylist(), digests, strict=True)):
            raise ValueError("a payload does not have its digest")
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("uri"), batch.column("kind"), batch.column("refers_to"), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(payloads, pa.binary())],
            names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"],
        )


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for a revisit)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    records = files.mapInArrow(_parsed, _READ)
    alone = records.where("origin IS NULL").select("kind", "page_id", "uri", "digest", "refers_to", "block")
    parts = records.where("origin IS NOT NULL")
    one = lambda c: F.max(F.when(F.col("kind") != "continuation", F.col(c))).alias(c)
    whole = parts.groupBy("origin").agg(one("page_id"), one("uri"), one("digest"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["block"]))
    numbers = F.transform("parts", lambda p: p["segment"])
    sound = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (F.octet_length("block") == F.col("total"))
    whole = whole.withColumn("block", joined).withColumn("block", F.when(sound, F.col("block")).otherwise(F.raise_error(F.lit("segments are missing"))))
    whole = whole.select(F.lit("response").alias("kind"), "page_id", "uri", "digest", F.lit(None).cast("long").alias("refers_to"), "block")
    return alone.unionByName(whole).mapInArrow(_payloads, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archive_folder(spark)
    write(table(spark, sf_dir, "pages"), path)
    out, _ = shelve(read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, path)
    return out


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
