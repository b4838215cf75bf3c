"""Operator 7, WARC: records are written as archives and read back by boundary-chain verification.

Writing: records are put together by DataFrame functions, numbered into archives and compressed, a
gzip member each, as Arrow batches; the text sink then writes the members as they are, so it works on
any file system that Spark knows. An archive is closed once its records have `most_bytes` bytes or
`per_file` records, so what a reader holds is bounded whatever the payloads.

Reading, an archive at a time: every place where a record could begin, payloads included, is a
candidate whose successor follows from its Content-Length; only offsets are gathered, in one pass
over the bytes. Pointer jumping from offset 0 then retains what is reachable: a record inside a
payload has no predecessor in the chain. Only retained records are parsed and hashed, so records
nested in payloads cost no more than other bytes. Offsets are those in the unpacked archive.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_path, table
from tessera.runtime import ship

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PER_FILE = 2000
MOST_BYTES = 1 << 25
#: A member's last byte, the top one of its size, is 0 for up to so many bytes; longer records have more members.
_MEMBER = (1 << 24) - 1


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary: 160 bits are four groups of eight digits."""
    hexed, digits = F.sha1(payload), []
    for group in range(4):
        bits = F.conv(F.substring(hexed, 10 * group + 1, 10), 16, 10).cast("long")
        digits += [F.substring(F.lit(ALPHABET), F.shiftright(bits, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(7, -1, -1)]
    return F.concat(*digits)


def _records(pages: DataFrame, min_bytes: int, version: str, date: str) -> DataFrame:
    """A whole record per row of pages, as `record` (binary)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    firsts = p.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    p = p.join(firsts, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")) & (F.col("size") >= min_bytes)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(f"WARC/{version}\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(f">\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(f">\r\nWARC-Profile: http://netpreserve.org/warc/{version}/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"),
    )
    return p.select(record.cast("binary").alias("record"))


def members(record: bytes) -> bytes:
    """The record as gzip; one member up to 16 MB, so that its last byte is 0."""
    out = []
    for at in range(0, len(record), _MEMBER):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(z.compress(record[at : at + _MEMBER]) + z.flush())
    return b"".join(out)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, per_file: int = PER_FILE, most_bytes: int = MOST_BYTES, version: str = "1.1", date: str | None = None) -> None:
    """Writes a record per row of pages (page_id, url, html) as gzip archives, a member each, under `path`.

    The payload is html in UTF-8, a null one empty. Of records with equal payloads of at least
    `min_bytes` bytes, those with the smallest page_id are `response`, the others `revisit` records
    without payload that refer to it; smaller payloads are always `response`. Repeated rows give
    repeated records. A null page_id is written as `null` and comes after all others. A null url
    gives no WARC-Target-URI; control characters in it are percent-encoded. An archive has `per_file`
    records and `most_bytes` bytes before compression at most, or one record. WARC-Date is `date`, by
    default the time of writing. Payloads of any length are written whole; other columns are ignored;
    an empty table gives no archive. Archives are named part-*.txt by the text sink; `read_warc` goes
    by their content.
    """
    ship(pages.sparkSession)
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = n = size = 0
        for b in batches:
            for record in b.column("record"):
                raw = record.as_py()
                if n and (n == per_file or size + len(raw) > most_bytes):
                    archive, n, size = archive + 1, 0, 0
                n, size = n + 1, size + len(raw)
                # The text sink ends each value with its line separator, here the member's last byte.
                yield pa.RecordBatch.from_arrays([pa.array([members(raw)[:-1]], pa.binary()), pa.array([archive], pa.int32())], names=["member", "archive"])

    packed = _records(pages, min_bytes, version, date).mapInArrow(run, "member binary, archive int")
    packed.select(F.col("member").cast("string").alias("value"), "archive").write.partitionBy("archive").option("compression", "none").option("lineSep", "\0").text(path)


def _unpacked(content: bytes) -> bytes:
    """gzip of one or more members, or plain bytes. What is left after a member isn't copied for each of them."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, view, at, step = [], memoryview(content), 0, 1 << 16
    while at < len(content) and content[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof and at < len(content):
            piece = view[at : at + step]
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
    return b"".join(out)


def candidates(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Every place that could begin a record, and its successor (-1: not a whole record), in one pass over the bytes."""
    at = lambda pattern: np.fromiter((m.start() for m in re.finditer(pattern, raw)), np.int64)
    begin, heads = at(MAGIC), at(rb"(?=\r\n\r\n)")
    sizes = [(m.start(), int(m[1])) for m in re.finditer(rb"(?i)(?<=\r\n)content-length:[ \t]*(\d{1,15})[ \t]*(?=\r\n)", raw)]
    where, size = (np.array(x, np.int64) for x in zip(*sizes)) if sizes else (np.zeros(0, np.int64),) * 2
    following = np.full(len(begin), -1, np.int64)
    if len(begin) and len(heads) and len(where):
        h, w = np.searchsorted(heads, begin), np.searchsorted(where, begin)
        ok = (h < len(heads)) & (w < len(where))
        h, w = np.where(ok, h, 0), np.where(ok, w, 0)
        end = heads[h] + 4 + size[w]
        ok &= (where[w] < heads[h]) & np.isin(end, heads)
        following[ok] = end[ok] + 4
    return begin, following


def parsed(raw: bytes, off: int, following: int) -> dict:
    """What a whole record says, and the digest of its payload."""
    head_end = raw.index(b"\r\n\r\n", off)
    lines = raw[off:head_end].split(b"\r\n")
    said: dict[bytes, bytes] = {}
    for k, _, v in (x.partition(b":") for x in lines[1:]):
        said.setdefault(k.strip().lower(), v.strip())
    block = raw[head_end + 4 : following - 4]
    text = lambda key: said[key].decode("utf-8", "replace") if key in said else None
    row = {"off": off, "next": following, "record_type": text(b"warc-type") or "", "record_id": text(b"warc-record-id"), "target_uri": text(b"warc-target-uri"), "date": text(b"warc-date")}
    for key, name in ((b"warc-record-id", "page_id"), (b"warc-refers-to", "refers_to")):
        n = re.fullmatch(rb"<urn:page:(-?\d+)>", said.get(key, b""))
        row[name] = int(n[1]) if n else None
    head, payload = b"", block
    if said.get(b"content-type", b"").lower().startswith(b"application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
    row["payload_bytes"], row["payload"] = len(payload), payload
    if row["record_type"] == "revisit":
        size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
        row["payload_bytes"] = int(size[1]) if size else len(payload)
        row["payload_digest"] = said.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace")
    else:
        row["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return row


def reachable(off: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which offsets (sorted) a chain from offset 0 reaches, by pointer jumping: each round doubles the step."""
    n = len(off)
    at = np.searchsorted(off, following)
    jump = np.where((at < n) & (off[np.minimum(at, n - 1)] == following), at, n)
    jump = np.append(jump, n)
    seen = np.zeros(n + 1, bool)
    seen[0] = bool(n and off[0] == 0)
    for _ in range(n.bit_length() + 1):
        seen[jump[seen]] = True
        seen[n] = False
        jump = jump[jump]
    return seen[:n]


_KINDS = [("path", pa.string()), ("off", pa.int64()), ("next", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
          ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives under `path`, sub-folders included: path, off, next and what each says.

    Archives are `*.warc`, `*.warc.gz` and whatever else lies there, plain or gzip by their first
    bytes, WARC 1.0 or 1.1. A chain ends at the end of the archive or where it is broken; what lies
    beyond a break is not returned. Digest and length of a response are computed from its payload;
    a revisit gives those of the record that it refers to. `payloads` adds them as a column. page_id
    and refers_to are those that `write_warc` gave, else null. A folder without archives gives no
    rows. A task holds one archive at a time.
    """
    ship(spark)
    kinds = pa.schema(_KINDS + ([("payload", pa.binary())] if payloads else []))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name, raw = b.column("path")[k].as_py(), _unpacked(b.column("content")[k].as_py())
                off, following = candidates(raw)
                kept = np.flatnonzero(reachable(off, following) & (following >= 0))
                for lo in range(0, len(kept), 256):
                    rows = [parsed(raw, int(off[i]), int(following[i])) | {"path": name} for i in kept[lo : lo + 256]]
                    yield pa.RecordBatch.from_pylist([{c: r[c] for c in kinds.names} for r in rows], kinds)

    schema = ", ".join(f"{n} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for n, t in zip(kinds.names, kinds.types))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(scan, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every row of `pages` as a record, reads the archives back; see write_warc and read_warc."""
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = " || ".join(
    f"substr('{ALPHABET}', 1 + CAST((('0x' || substr(h, {10 * g + 1}, 10))::BIGINT >> {5 * k}) & 31 AS INT), 1)" for g in range(4) for k in range(7, -1, -1)
)
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d
"""
