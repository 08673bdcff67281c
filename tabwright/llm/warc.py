"""WARC archives: gzip member per record, sequential reading with bounded memory, digests verified.

``write_warc`` stores rows as response and revisit records; ``read_warc`` streams archives back: each member is
decompressed in steps of 64 KB, framed by its Content-Length, and its block and payload digests are verified while
the bytes go by. A record that is damaged gives a row whose ``error`` says what is wrong, and reading goes on at the
next member; where compressed bytes are damaged, or bytes stand between members, that is the next place from which a
record can be unpacked. WARC headers may have up to ``MOST_HEADER`` bytes, the HTTP
headers of a payload up to ``MOST_HEAD``; a payload may have any length and is held once, to be given back.
Archives are reached through ``pyarrow.fs`` (file, hdfs, s3, gs), at paths that all executors share.

Defined results: a null payload is an empty one; a null URL leaves its header out; a null id makes a record without
a numbered id. Of rows that tie on the largest id of equal payloads, all are responses. An empty table makes no
archive. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import new_folder, shared_table

STEP = 1 << 16
#: Bytes of HTTP headers, and of a record's own, which a URL makes longer.
MOST_HEAD, MOST_HEADER = 1 << 20, 16 << 20
MEMBER_START = b"\x1f\x8b\x08"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "archive string, record_offset long, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary, error string"
)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Add ``revisit_of``: for payloads of at least ``min_bytes`` that equal another's, the largest id of the equal ones."""
    keyed = pages.withColumn("_warc_key", F.sha2(F.col(payload_col), 256))
    large = keyed.where(F.octet_length(payload_col) >= min_bytes)
    # A written table, so that the join below has plain exchanges on both sides and skewed keys can be split.
    targets = shared_table(
        large.groupBy("_warc_key").agg(F.max(id_col).alias("_warc_target"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"),
        "warc-targets",
    )
    target = F.col("_warc_target")
    same = target.isNull() | (F.octet_length(payload_col) < min_bytes)
    return (
        keyed.join(targets, "_warc_key", "left")
        .withColumn("revisit_of", F.when(same | F.col(id_col).eqNullSafe(target), None).otherwise(target))
        .drop("_warc_key", "_warc_target")
    )


def record_bytes(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One uncompressed record: a response, or a revisit that leaves the payload out."""
    head = HTTP_HEAD % len(payload)
    block = head if refers_to else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "payload",
    level: int = 4,
    archive_bytes: int = 256 << 20,
    date: str = "2020-01-01T00:00:00Z",
) -> DataFrame:
    """Write archives below ``folder`` and return the manifest (archive, records, bytes).

    Each task writes files of its own name; only those of tasks that succeeded enter the manifest, so what a lost
    executor left behind is never read.
    """
    spark = pages.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, name, n, size, made = None, "", 0, 0, []
        for batch in batches:
            for page, uri, payload, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                ids = [None if x is None else f"urn:page:{x}" for x in (page, target)]
                member = gzip_member(record_bytes(ids[0] or f"urn:uuid:{uuid.uuid4()}", uri, payload, ids[1], date), level)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    made.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            made.append((f"{folder}/{name}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True) if made else [(), (), ()], (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "records", "bytes"])

    rows = pages.select(id_col, F.col(uri_col).cast("string"), F.col(payload_col).cast("binary"), "revisit_of")
    path = f"{folder}/manifest"
    rows.mapInArrow(write, "archive string, records long, bytes long").write.parquet(path)
    return spark.read.parquet(path)


class RecordStream:
    """The bytes of consecutive gzip members, decompressed in steps."""

    def __init__(self, raw) -> None:
        self.raw, self.rest, self.offset, self.read_so_far = raw, b"", 0, 0
        self.unzip, self.plain = None, b""

    def next_member(self) -> bool:
        """Go to the next member, skipping what is left of this one."""
        while self.unzip is not None and not self.unzip.eof and self._more():
            self.plain = b""
        if self.unzip is not None:
            self.rest = self.unzip.unused_data or self.rest
        self.rest = self.rest or self._load()
        self.offset, self.plain = self.read_so_far - len(self.rest), b""
        self.unzip = zlib.decompressobj(31) if self.rest else None
        return self.unzip is not None

    def resume(self) -> bool:
        """Go back to the start of this member and on to the next place where a record begins; False if there is none."""
        at, held = self.offset + 1, b""
        self.raw.seek(at)
        while data := self.raw.read(STEP):
            held += data
            k = held.find(MEMBER_START)
            while k >= 0:
                self.raw.seek(at + k)
                try:
                    begins = zlib.decompressobj(31).decompress(self.raw.read(4096), 5) == b"WARC/"
                except zlib.error:
                    begins = False
                if begins:
                    self.raw.seek(at + k)
                    self.rest, self.read_so_far, self.unzip, self.plain = b"", at + k, None, b""
                    return True
                k = held.find(MEMBER_START, k + 1)
            at, held = at + len(held) - min(2, len(held)), held[-2:]
            self.raw.seek(at + len(held))
        return False

    def _load(self) -> bytes:
        data = self.raw.read(STEP)
        self.read_so_far += len(data)
        return data

    def _more(self) -> bool:
        """Decompress another step; False at the member's end."""
        while not self.unzip.eof:
            data = self.unzip.unconsumed_tail or self.rest or self._load()
            self.rest = b""
            if not data:
                raise ValueError("archive ends within a record")
            plain = self.unzip.decompress(data, STEP)
            if plain:
                self.plain += plain
                return True
        return False

    def line_block(self) -> bytes:
        """Up to the next blank line, without it; at most ``MOST_HEADER`` bytes and a step are held in search of it."""
        seen = 0
        while (end := self.plain.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.plain)
            if seen > MOST_HEADER:
                raise ValueError(f"a header of more than {MOST_HEADER} bytes")
            if not self._more():
                raise ValueError("no end of headers")
        block, self.plain = self.plain[:end], self.plain[end + 4 :]
        return block

    def body(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.plain and not self._more():
                raise ValueError("block shorter than Content-Length")
            step, self.plain = self.plain[:length], self.plain[length:]
            length -= len(step)
            yield step


def headers(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is left out."""
    found = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def block_length(head: dict[str, str]) -> int:
    """The Content-Length of a header: digits 0 to 9, nothing else, and no more than a file can hold."""
    given = head.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", given):
        raise ValueError(f"Content-Length {given[:40]!r} is no length")
    return int(given)


def read_record(stream: RecordStream, keep_payload: bool) -> dict:
    """The record of the member at which ``stream`` stands, with both digests verified."""
    head = headers(stream.line_block())
    block_hash, payload_hash, kept, size, before = hashlib.sha1(), hashlib.sha1(), [], 0, b""
    http = "application/http" in head.get("content-type", "")
    for step in stream.body(block_length(head)):
        block_hash.update(step)
        if http:  # up to the blank line these are the HTTP headers
            seen = max(0, len(before) - 3)
            before += step
            if (end := before.find(b"\r\n\r\n", seen)) < 0:
                if len(before) > MOST_HEAD:
                    raise ValueError(f"HTTP headers of more than {MOST_HEAD} bytes")
                continue
            step, http, before = before[end + 4 :], False, b""
        payload_hash.update(step)
        size += len(step)
        if keep_payload:
            kept.append(step)
    while len(stream.plain) < 4 and stream._more():
        pass
    named = lambda key: head.get(key, "").rpartition(":")[2]
    is_revisit = head.get("warc-type") == "revisit"
    found = lambda h: base64.b32encode(h.digest()).decode()
    wrong = None
    if stream.plain != b"\r\n\r\n":
        wrong = "record doesn't end after its block"
    elif named("warc-block-digest") not in ("", found(block_hash)):
        wrong = "block digest differs"
    elif not is_revisit and named("warc-payload-digest") not in ("", found(payload_hash)):
        wrong = "payload digest differs"
    bare = lambda key: head[key].strip("<>") if key in head else None
    return {
        "record_type": head.get("warc-type"), "record_id": bare("warc-record-id"), "target_uri": head.get("warc-target-uri"), "refers_to": bare("warc-refers-to"),
        "payload_digest": named("warc-payload-digest") if is_revisit else found(payload_hash), "payload_bytes": None if is_revisit else size, "payload": b"".join(kept) if keep_payload and not is_revisit else None, "error": wrong,
    }


def records(raw, keep_payload: bool = True) -> Iterator[dict]:
    """All records of an open archive in order; a damaged member gives a row with ``error``."""
    stream = RecordStream(raw)
    while True:
        try:
            if not stream.next_member():
                return
        except (ValueError, zlib.error):  # in what was left of a record that has its row
            if not stream.resume():
                return
            continue
        at = stream.offset
        try:
            yield {"record_offset": at} | read_record(stream, keep_payload)
        except (ValueError, KeyError, zlib.error) as e:
            yield {"record_offset": at, "error": f"{type(e).__name__}: {e}"}
            if (isinstance(e, zlib.error) or "within" in str(e)) and not stream.resume():
                return


def read_warc(archives: DataFrame, keep_payload: bool = True, rows_per_batch: int = 256) -> DataFrame:
    """Rows of ``RECORD_SCHEMA`` from the archives that column ``archive`` names, one task reading each in sequence."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, RECORD_SCHEMA.split(", "), strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, path = fs.FileSystem.from_uri(archive)
                with files.open_input_file(path) as raw:
                    rows, held = [], 0
                    for row in records(raw, keep_payload):
                        rows.append(row | {"archive": archive})
                        held += len(row.get("payload") or b"")
                        if len(rows) >= rows_per_batch and (keep_payload or len(rows) >= 8192) or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    spark = archives.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return archives.select("archive").repartition(tasks).mapInArrow(read, RECORD_SCHEMA)


def archives_in(spark: SparkSession, path: str) -> DataFrame:
    """The ``*.warc.gz`` files below ``path``, without reading them (the content column is pruned)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(path)
    return found.select(F.col("path").alias("archive"))


def resolve_revisits(rows: DataFrame) -> DataFrame:
    """Give each revisit the ``payload_bytes`` of the response that it refers to."""
    full = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("full_id"), F.col("payload_digest").alias("full_digest")).agg(F.max("payload_bytes").alias("full_bytes"))
    full = shared_table(full, "warc-responses")  # so that a response with very many revisits can be split in the join
    at = (F.col("refers_to") == F.col("full_id")) & (F.col("payload_digest") == F.col("full_digest"))
    return rows.join(full, at, "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes")).drop("full_id", "full_digest", "full_bytes")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a WARC record per page to the shared folder, read the archives back, and describe each page's record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    manifest = write_warc(mark_revisits(pages, "page_id", "payload"), new_folder(spark, "warc"))
    rows = shared_table(read_warc(manifest, keep_payload=False).drop("payload"), "warc-records")
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return resolve_revisits(rows).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: Base32 of a SHA-1: four times 40 bits, each eight digits to the base of 32.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS target,
         translate(concat(to_base(('0x' || h[1:10])::BIGINT, 32, 8), to_base(('0x' || h[11:20])::BIGINT, 32, 8), to_base(('0x' || h[21:30])::BIGINT, 32, 8), to_base(('0x' || h[31:40])::BIGINT, 32, 8)),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type, nullif(target, page_id) AS refers_to FROM d
"""
