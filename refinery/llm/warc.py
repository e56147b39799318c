"""WARC archives: one gzip member per record, and a splittable reader.

Writing. The first row (smallest page_id) of each payload becomes a ``response``;
the others are ``revisit`` records that name it and hold HTTP headers only. Equal
payloads are found by a partial aggregate on their SHA-1, so a payload shared by a
third of all pages is one row a task. Records are written by Spark's text writer,
whose line separator is a constant gzip member holding the two line ends that
close a WARC record; files are therefore plain multi-member gzip.

Reading. Tasks get byte ranges of the files (Spark's text reader with the gzip
magic as separator), so a large archive is read by many tasks, and a range owns
what starts in it. The magic may also occur inside compressed data: a candidate
counts if it decodes to a WARC header, and a member goes on over false magics
until its stream ends. A member whose false magic lies behind the end of its range
leaves fragments in two ranges; these few rows are put together in a second step.
Name archives other than ``*.gz``: Spark's readers unpack that suffix as one stream.

Nulls and ties: a null html is an empty payload, a null url leaves its header out.
A null page_id is written without a number and read as null; it is a response only
if no row with the payload has a number. Rows that repeat a page_id and payload are
all responses if it is the smallest. Payloads under ``least_bytes`` are always
responses. An empty table gives an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refinery.llm.store import fresh_path, in_tasks

MAGIC = b"\x1f\x8b\x08"
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:refinery:page:"
OUT_BYTES = 8 << 20


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


CLOSING = member(b"\r\n\r\n", 9)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The bytes of a record without its closing line ends."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def _encode(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers = (c[i].as_py() for c in batch.columns)
                out.append(member(record(page_id, url, payload, refers, date)))
                size += len(out[-1])
                if size >= OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
    return run


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages`` as WARC files (``part-*``) under ``path``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")) \
        .withColumn("sha", F.sha1("payload"))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha") \
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    refers = F.when(F.col("first") == F.col("page_id"), F.lit(None)).otherwise(F.col("first"))
    records = rows.join(first, "sha", "left").select("page_id", "url", "payload", refers.cast("long").alias("refers_to"))
    in_tasks(records, _encode(date), "record binary").select(F.col("record").cast("string").alias("value")) \
        .write.option("encoding", "ISO-8859-1").option("lineSep", CLOSING.decode("latin-1")).text(path)


def parse(data: bytes) -> dict | None:
    """Fields of a decoded record; None if it isn't one."""
    head, found, block = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        return None
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    block = block[:int(fields.get("content-length", len(block)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = [int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]

    def number(name: str) -> int | None:
        text = fields.get(name, "").strip("<>").rpartition(":")[2]
        return int(text) if text.lstrip("-").isdigit() else None

    kind = fields.get("warc-type", "")
    full = kind == "response"
    return {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind,
            "refers_to": number("warc-refers-to"), "payload": payload if full else None,
            "payload_bytes": len(payload) if full else next(iter(declared), None),
            "payload_digest": digest(payload) if full else fields.get("warc-payload-digest", "").removeprefix("sha1:")}


class Stream:
    """Decodes the pieces that follow magics, in order."""

    def __init__(self):
        self.raw: bytes | None = None  # of the open member
        self.decoder, self.text = None, b""

    def starts(self, data: bytes) -> bool:
        """Does a record, or the closing of one, begin here?"""
        try:
            d = zlib.decompressobj(31)
            text = d.decompress(data, 64)
        except zlib.error:
            return False
        return text.startswith(b"WARC/1.") or text == b"\r\n\r\n"

    def feed(self, piece: bytes) -> tuple[bool, bytes | None]:
        """(belongs to a known member, the decoded member if it ended)."""
        data = MAGIC + piece
        if self.raw is None or self.starts(data):
            if not self.starts(data):
                return False, None
            self.raw, self.decoder, self.text = b"", zlib.decompressobj(31), b""
        self.raw += data
        try:
            self.text += self.decoder.decompress(data)
        except zlib.error:
            self.raw = None  # a broken member
            return True, None
        if self.decoder.eof:
            text, self.raw = self.text, None
            return True, text
        return True, None


_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
           ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
_PARTS = [("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("fragment", pa.binary())]
RECORD_DDL = ("page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, "
              "payload_digest string")
_DDL = RECORD_DDL + ", file string, start long, seq long, fragment binary"
_SCHEMA = pa.schema(_FIELDS + _PARTS)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (value, file, start) in file order within a range: records, and the
    fragments at a range's ends (seq -1: its open member; from 0: leading pieces
    that begin no member)."""
    out, size, here, stream, leading, seq = [], 0, None, Stream(), True, 0

    def left_over() -> list[dict]:
        return [] if here is None or stream.raw is None else \
            [{"file": here[0], "start": here[1], "seq": -1, "fragment": stream.raw}]

    for batch in batches:
        for value, file, start in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != here:
                out += left_over()
                here, stream, leading, seq = (file, start), Stream(), True, 0
                if start == 0:
                    continue  # what lies before the first magic
            known, text = stream.feed(value)
            if known:
                leading = False
            elif leading:
                out.append({"file": file, "start": start, "seq": seq, "fragment": MAGIC + value})
                seq += 1
            if text is not None and (row := parse(text)) is not None:
                out.append(row)
                size += len(row["payload"] or b"") + 200
            if size >= OUT_BYTES:
                yield _batch(out)
                out, size = [], 0
    yield _batch(out + left_over())


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments sorted by (file, start, leading pieces before the open member)."""
    here, stream = None, Stream()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["file"] != here:
                here, stream = r["file"], Stream()
            if r["seq"] < 0:  # a member that ran out of its range
                stream = Stream()
                _, text = stream.feed(r["fragment"][len(MAGIC):])
            else:
                _, text = stream.feed(r["fragment"][len(MAGIC):]) if stream.raw is not None else (False, None)
            if text is not None and (row := parse(text)) is not None:
                out.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(_FIELDS))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``: page_id, url, record_type, refers_to,
    payload (null for revisits), payload_bytes and payload_digest of the full payload."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))
    found = in_tasks(lines, _scan, _DDL)
    names = [n for n, _ in _FIELDS]
    split = found.where("fragment is not null").select("file", "start", "seq", "fragment")
    order = F.when(F.col("seq") < 0, F.lit((1 << 63) - 1)).otherwise(F.col("seq"))
    joined = in_tasks(split.repartition("file").sortWithinPartitions("file", "start", order), _stitch, RECORD_DDL)
    return found.where("fragment is null").select(*names).unionByName(joined)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared folder, read them back, describe each record."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
