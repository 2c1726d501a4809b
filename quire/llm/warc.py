"""WARC archives through a chunked record table.

Payloads travel as rows (record, chunk number, bytes), so no step in Python holds a whole record: the writer
compresses chunk after chunk into one gzip member per record, and the reader decompresses a stream and emits
chunk rows with the number of bytes and the SHA-1 so far; the last chunk's are those of the payload. Files
are named anew by each attempt and count only if the task's row reached the written manifest, so a lost
executor leaves nothing that is read.

Defined cases: a null html is an empty payload; a null url is written as ``about:blank``; a null page_id is
read back as null and never referred to; rows with one page_id and payload are written as they are, none
referring to the other; an empty table gives no files and no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Written, mapped, new_path, row_key, small

CHUNK = 1 << 18
ROLL = 1 << 28
LEAST_SHARED = 1000
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def _open(uri: str, write: bool):
    from pyarrow import fs

    at, path = fs.FileSystem.from_uri(uri)
    if not write:
        return at.open_input_stream(path, compression=None)
    at.create_dir(path.rpartition("/")[0])
    return at.open_output_stream(path, compression=None)


def record_urn(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id} {digest}')}>"


def head(page_id, url, n: int, digest: str, refers_to, date: str = DATE) -> bytes:
    """Header fields and the HTTP head, up to the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_urn(page_id, digest)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_urn(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (n if refers_to is None else 0)}"]
    return "\r\n".join(lines).encode() + END + http


def chunk_table(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (page_id, url, n, digest, refers_to, chunk_no, last, data) in record order within each partition."""
    data = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", "html")
    rows = rows.select(*row_key(rows), "page_id", "url", data.alias("data"))
    meta = Written(rows.select("key_a", "key_b", "page_id", F.octet_length("data").cast("long").alias("n"), F.sha1("data").alias("digest")), "payloads").df
    shared = meta.where(F.col("n") >= LEAST_SHARED).groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    revisits = Written(meta.join(shared, ["digest", "n"]).where("page_id <> refers_to").select("key_a", "key_b", "refers_to").distinct(), "revisits").df
    rows = rows.join(small(revisits), ["key_a", "key_b"], "left")
    rows = rows.select("page_id", "url", "refers_to", F.octet_length("data").cast("long").alias("n"), F.sha1("data").alias("digest"), F.when(F.col("refers_to").isNull(), F.col("data")).otherwise(F.lit(b"")).alias("data"))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("data") / chunk).cast("int") - 1)
    rows = rows.select("*", last.alias("last_no"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("last_no"))).alias("chunk_no"))
    part = F.substring("data", F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return rows.select("page_id", "url", "n", "digest", "refers_to", "chunk_no", (F.col("chunk_no") == F.col("last_no")).alias("last"), part.alias("data"))


def write_warc(pages: DataFrame, folder: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Writes archives and returns the manifest (path, records, bytes)."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(it):
        out, made, path, n = None, 0, "", 0
        for b in it:
            for page_id, url, size, digest, refers_to, no, last, data in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "n", "digest", "refers_to", "chunk_no", "last", "data"))):
                if out is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, made, n = _open(path, True), 0, 0
                if no == 0:
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    made += out.write(gz.compress(head(page_id, url, size, digest, refers_to)))
                made += out.write(gz.compress(data))
                if last:
                    made += out.write(gz.compress(END) + gz.flush())
                    n += 1
                    if made >= ROLL:
                        out.close()
                        out = None
                        yield manifest(path, n, made)
        if out is not None:
            out.close()
            yield manifest(path, n, made)

    def manifest(*row):
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["path", "records", "bytes"])

    return Written(mapped(chunk_table(pages, chunk), run, "path string, records long, bytes long", 200), "manifest").df


class Stream:
    """Decompresses gzip members one after another; holds what was not taken yet."""

    def __init__(self, file, step: int = 1 << 16):
        self.file, self.step, self.gz, self.raw, self.buf = file, step, zlib.decompressobj(31), b"", bytearray()

    def more(self) -> bool:
        if not self.raw:
            self.raw = self.file.read(self.step)
            if not self.raw:
                return False
        if self.gz.eof:
            self.gz = zlib.decompressobj(31)
        self.buf += self.gz.decompress(self.raw, self.step)
        self.raw = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.buf.find(mark, seen)) < 0:
            seen = max(0, len(self.buf) - len(mark))
            if not self.more():
                return None
        out = bytes(self.buf[:at])
        del self.buf[: at + len(mark)]
        return out

    def take(self, most: int) -> bytes:
        while len(self.buf) < most and self.more():
            pass
        out = bytes(self.buf[:most])
        del self.buf[:most]
        return out


def records(file, chunk: int = CHUNK) -> Iterator[tuple]:
    """(page_id, record_type, refers_to, chunk_no, last, payload bytes so far, SHA-1 so far, agrees, data)."""
    stream = Stream(file)
    while (raw := stream.until(END)) is not None:
        fields = dict(x.split(": ", 1) for x in raw.decode().split("\r\n") if ": " in x)
        http = stream.until(END) + END
        left = int(fields["Content-Length"]) - len(http)
        page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
        kind, stated = fields["WARC-Type"], base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        ids = (None if page is None else int(page), kind, None if refers is None else int(refers))
        if kind == "revisit":
            n = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
            yield (*ids, 0, True, n, stated, True, b"")
        else:
            sha, n, no = hashlib.sha1(), 0, 0
            while True:
                data = stream.take(min(chunk, left))
                sha.update(data)
                left, n = left - len(data), n + len(data)
                if left and not data:
                    raise EOFError(f"record of page {page} is cut short")
                yield (*ids, no, not left, n, sha.hexdigest(), bool(left) or sha.hexdigest() == stated, data)
                no += 1
                if not left:
                    break
        stream.take(len(END))


def read_warc(spark: SparkSession, manifest: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives in ``manifest`` (path)."""
    types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = ["page_id", "record_type", "refers_to", "chunk_no", "last", "n", "sha1", "agrees", "data"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(it):
        for b in it:
            for path in b.column("path").to_pylist():
                with _open(path, False) as file:
                    rows, size = [], 0
                    for r in records(file, chunk):
                        rows.append(r if with_data else (*r[:-1], b""))
                        size += len(rows[-1][-1])
                        if size > 4_000_000 or len(rows) >= 10_000:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    schema = "page_id long, record_type string, refers_to long, chunk_no int, last boolean, n long, sha1 string, agrees boolean, data binary"
    return mapped(manifest.select("path").repartition(max(1, manifest.count())), run, schema)
