"""WARC archives as chunked record tables.

A payload is a series of rows (record, chunk number, bytes), so neither writer nor reader holds a whole
record: the writer streams chunks into one gzip member a record, the reader streams members out again
and carries the digest from chunk to chunk. Each writing task names its file anew and reports it in a
manifest that Spark commits with the task; a file of a failed or repeated attempt is in no manifest and
is never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

CHUNK_BYTES = 64 << 10
LEAST_REVISIT = 1000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunks(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """The chunk table: record, url, record_type, refers_to, payload_bytes, payload_digest, chunk, data.

    Of payloads of least bytes or more with one digest, the largest id is the response and the others
    revisit it, with one chunk without data. Digests are grouped without the payloads, and the copies of a
    group, however many, come together as a partial maximum only.
    """
    data = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("record"), F.col(url_col).alias("url"), data.alias("data")).withColumns({"payload_bytes": F.octet_length("data").cast("long"), "payload_digest": F.sha1("data")})
    light = rows.filter(F.col("payload_bytes") >= least).select("record", "payload_digest")
    firsts = light.groupBy("payload_digest").agg(F.max("record").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("payload_digest", "first")
    again = light.join(firsts, "payload_digest").filter("record < first").select("record", "payload_digest", F.col("first").alias("refers_to")).distinct()
    named = rows.join(again, ["record", "payload_digest"], "left").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    last = F.when(F.col("refers_to").isNull(), F.greatest(F.ceil(F.col("payload_bytes") / chunk_bytes).cast("int") - 1, F.lit(0))).otherwise(0)
    named = named.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    piece = F.when(F.col("refers_to").isNull(), F.substring(F.col("data"), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return named.select("record", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk", piece.alias("data"))


def _urn(record, digest: str) -> str:
    return f"urn:page:{'' if record is None else 'id-' + quote(str(record), safe='')}:{digest}"


def _page(urn: str | None) -> str | None:
    """The id in a record's name; null for a record without."""
    found = urn.split(":")[2] if urn else ""
    return unquote(found.removeprefix("id-")) if found else None


def _head(record, url, kind, refers_to, size: int, digest: str) -> bytes:
    """The WARC header of a record and its HTTP header, up to the payload. A record is named by its id and its payload's digest."""
    http = _HTTP.format(size).encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_urn(record, digest)}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    lines += [f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_urn(refers_to, digest)}>"]
    lines.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write(table: DataFrame, folder: str) -> DataFrame:
    """Write a chunk table, whose chunks of a record come in order in one partition, as archives; returns the manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        path, out, member, n = f"{base}/{uuid.uuid4().hex}.warc.gz", None, None, 0
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("record", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk", "data")]
            for record, url, kind, refers_to, size, digest, chunk, data in zip(*cols, strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                if chunk == 0:
                    if member is not None:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
                    member, n = zlib.compressobj(1, zlib.DEFLATED, 31), n + 1
                    out.write(member.compress(_head(record, url, kind, refers_to, size, digest)))
                out.write(member.compress(data or b""))
        if out is not None:
            out.write(member.compress(b"\r\n\r\n") + member.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return common.saved(table.mapInArrow(run, "path string, records bigint"), f"{folder}-manifest")


class _Members:
    """Bytes of an archive, decompressed as they are asked for."""

    def __init__(self, raw):
        self.raw, self.gz, self.buf, self.rest = raw, zlib.decompressobj(31), bytearray(), b""

    def fill(self) -> bool:
        while True:
            if self.gz.eof:
                self.rest, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            data = self.rest or self.raw.read(CHUNK_BYTES)
            self.rest = b""
            if not data:
                return False
            got = self.gz.decompress(data, CHUNK_BYTES)
            self.rest = self.gz.unconsumed_tail
            if got:
                self.buf += got
                return True

    def head(self) -> dict[str, str] | None:
        """The lines up to an empty one."""
        while (at := self.buf.find(b"\r\n\r\n")) < 0 or at == 0:
            if at == 0:
                del self.buf[:4]
            elif not self.fill():
                return None
        lines = bytes(self.buf[:at]).decode("utf-8", "replace").split("\r\n")
        del self.buf[: at + 4]
        return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}

    def body(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.buf and not self.fill():
                raise EOFError("the archive ends inside a record")
            part = bytes(self.buf[: min(size, CHUNK_BYTES)])
            del self.buf[: len(part)]
            size -= len(part)
            yield part


def read(spark: SparkSession, manifest: DataFrame, *, data: bool = True, id_type: str = "bigint") -> DataFrame:
    """The chunk table of the archives of a manifest: record, url, record_type, refers_to, payload_bytes, stated_digest, chunk, bytes_so_far, digest_so_far, last and data.

    payload_bytes is the HTTP length, which a revisit states too. A payload whose digest isn't the stated one is an error. Without data only the last row of each record comes, without its bytes.
    """
    names = ["record", "url", "record_type", "refers_to", "payload_bytes", "stated_digest", "chunk", "bytes_so_far", "digest_so_far", "last", "data"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    flush_rows = 2048 if not data else (common.BATCH_BYTES // CHUNK_BYTES)

    def records(path: str) -> Iterator[tuple]:
        fs, inner = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(inner, compression=None) as raw:
            src = _Members(raw)
            while (head := src.head()) is not None:
                http, size = src.head(), int(head["content-length"])
                name = lambda k, h=head: _page(h.get(k))
                length = int(http["content-length"])
                sha, so_far, chunk = hashlib.sha1(), 0, 0
                fixed = (name("warc-record-id"), head["warc-target-uri"], head["warc-type"], name("warc-refers-to"), length, head["warc-payload-digest"].removeprefix("sha1:"))
                left = length if head["warc-type"] == "response" else 0
                if size < left:
                    raise ValueError("a record is shorter than its payload")
                if not left:
                    yield (*fixed, 0, 0, sha.hexdigest(), True, b"" if data else None)
                for part in src.body(left):
                    sha.update(part)
                    so_far += len(part)
                    if so_far == left and sha.hexdigest() != fixed[5]:
                        raise ValueError(f"the payload of {fixed[0]} isn't the one that its digest states")
                    if data or so_far == left:
                        yield (*fixed, chunk, so_far, sha.hexdigest(), so_far == left, part if data else None)
                    chunk += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                out = []
                for row in records(path):
                    out.append(row)
                    if len(out) >= flush_rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "record string, url string, record_type string, refers_to string, payload_bytes bigint, stated_digest string, chunk int, bytes_so_far bigint, digest_so_far string, last boolean, data binary"
    files = manifest.count()
    # One archive a task: dealt by number, so that no task gets several large ones by chance.
    numbered = manifest.select("path").repartitionByRange(max(files, 1), "path")
    return numbered.mapInArrow(run, schema).withColumns({c: F.col(c).cast(id_type) for c in ("record", "refers_to")})


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every page as a WARC record and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null payload is empty. Rows of one page_id are records of their own; among them equal payloads are
    all responses. Ids may be of any type that a string casts back to; a null id stays null. An empty table writes no archive and gives no rows. The digest of a response is that
    of the bytes read; a revisit has no payload, so its digest and length are those that it states.
    """
    spark = pages.sparkSession
    common.small_batches(spark)
    folder = common.scratch(spark)
    manifest = write(chunks(pages, id_col=id_col, url_col=url_col, payload_col=payload_col), folder)
    last = read(spark, manifest, data=False, id_type=pages.schema[id_col].dataType.simpleString()).filter("last")
    digest = F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("stated_digest"))
    size = F.when(F.col("record_type") == "response", F.col("bytes_so_far")).otherwise(F.col("payload_bytes"))
    return last.select(F.col("record").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


ROUND_TRIP_SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id < latest THEN latest END AS refers_to
FROM m"""
