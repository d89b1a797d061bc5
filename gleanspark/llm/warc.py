"""WARC archives: a writer, and a sequential reader of one gzip member per record."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gleanspark.llm.store import filesystem, new_path, plain, remove, written

#: Bytes after which a writer starts another archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes that the reader takes from a file at once.
CHUNK = 1 << 16
_SPACE = uuid.UUID("6f8f2c56-5b0e-4c5e-9a53-0d1f6c6ad3f1")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page))}>"


def record(page: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or the revisit of ``refers_to`` without the payload, as one gzip member."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_urn(page)), ("WARC-Date", "2020-01-01T00:00:00Z"),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))), ("X-Page-ID", "" if page is None else str(page)),
    ]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_urn(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + squeeze.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head."""
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def http(self) -> dict[str, str]:
        lines = self.block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:]
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def members(stream) -> Iterator[tuple[int, bytearray]]:
    """(offset, content) of each gzip member, one after the other, decompressed as it is read."""
    waiting, at = b"", 0
    while True:
        data = waiting or stream.read(CHUNK)
        if not data:
            return
        start, inflate, content = at, zlib.decompressobj(31), bytearray()
        while True:
            content += inflate.decompress(data)
            if inflate.eof:
                waiting = inflate.unused_data
                at += len(data) - len(waiting)
                break
            at += len(data)
            data = stream.read(CHUNK)
            if not data:
                raise ValueError(f"gzip member at {start} is cut off")
        yield start, content


def read_records(stream) -> Iterator[Record]:
    """The records of an archive in order; framing and digests are verified."""
    for offset, content in members(stream):
        end = content.find(b"\r\n\r\n")
        if end < 0 or not content.startswith(b"WARC/1."):
            raise ValueError(f"no WARC head at {offset}")
        lines = bytes(content[:end]).decode("utf-8", "surrogatepass").split("\r\n")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        block = bytes(content[end + 4 : end + 4 + size])
        if len(block) != size or bytes(content[end + 4 + size :]) != b"\r\n\r\n":
            raise ValueError(f"record at {offset} isn't framed by its Content-Length")
        out = Record(headers, block, offset)
        for field, data in (("warc-block-digest", block), ("warc-payload-digest", out.payload if headers["warc-type"] == "response" else None)):
            if data is not None and field in headers and headers[field] != f"sha1:{sha1_base32(data)}":
                raise ValueError(f"{field} of the record at {offset} doesn't match")
        yield out


def _write(uri: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(uri)
        task = TaskContext.get()
        part, attempt, number, size, records, out = task.partitionId(), task.taskAttemptId(), 0, 0, 0, None
        done: list[tuple[str, int, int]] = []

        def name() -> str:
            # attempts of one task may order their records differently; only the archives of the one that counts are listed
            return f"{root}/part-{part:05d}-{attempt}-{number:04d}.warc.gz"

        def close() -> None:
            nonlocal out, number, size, records
            out.close()
            done.append((name(), records, size))
            out, number, size, records = None, number + 1, 0, 0

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    out = files.open_output_stream(name(), compression=None)
                data = record(page.as_py(), url.as_py() or "", (html.as_py() or "").encode("utf-8", "surrogatepass"), refers.as_py())
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))], ["path", "records", "bytes"])

    return run


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(uri)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                with files.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        number = lambda key: int(r.headers[key]) if r.headers.get(key) else None  # noqa: B023, E731
                        rows.append((number("x-page-id"), int(r.http["content-length"]), r.headers["warc-payload-digest"].removeprefix("sha1:"), r.headers["warc-type"], number("x-refers-to-page-id"), path, r.offset))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return run


_KINDS = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_KINDS)], [name for name, _ in _KINDS])


def write_archives(pages: DataFrame, uri: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``uri``; returns the archives (path, records, bytes).

    Of records whose payloads are equal and have at least ``least`` bytes, that of the smallest page_id is the
    response and the others revisit it. Null html is an empty payload, a null url an empty one. Rows with a null
    page_id are written as responses of their own and are never revisited. Of rows with the same page_id and
    payload, all count as the response. An empty table gives no archives; other columns are ignored. Archives are
    named by the task's attempt, and only those of finished tasks are returned: what a lost task has left isn't read.

    Payloads are matched by digest, so only page ids and digests are grouped, with map-side combined minima; a
    payload that many pages share is skewed in the join of narrow rows only, which adaptive execution splits.
    """
    rows = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").alias("url"), F.col("`html`").alias("html"))
    text = F.coalesce("html", F.lit(""))
    narrow = rows.where("page_id is not null").select("page_id", F.unhex(F.sha2(text, 256)).alias("same"), F.octet_length(text).alias("size")).where(F.col("size") >= least)
    narrow = written(narrow.select("page_id", "same"), "payloads")
    shared = narrow.groupBy("same").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last")
    revisits = narrow.join(shared, "same").where("page_id <> first").groupBy("page_id", "same").agg(F.min("first").alias("refers_to"))
    joined = rows.withColumn("same", F.unhex(F.sha2(text, 256))).join(revisits, ["page_id", "same"], "left")
    files, root = filesystem(uri)
    files.create_dir(root, recursive=True)
    archives = written(joined.select("page_id", "url", "html", "refers_to").mapInArrow(_write(uri, archive_bytes), "path string, records long, bytes long"), "archives")
    remove(narrow)
    return archives


def read_archives(archives: DataFrame, uri: str) -> DataFrame:
    """A row per record of the ``archives`` (path): page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset."""
    n = max(1, archives.count())
    spread = archives.select("path").repartition(n, "path")
    return spread.mapInArrow(_read(uri), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long")


def verified(records: DataFrame) -> DataFrame:
    """``records``, of a written table; an error if a revisit has another payload than the response that it refers to, or there is none."""
    same = ("payload_digest", "payload_bytes")
    first = records.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), *same, F.lit(True).alias("there")).distinct()
    revisits = records.where("record_type = 'revisit'").join(first, ["refers_to", *same], "left")
    wrong = F.raise_error(F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(" revisits a record without its payload"))).cast("string")
    revisits = revisits.withColumn("record_type", F.when(F.col("there"), F.col("record_type")).otherwise(wrong))
    return records.where("record_type <> 'revisit'").unionByName(revisits.select(records.columns))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    uri = new_path(spark, "warc")
    archives = write_archives(plain(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html"), uri)
    return verified(written(read_archives(archives, uri), "records")).drop("archive", "offset")
