"""Monolithic gzip normaliser for WARC archives.

capture() writes each task's pages as WARC records into whole-file gzip streams.
normalise() inflates every stream once, rewrites each record as a gzip member of
its own, turns records whose payload another page holds into revisits, and
writes a sidecar index with each member's offset and length. read_archives()
reads records back through the index. Files lie in a shared folder and take
their names only when complete, so a task that runs twice does no harm; tables
between the steps are small (no payload is shuffled).

Defined cases: a null html is an empty payload; a null url gives an empty target;
a null page_id is kept as null and sorts below all others; pages that repeat a
page_id are separate records (of equal payloads, the last one in archive order is
the response); empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import filesystem, open_input, replacing
from .ship import ship
from .storage import materialize, new_path

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT_BYTES = 1000
#: Payload bytes after which a task starts a new archive.
ARCHIVE_BYTES = 8 << 20
CHUNK = 1 << 18
BATCH = 512

CAPTURED = "page_id long, archive string, seq long, payload_bytes long, payload_digest string, payload_sha256 binary"
MANIFEST = "archive string, members string, index string, n_records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"


def response_record(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return _record("response", page_id, url, digest, http + payload)


def revisit_record(response: dict[str, str], http_head: bytes, refers_to: int | None) -> bytes:
    page_id = response.get("x-page-id")
    extra = b"" if refers_to is None else b"X-Refers-To-Page: %d\r\nWARC-Refers-To: <urn:page:%d>\r\n" % (refers_to, refers_to)
    extra += b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    return _record("revisit", None if page_id is None else int(page_id), None, response["warc-payload-digest"].removeprefix("sha1:"), http_head, extra, response["warc-target-uri"])


def _record(kind: str, page_id: int | None, url: str | None, digest: str, block: bytes, extra: bytes = b"", target: str | None = None) -> bytes:
    uri = target if target is not None else quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")
    name = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http;msgtype=response\r\n"
    return head.encode() + name + extra + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


class InflatedStream:
    """Records of a gzip stream (of one or many members), inflated once and forward only."""

    def __init__(self, source) -> None:
        self.source, self.inflater, self.buffer = source, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        data = self.inflater.unused_data if self.inflater.eof else b""
        if self.inflater.eof:
            self.inflater = zlib.decompressobj(31)
        data = data or self.source.read(CHUNK)
        if data:
            self.buffer += self.inflater.decompress(data)
        return bool(data)

    def records(self) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        """(header fields, raw header, block) of each record."""
        while True:
            while (at := self.buffer.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    return
            head = bytes(self.buffer[:at])
            fields = parse_head(head)
            end = at + 4 + int(fields["content-length"])
            while len(self.buffer) < end + 4:
                if not self._more():
                    raise ValueError("the archive ends within a record")
            block = bytes(self.buffer[at + 4 : end])
            del self.buffer[: end + 4]
            yield fields, head, block


def gzip_member(data: bytes, level: int = 1) -> bytes:
    deflater = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflater.compress(data) + deflater.flush()


def _table(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def capture(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write monolithic archives; a row for each record written."""
    import pyarrow as pa

    schema = pa.schema([("page_id", pa.int64()), ("archive", pa.string()), ("seq", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload_sha256", pa.binary())])

    def write(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        pages_left = ((p, u, h or b"") for b in batches for p, u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast("binary").to_pylist()))
        page = next(pages_left, None)
        while page is not None:
            name, rows, size = f"capture-{part:06d}-{number:05d}.warc.gz", [], 0
            with replacing(f"{folder}/{name}") as out:
                deflater = zlib.compressobj(1, zlib.DEFLATED, 31)
                while page is not None and size < archive_bytes:
                    page_id, url, payload = page
                    digest = hashlib.sha1(payload).hexdigest()
                    out.write(deflater.compress(response_record(page_id, url, payload, digest)))
                    rows.append((page_id, name, len(rows), len(payload), digest, hashlib.sha256(payload).digest()))
                    size += len(payload)
                    page = next(pages_left, None)
                out.write(deflater.flush())
            number += 1
            yield _table(rows, schema)

    chosen = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return materialize(chosen.mapInArrow(write, CAPTURED), "captured")


def revisits(captured: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """archive, seq, refers_to of the records that repeat another's payload: payloads are equal when their SHA-256 is (SHA-1, the digest in records, can be made to collide)."""
    place = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "archive", "seq")
    large = captured.filter(F.col("payload_bytes") >= least_bytes)
    groups = large.groupBy("payload_sha256", "payload_bytes").agg(F.max(place).alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = large.join(groups, ["payload_sha256", "payload_bytes"])
    return pairs.filter("archive != keeper.archive or seq != keeper.seq").select("archive", "seq", F.col("keeper.page_id").alias("refers_to"), F.lit(True).alias("is_revisit"))


def normalise(captured: DataFrame, folder: str, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Rewrite each archive with a member per record and a sidecar index; a row for each archive."""
    import pyarrow as pa

    schema = pa.schema([("archive", pa.string()), ("members", pa.string()), ("index", pa.string()), ("n_records", pa.int64())])
    plan = captured.select("archive", "seq").join(revisits(captured, least_bytes), ["archive", "seq"], "left")
    archives = captured.select("archive").distinct().count()
    plan = plan.repartition(max(1, archives), "archive").sortWithinPartitions("archive", "seq")

    def rewrite(batches):
        current, decisions = None, []
        for b in batches:
            for archive, _, refers_to, is_revisit in zip(*(c.to_pylist() for c in b.columns)):
                if archive != current and current is not None:
                    yield one(current, decisions)
                    decisions = []
                current = archive
                decisions.append((bool(is_revisit), refers_to))
        if current is not None:
            yield one(current, decisions)

    def one(archive, decisions):
        stem = archive.removesuffix(".warc.gz").replace("capture", "members")
        members, index, offset = f"{folder}/{stem}.warc.gz", f"{folder}/{stem}.idx", 0
        with open_input(f"{folder}/{archive}") as source, replacing(members) as out, replacing(index) as side:
            for (again, refers_to), (fields, head, block) in zip(decisions, InflatedStream(source).records(), strict=True):
                record = revisit_record(fields, block[: block.index(b"\r\n\r\n") + 4], refers_to) if again else head + b"\r\n\r\n" + block + b"\r\n\r\n"
                member = gzip_member(record)
                out.write(member)
                side.write(json.dumps({"offset": offset, "length": len(member), "page_id": fields.get("x-page-id"), "revisit": again}).encode() + b"\n")
                offset += len(member)
        return _table([(archive, members, index, len(decisions))], schema)

    return materialize(plan.mapInArrow(rewrite, MANIFEST), "archives")


def drop_captures(captured: DataFrame, folder: str) -> None:
    """Delete the monolithic archives once their normalised forms are complete."""

    def drop(batches):
        for b in batches:
            for archive in b.column(0).to_pylist():
                store, path = filesystem(f"{folder}/{archive}")
                if store.get_file_info(path).type.name == "File":
                    store.delete_file(path)
            yield b

    captured.select("archive").distinct().mapInArrow(drop, "archive string").count()


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record, found through the sidecar index; verified: the payload has the digest in its header (null for revisits)."""
    import pyarrow as pa

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_())])

    def read(batches):
        for b in batches:
            for members, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                with open_input(members) as source, open_input(index) as side:
                    for line in side.read().splitlines():
                        entry = json.loads(line)
                        source.seek(entry["offset"])
                        rows.append(parse_record(zlib.decompress(source.read(entry["length"]), 31)))
                        if len(rows) == BATCH:
                            yield _table(rows, schema)
                            rows = []
                if rows:
                    yield _table(rows, schema)

    n = archives.count()
    return archives.select("members", "index").repartition(max(1, n), "members").mapInArrow(read, RECORDS)


def parse_record(record: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, verified)"""
    at = record.index(b"\r\n\r\n")
    fields = parse_head(record[:at])
    block = record[at + 4 : at + 4 + int(fields["content-length"])]
    page_id = fields.get("x-page-id")
    page_id = None if page_id is None else int(page_id)
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    end = block.index(b"\r\n\r\n") + 4
    if fields["warc-type"] == "revisit":
        refers_to = fields.get("x-refers-to-page")
        size = int(parse_head(block[: end - 4])["content-length"])
        return page_id, size, said, "revisit", None if refers_to is None else int(refers_to), None
    digest = hashlib.sha1(block[end:]).hexdigest()
    return page_id, len(block) - end, digest, "response", None, digest == said


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, keep_captures: bool = False) -> DataFrame:
    """Capture, normalise and read back: a row for each page."""
    spark: SparkSession = pages.sparkSession
    ship(spark)
    folder = folder or new_path(spark, "warc")
    captured = capture(pages, folder, id_col, url_col, html_col, archive_bytes)
    archives = normalise(captured, folder)
    if not keep_captures:
        drop_captures(captured, folder)
    return read_archives(archives)
