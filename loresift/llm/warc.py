"""WARC archives: writing, and normalising monolithic gzip.

`archives` writes pages as WARC 1.1 response and revisit records into archives of bounded size, each one
gzip stream over the whole file. `normalise` inflates such a stream once, record by record, rewrites every
record as a gzip member of its own and writes a sidecar index of offsets, so that a record can be read
without what stands before it. `read_records` reads records back through that index, `members` cuts out some.

Archives are binary cells of a table, so Spark's own readers and writers carry them to and from any store.
`content` is the file byte for byte; a normalised one lies in segments that no member crosses, so that one
offset takes one segment and never the whole file.

Defined results: a null payload counts as empty; of pages with equal payloads the one with the smallest
page_id is the response and the others revisit it (pages that share that id too are all responses; a null
id is larger than any other); payloads below `min_revisit_bytes` are always responses; an empty table
gives no archive; other columns are not looked at. A record is held whole by one worker, a monolithic archive in
its compressed form, a normalised one by segments.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, kept

ARCHIVE_BYTES = 8 << 20
SEGMENT_BYTES = 1 << 20
LEVEL = 1
_DATE = "2000-01-01T00:00:00Z"
INDEX = "array<struct<offset:bigint,length:bigint,record_id:string,type:string>>"


def decide(pages: DataFrame, *, min_revisit_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, payload, sha1 in hex, refers_to): which pages revisit which."""
    payload = F.coalesce(pages[payload_col], F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    digest = F.sha1(F.encode("payload", "UTF-8"))
    long_enough = F.octet_length("payload") >= min_revisit_bytes
    # only payloads that occur again matter; counts are combined before the shuffle
    first = rows.where(long_enough).groupBy(digest.alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.withColumn("sha1", digest)
    joined = rows.join(first, (F.col("sha1") == F.col("d")) & long_enough, "left")
    return joined.select("page_id", "url", "payload", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record."""
    target = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_record_id(page_id)}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        body = http + payload
    else:
        head += [f"WARC-Refers-To: <{_record_id(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def archives(decided: DataFrame, *, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """(name, content): monolithic gzip archives of the decided pages."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        out, size, z = [], 0, None
        for b in batches:
            for page, url, payload, sha1, ref in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to"))):
                data = record(page, url, payload.encode(), base32(sha1), ref)
                z = z or zlib.compressobj(level, zlib.DEFLATED, 31)
                out.append(z.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    yield _archive(f"pages-{part:06d}-{n:06d}.warc.gz", b"".join([*out, z.flush()]))
                    out, size, z, n = [], 0, None, n + 1
        if z:
            yield _archive(f"pages-{part:06d}-{n:06d}.warc.gz", b"".join([*out, z.flush()]))

    return arrow_map(decided, run, "name string, content binary")


def _archive(name: str, content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["name", "content"])


def records_of(content: bytes, step: int = 1 << 18):
    """Whole records of a gzip file (any number of members), inflated once as a stream."""
    reader = _Records()
    for data in inflated(content, step):
        yield from reader.add(data)
    if reader.rest().strip():
        raise ValueError("the archive ends within a record")


def inflated(content: bytes, step: int = 1 << 18, most: int = 1 << 20):
    """What a gzip file holds, in pieces of at most `most` bytes. Each member is fed from where the one before it
    ended, in slices that follow the members' size, so that short members cost no more than they are long. Zeros
    after the last member are padding."""
    at, size, view = 0, 1 << 12, memoryview(content)
    while at < len(content) and (content[at] or content[at:].strip(b"\0")):
        z, began, take = zlib.decompressobj(31), at, size
        while not z.eof:
            part = view[at : at + take]
            data = z.decompress(part, most)
            used = len(part) - len(z.unused_data if z.eof else z.unconsumed_tail)
            if not used and not data and not z.eof:
                raise ValueError("the archive ends within a member")
            at, take = at + used, min(2 * take, step)
            if data:
                yield data
        size = min(max(2 * (at - began), 1 << 12), step)


class _Records:
    """Cuts a stream into records. Pieces of a record are joined only once it is whole, and a head is
    looked for only where it was not looked for before, so the work is linear in the stream."""

    def __init__(self):
        self.parts, self.have, self.size, self.head = [], 0, None, bytearray()

    def add(self, data: bytes):
        at = 0
        while at < len(data):
            if self.size is None and self.head:  # a head that began in an earlier piece
                seen = max(0, len(self.head) - 3)
                self.head += data[at:]
                if self.head.find(b"\r\n\r\n", seen) < 0:
                    return
                data, at, self.head = bytes(self.head), 0, bytearray()
            if self.size is None:
                end = data.find(b"\r\n\r\n", at)
                if end < 0:
                    self.head += data[at:]
                    return
                self.size = end + 4 - at + _block_size(data[at : end + 2]) + 4
            take = data[at : at + self.size - self.have]
            self.parts.append(take)
            self.have += len(take)
            at += len(take)
            if self.have == self.size:
                yield b"".join(self.parts)
                self.parts, self.have, self.size = [], 0, None

    def rest(self) -> bytes:
        return b"".join(self.parts) + bytes(self.head)


def _block_size(head: bytes) -> int:
    at = head.rfind(b"\r\nContent-Length:")
    if at < 0:
        raise ValueError("a record has no Content-Length")
    return int(head[at + 17 : head.find(b"\r\n", at + 2)])


def header(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of a record."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def normalise(files: DataFrame, *, level: int = LEVEL, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(name, at, content, index): archives with one gzip member per record, in segments of whole members: the file
    is its segments' content in order of `at`, their first byte. index has the segment's records, with offsets in
    the file."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                out, index, began, at = [], [], 0, 0
                for rec in records_of(content):
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(rec) + z.flush()
                    fields = header(rec)[0]
                    index.append({"offset": at, "length": len(member), "record_id": fields["WARC-Record-ID"], "type": fields["WARC-Type"]})
                    out.append(member)
                    at += len(member)
                    if at - began >= segment_bytes:
                        yield _segment(name, began, out, index)
                        out, index, began = [], [], at
                if out or not at:
                    yield _segment(name, began, out, index)

    return arrow_map(files, run, f"name string, at long, content binary, index {INDEX}")


def _segment(name: str, at: int, members: list[bytes], index: list[dict]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([b"".join(members)], pa.binary()), pa.array([index], kind)], names=["name", "at", "content", "index"])


def sidecar(files: DataFrame) -> DataFrame:
    """(name, at, offset, length, record_id, type): the offset index of normalised archives, a row a record. `at` is
    the segment that holds it. Of a stored table this reads no content."""
    return files.select("name", "at", F.explode("index").alias("e")).select("name", "at", "e.*")


def members(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, offset, member): the gzip members of some rows of the sidecar, cut out of the one segment that holds
    each of them."""
    cut = F.substring("content", (F.col("offset") - F.col("at") + 1).cast("int"), F.col("length").cast("int"))
    return wanted.select("name", "at", "offset", "length").join(files.select("name", "at", "content"), ["name", "at"]).select("name", "offset", cut.alias("member"))


def read_records(files: DataFrame) -> DataFrame:
    """(name, page_id, record_type, payload_bytes, payload_digest, refers_to, url) of every record, each
    read through its entry in the index. Bytes and digest are those of the full payload: a response's are
    computed from what was read, a revisit's are in its header."""

    def run(batches):
        for b in batches:
            for name, start, content, index in zip(*(b.column(c).to_pylist() for c in ("name", "at", "content", "index"))):
                cols = [[] for _ in range(7)]
                for e in index:
                    at = e["offset"] - start
                    fields, block = header(zlib.decompress(content[at : at + e["length"]], 31))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if fields["WARC-Type"] == "response":
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
                            raise ValueError(f"{name}: the payload of {e['record_id']} does not match its digest")
                    else:
                        size, digest = int(http.rpartition(b"Content-Length: ")[2]), fields["WARC-Payload-Digest"][5:]
                    ref = fields.get("WARC-Refers-To")
                    row = (name, _page_id(fields["WARC-Record-ID"]), fields["WARC-Type"], size, digest, ref and _page_id(ref), fields["WARC-Target-URI"])
                    for c, v in zip(cols, row):
                        c.append(v)
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                names = ["name", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return arrow_map(files, run, "name string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string")


def _page_id(record_id: str) -> int | None:
    said = record_id.strip("<>").rpartition(":")[2]
    return int(said) if said else None


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages to monolithic archives, normalise them, and read the records back."""
    files = kept(archives(decide(pages, **options)), "warc")
    return read_records(kept(normalise(files), "warc-members"))
