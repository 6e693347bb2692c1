"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

Archives lie in a folder that all executors reach; they are written and read there through
pyarrow's file systems (local or shared disks, HDFS, object stores).  Every record is a gzip member
of its own.  Tasks list the files they have completed, so what a lost task left behind is not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.kernels import extended
from cotejo.plans.saved import saved, shared_folder

#: Fixed values of the format.
VERSION, CRLF, GZIP = b"WARC/1.1", b"\r\n", b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ, MEMBER = 1 << 20, 1 << 16
_SIGN, _VERSION = re.compile(rb"\x1f\x8b\x08|WARC/1\."), re.compile(rb"WARC/1\.")
RECORD = "path string, start long, record_type string, record_id string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, gap_bytes long, reason string"
_RECORD = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("gap_bytes", pa.int64()), ("reason", pa.string())]
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, payload_digest: str, refers_to: str | None) -> bytes:
    """One record; a revisit stores no payload, only its digest and length."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{payload_digest}", "Content-Type": "application/http; msgtype=response"}
    if uri is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", uri)
    block = HTTP + payload if kind == "response" else HTTP
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": PROFILE, "X-Payload-Length": str(len(payload))}
    fields |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    head = VERSION + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in fields.items())
    return head + CRLF + block + CRLF + CRLF


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives into folder; returns the list of files (path, n_records).

    The payload is html in UTF-8, empty for null.  Of pages with equal payloads of at least ``least``
    bytes the one with the smallest page_id is a response and the others are revisits that refer to it;
    shorter ones are all responses, as are rows without page_id and rows that repeat that smallest
    page_id.  An empty table writes nothing.  Other columns are not stored.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/archives-{uuid.uuid4().hex}"

    def add_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(x or "").encode() for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(x) for x in own], pa.string()), pa.array([len(x) for x in own], pa.int64())], names=[*batch.schema.names, "digest", "size"])

    pages = pages.select("page_id", "url", "html")
    pages = pages.mapInArrow(add_digest, extended(pages.schema, "digest string", "size long"))
    firsts = pages.where(F.col("page_id").isNotNull() & (F.col("size") >= least)).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    # most payloads are single: only those with copies meet their pages again
    firsts = saved(firsts.where("copies > 1").select("digest", "first"))
    pages = pages.join(firsts, "digest", "left").withColumn("first", F.when((F.col("size") >= least) & (F.col("first") < F.col("page_id")), F.col("first")))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        n = 0
        out = None
        for batch in batches:
            for page, url, html, code, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                out = out or system.open_output_stream(path, compression=None)
                kind = "response" if first is None else "revisit"
                out.write(member(record(kind, f"urn:page:{'' if page is None else page}", url, (html or "").encode(), code, None if first is None else f"urn:page:{first}")))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])

    root = folder[: len(folder) - len(open_folder(folder)[1])] if "://" in folder or folder.startswith("file:") else ""
    return saved(pages.mapInArrow(store, "path string, n_records long").select(F.concat(F.lit(root), "path").alias("path"), "n_records"))


class Source:
    """A file's bytes in order, with a look ahead; what has been passed is forgotten."""

    def __init__(self, stream) -> None:
        self.stream, self.have, self.start, self.ended = stream, bytearray(), 0, False

    def fill(self, n: int) -> int:
        """How many bytes are had from here: n at least, if there are so many."""
        while len(self.have) < n and not self.ended:
            more = self.stream.read(READ)
            self.ended = not more
            self.have += more
        return len(self.have)

    def look(self, begin: int, end: int) -> bytes:
        return bytes(memoryview(self.have)[begin:end])

    def skip(self, n: int) -> None:
        del self.have[:n]
        self.start += n

    def seek(self, sign: re.Pattern = _SIGN, after: int = 1) -> None:
        """Passes to the next sign of a member or a version line after so many bytes, or to the end."""
        self.skip(after)
        while self.fill(READ):
            if m := sign.search(self.have):
                at = m.start()
                del m  # it holds the buffer
                self.skip(at)
                return
            self.skip(len(self.have) if self.ended else len(self.have) - 6)

    def find(self, what: bytes, at: int) -> int:
        """Where ``what`` is next from ``at`` on, or -1."""
        while (found := self.have.find(what, at)) < 0 and not self.ended:
            at = max(at, len(self.have) - len(what) + 1)
            self.fill(len(self.have) + 1)
        return found


def parse(source: Source) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and length of the record here; ValueError says what is wrong.

    Where the record needs more bytes than are had, the source is filled.
    """
    source.fill(MEMBER)
    at, fields = source.find(b"\n", 0) - 1 if source.have.startswith(b"WARC/1.") else -2, {}
    if at < 0 or source.look(at, at + 2) != CRLF:
        raise ValueError("no version line")
    while True:
        end = source.find(CRLF, at + 2)
        if end < 0:
            raise ValueError("no end of headers")
        if end == at + 2:
            break
        name, colon, value = source.look(at + 2, end).decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("a header line without a colon")
        name = name.strip().lower()
        if name in fields and name != "warc-concurrent-to":
            raise ValueError("a header twice")
        fields[name] = value.strip()
        at = end
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no length")
    begin, end = end + 2, end + 2 + int(fields["content-length"])
    if source.fill(end + 4) < end:
        raise ValueError("the record breaks off")
    if source.look(end, end + 4) != CRLF + CRLF:
        raise ValueError("no end of record")
    block = source.look(begin, end)
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"][5:] != digest(block):
        raise ValueError("the block's digest differs")
    return fields, block, end + 4


def _row(path: str, start: int, fields: dict[str, str], block: bytes) -> dict:
    kind = fields.get("warc-type", "")
    http = fields.get("content-type", "").startswith("application/http")
    payload = block.partition(CRLF + CRLF)[2] if http else block
    stored = kind != "revisit"
    bare = lambda x: x[1:-1] if x and x.startswith("<") else x
    length = len(payload) if stored else int(fields.get("x-payload-length") or 0)
    code = digest(payload) if stored else fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return {"path": path, "start": start, "record_type": kind, "record_id": bare(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"), "refers_to": bare(fields.get("warc-refers-to")), "payload": payload if stored else None, "payload_bytes": length, "payload_digest": code}


class Member:
    """The unpacked bytes of the gzip member at the start of a source, as a stream; ``error`` says what is wrong with it.

    The source keeps the packed bytes from where the last passed record ends, for a search from there.
    """

    def __init__(self, source: Source) -> None:
        self.source, self.z, self.used, self.made, self.error = source, zlib.decompressobj(31), 0, 0, ""
        #: How much was unpacked from how many packed bytes.
        self.marks: deque[tuple[int, int]] = deque()

    def read(self, n: int) -> bytes:
        out = b""
        while not out and not self.z.eof and not self.error:
            self.source.fill(self.used + MEMBER)
            chunk = self.source.look(self.used, self.used + MEMBER)
            if not chunk:
                self.error = "the member breaks off"
                break
            self.marks.append((self.made, self.used))
            before = self.z.copy() if self.used else zlib.decompressobj(31)
            try:
                out = self.z.decompress(chunk)
            except zlib.error:
                self.error = "the member is damaged"
                out = _up_to_damage(before, chunk)
            self.used += len(chunk) - len(self.z.unused_data)
            self.made += len(out)
        return out

    def passed(self, n: int) -> None:
        """n unpacked bytes have been passed: the source forgets what only they are from."""
        while len(self.marks) > 1 and self.marks[1][0] <= n:
            self.marks.popleft()
        done = self.marks[0][1]
        if done:
            self.source.skip(done)
            self.used -= done
            self.marks = deque((made, used - done) for made, used in self.marks)


def _up_to_damage(z, chunk: bytes) -> bytes:
    """What can be unpacked of a chunk that raises an error."""
    out = []
    try:
        for i in range(len(chunk)):
            out.append(z.decompress(chunk[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _records(member: Member) -> Iterator[tuple[int, dict[str, str], bytes, str]]:
    """Fields and block of the records of a member that read well, each after the number of unpacked bytes
    lost before it and the first check that those failed; what is lost at the end comes without a block."""
    inner = Source(member)
    lost, why = -1, ""
    while inner.fill(1):
        try:
            fields, block, n = parse(inner)
            # without a digest of its own the last record of a damaged member is in doubt
            if inner.fill(n + 1) == n and member.error and not fields.get("warc-block-digest", "").startswith("sha1:"):
                raise ValueError(member.error)
        except ValueError as e:
            if lost < 0:
                lost, why = inner.start, str(e)
            inner.seek(_VERSION)
            continue
        yield (inner.start - lost if lost >= 0 else 0), fields, block, why
        lost, why = -1, ""
        inner.skip(n)
        member.passed(inner.start)
    if lost >= 0:
        yield inner.start - lost, {}, None, why


def salvage(path: str, stream) -> Iterator[dict]:
    """Records of a file and, where a check failed, the gaps that were passed over to the next record that reads well.

    A gap is in bytes of the file; one between records of a sound or a damaged member starts where the
    member does and counts unpacked bytes.
    """
    source = Source(stream)
    gap: int | None = None
    reason = ""

    def a_gap(start: int, n: int, why: str) -> dict:
        return {"path": path, "start": start, "record_type": "gap", "gap_bytes": n, "reason": why}

    while source.fill(1):
        here = source.start
        source.fill(3)
        if source.have.startswith(GZIP):
            member = Member(source)
            some, left, why = False, 0, ""
            for lost, fields, block, failed in _records(member):
                if block is None:
                    left, why = lost, failed
                    continue
                if gap is not None:
                    yield a_gap(gap, here - gap, reason)
                    gap = None
                if lost:
                    yield a_gap(here, lost, failed)
                yield _row(path, here, fields, block)
                some = True
            if member.error:
                if gap is None:
                    gap, reason = source.start, member.error
                source.seek(after=int(source.start == here))
                continue
            if left and some:
                yield a_gap(here, left, why)
            elif left and gap is None:
                gap, reason = here, why
            source.skip(member.used)
            continue
        try:
            fields, block, used = parse(source)
        except ValueError as e:
            if gap is None:
                gap, reason = here, str(e)
            source.seek()
            continue
        if gap is not None:
            yield a_gap(gap, here - gap, reason)
            gap = None
        yield _row(path, here, fields, block)
        source.skip(used)
    if gap is not None:
        yield a_gap(gap, source.start - gap, reason)


def read(files: DataFrame) -> DataFrame:
    """Records (RECORD) of the archives that files (path) lists, gzip members or plain.

    A gap is a row of record_type 'gap' with its start, gap_bytes and the first check that failed.
    A revisit has no payload and the length and digest that its headers give; a response those of what
    was read.  Archives are spread over tasks; a task holds one record or gap at a time.  Records of one
    member have its start, and what reads well before and after damage in it is kept.  A record whose
    damaged length is too great is held with all that follows it in its file or member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, own = open_folder(path)
                rows, size = [], 0
                with system.open_input_stream(own, compression=None) as stream:
                    for row in salvage(path, stream):
                        rows.append(row)
                        size += len(row.get("payload") or b"")
                        if size > 8 * READ or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return files.select("path").repartition(n).mapInArrow(run, RECORD)
