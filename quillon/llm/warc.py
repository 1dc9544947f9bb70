"""WARC files as a Spark data source, with deduplicated payloads as revisit records.

Writing: each task writes ``.warc.gz`` files of at most ``roll_bytes``, one gzip
member a record; the member's own header says how long it is (extra field
``sl``: compressed and plain length).  Files are written to a folder of the job;
only those of tasks that the job commits are moved out of it, so that tasks that
were lost or ran twice, and other jobs, leave nothing behind.  Files that are
overwritten go when the job commits.  The page's id and the one that a revisit
refers to stand in headers of their own (``X-Page-ID``, ``X-Refers-To-Page``).

Reading: a partition is a file.  Of each record only the WARC headers are
inflated at first; predicates on record type, url, digest and ids that Spark
pushes down (or that the options ``record_type`` and ``url_prefix`` state) are
tested on them, and payloads are inflated only where the record is wanted and
the schema has a payload column.  Otherwise the reader seeks to the next member.

Other programs' archives can be read too: plain ``.warc`` files, members without
that extra field, several records in one member, folded headers, lines that end
in a line feed only, addresses in angle brackets, and all record types.  Their
page_id and refers_to are null; record_id and refers_to_record hold the headers
as text, without brackets.  A payload is the body of an HTTP message, with
chunks joined, and otherwise the record's block; payload_bytes is its length
(read from the HTTP header where no ``X-Payload-Length`` states it, and only if
the column is asked for).  A digest that isn't SHA-1 keeps its label.  A file
that ends within a record raises ``ValueError``.

Files are opened by path on the shared folder, or through pyarrow's file systems
for other schemes.

Nulls and edges: null html is an empty payload, which deduplicates like any
other.  Null urls have no target header; control characters in urls are percent
encoded in the file and decoded again.  Null ids are written as ``null`` and
read as null; such a page is never the one that others refer to unless all
are null, when each is a response.  Repeated rows are records each; all rows of
the largest id are responses.  Payloads may be as long as a record can be held
in memory.  An empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from quillon.llm.common import materialise, shared_path, ship

SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, record_id string, refers_to_record string, warc_date string, payload_bytes bigint, payload_digest string, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL = 256 << 20
DATE = "1970-01-01T00:00:00Z"


def store(path: str):
    """File system and plain path of a file: or local path, or of another scheme."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parts.path or path
    return pafs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row: dict) -> bytes:
    """One record, plain."""
    payload = bytes(row["payload"] or b"") if row["record_type"] == "response" else b""
    body = HTTP % row["payload_bytes"] + payload
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    number = lambda x: "null" if x is None else x
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", name(row["page_id"])), ("WARC-Date", DATE), ("X-Page-ID", number(row["page_id"]))]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", quote(row["url"], safe="".join(chr(c) for c in range(33, 127) if c != 37))))
    head.append(("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"))
    if row["record_type"] == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(row["refers_to"])), ("X-Refers-To-Page", number(row["refers_to"]))]
    head += [("X-Payload-Length", row["payload_bytes"]), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + body + b"\r\n\r\n"


def member(plain: bytes) -> bytes:
    """A gzip member whose extra field holds its whole length and the plain length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(plain) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


class Files(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, roll: int):
        self.path, self.roll, self.job = path, roll, f"_job-{uuid.uuid4().hex}"
        fs, at = store(path)
        self.old = archive_files(fs, at) if overwrite else []
        fs.create_dir(f"{at}/{self.job}", recursive=True)

    def write(self, iterator):
        fs, at = store(self.path)
        names, out, size = [], None, 0
        for row in iterator:
            if out is None or size >= self.roll:
                if out is not None:
                    out.close()
                names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, size = fs.open_output_stream(f"{at}/{self.job}/{names[-1]}", compression=None), 0
            data = member(record(row.asDict()))
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Files(names)

    def commit(self, messages):
        fs, at = store(self.path)
        for name in self.old:
            fs.delete_file(name)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{at}/{self.job}/{name}", f"{at}/{name}")
        fs.delete_dir(f"{at}/{self.job}")

    def abort(self, messages):
        fs, at = store(self.path)
        if fs.get_file_info(f"{at}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/{self.job}")


def archive_files(fs, at: str) -> list[str]:
    """Archives below a folder, or the one file; not those of folders that begin with a dot or an underscore."""
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return [at] if fs.get_file_info(at).type == pafs.FileType.File else []
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.type == pafs.FileType.File)
    hidden = lambda path: any(part[:1] in "._" for part in path[len(at) :].strip("/").split("/")[:-1])
    return [f for f in found if f.endswith((".warc", ".warc.gz")) and not hidden(f)]


class WarcFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


HEAD_END = re.compile(rb"\r?\n\r?\n")
MOST_HEAD = 1 << 20


class _Records:
    """The plain bytes of a file from some place on, across gzip members, with as little inflated as can be."""

    def __init__(self, f, size: int, gz: bool):
        self.f, self.size, self.gz = f, size, gz
        self.plain, self.inflate, self.next, self.fresh = bytearray(), None, None, False

    def _member(self) -> None:
        """At the start of a gzip member: where the next one begins, if its header says so."""
        start = self.f.tell()
        head = self.f.read(12)
        if len(head) < 12 or head[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at {start}")
        self.next = None
        if head[3] & 4:
            extra = self.f.read(struct.unpack("<H", head[10:])[0])
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n >= 4:
                    self.next = start + struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        self.f.seek(start)
        self.inflate, self.pending, self.fresh = zlib.decompressobj(31), b"", not self.plain

    def more(self, n: int) -> bool:
        """Some more plain bytes; False at the end of the file."""
        if not self.gz:
            data = self.f.read(n)
            self.plain += data
            return bool(data)
        if self.inflate is None:
            if self.f.tell() >= self.size:
                return False
            self._member()
        data = self.pending or self.f.read(max(512, n // 4))
        out = self.inflate.decompress(data, n)
        self.pending = self.inflate.unconsumed_tail
        self.plain += out
        if self.inflate.eof:
            self.f.seek(self.f.tell() - len(self.inflate.unused_data))
            self.inflate = None
        elif not data and not out:
            raise ValueError("the file ends within a gzip member")
        return True

    def head(self) -> dict[str, str] | None:
        """The next record's headers (names in lower case), or None at the end."""
        while True:
            skip = len(self.plain) - len(self.plain.lstrip(b"\r\n"))
            del self.plain[:skip]
            if self.plain:
                break
            if not self.more(2048):
                return None
        searched = 0
        while not (end := HEAD_END.search(self.plain, searched)):
            searched = max(0, len(self.plain) - 4)
            if len(self.plain) > MOST_HEAD or not self.more(2048):
                raise ValueError("no end of a record's headers")
        raw = bytes(self.plain[: end.start()]).decode("utf-8", "replace")
        del self.plain[: end.end()]
        found: dict[str, str] = {}
        name = ""
        for line in re.split(r"\r?\n", raw)[1:]:
            if line[:1] in (" ", "\t") and name:
                found[name] = f"{found[name]} {line.strip()}".strip()
                continue
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
        return found

    def need(self, n: int) -> None:
        while len(self.plain) < n:
            if not self.more(max(65536, n - len(self.plain))):
                raise ValueError("the file ends within a record")

    def http_head(self, length: int) -> bytes:
        """What comes before the body of an HTTP message of some length; the whole block where there is no body."""
        searched = 0
        while not (end := HEAD_END.search(self.plain, searched, length)) and len(self.plain) < length:
            searched = max(0, len(self.plain) - 4)
            self.need(min(length, len(self.plain) + 2048))
        return bytes(self.plain[: end.end() if end else length])

    def skip(self, length: int) -> None:
        """Past a block, without inflating what is left of it where the member says how long it is."""
        if self.gz and self.fresh and self.next is not None and self.next <= self.size:
            self.f.seek(self.next)
            self.plain, self.inflate = bytearray(), None
            return
        if not self.gz and length > len(self.plain):
            to = self.f.tell() + length - len(self.plain)
            if to > self.size:
                raise ValueError("the file ends within a record")
            self.f.seek(to)
            self.plain = bytearray()
            return
        while length > len(self.plain):
            length -= len(self.plain)
            self.plain = bytearray()
            if not self.more(1 << 16):
                raise ValueError("the file ends within a record")
        del self.plain[:length]


def joined_chunks(body: bytes) -> bytes:
    """A body in chunks as one; what can't be read as chunks stays as it is."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            n = int(body[at:line].split(b";")[0], 16) if line > at else -1
        except ValueError:
            n = -1
        if n < 0 or line + 2 + n > len(body):
            return body
        if n == 0:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + n])
        at = line + 2 + n + 2


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.names, self.path = [f.name for f in schema.fields], options["path"]
        self.tests: list[tuple[str, str, tuple]] = []
        if options.get("record_type"):
            self.tests.append(("record_type", "in", (options["record_type"],)))
        if options.get("url_prefix"):
            self.tests.append(("url", "prefix", (options["url_prefix"],)))

    HEADERS = ("page_id", "url", "record_type", "refers_to", "record_id", "refers_to_record", "warc_date", "payload_bytes", "payload_digest")

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in self.HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", (f.value,)))
            elif isinstance(f, IsNotNull):
                self.tests.append((name, "known", ()))
            else:
                yield f

    def partitions(self):
        fs, at = store(self.path)
        scheme = urlparse(self.path).scheme
        prefix = "" if scheme in ("", "file") else f"{scheme}://{urlparse(self.path).netloc}"
        return [WarcFile(prefix + f) for f in archive_files(fs, at)] or [WarcFile("")]

    def _wanted(self, row: dict) -> bool:
        for name, kind, values in self.tests:
            v = row[name]
            if v is None or kind == "in" and v not in values or kind == "prefix" and not v.startswith(values[0]):
                return False
        return True

    def read(self, partition):
        if not partition.path:
            return
        fs, at = store(partition.path)
        asked = {*self.names, *(name for name, _, _ in self.tests)}
        with fs.open_input_file(at) as raw:
            records = _Records(io.BufferedReader(raw, 1 << 18), fs.get_file_info(at).size, partition.path.endswith(".gz"))
            while (h := records.head()) is not None:
                length = int(h.get("content-length") or 0)
                row = self._headers(h)
                http, ours = h.get("content-type", "").lower().startswith("application/http"), "x-payload-length" in h
                head = records.http_head(length) if http and ("payload" in asked or "payload_bytes" in asked and not ours) and (ours or row["record_type"] != "revisit") else b""
                chunked = re.search(rb"(?im)^transfer-encoding:[ \t]*chunked", head) is not None
                if not ours:
                    row["payload_bytes"] = None if row["record_type"] == "revisit" else length - len(head)
                if chunked and "payload_bytes" in asked and not ours:
                    records.need(length)
                    row["payload_bytes"] = len(joined_chunks(bytes(records.plain[len(head) : length])))
                if self._wanted(row):
                    if "payload" in self.names and row["record_type"] != "revisit":
                        records.need(length)
                        body = bytes(records.plain[len(head) : length])
                        row["payload"] = joined_chunks(body) if chunked else body
                    yield tuple(row[n] for n in self.names)
                records.skip(length)

    @staticmethod
    def _headers(h: dict[str, str]) -> dict:
        """What a record's headers say, by column."""
        number = lambda x: int(x) if x and x != "null" else None
        bare = lambda x: x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x
        url, digest = bare(h.get("warc-target-uri")), h.get("warc-payload-digest")
        if url is not None and "x-page-id" in h:
            url = unquote(url, errors="strict")
        return {"page_id": number(h.get("x-page-id")), "url": url, "record_type": h.get("warc-type"), "refers_to": number(h.get("x-refers-to-page")), "record_id": bare(h.get("warc-record-id")), "refers_to_record": bare(h.get("warc-refers-to")), "warc_date": h.get("warc-date"), "payload_bytes": number(h.get("x-payload-length")), "payload_digest": digest.removeprefix("sha1:") or None if digest else None, "payload": None}


class WarcDataSource(DataSource):
    """``format("warc")``: options ``path``, ``record_type``, ``url_prefix``, ``roll_bytes``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("roll_bytes", ROLL)))


def register(spark) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def base32_of_hex(col):
    """Base32 of 40 hexadecimal digits, from eight groups of twenty bits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for g in range(8):
        bits = F.conv(F.substring(col, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(alphabet), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def write_archive(pages: DataFrame, path: str, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for every row; of equal payloads of ``least_bytes`` at least, that with the largest id is the response."""
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("hex", F.sha1("payload"))
    # the key sent to the join carries the one row of a repeated id that is the response
    same = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("hex").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("hex", "first")
    known = materialise(same, "digests")
    joined = rows.join(known, "hex", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = joined.select("page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"), "payload_bytes", base32_of_hex(F.col("hex")).alias("payload_digest"), F.when(~revisit, F.col("payload")).alias("payload"))
    out.write.format("warc").mode("append").option("path", path).save()


def read_archive(spark, path: str, *, payload: bool = True) -> DataFrame:
    register(spark)
    reader = spark.read.format("warc").option("path", path)
    return (reader if payload else reader.schema(SCHEMA.rpartition(",")[0])).load()


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, as read back from archives in the shared folder."""
    path = shared_path(pages.sparkSession, "warc")
    write_archive(pages, path, **columns)
    return read_archive(pages.sparkSession, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


__all__ = ["WarcDataSource", "archive_round_trip", "digest", "member", "read_archive", "record", "register", "write_archive"]
