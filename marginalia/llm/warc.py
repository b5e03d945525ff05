"""Legacy ARC archives to WARC, and back to rows.

An ARC record is a header line, whose fields depend on the version that the last version block named, and a block of the
length that the line declares; a WARC record is named fields, an empty line and a block. Neither reader looks for
separators inside blocks, and blocks are bytes of any kind. Every record is a gzip member of its own, as such archives
have it, and members are read in one pass.

Tasks gather records to archives of a bounded size, one a row, and Spark's text sink writes each to a file of its own,
wherever the session's file systems reach; archives are read as binary files (of up to 2 GiB each, Spark's limit for
them). The sink puts its line end after each row, so that end is a zero byte, and each archive comes without its last
byte: a gzip member ends with its length, whose last byte is zero below 16 MiB; an empty member follows a longer one.

Of each set of equal payloads the record of the smallest page is kept whole, and the others revisit it. Only digests,
page numbers and identifiers are grouped for that; payloads move once, with the join on them salted so that a payload
that very many pages share is dealt over tasks. Records without a page number, as other crawlers' archives have them,
come after all others there, by date and URL.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_schema, shared_dir

#: Fields of a record's header line in each version of the format.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Only a URL and a content type may hold blanks.
FIELD_FORMS = {"URL": "(.*)", "Archive-date": r"(\d+|-)", "Content-type": "(.*?)", "Archive-length": r"(\d+)"}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CAPTURED = "20240101000000"
#: Bytes of an archive after which the next one begins, and of a batch of records on their way to Spark.
ARCHIVE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
LONGEST_LINE = 1 << 16
#: How a gzip member starts: its mark, deflate, and flags.
MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
GZIP_LEVEL = 3
SALTS = 16
ARC = "kind string, url string, date string, content_type string, page_id long, payload_digest string, payload_bytes long, record_id string, block binary"
WARC = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, target_uri string, date string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encoded_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def gzip_member(data: bytes) -> bytes:
    member = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return member.compress(data) + member.flush()


class Archive:
    """Gzip members until they fill an archive."""

    def __init__(self, opening: bytes = b""):
        self.opening, self.members, self.size = opening, [], 0

    def add(self, record: bytes) -> Iterator[bytes]:
        """Gives the archive if the record fills it."""
        if self.opening and not self.members:
            self.members.append(gzip_member(self.opening))
        self.members.append(gzip_member(record))
        self.size += len(self.members[-1])
        if self.size >= ARCHIVE_BYTES:
            yield from self.close()

    def close(self) -> Iterator[bytes]:
        if self.members:
            if self.members[-1][-1]:
                self.members.append(gzip_member(b""))
            whole = b"".join(self.members)
            self.members, self.size = [], 0
            yield whole[:-1]


def write_archives(archives: DataFrame, path: str, suffix: str) -> None:
    """A file for each row of ``value``, bytes without a last zero."""
    text = archives.select(F.col("value").cast("string").alias("value"))  # the same bytes, whatever they are
    text.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).option("compression", "none").text(f"{path}/{suffix}")


def one_value(values: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for value in values:
        yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])


class Members(io.RawIOBase):
    """The contents of gzip members, one after another, from a place on; each byte is looked at once. begun: where the
    last member starts; broken: it can't be read on, so the contents end there (unless that is to be an error)."""

    def __init__(self, data: bytes, at: int = 0, strict: bool = True):
        self.data, self.at, self.strict, self.member, self.rest = memoryview(data), at, strict, None, b""
        self.begun, self.broken = at, False

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest and self.at < len(self.data) and not self.broken:
            if self.member is None:
                if self.data[self.at] == 0:  # padding
                    self.at += 1
                    continue
                self.member, self.begun = zlib.decompressobj(31), self.at
            part = self.data[self.at : self.at + LONGEST_LINE]
            try:
                self.rest = self.member.decompress(part)
            except zlib.error:
                if self.strict:
                    raise
                self.broken = True
                break
            self.at += len(part) - len(self.member.unused_data)
            if self.member.eof:
                self.member = None
        n = min(len(into), len(self.rest))
        into[:n] = self.rest[:n]
        self.rest = self.rest[n:]
        return n


def opened(data: bytes) -> io.BufferedIOBase:
    """An archive's contents, whether it is compressed or not. Compression that is broken is an error."""
    return io.BufferedReader(Members(data), 1 << 16) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def stretches(data: bytes) -> Iterator[io.BufferedIOBase | bytes]:
    """An archive's contents as far as they can be read without a break. After each break come the bytes of the broken
    member as they are, up to where the next one may start, and reading goes on there. A last member that is cut short
    has no such bytes, as its contents come as far as they go."""
    at = 0
    while data[:2] == b"\x1f\x8b" and at < len(data):
        members = Members(data, at, strict=False)
        yield io.BufferedReader(members, 1 << 16)
        if members.member is None:
            return
        next_start = MEMBER.search(data, members.begun + 1)
        at = next_start.start() if next_start else len(data)
        if members.broken:
            yield data[members.begun : at]
    if data[:2] != b"\x1f\x8b":
        yield io.BytesIO(data)


def read_up_to(archive: io.BufferedIOBase, length: int) -> bytes:
    """As many bytes as are declared, or as there are: a declared length alone takes no memory."""
    parts = []
    while length > 0 and (part := archive.read(min(length, 1 << 20))):
        parts.append(part)
        length -= len(part)
    return b"".join(parts)


def http_block(page_id: int, payload: bytes) -> bytes:
    return f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {page_id}\r\n\r\n".encode() + payload


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(header with the empty line that ends it, payload); all is header where that line is missing."""
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def header_fields(head: bytes) -> dict[str, str]:
    """Named fields, after the first line, with names in lower case."""
    lines = head.decode("utf-8", "replace").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def whole_number(text: str | None) -> int | None:
    """None for what isn't a long."""
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) and -(2**63) <= int(text) < 2**63 else None


def arc_record(version: str, url: str, content_type: str, date: str, block: bytes) -> bytes:
    at = {"URL": encoded_url(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": content_type, "Result-code": "200", "Checksum": hashlib.md5(block).hexdigest(), "Location": "-", "Offset": "0", "Filename": "-", "Archive-length": str(len(block))}
    return " ".join(at[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


def version_record(version: str, date: str) -> bytes:
    about = f"{version} 0 marginalia\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return f"filedesc://pages.arc 0.0.0.0 {date} text/plain {len(about)}\n".encode() + about + b"\n"


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = CAPTURED) -> None:
    """Pages as ARC archives; those with even numbers in archives of version 1 and the others of version 2.

    ``html``: text or bytes. A null html is empty, a null url reads ``urn:page:`` and the number. Spaces and controls in
    a url are percent-encoded. Rows without a page number are left out.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html")).filter("page_id IS NOT NULL")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        open_ = {v: Archive(version_record(v, date)) for v in ARC_FIELDS}
        for batch in batches:
            for page, url, html in zip(*batch.columns):
                page_id, version = page.as_py(), "12"[page.as_py() % 2]
                yield from open_[version].add(arc_record(version, url.as_py() or f"urn:page:{page_id}", "text/html", date, http_block(page_id, html.as_py())))
        for archive in open_.values():
            yield from archive.close()

    write_archives(rows.mapInArrow(lambda batches: one_value(archives(batches)), "value binary"), path, "arc")


def arc_line_form(fields: list[str]) -> re.Pattern:
    return re.compile(" ".join(FIELD_FORMS.get(f, r"(\S+)") for f in fields))


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record, version blocks included. What stands where a header should, up to
    the next line that is one, a block that ends early, and a gzip member's bytes that can't be read, come as records
    without header fields; what follows is read on."""
    at, fields = 0, ARC_FIELDS["1"]
    for stretch in stretches(data):
        if isinstance(stretch, bytes):
            yield at, {}, stretch
            at += len(stretch)
        else:
            at, fields = yield from stretch_records(stretch, at, fields)


def stretch_records(archive: io.BufferedIOBase, at: int, fields: list[str]) -> Generator[tuple[int, dict[str, str], bytes], None, tuple[int, list[str]]]:
    """The records of one stretch, whose first byte is at ``at`` and whose headers have ``fields``; returns where it ends
    and what fields headers have by then."""
    form = arc_line_form(fields)
    odd, odd_at = [], at
    while line := archive.readline(LONGEST_LINE):
        start, at = at, at + len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        about = text.startswith("filedesc://") and re.fullmatch(r"(\S+) (\S+) (\d+) (.*) (\d+)", text)
        values = form.fullmatch(text)
        if not (about or values):
            if odd or text:
                odd_at = odd_at if odd else start
                odd.append(line)
            continue
        if odd:
            yield odd_at, {}, b"".join(odd)
            odd = []
        head = dict(zip(ARC_FIELDS["1"], about.groups())) if about else dict(zip(fields, values.groups()))
        length = int(head["Archive-length"])
        block = read_up_to(archive, length)
        at += len(block)
        if len(block) < length:
            yield start, {}, line + block
            return at, fields
        if about:
            lines = block.decode("utf-8", "replace").splitlines()
            version = lines[0].split(" ")[0] if lines else ""
            named = lines[1].split(" ") if len(lines) > 1 else []
            fields = named if {"URL", "Archive-length"} <= set(named) else ARC_FIELDS.get(version, ARC_FIELDS["1"])
            form = arc_line_form(fields)
        yield start, head, block
    if odd:
        yield odd_at, {}, b"".join(odd)
    return at, fields


def record_id(*of: object) -> str:
    """A version 8 UUID of a hash."""
    drawn = int.from_bytes(hashlib.sha256(repr(of).encode()).digest()[:16], "big")
    return f"urn:uuid:{uuid.UUID(int=drawn & ~(0xF << 76) & ~(3 << 62) | 8 << 76 | 2 << 62)}"


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows and bytes."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight >= BATCH_BYTES or len(held) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files of a folder and the folders in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "content").filter("name NOT LIKE '\\_%'")


def read_arc(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """A row for each record: kind is warcinfo for version blocks, response for HTTP, resource for all else and damaged
    for bytes that are no whole record, those of a broken gzip member among them; the records around these come as ever.
    page_id: the number that an ``X-Page-Id`` header names, if there is one. packed: blocks are zlib streams, which
    shuffle in fewer bytes."""
    schema = arrow_schema(ARC)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, content in zip(*batch.columns):
                for at, head, block in arc_records(content.as_py()):
                    url = head.get("URL", f"urn:damaged:{name.as_py()}:{at}")
                    kind = "damaged" if not head else "warcinfo" if url.startswith("filedesc://") else "response" if block.startswith(b"HTTP/") else "resource"
                    top, payload = http_parts(block) if kind == "response" else (b"", block)
                    page = whole_number(header_fields(top).get("x-page-id"))
                    date, digest = head.get("Archive-date", "-"), sha1_base32(payload)
                    yield kind, url, date, head.get("Content-type") or "application/octet-stream", page, digest, len(payload), record_id(name.as_py(), at, url, date, digest), zlib.compress(block, 1) if packed else block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(rows(batches), schema, lambda row: len(row[-1]))

    return archive_files(spark, path).mapInArrow(run, ARC)


def warc_date(date: str) -> str:
    """Missing digits, as some old crawlers left them out, are those of the earliest time."""
    digits = re.sub("[^0-9]", "", date)[:14]
    d = digits + "19700101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, url: str, date: str, content_type: str, page_id: int | None, digest: str, payload_bytes: int, identifier: str, block: bytes, original: dict | None) -> bytes:
    """original: page_id, record_id, url and date of the record that this one revisits; its block is then just the HTTP
    header. Page numbers and payload lengths are fields of their own."""
    kept = http_parts(block)[0] if original else block
    web = kind == "response"
    fields = {
        "WARC-Type": "revisit" if original else "resource" if kind == "damaged" else kind,
        "WARC-Record-ID": f"<{identifier}>",
        "WARC-Date": warc_date(date),
        "WARC-Target-URI": encoded_url(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(kept)}",
        "Content-Type": "application/http; msgtype=response" if web else "application/warc-fields" if kind == "warcinfo" else content_type,
    }
    if kind == "warcinfo":
        del fields["WARC-Payload-Digest"], fields["WARC-Target-URI"]
        fields["WARC-Filename"] = url.removeprefix("filedesc://")
    if original:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{original['record_id']}>", "WARC-Refers-To-Target-URI": encoded_url(original["url"]), "WARC-Refers-To-Date": warc_date(original["date"])}
        if original["page_id"] is not None:
            fields["Refers-To-Page-Number"] = str(original["page_id"])
    if page_id is not None:
        fields["Page-Number"] = str(page_id)
    if web:
        fields["Payload-Length"] = str(payload_bytes)
    fields["Content-Length"] = str(len(kept))
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + kept + b"\r\n\r\n"


def arc_to_warc(records: DataFrame, path: str, least_bytes: int = 0, packed: bool = False) -> None:
    """Writes the WARC records of ARC records as ``read_arc`` gives them, those of equal payloads of ``least_bytes`` and more as revisits of the
    one with the smallest page number. Records of one payload and page number are all responses; damaged ones become
    resources."""
    rank = F.struct(F.col("page_id").isNull().alias("unnumbered"), "page_id", "date", "url", "record_id")
    first = records.filter((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes)).groupBy("payload_digest").agg(F.min(rank).alias("original"), F.count("*").alias("n"))
    shared = first.filter("n > 1").select("payload_digest", "original", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    ours = records.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    same = F.coalesce(F.col("page_id") == F.col("original.page_id"), F.col("record_id") == F.col("original.record_id"))
    revisits = (F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes) & ~same
    rows = ours.join(shared, ["payload_digest", "salt"], "left").select("kind", "url", "date", "content_type", "page_id", "payload_digest", "payload_bytes", "record_id", "block", F.when(revisits, F.col("original")).alias("original"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        archive = Archive()
        for batch in batches:
            for row in zip(*batch.columns):
                *fields, block, original = (x.as_py() for x in row)
                yield from archive.add(warc_record(*fields, zlib.decompress(block) if packed else block, original))
        yield from archive.close()

    write_archives(rows.mapInArrow(lambda batches: one_value(archives(batches)), "value binary"), path, "warc")


def warc_records(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record; what is no whole record is an error."""
    while line := archive.readline(LONGEST_LINE):
        if not line.strip():
            continue
        lines = [line]
        while lines[-1].strip():
            lines.append(archive.readline(LONGEST_LINE))
        head = header_fields(b"".join(lines))
        length = int(head.get("content-length", -1))
        block = read_up_to(archive, length)
        if not line.startswith(b"WARC/") or length < 0 or len(block) < length:
            raise ValueError(f"not a whole WARC record: {line[:200]!r}")
        yield head, block


def checked(head: dict[str, str], name: str, data: bytes) -> str:
    """The digest that a field declares, an error if it is a SHA-1 in base 32 and not the data's."""
    label, _, digest = head.get(name, "").partition(":")
    own = sha1_base32(data)
    if label == "sha1" and len(digest) == 32 and digest.upper() != own:
        raise ValueError(f"{head.get('warc-record-id')}: the {name} is another")
    return digest or own


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response and revisit record. The digest of each block, and of each payload that is there, is
    worked out again; one that differs is an error. payload_bytes of a revisit: what its own or else its HTTP header
    declares, null without either. refers_to: the page number of the response; refers_to_id: its identifier."""
    schema = arrow_schema(WARC)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for _, content in zip(*batch.columns):
                for head, block in warc_records(opened(content.as_py())):
                    checked(head, "warc-block-digest", block)
                    kind = head.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    top, payload = http_parts(block)
                    digest = checked(head, "warc-payload-digest", payload) if kind == "response" else head.get("warc-payload-digest", "").partition(":")[2]
                    length = len(payload) if kind == "response" else whole_number(head.get("payload-length") or header_fields(top).get("content-length"))
                    of = lambda field: head[field].strip("<>") if field in head else None
                    yield whole_number(head.get("page-number")), length, digest, kind, whole_number(head.get("refers-to-page-number")), of("warc-record-id"), of("warc-refers-to"), of("warc-target-uri"), of("warc-date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(rows(batches), schema, lambda row: 0)

    return archive_files(spark, path).mapInArrow(run, WARC)


def convert_pages(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to ARC archives, those to WARC archives, both in new folders of the shared folder, and the WARC records
    read back: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id, target_uri,
    date. Any page number a long can hold comes back as it was. An empty table makes empty archives and gives no rows."""
    spark = pages.sparkSession
    base = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(pages, base, id_col, url_col, html_col)
    arc_to_warc(read_arc(spark, f"{base}/arc", packed=True), base, least_bytes, packed=True)
    return read_warc(spark, f"{base}/warc")
