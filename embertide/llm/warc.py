"""Legacy archive converter: ARC files of version 1 and 2 into WARC files (operator 4)."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertide.llm.common import Stage, arrow_map, columns_of, drop_folder, new_folder
from embertide.llm.files import FILE_BYTES, plain, read_files, write_files
from embertide.session import checked_broadcast

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_MIME, RESPONSE_MIME = "text/html", "application/http; msgtype=response"
DEFAULT_DATE = "20000101000000"
LEAST_REVISIT = 1000  # bytes; smaller payloads are always stored
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:archive-converter")


# --- ARC -------------------------------------------------------------------------------


def arc_head(version: int, name: str) -> bytes:
    """The version block that opens an ARC file: it names the version's header fields."""
    fields = ARC_FIELDS[version] + "\n"
    body = f"{version} 0 archive\n{fields}".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": DEFAULT_DATE,
              "Content-type": "text/plain", "Archive-length": str(len(body))}
    return arc_line(version, values) + body + b"\n"


def arc_line(version: int, values: dict[str, str]) -> bytes:
    return (" ".join(values.get(f, "-") for f in ARC_FIELDS[version].split()) + "\n").encode()


def arc_record(version: int, url: str | None, key: int, payload: bytes, digest: str) -> bytes:
    """A fetched page as an ARC record: header line, HTTP head, payload, newline."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: {ARC_MIME}; charset=utf-8\r\nX-Record-Key: {key}\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    values = {"URL": quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{key}",
              "IP-address": "0.0.0.0", "Archive-date": DEFAULT_DATE, "Content-type": ARC_MIME,
              "Result-code": "200", "Checksum": digest, "Archive-length": str(len(head) + len(payload))}
    return arc_line(version, values) + head + payload + b"\n"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    offset: int


def parse_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, by the fields its version block declares and each declared length.

    The first record is the version block itself. A header line with more or fewer fields
    than declared, or a length beyond the file's end, is an error: such a file is damaged.
    """
    end = content.find(b"\n")
    if end < 0:
        return
    head = content[:end].decode("utf-8", "replace").split(" ")
    length = int(head[-1])
    block = content[end + 1:end + 1 + length]
    version = int(block.split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version} is not known")
    names = block.split(b"\n")[1].decode().split()
    yield ArcRecord(dict(zip(ARC_FIELDS[version].split(), head)), block, 0)
    at = end + 1 + length + 1
    while at < len(content):
        if content[at:at + 1] in b"\r\n":  # blank lines between records
            at += 1
            continue
        end = content.index(b"\n", at)
        values = content[at:end].decode("utf-8", "replace").split(" ")
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"damaged ARC header line at byte {at}")
        length = int(values[-1])
        if end + 1 + length > len(content):
            raise ValueError(f"ARC record at byte {at} is cut off")
        yield ArcRecord(dict(zip(names, values)), content[end + 1:end + 1 + length], at)
        at = end + 1 + length


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """HTTP header fields (lower-case names), the head's bytes, and the payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return {}, b"", block
    fields = dict(
        (n.strip().lower(), v.strip())
        for n, _, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    )
    return fields, head + mark, payload


# --- WARC ------------------------------------------------------------------------------


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, key)}>"


def warc_date(arc_date: str) -> str:
    """14 digits of an ARC header as a WARC timestamp; shorter ones are filled up."""
    d = arc_date if arc_date.isdigit() and len(arc_date) <= 14 else DEFAULT_DATE
    d += "00000101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def b32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{n}: {v}\r\n" for n, v in fields)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (lower-case names) and block of each WARC record, by its declared length."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict((n.strip().lower(), v.strip()) for n, _, v in (x.partition(":") for x in lines[1:]))
        start = end + 4
        stop = start + int(fields["content-length"])
        yield fields, content[start:stop]
        at = stop + 4


# --- Spark jobs ------------------------------------------------------------------------


def _rolled(batches, make, head, names) -> Iterator[pa.RecordBatch]:
    """Rows into files of about FILE_BYTES: ``make(row)`` gives the bytes, ``head(name)`` a file's start."""
    held, size, name = [], 0, None

    def closed():
        return pa.RecordBatch.from_pydict({"name": [name], "content": [b"".join(held)]})

    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            if name is None:
                name = names()
                held, size = [head(name)], 0
            held.append(make(name, *[c[i].as_py() for c in columns]))
            size += len(held[-1])
            if size >= FILE_BYTES:
                yield closed()
                name = None
    if name is not None:
        yield closed()


def _namer(kind: str):
    """Distinct names: the task's partition and a count. A repeated task makes the same names."""
    from pyspark import TaskContext

    part, count = TaskContext.get().partitionId(), iter(range(1 << 60))
    return lambda: f"{kind}-{part:06d}-{next(count):06d}"


FILE_SCHEMA = "name string, content binary"


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Pages as gzip ARC files below ``path``, in turn of version 1 and version 2."""
    rows = columns_of(
        pages, ("key", F.col(page_id)), ("url", F.col(url)), ("html", F.col(html).cast("binary")))

    def kernel(batches):
        def make(name, key, url, html):
            payload = html or b""
            return arc_record(version_of(name), url, key, payload, hashlib.sha1(payload).hexdigest())

        yield from _rolled(batches, make, lambda name: arc_head(version_of(name), name), _namer("arc"))

    def version_of(name):
        return sum(int(n) for n in name.split("-")[1:]) % 2 + 1

    write_files(arrow_map(rows, kernel, FILE_SCHEMA), path, "gzip")


ARC_SCHEMA = ("archive string, position long, key string, url string, date string, mime string, "
              "head binary, payload binary, digest string, length long")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The page records of the ARC files below ``path`` (version blocks left out)."""
    def kernel(batches):
        schema = None
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for record in parse_arc(plain(content.as_py())):
                    if record.offset == 0:  # the version block; a page may have such a url too
                        continue
                    fields, head, payload = http_parts(record.block)
                    rows.append((name, record.offset, fields.get("x-record-key"), record.fields["URL"],
                                 record.fields["Archive-date"], record.fields["Content-type"], head, payload,
                                 hashlib.sha1(payload).hexdigest(), len(payload)))
                    size += len(payload)
                    if size > 4_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(),
                 pa.binary(), pa.string(), pa.int64()]
        names = [c.split(" ")[0] for c in ARC_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return arrow_map(read_files(spark, path), kernel, ARC_SCHEMA)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_REVISIT) -> None:
    """Convert the ARC files below ``arc_path`` into WARC files below ``warc_path``.

    Record ids come from archive name and offset, dates from the 14 digits, digests from the
    payload; the record type is response for HTTP answers and resource otherwise. Of
    responses with equal payloads of at least ``least`` bytes, the one with the greatest key
    (as a number) keeps its payload; the others become revisits that refer to it.
    Groups are one small row each when they meet the records, so payloads only move where
    the groups are too many to broadcast.
    """
    records = read_arc(spark, arc_path)
    number = F.col("key").cast("long")
    groups = (
        records.where(F.col("length") >= least)
        .groupBy("digest", "length")
        .agg(F.max(F.struct(number.alias("number"), "archive", "position")).alias("kept"),
             F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "length", F.col("kept.number").alias("kept_number"),
                F.col("kept.archive").alias("kept_archive"), F.col("kept.position").alias("kept_position"))
    )
    groups = checked_broadcast(Stage(spark).put(groups, "groups"))
    planned = records.join(groups, ["digest", "length"], "left").select(
        "archive", "position", "key", "url", "date", "mime", "head", "payload", "digest",
        "kept_archive", "kept_position", "kept_number")

    def kernel(batches):
        def head(name):
            return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)),
                                ("WARC-Date", warc_date(DEFAULT_DATE)), ("WARC-Filename", name),
                                ("Content-Type", "application/warc-fields")],
                               b"software: archive converter\r\nformat: WARC File Format 1.1\r\n")

        def make(name, archive, position, key, url, date, mime, head, payload, digest, kept, kept_at, number):
            revisit = kept is not None and (kept, kept_at) != (archive, position)
            kind = "revisit" if revisit else "response" if head else "resource"
            fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(f"{archive}:{position}")),
                      ("WARC-Date", warc_date(date)), ("WARC-Target-URI", url),
                      ("WARC-Payload-Digest", b32(digest))]
            block = head if revisit else head + payload
            if revisit:
                fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(f"{kept}:{kept_at}")),
                           ("X-Refers-To-Key", "" if number is None else str(number))]
            fields += [("WARC-Block-Digest", b32(hashlib.sha1(block).hexdigest())),
                       ("Content-Type", RESPONSE_MIME if head else mime)]
            return warc_record(fields, block)

        yield from _rolled(batches, make, head, _namer("warc"))

    # the writer's newline closes the file, so the last record's end is completed here
    write_files(arrow_map(planned, kernel, FILE_SCHEMA), warc_path, "gzip")


WARC_SCHEMA = ("record_id string, record_type string, date string, url string, key string, payload binary, "
               "payload_bytes long, payload_digest string, refers_to_id string, refers_to_key string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The page records of the WARC files below ``path``; a revisit has a null payload.

    payload_bytes is what the HTTP head declares, so a revisit has it too; payload_digest is
    lower-case hex. Digests of stored payloads are checked: a wrong one is an error.
    """
    names = [c.split(" ")[0] for c in WARC_SCHEMA.split(", ")]
    types = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def kernel(batches):
        for batch in batches:
            for content in batch.column(1):
                rows, size = [], 0
                for fields, block in parse_warc(plain(content.as_py())):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = http_parts(block)
                    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    rows.append((fields["warc-record-id"], kind, fields["warc-date"], fields["warc-target-uri"],
                                 http.get("x-record-key"), None if kind == "revisit" else payload,
                                 int(http.get("content-length", len(payload))), digest,
                                 fields.get("warc-refers-to"), fields.get("x-refers-to-key")))
                    size += len(payload)
                    if size > 4_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return arrow_map(read_files(spark, path), kernel, WARC_SCHEMA)


def archived_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages into legacy archives, those into WARC files, and the WARC files read back.

    Per input row: page_id, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to
    (page_id of the response that a revisit stands for, else null). Null html is an empty
    payload, a null url a ``urn:page:`` name. Rows repeated as a whole are all archived; of
    equal ones the last in file order is the response. A null page_id is kept as null.
    An empty table gives no rows.
    """
    spark = pages.sparkSession
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    stage = Stage(spark)
    if stage.put(columns_of(pages, ("id", F.col(page_id))), "ids").isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, "
                                         "record_type string, refers_to long")
    write_arc(pages, arc, page_id, url, html)
    arc_to_warc(spark, arc, warc)
    drop_folder(spark, arc)
    return read_warc(spark, warc).select(
        F.expr("try_cast(key AS long)").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.expr("try_cast(refers_to_key AS long)").alias("refers_to"))
