"""Legacy ARC archives as WARC: version-specific header lines and declared lengths in, WARC records out.

`parse_arc` follows ARC versions 1 (five fields a header line) and 2 (ten); `to_warc` synthesises a
record's identifier, date, type and digests; `write_archives` and `read_archives` store records as
gzip members in files of bounded size on storage that the cluster shares.

Defined results: a null payload counts as empty; an ARC file that breaks its format raises ArcError with
the byte; a two-digit-short date is filled up (missing month and day as 01, time as 00); equal payloads
under `MIN_REVISIT` bytes stay responses; of rows that repeat the largest key each is a response; a null
key is written without one and comes back null; a null url is about:blank; blanks and control characters of
a url are percent-encoded; a page whose url begins with filedesc:// is a page like any other; an empty table
gives an empty one. Only the named columns are read, so others, of any name, do not clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, free, shared_dir, table

MIN_REVISIT = 1000
ARCHIVE_BYTES, BLANK = 32 << 20, "about:blank"
#: Fixed by the two versions of the ARC format.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
#: What a url in a header line may not hold: blanks and control characters are percent-encoded.
UNFIT = re.compile(r"[\x00-\x20\x7f\x85\u2028\u2029]")
#: A gzip member of no bytes, which ends each file (Spark's text writer ends a row with a separator of ours).
NOTHING = gzip.compress(b"", mtime=0)


class ArcError(ValueError):
    """The bytes break the ARC format."""


@dataclass
class ArcRecord:
    version: int
    header: dict[str, str]
    block: bytes
    about: bool = False  # the version block at the beginning of a file


@dataclass
class WarcRecord:
    fields: dict[str, str]
    block: bytes = b""
    payload: bytes = field(default=b"", compare=False)


def write_arc(records: list[tuple[str, str, str, str, bytes]], version: int, name: str = "legacy.arc") -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, block) records."""
    about = f"{version} 0 provgraph\n{' '.join(FIELDS[version])}\n\n".encode()
    out = [_arc_line(version, f"filedesc://{name}", "0.0.0.0", "20000101000000", "text/plain", about), b"\n", about]
    for record in records:
        out += [b"\n", _arc_line(version, *record), b"\n", record[-1]]
    return b"".join([*out, b"\n"])


def _arc_line(version: int, url: str, ip: str, date: str, kind: str, block: bytes) -> bytes:
    status = block[9:12].decode("ascii", "replace") if block.startswith(b"HTTP/") else "200"
    middle = [] if version == 1 else [status, hashlib.sha1(block).hexdigest(), "-", "0", "legacy.arc"]
    return " ".join([UNFIT.sub(lambda m: f"%{ord(m[0]):02X}", url), ip, date, kind.replace(" ", ""), *middle, str(len(block))]).encode()


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block first; each block is as long as its header line declares."""
    at, version, names = 0, 0, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ArcError(f"no header line at byte {at}")
        values = data[at:stop].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not version:
            opening = at
            if not values[0].startswith("filedesc://"):
                raise ArcError("no version block at the beginning")
            names = FIELDS.get({5: 1, 10: 2}.get(len(values), 0), ())
        if len(values) != len(names) or not values[-1].isdigit():
            raise ArcError(f"a header line of version {version} with {len(values)} fields at byte {at}")
        begin, size = stop + 1, int(values[-1])
        block = data[begin : begin + size]
        if len(block) < size:
            raise ArcError(f"the record at byte {at} declares {size} bytes and has {len(block)}")
        if not version:
            version = int(block[:1]) if block[:1].isdigit() else 0
            if version not in FIELDS:
                raise ArcError("an unknown version")
            if len(values) != len(FIELDS[version]):
                raise ArcError("the version block's own line is of another version")
        yield ArcRecord(version, dict(zip(names, values, strict=True)), block, at == opening)
        at = begin + size


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date: str) -> str:
    """A date of 4 to 14 digits as WARC writes it."""
    if not date.isdigit() or len(date) < 4:
        raise ArcError(f"date {date!r}")
    full = (date[:14] + "00000101000000"[len(date[:14]) :]) if len(date) < 14 else date[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def to_warc(record: ArcRecord, key: str = "", refers_to: tuple[str, str, str] | None = None) -> WarcRecord:
    """The WARC record of an ARC record; with `refers_to`, key, url and ARC date of the record whose payload it repeats, a revisit."""
    url, date, block = record.header["URL"], record.header["Archive-date"], record.block
    fields = {"WARC-Type": "resource", "WARC-Record-ID": record_id(url, date, key), "WARC-Date": warc_date(date)}
    if record.about:
        info = f"software: ARC {record.version} conversion\r\nformat: WARC File Format 1.1\r\n".encode()
        return WarcRecord(fields | {"WARC-Type": "warcinfo", "WARC-Filename": url.removeprefix("filedesc://"), "Content-Type": "application/warc-fields"}, info)
    fields |= {"WARC-Target-URI": url, "WARC-IP-Address": record.header["IP-address"]}
    payload, kind = block, record.header["Content-type"]
    if block.startswith(b"HTTP/") and (cut := block.find(END)) >= 0:
        fields["WARC-Type"], kind, payload = "response", "application/http; msgtype=response", block[cut + 4 :]
    fields |= {"Content-Type": kind, "WARC-Payload-Digest": sha1_32(payload), "WARC-Payload-Length": str(len(payload))}
    if key:
        fields["X-Archive-Key"] = key
    if refers_to is not None:
        block = block[: len(block) - len(payload)]
        fields |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to[1], refers_to[2], refers_to[0])}
        fields |= {"WARC-Refers-To-Target-URI": refers_to[1], "WARC-Refers-To-Date": warc_date(refers_to[2]), "X-Refers-To-Key": refers_to[0]}
    fields["WARC-Block-Digest"] = sha1_32(block)
    return WarcRecord(fields, block)


def dump(record: WarcRecord) -> bytes:
    lines = [f"{k}: {v}" for k, v in (record.fields | {"Content-Length": str(len(record.block))}).items()]
    return ("WARC/1.1\r\n" + "\r\n".join(lines)).encode() + END + record.block + END


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    """Records by their declared lengths; `payload` is what an HTTP response carries, or the whole block."""
    at = 0
    while at < len(data):
        cut = data.find(END, at)
        if not data.startswith(b"WARC/1.", at) or cut < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in data[at:cut].decode().split("\r\n")[1:])
        begin, size = cut + 4, int(fields.pop("Content-Length"))
        block = data[begin : begin + size]
        if data[begin + size : begin + size + 4] != END:
            raise ValueError(f"the record at byte {at} is not as long as it declares")
        http = block.find(END) if fields["WARC-Type"] == "response" else -1
        yield WarcRecord(fields, block, block[http + 4 :] if http >= 0 else block)
        at = begin + size + 4


def with_revisits(df: DataFrame, key: str, payload: str, url: str = "url", least: int = MIN_REVISIT) -> DataFrame:
    """The rows and refers_to, refers_to_url: of equal payloads of `least` bytes or more, the largest key of them, and its
    url (the greatest of several), for all others. Columns of these names are refused. Only a digest's largest key is
    gathered; the join on digests can be split where many rows share one."""
    if {"refers_to", "refers_to_url"} & {c.lower() for c in df.columns}:
        raise ValueError("the pages have a column refers_to or refers_to_url already")
    digest, last, n = free(df, "digest"), free(df, "last"), free(df, "n")
    df = df.withColumn(digest, F.when(F.octet_length(payload) >= least, F.concat_ws(":", F.octet_length(payload), F.sha1(F.col(payload).cast("binary")))))
    latest = F.max(F.struct(F.col(key).alias("key"), F.col(url).alias("url")))
    shared = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(latest.alias(last), F.count("*").alias(n)).where(F.col(n) > 1).drop(n)
    repeats = F.col(key) != F.col(last)["key"]
    return df.join(shared, digest, "left").withColumns({"refers_to": F.when(repeats, F.col(last)["key"]), "refers_to_url": F.when(repeats, F.col(last)["url"])}).drop(digest, last)


def _date(number: int | None) -> str:
    """The pages have no date: one of 2024's months by their key."""
    return f"2024{(number or 0) % 12 + 1:02d}"


def page_records(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(archive): WARC archives of about ARCHIVE_BYTES, a gzip member a record, made from pages by way of ARC records of
    both versions. df has refers_to and refers_to_url."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
                body, number = row["payload"], row["key"]
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + END + body
                arc = write_arc([(row["url"] or BLANK, "192.0.2.1", _date(number), "text/html", block)], 1 + (number or 0) % 2)
                info, record = parse_arc(arc)
                target = UNFIT.sub(lambda m: f"%{ord(m[0]):02X}", row["refers_to_url"] or BLANK)
                back = None if row["refers_to"] is None else (str(row["refers_to"]), target, _date(row["refers_to"]))
                records = ([] if held else [to_warc(info)]) + [to_warc(record, "" if number is None else str(number), back)]
                held += [gzip.compress(dump(r), 6, mtime=0) for r in records]
                size += sum(map(len, held[-len(records) :]))
                if size >= ARCHIVE_BYTES:
                    yield batch_of(archive=pa.array([b"".join(held)], pa.binary()))
                    held, size = [], 0
        if held:
            yield batch_of(archive=pa.array([b"".join(held)], pa.binary()))

    pages = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"), "refers_to", "refers_to_url")
    return pages.mapInArrow(run, "archive binary")


def write_archives(archives: DataFrame, path: str) -> str:
    """One file an archive, by Spark's text writer: its rows are the archives' bytes, its separator an empty gzip member. Bytes are
    cast to a string and written as they are, which Spark does but does not promise; a test reads all kinds of bytes back."""
    rows = archives.select(F.col("archive").cast("string").alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(key, type, target, payload_bytes, payload_digest, refers_to, block): every record with a payload.
    Length and digest of a response are of the payload as read; of a revisit, as its header has them."""

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["key", "type", "target", "payload_bytes", "payload_digest", "refers_to", "block"]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())).read()):
                    kind, f = r.fields["WARC-Type"], r.fields
                    if kind == "warcinfo":
                        continue
                    if kind == "revisit":
                        n, digest = int(f["WARC-Payload-Length"]), base64.b32decode(f["WARC-Payload-Digest"][5:]).hex()
                    else:
                        n, digest = len(r.payload), hashlib.sha1(r.payload).hexdigest()
                    key, back = f.get("X-Archive-Key"), f.get("X-Refers-To-Key")
                    rows.append((None if key is None else int(key), kind, f["WARC-Target-URI"], n, digest, None if back is None else int(back), r.block))
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 256], strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content").where(F.length("content") > 0)
    return files.mapInArrow(run, "key bigint, type string, target string, payload_bytes bigint, payload_digest string, refers_to bigint, block binary")


def op3_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    pages = with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "html")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4()}"
    back = read_archives(spark, write_archives(page_records(pages), path))
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), last AS (
  SELECT payload_digest, max(page_id) AS last_page FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN last_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last_page <> page_id THEN last_page END AS refers_to
FROM p LEFT JOIN last ON p.payload_digest = last.payload_digest AND p.payload_bytes >= 1000
"""
