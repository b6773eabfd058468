"""WARC archives: writing pages as records with segments and revisits, and reading them back.

A payload is sent in chunked transfer framing behind an HTTP header.  A record longer than
`SEGMENT` bytes is cut: its first segment is a `response`, the others are `continuation` records that
name its id as their origin, carry segment numbers, and, on the last one, the total length.  Reading
groups them by origin, orders them, verifies numbers and length, and only then decodes the framing;
records in one piece need no shuffle.  Archives are gzip members, one for each record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import fresh_path, lots, release, sliced, tidied, unskewed, written

SEGMENT, CHUNK, SMALL = 64 << 10, 8 << 10, 100
#: Stands for a page without an id, which comes last.
_NO_PAGE = 2**63 - 1
#: Bytes after which a task begins another archive.
ARCHIVE = 256 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """What chunked transfer framing holds; extensions and trailers are skipped.  ValueError if it is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def record(kind: str, name: str, body: bytes, fields: dict[str, str]) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": "2024-01-01T00:00:00Z", **fields, "Content-Length": str(len(body))}.items())
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n") + packer.flush()


def page_records(name: str, url: str | None, payload: bytes, size: int, digest: str, refers: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a revisit, which needs the payload's size and digest only, or a response with its continuations."""
    safe = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "urn:none")
    about = {"WARC-Target-URI": safe, "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers is not None:
        return [record("revisit", name, b"", about | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers}>", "X-Payload-Length": str(size)})]
    body = HTTP + chunked(payload)
    if len(body) <= segment:
        return [record("response", name, body, about)]
    out = []
    for number, at in enumerate(range(0, len(body), segment), 1):
        part = body[at : at + segment]
        fields = {"WARC-Segment-Number": str(number)}
        if number > 1:
            fields["WARC-Segment-Origin-ID"] = f"<{name}>"
        if at + segment >= len(body):
            fields["WARC-Segment-Total-Length"] = str(len(body))
        out.append(record("response" if number == 1 else "continuation", name if number == 1 else f"{name}:{number}", part, (about if number == 1 else {"WARC-Target-URI": safe}) | fields))
    return out


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and bodies of the records of an archive, read as a stream."""
    inflate, member, more = zlib.decompressobj(31), [], b""
    while data := more or source.read(1 << 20):
        member.append(inflate.decompress(data))
        more = inflate.unused_data
        if inflate.eof:
            yield _parsed(b"".join(member))
            inflate, member = zlib.decompressobj(31), []
    if any(member):
        raise ValueError("an archive is cut off")


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    if len(body) != int(fields["content-length"]):
        raise ValueError("a record is cut off")
    return fields, body


def _payload(body: bytes) -> bytes:
    head, _, rest = body.partition(b"\r\n\r\n")
    return unchunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest


def record_id(page: int, url: str, digest: str) -> str:
    """The id of a page's record: `urn:page:<page>:<what tells it from others with that page>`."""
    return f"urn:page:{'none' if page == _NO_PAGE else page}:{hashlib.sha256(url.encode() + digest.encode()).hexdigest()[:32]}"


def _number(name: str | None) -> int | None:
    """The page in a record id."""
    page = name.strip("<>").split(":")[2] if name else ""
    return int(page) if page not in ("", "none") else None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", segment: int = SEGMENT) -> DataFrame:
    """Writes all pages into archives in `folder` and returns (file, records) of each.

    Of pages with equal payloads of `SMALL` bytes or more the smallest id (then the smallest url) is the
    response and the others refer to it; of equal rows, which stand for each other, any one.  Ids of
    records follow from what the rows hold, so a lost executor changes none.  Pages meet their like by id, url
    and digest; the payloads of revisits go no further.  Archives get their name when they are whole.
    """
    spark = pages.sparkSession
    page, url = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_PAGE)), F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(page.alias("page"), url.alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"))
    same = ["page", "url", "digest"]  # rows that are equal in these can stand for each other
    alike = rows.groupBy(*same, F.octet_length("html").cast("long").alias("size")).agg(F.count("*").alias("copies"))
    alike = written(alike, "alike")
    origin = alike.where(F.col("size") >= SMALL).groupBy("digest").agg(F.min(F.struct("page", "url")).alias("first"), F.count("*").alias("c"), F.sum("copies").alias("all"))
    origin = written(origin.where("all > 1").drop("all"), "origin")
    first = (F.col("page") == F.col("first.page")) & (F.col("url") == F.col("first.url"))
    # rows that are not simply a response each: revisits, and the one response among equal rows
    odd = unskewed(alike, origin, ["digest"]).withColumn("leads", first).where("not leads or copies > 1")
    odd = written(odd.select(*same, "size", "copies", "leads", F.col("first.page").alias("rp"), F.col("first.url").alias("ru")), "odd")
    release(spark, origin)

    responses = rows.join(odd.select(*same), same, "left_anti")
    leading = written(odd.where("leads").select(*same), "leading")  # one of several equal rows
    if not leading.isEmpty():
        responses = responses.unionByName(rows.join(leading, same, "left_semi").dropDuplicates(same))
    number = F.explode(F.sequence(F.when(F.col("leads"), 1).otherwise(0), (F.col("copies") - 1).cast("int")))
    revisits = odd.where("not leads or copies > 1").select("page", "url", "digest", "size", number.alias("copy"), "rp", "ru")
    none = F.lit(None)
    every = responses.select("page", "url", "html", "digest", F.octet_length("html").cast("long").alias("size"), none.cast("int").alias("copy"), none.cast("long").alias("rp"), none.cast("string").alias("ru"))
    every = every.unionByName(revisits.withColumn("html", none.cast("string")))

    @tidied

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        pid, number, out, size, count, part = TaskContext.get().partitionId(), 0, None, 0, 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            name = f"pages-{pid:06d}-{number:04d}.warc.gz"
            fs.move(part, f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([count], pa.int64())})

        serial = 0
        for batch in sliced(batches, "html"):
            for page, url, html, digest, size_of, copy, rp, ru in zip(*(batch.column(k).to_pylist() for k in ("page", "url", "html", "digest", "size", "copy", "rp", "ru")), strict=True):
                if out is None:
                    part = f"{path}/_pages-{pid:06d}-{number:04d}.{uuid.uuid4().hex}"
                    out, size, count = fs.open_output_stream(part), 0, 0
                name, refer = record_id(page, url, digest), None
                if rp is not None:
                    name, refer = f"{name}:copy-{copy}", record_id(rp, ru, digest)
                elif size_of < SMALL:  # equal small pages are all responses; no other record refers to them
                    name, serial = f"{name}:{pid}-{serial}", serial + 1
                for member in page_records(name, url, (html or "").encode(), size_of, digest, refer, segment):
                    out.write(member)
                    size, count = size + len(member), count + 1
                if size >= ARCHIVE:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return every.mapInArrow(write, "file string, records long")


RECORD = "record string, page long, type string, refers long, digest string, length long, total long, number int, body binary"


def read_archives(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload): all records of the archives, put together.

    An incomplete or broken record raises ValueError.  A revisit has no payload of its own (null).
    """

    @tidied

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("record", pa.string()), ("page", pa.int64()), ("type", pa.string()), ("refers", pa.int64()), ("digest", pa.string()), ("length", pa.int64()), ("total", pa.int64()), ("number", pa.int32()), ("body", pa.binary())])
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(f"{path}/{file}", compression=None) as source:
                    for fields, body in records(source):
                        origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                        number = int(fields.get("warc-segment-number", 0))
                        kind = fields["warc-type"]
                        digest = fields.get("warc-payload-digest", ":").split(":")[1]
                        total = int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None
                        length = int(fields["x-payload-length"]) if "x-payload-length" in fields else None
                        if number == 0 and kind == "response":
                            body = _payload(body)
                        rows.append((origin, _number(origin), kind, _number(fields.get("warc-refers-to")), digest, length, total, number, body))
                        held += len(body)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = files.select("file").mapInArrow(read, RECORD)
    return found


def assembled(found: DataFrame) -> DataFrame:
    """Whole records from those of `read_archives`, segments grouped by origin and put in order."""

    @tidied

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots(batches, ["record"], "body", 4 << 20):
            out: list[tuple] = []
            names = np.asarray(lot.column("record").to_pylist(), object)
            opens = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            rows = lot.to_pylist()
            for a, b in zip(opens.tolist(), [*opens[1:].tolist(), len(rows)], strict=True):
                group = rows[a:b]
                body = b"".join(r["body"] for r in group)
                if [r["number"] for r in group] != list(range(1, len(group) + 1)) or group[-1]["total"] != len(body):
                    raise ValueError(f"segments of {names[a]} don't add up")
                out.append((names[a], group[0]["page"], "response", None, group[0]["digest"], None, None, 0, _payload(body)))
            columns = list(zip(*out, strict=True))
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=lot.schema.names)

    segments = found.where("number > 0").repartition("record").sortWithinPartitions("record", "number")
    return found.where("number = 0").unionByName(segments.mapInArrow(join, RECORD))


def round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", segment: int = SEGMENT) -> DataFrame:
    """Pages written to archives and read back: page_id, url-free, as `payload` (null for revisits) and what their records say.

    A null page is an empty payload; repeated rows are records of their own, told apart by their row;
    a null id is written as none and read as null.  The digest of every payload read is verified.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")

    files = written(write_archives(pages, folder, id_col, html_col, url_col, segment), "archives")
    files = files.repartition(max(1, files.count()), "file")
    whole = assembled(read_archives(spark, folder, files))
    payload = F.when(F.col("type") == "response", F.col("body"))
    whole = whole.select("page", "type", "refers", "digest", "length", payload.alias("payload"))
    sha = F.sha2("payload", 256)
    right = F.when(F.col("payload").isNull() | (sha == F.col("digest")), F.col("digest")).otherwise(F.raise_error(F.lit("a payload doesn't have its digest")))
    return whole.select(
        F.col("page").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), "length").alias("payload_bytes"), right.alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers").alias("refers_to"), "payload",
    )


