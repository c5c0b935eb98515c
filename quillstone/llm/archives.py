"""Legacy web archives: ARC files of versions 1 and 2 become WARC files, with revisit records for repeated payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialise, work_dir, tidy
from quillstone.llm.token_records import opened

# Fields of an ARC header line by version, as the version block of each file names them.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
ID_HEADER = "X-Page-Id"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARC_BYTES = 32 << 20
ARC_RECORDS = 20_000
LEVEL = 1


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes


def member(data: bytes) -> bytes:
    """One gzip member, without a time stamp, so that equal records give equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records of an ARC file, version block left out.

    The version block's first line has the version and its second the field names. A header line is cut from its right
    end, since old URLs may hold spaces; the declared length alone says where a record ends, and blank lines between
    records are skipped. A wrong line or a record that is cut short raises.
    """
    fields: list[str] | None = None
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        width = len(fields or ()) or (len(ARC_FIELDS["2"]) if len(text.split(" ")) >= 10 else len(ARC_FIELDS["1"]))
        values = text.rsplit(" ", width - 1)
        if len(values) < width or not values[-1].isdigit():
            raise ValueError(f"bad ARC header line: {text[:200]!r}")
        body = stream.read(int(values[-1]))
        if len(body) < int(values[-1]):
            raise ValueError(f"ARC record cut short: {text[:200]!r}")
        if fields is None:
            if not values[0].startswith("filedesc:"):
                raise ValueError("an ARC file begins with its version block")
            version, names = body.decode("utf-8", "replace").split("\n")[:2]
            fields = names.split() or ARC_FIELDS[version.split(" ")[0]]
            continue
        row = dict(zip(fields, values))
        yield ArcRecord(row["URL"], row["IP-address"], row["Archive-date"], row["Content-type"], body)


def arc_header(version: str, name: str, values: dict[str, str], body: bytes) -> bytes:
    row = {"Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name} | values
    row["Archive-length"] = str(len(body))
    return " ".join(row[f] for f in ARC_FIELDS[version]).encode() + b"\n"


def version_block(version: str, name: str) -> bytes:
    body = f"{version} 0 Archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20000101000000", "Content-type": "text/plain"}
    return arc_header(version, name, values, body) + body + b"\n"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Response head with its blank line, and payload; a body without an HTTP head is payload alone."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    found = re.search(rb"\r?\n\r?\n", body)
    return (body[: found.end()], body[found.end() :]) if found else (body, b"")


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def warc_date(date: str) -> str:
    """14 digits of an ARC date, missing ones as in the first moment of the period, in WARC form."""
    digits = re.sub(r"\D", "", date)[:14]
    full = digits + "00000101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(*parts: str) -> str:
    """A WARC identifier made from what identifies the ARC record, so that a second conversion gives the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"bad WARC version line: {line[:100]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("WARC record cut short")
        yield fields, block


def reading(path: str) -> io.BufferedIOBase:
    system, name = opened(path)
    raw = system.open_input_stream(name, buffer_size=1 << 20)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)


def new_file(folder: str, suffix: str) -> tuple[object, str]:
    system, root = opened(folder)
    system.create_dir(root)
    name = uuid.uuid4().hex + suffix
    return system.open_output_stream(f"{root}/{name}"), f"{folder}/{name}"


def write_arc(pages: DataFrame, folder: str | None = None, most_records: int = ARC_RECORDS) -> DataFrame:
    """(path, version): the pages as ARC files, versions taking turns; the legacy archive that is then converted.

    The HTTP head carries the page_id. Files end at a bounded size. White space in a URL is escaped, a null URL becomes
    a name under ``page:``.
    """
    folder = folder or work_dir(pages.sparkSession, "arc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, records, files = None, "", 0, 0, []
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if out is None or size >= ARC_BYTES or records >= most_records:
                    if out is not None:
                        out.close()
                    version = "12"[(turn + len(files)) % 2]
                    out, path = new_file(folder, ".arc.gz")
                    files.append((path, version))
                    size, records, name = 0, 0, path.rsplit("/", 1)[-1]
                    out.write(member(version_block(version, name)))
                payload = (html or "").encode()
                own = "" if page is None else f"{ID_HEADER}: {page}\r\n"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                safe = re.sub(r"[\x00-\x20\x7f\x85\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or f"page:{page}")
                stamp = 1_000_000_000 + (page or 0) % 1_000_000_000
                values = {"URL": safe, "IP-address": "0.0.0.0", "Archive-date": "%04d%02d%02d%02d%02d%02d" % moment(stamp), "Content-type": "text/html"}
                data = member(arc_header(version, name, values, body) + body + b"\n")
                out.write(data)
                size, records = size + len(data), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*files)], names=["path", "version"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return materialise(rows.mapInArrow(tidy(run), "path string, version string"), "arc-files")


def moment(seconds: int) -> tuple[int, ...]:
    import time

    return time.gmtime(seconds)[:6]


def arc_records(files: DataFrame) -> DataFrame:
    """(path, ordinal, page_id, url, date, digest, length) of every record of the ARC files, payloads left out."""
    names = ["path", "ordinal", "page_id", "url", "date", "digest", "length"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with reading(path) as stream:
                    for i, record in enumerate(read_arc(stream)):
                        head, payload = split_http(record.body)
                        page = http_field(head, ID_HEADER)
                        rows.append((path, i, int(page) if page else None, record.url, warc_date(record.date), digest(payload), len(payload)))
                columns = list(zip(*rows)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    shape = "path string, ordinal int, page_id long, url string, date string, digest string, length long"
    return files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(tidy(run), shape)


def revisits(records: DataFrame, least_bytes: int) -> DataFrame:
    """Adds the original's page_id, url and date, null where the record is itself the response.

    Of records with equal payloads of at least ``least_bytes`` the one with the largest page_id is the original; the
    last in the files wins between equal or null ids. One row per payload comes back from a pre-aggregated group.
    """
    rank = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("k"), "path", "ordinal", "page_id", "url", "date")
    best = records.where(F.col("length") >= least_bytes).groupBy("digest", "length").agg(F.max(rank).alias("_o"), F.count("*").alias("_n"))
    repeated = best.where("_n > 1").drop("_n")
    joined = records.join(repeated, ["digest", "length"], "left")
    other = F.col("_o").isNotNull() & ~((F.col("_o.path") == F.col("path")) & (F.col("_o.ordinal") == F.col("ordinal")))
    return joined.select(
        "path",
        "ordinal",
        other.alias("revisit"),
        *[F.when(other, F.col(f"_o.{c}")).alias(f"to_{c}") for c in ("page_id", "url", "date")],
    )


def write_warc(decided: DataFrame, folder: str | None = None) -> DataFrame:
    """Converts each ARC file to a WARC file; the rows of one ARC file, whose number is bounded, meet in one group."""
    folder = folder or work_dir(decided.sparkSession, "warc")

    def run(group: pa.Table) -> pa.Table:
        rows = {r["ordinal"]: r for r in group.to_pylist()}
        source = group.column("path")[0].as_py()
        out, path = new_file(folder, ".warc.gz")
        name = source.rsplit("/", 1)[-1]
        info = f"software: archive converter\r\nformat: WARC File Format 1.0\r\nconverted-from: {name}\r\n".encode()
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", warc_date("20000101")), ("Content-Type", "application/warc-fields")]
        out.write(member(warc_record(fields, info)))
        with reading(source) as stream:
            for i, record in enumerate(read_arc(stream)):
                row = rows[i]
                head, payload = split_http(record.body)
                date, page = warc_date(record.date), http_field(head, ID_HEADER) or ""
                block = head if row["revisit"] else record.body
                fields = [
                    ("WARC-Type", "revisit" if row["revisit"] else "response"),
                    ("WARC-Record-ID", record_id(record.url, date, page)),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", record.url),
                    ("WARC-IP-Address", record.ip),
                    ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
                    ("WARC-Block-Digest", f"sha1:{digest(block)}"),
                    ("Content-Type", "application/http; msgtype=response" if head else record.mime),
                ]
                if row["revisit"]:
                    to = "" if row["to_page_id"] is None else str(row["to_page_id"])
                    fields += [
                        ("WARC-Profile", SAME_PAYLOAD),
                        ("WARC-Refers-To", record_id(row["to_url"], row["to_date"], to)),
                        ("WARC-Refers-To-Target-URI", row["to_url"]),
                        ("WARC-Refers-To-Date", row["to_date"]),
                        ("WARC-Truncated", "length"),
                        (f"{ID_HEADER}-Refers-To", to),
                    ]
                out.write(member(warc_record(fields, block)))
        out.close()
        return pa.table({"path": pa.array([path], pa.string()), "records": pa.array([len(rows)], pa.int64())})

    return materialise(decided.groupBy("path").applyInArrow(run, "path string, records long"), "warc-files")


def warc_pages(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the WARC files, digests checked.

    Of a revisit the length is the Content-Length of the kept HTTP head, as the payload itself is not repeated.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with reading(path) as stream:
                    for fields, block in read_warc(stream):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        head, payload = split_http(block)
                        told = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-block-digest"] != f"sha1:{digest(block)}" or (kind == "response" and told != digest(payload)):
                            raise ValueError(f"a digest of {fields['warc-record-id']} is wrong")
                        page, to = http_field(head, ID_HEADER), fields.get(f"{ID_HEADER}-Refers-To".lower())
                        length = len(payload) if kind == "response" else int(http_field(head, "Content-Length") or 0)
                        rows.append((int(page) if page else None, length, told, kind, int(to) if to else None))
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(tidy(run), shape)


def convert_arc(files: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """(path, records) of the WARC files made from ARC files (path): one WARC file for each, in the shared folder.

    Files are named anew at each attempt and only those of attempts that succeeded are listed.
    """
    return write_warc(revisits(materialise(arc_records(files), "arc-records"), least_bytes), folder)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages as a legacy archive, converted and read back: one row per page as in :func:`warc_pages`.

    A null html is an empty payload. A null page_id has no id header and comes back null; it can be an original only
    among null ids, and what refers to it has a null refers_to. Rows that repeat a page_id are records of their own.
    Only page_id, url and html are looked at; an empty table writes no file and gives an empty result.
    """
    return warc_pages(convert_arc(write_arc(pages), least_bytes=least_bytes))
