"""WARC archives: a writer in DataFrame operations and a Python data source.

Writing: a record is one value of Spark's text writer, with the WARC record
end (two CRLF) as its line separator, so files are committed as Spark commits
any output. Of records with equal payloads one is the ``response``; the others
are ``revisit`` records that refer to it and carry no payload.

Reading: the source plans partitions from the files' sizes, takes equality and
IN filters on the record type and on header columns, and reads a record's
headers first. Payloads of unwanted records, or all of them with the option
``payload=false``, are stepped over without being read or decoded; in files
compressed by gzip (``.gz``) they are passed over as they are unpacked.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .common import discard, written

CRLF = "\r\n"
RECORD_ID = "urn:x-page:"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """One record per row of ``pages``. Of rows with equal payloads of at least
    ``least_bytes`` bytes the one with the largest id is the response.

    Null html is an empty payload, a null url an empty one. Rows with a null id
    are responses of their own. An id may repeat: rows that share both id and
    payload are one response and its repeats (all ``response`` rows) if the id
    is the payload's largest, else all revisits; rows that share an id alone are
    judged each by its own payload. Other columns are ignored; an empty table
    writes no record. The texts meet their record's outcome once, by id and
    digest; hot groups of equal payloads are resolved on thin rows, first per
    run of the scan."""
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.regexp_replace(F.col(url_col).cast("string"), r"[\r\n]", " "), F.lit("")).alias("url"), body.alias("body")).withColumn("sha1", F.sha1("body"))
    thin = written(source.where("id is not null").select("id", F.spark_partition_id().alias("run"), "sha1", F.octet_length("body").alias("n_bytes")), "warc-digests")
    large = thin.where(F.col("n_bytes") >= least_bytes)
    of_run = large.groupBy("sha1", "run").agg(F.max("id").alias("first"))
    best = of_run.join(of_run.groupBy("sha1").agg(F.max("first").alias("best")), "sha1").select("sha1", "run", F.col("best").alias("first"))
    revisits = large.join(best, ["sha1", "run"]).where("id <> first").select("id", "sha1", "first").distinct()
    # Written first, so that Spark plans the join of the texts by its true size.
    revisits = written(revisits, "warc-revisits")
    joined = source.join(revisits, ["id", "sha1"], "left").withColumn("digest", base32(F.col("sha1")))
    n_bytes = F.octet_length("body")
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n_bytes.cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.when(F.col("id").isNotNull(), line("WARC-Record-ID", F.concat(F.lit(f"<{RECORD_ID}"), F.col("id").cast("string"), F.lit(">")))).otherwise(""),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", n_bytes.cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit(f"<{RECORD_ID}"), F.col("first").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )
    joined.select(record.alias("value")).write.option("lineSep", CRLF * 2).mode("errorifexists").text(folder)
    discard(thin, revisits)


def base32(digest: Column) -> Column:
    """Base32 of the 40 hex digits of a SHA-1 digest: Spark writes each 40 bits as
    eight digits to base 32, whose alphabet is then replaced."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


@dataclass
class WarcFiles(InputPartition):
    files: tuple[tuple[str, int], ...]


HEADER_COLUMNS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "payload_length": "x-payload-length"}


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.files = [tuple(x.rsplit(" ", 1)) for x in options.get("files", "").split("\n") if x]
        self.target = int(options.get("partitionBytes", 64 << 20))
        self.payload = options.get("payload", "true") == "true"
        self.wanted: dict[str, set] = {}

    def __getstate__(self):
        """Tasks get their partition's files, not the list of all."""
        return self.__dict__ | {"files": []}

    def partitions(self):
        """Files packed, in order, to about ``partitionBytes`` each."""
        out, held, n = [], [], 0
        for path, size in self.files:
            if held and n + int(size) > self.target:
                out.append(WarcFiles(tuple(held)))
                held, n = [], 0
            held.append((path, int(size)))
            n += int(size)
        return out + ([WarcFiles(tuple(held))] if held else []) or [WarcFiles(())]

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name in HEADER_COLUMNS and values is not None and all(isinstance(v, str) for v in values):
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def read(self, partition):
        from pyarrow import fs

        rows = []
        for path, _ in partition.files:
            files, inner = fs.FileSystem.from_uri(path)
            packed = inner.endswith(".gz")
            with files.open_input_stream(inner, compression="gzip") if packed else files.open_input_file(inner) as source:
                for row in read_records(source, self.wanted, self.payload):
                    rows.append(row)
                    if len(rows) >= 500:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


_ROW = pa.schema([*((c, pa.string()) for c in HEADER_COLUMNS), ("payload", pa.binary())])


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _skipped(source, n: int) -> int:
    """Passes over ``n`` bytes; returns how many there were."""
    if source.seekable():
        at = source.tell()
        source.seek(min(at + n, source.size()))
        return source.tell() - at
    left = n
    while left and (got := len(source.read(min(left, 1 << 20)))):
        left -= got
    return n - left


def read_records(source, wanted: dict[str, set], payload: bool):
    """Rows of the records whose headers fit ``wanted``. Only their blocks are
    read, and only if ``payload``."""
    ahead = b""  # read, not yet used
    while True:
        end = ahead.find(b"\r\n\r\n")
        while end < 0:
            more = source.read(1 << 14)
            if not more:
                if ahead.strip():
                    raise ValueError("a record's headers are cut short")
                return
            end_from = max(0, len(ahead) - 3)
            ahead += more
            end = ahead.find(b"\r\n\r\n", end_from)
        lines = ahead[:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        values = {c: headers.get(h) for c, h in HEADER_COLUMNS.items()}
        rest, ahead = ahead[end + 4 :], b""
        body, fits = None, all(values[c] in v for c, v in wanted.items())
        if fits and payload and values["record_type"] != "revisit":
            if len(rest) < length + 4:
                rest += source.read(length + 4 - len(rest))
            body = rest[:length]
            if len(body) < length:
                raise ValueError("a record's block is cut short")
            if headers.get("content-type", "").startswith("application/http"):
                body = body[body.find(b"\r\n\r\n") + 4 :]
            ahead = rest[length + 4 :]
        elif len(rest) >= length + 4:
            ahead = rest[length + 4 :]
        elif _skipped(source, length + 4 - len(rest)) < length - len(rest):
            raise ValueError("a record's block is cut short")
        if fits:
            yield (*values.values(), body)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; use ``read_warc`` to list the files."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return ", ".join(f"{c} string" for c in HEADER_COLUMNS) + ", payload binary"

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark: SparkSession, folder: str, payload: bool = True, partition_bytes: int = 64 << 20, pattern: str = "*") -> DataFrame:
    """The records of all files in ``folder`` whose names fit ``pattern``, plain
    or gzip. Spark lists them, so the folder can be wherever Spark reads; one
    line per file goes through the driver. Turns the session's
    ``spark.sql.python.filterPushdown.enabled`` on, without which filters are
    applied only after reading. No files give no records."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length").orderBy("path").collect()
    files = "\n".join(f"{_uri(r.path)} {r.length}" for r in listed)
    return spark.read.format("warc").option("files", files).option("payload", str(payload).lower()).option("partitionBytes", str(partition_bytes)).load()


def _uri(path: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", path)


def verified_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each
    record; a response's payload must have the length and digest it states."""

    def run(batches):
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for kind, stated, n, body in zip(c["record_type"], c["payload_digest"], c["payload_length"], c["payload"], strict=True):
                if kind == "response" and (len(body) != int(n) or f"sha1:{payload_digest(body)}" != stated):
                    raise ValueError("a payload differs from its stated digest")
            number = lambda v: int(m[1]) if v and (m := re.fullmatch(rf"<{RECORD_ID}(-?\d+)>", v)) else None
            yield pa.RecordBatch.from_pydict({"page_id": pa.array(map(number, c["record_id"]), pa.int64()), "payload_bytes": pa.array(map(int, c["payload_length"]), pa.int64()), "payload_digest": [d.removeprefix("sha1:") for d in c["payload_digest"]], "record_type": c["record_type"], "refers_to": pa.array(map(number, c["refers_to"]), pa.int64())})

    return records.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
