"""WARC archives: writing captures, and assembling them from their records.

A capture is a transaction of three records: request, response (or revisit, where
the payload is stored elsewhere already) and metadata. Request and metadata name
the response through WARC-Concurrent-To. Archives are gzip files that Spark writes
and reads, so any storage that Spark reaches will do.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import stored
from tickloom.session import scratch_path

#: Payloads of fewer bytes are stored anew each time.
LEAST = 100
#: Records of an archive, at most; three for each capture.
ARCHIVE = 3_000
#: Bytes of records handed on at once.
BATCH = 4 << 20

_END = "\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, profile string, digest string, "
    "payload_bytes long, block string, payload string"
)


def _lines(*lines: Column | str) -> Column:
    return F.concat(*(x for line in lines for x in (F.lit(line) if isinstance(line, str) else line, F.lit(_END))))


def _record(kind: str, fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record's text without its last line end, which the writer adds. A field that is null is left out."""
    head = F.concat(F.lit(f"WARC/1.1{_END}WARC-Type: {kind}{_END}"), *(
        F.coalesce(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(_END)), F.lit("")) for name, value in fields
    ))
    return F.concat(head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END + _END), block, F.lit(_END))


def _urn(kind: str, name: Column) -> Column:
    """An identifier that follows from the capture's name, so that a task run again writes the same."""
    x = F.md5(F.concat(F.lit(f"{kind}:"), name).cast("binary"))
    parts = [F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Archives of ``pages`` (page_id, url, html) in the folder ``path``.

    Of pages with one payload of at least ``least`` bytes the one with the smallest
    page_id is stored, the others revisit it. A null html is an empty payload, a null url an
    unknown one; line ends in a url are dropped. Rows equal in all three columns are one capture.
    A page without a page_id never stands for others if another has one.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("unknown:")), r"[\r\n]", "").alias("url"), payload.alias("payload"))
    pages = pages.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "size": F.octet_length("payload").cast("long")})
    name = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.col("digest"), F.col("url"))
    pages = pages.withColumn("name", name)
    # only payloads that come twice have anything to refer to
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = pages.filter(F.col("size") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.min_by("name", order).alias("stored"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").select("digest", F.col("first.page_id").alias("first_id"), "stored")
    pages = pages.join(first, "digest", "left")
    again = F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    own, request, notes = _urn("response", F.col("name")), _urn("request", F.col("name")), _urn("metadata", F.col("name"))
    date = "1970-01-01T00:00:00Z"
    answer = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", F.concat(F.lit("Content-Length: "), F.col("size").cast("string")), "")
    labelled = F.concat(F.lit("sha256:"), F.col("digest"))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    response = _record("response", [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", labelled), ("Content-Type", "application/http; msgtype=response")], F.concat(answer, "payload"))
    revisit = _record(
        "revisit",
        [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", labelled), ("WARC-Profile", _REVISIT), ("WARC-Refers-To", _urn("response", F.col("stored"))), ("Content-Type", "application/http; msgtype=response")],
        answer,
    )
    asked = _lines(F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1")), "")
    asking = _record("request", [("WARC-Record-ID", request), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], asked)
    noted = F.coalesce(_lines(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"))), F.lit(""))
    noting = _record("metadata", [("WARC-Record-ID", notes), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], noted)
    records = pages.select(F.explode(F.array(asking, F.when(again, revisit).otherwise(response), noting)).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", _END).option("maxRecordsPerFile", ARCHIVE).text(path)


class _Reader:
    """Bytes of an archive, unpacked as they are asked for."""

    def __init__(self, raw: bytes):
        self.rest, self.held, self.member = raw, bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        while self.rest:
            got = self.member.decompress(self.rest, 1 << 20)
            self.held += got
            if self.member.eof:
                self.rest, self.member = self.member.unused_data, zlib.decompressobj(31)
            else:
                self.rest = self.member.unconsumed_tail
            if got:
                return True
        return False

    def until(self, end: bytes) -> bytes | None:
        """Up to and without ``end``; nothing at the end of the archive."""
        at = self.held.find(end)
        while at < 0:
            seen = max(0, len(self.held) - len(end))
            if not self._more():
                return None
            at = self.held.find(end, seen)
        out = bytes(self.held[:at])
        del self.held[: at + len(end)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records_of(raw: bytes) -> Iterator[tuple]:
    """The records of an archive, by their stated lengths."""
    reader = _Reader(raw)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        fields = _fields(head.lstrip(b"\r\n"))
        block = reader.take(int(fields["content-length"]))
        if reader.take(4) != b"\r\n\r\n":
            raise ValueError("a record has another length than it states")
        kind, digest, payload, size = fields.get("warc-type", ""), None, None, None
        if kind in ("response", "revisit"):
            answer, _, body = block.partition(b"\r\n\r\n")
            if kind == "response":
                payload, size = body, len(body)
                digest = hashlib.sha256(body).hexdigest()
                if fields.get("warc-payload-digest", f"sha256:{digest}") != f"sha256:{digest}":
                    raise ValueError("a payload differs from its digest")
            else:
                digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                size = int(_fields(answer).get("content-length", -1))
            block = answer
        yield (
            kind, fields.get("warc-record-id"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"),
            fields.get("warc-target-uri"), fields.get("warc-profile"), digest, size, block.decode(errors="replace"),
            None if payload is None else payload.decode(errors="replace"),
        )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in _RECORD.split(", ")]
    kinds = [pa.int64() if n == "payload_bytes" else pa.string() for n in names]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for raw in batch.column("content"):
            rows, size = [], 0
            for record in records_of(raw.as_py()):
                rows.append(record)
                size += len(record[-1] or "") + len(record[-2])
                if size > BATCH:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: type, identifiers, target_uri, digest, payload_bytes, block (headers or fields), payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_read, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """A row for each capture: capture_id and the structs response, request and metadata.

    Records are joined through the identifier that they name as concurrent; a record told twice
    counts once. Captures whose response record is missing have a null response.
    """
    inner = [c for c in records.columns if c != "concurrent_to"]
    answers = F.col("type").isin("response", "revisit")
    part = lambda test, columns: F.first(F.when(test, F.struct(*columns)), ignorenulls=True)
    small = ["record_id", "target_uri", "block"]
    return (
        records.filter(answers | F.col("concurrent_to").isNotNull())
        .groupBy(F.when(answers, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id"))
        .agg(part(answers, inner).alias("response"), part(F.col("type") == "request", small).alias("request"), part(F.col("type") == "metadata", small).alias("metadata"))
    )


def page_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The records of ``pages``, written to archives in the shared folder and read back."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)


def page_digests(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page_id) of every capture of ``pages``."""
    # what is asked for is in the heads; payloads need not be shuffled
    captures = assemble(page_records(pages, least).drop("payload"))
    number = F.regexp_extract(F.col("metadata.block"), r"(?m)^page-id: (-?\d+)", 1)
    captures = stored(
        captures.select(
            "capture_id", F.when(number != "", number.cast("long")).alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("stored"),
        ),
        "captures",
    )
    stored_by = captures.filter("record_type = 'response'").select(F.col("capture_id").alias("stored"), F.col("page_id").alias("refers_to"))
    return captures.join(stored_by, "stored", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
