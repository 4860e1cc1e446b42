"""Content-addressed WARC archive.

Two Parquet tables hold an archive. ``payloads`` has the bytes of each payload once, under its
SHA-256, as a zstd frame. ``headers`` has, for each record, the exact header bytes, a key to the payload, and nothing
else. Joining them gives the original records back: header bytes, payload bytes (none for a
revisit), two line ends. A payload counts only if its bytes still have the digest it is stored under.

Reading an archive rebuilds every record so, and takes what it says from the record's own bytes: length and digest of a
response from the bytes behind its header, those of a revisit from its header, which the response it refers to must bear out.

Of a payload that a third of the records share, each task keeps one copy before the shuffle (partial aggregation) and one
row is stored; short payloads that many responses share are joined back by a sort-merge join, which Spark splits where a
key has many rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop, file_system, put, stage, workspace

#: Payloads of fewer bytes are always stored as responses.
REVISIT_BYTES = 1000
EOL = "\r\n"
#: Records carry a fixed date: the tables have none, and the same input gives the same archive.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(c: dict[str, Column]) -> Column:
    """Header block of a record, up to and with its empty line."""
    revisit = c["record_type"] == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), c["record_type"]),
        # The number tells records of one page, and of none, apart.
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(c["page_id"].cast("string"), F.lit("none")), F.lit(":"), c["number"].cast("string"), F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"),
        # A line end within a URL would end the header line.
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(c["url"], "[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), c["sha1"]),
        F.concat(F.lit("X-Payload-Length: "), c["payload_bytes"].cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), c["refers_to"].cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(c["payload_bytes"].cast("string"))),
    ]
    return F.encode(F.concat(F.concat_ws(EOL, *lines), F.lit(EOL + EOL)), "UTF-8")


class Archive:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def headers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/headers")

    @property
    def payloads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/payloads")

    def records(self) -> DataFrame:
        """number, sha256 and the original bytes of each record, from header and payload joined; a damaged payload stops the job."""
        return self._joined().mapInArrow(_rebuild, "number long, sha256 string, record binary")

    def _joined(self) -> DataFrame:
        bounded_batches(self.spark)
        head = self.headers
        # Revisits have no payload of their own, so they meet none.
        answers = head.where("record_type = 'response'").join(self.payloads, "sha256", "left")
        others = head.where("record_type != 'response'").select("number", "sha256", "header", F.lit(None).cast("binary").alias("frame"))
        return answers.select("number", "sha256", "header", "frame").unionByName(others)

    def read(self) -> DataFrame:
        """What the rebuilt records say: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

        A revisit's length and digest are its header's; a response with that payload must have the same."""
        rows, path = stage(self._joined().mapInArrow(lambda batches: _parse(_rebuild(batches)), FIELDS), "warc-read")
        told = rows.where("record_type = 'response'").groupBy("sha256").agg(F.max(F.struct("payload_digest", "payload_bytes")).alias("told"))
        told, _ = stage(told, "warc-told")
        revisits = rows.where("record_type = 'revisit'").join(told, "sha256", "left")
        holds = F.coalesce((F.col("told.payload_digest") == F.col("payload_digest")) & (F.col("told.payload_bytes") == F.col("payload_bytes")), F.lit(False))
        sure = F.when(holds, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("revisit without its response: "), F.col("sha256"))))
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        return rows.where("record_type = 'response'").select(*names).unionByName(revisits.withColumn("payload_digest", sure).select(*names))

    def export(self, folder: str) -> DataFrame:
        """Write the records as .warc files (one for each task) and return path and records of each.
        A file gets its name only when it is whole."""

        def run(batches):
            fs, base = file_system(folder)
            fs.create_dir(base, recursive=True)
            name, n = f"{base}/{uuid.uuid4().hex}", 0
            with fs.open_output_stream(f"{name}.tmp") as out:
                for b in batches:
                    for r in b.column(0):
                        out.write(r.as_py())
                        n += 1
            put(fs, f"{name}.tmp", f"{name}.warc")
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc"]), pa.array([n])], names=["path", "records"])

        return self.records().select("record").mapInArrow(run, "path string, records long")


FIELDS = "sha256 string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_END = (EOL + EOL).encode()
_PAGE = re.compile(r"<urn:page:(-?\d+)(?::\d+)?>")


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record bytes of rows number, sha256, header, frame."""
    for b in batches:
        records = []
        for name, head, frame in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            payload = b""
            if b"\r\nWARC-Type: response\r\n" in head:
                if frame is None:
                    raise ValueError(f"payload is missing: {name}")
                payload = zstandard.decompress(frame)
                if hashlib.sha256(payload).hexdigest() != name:
                    raise ValueError(f"payload is damaged: {name}")
            records.append(head + payload + _END)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(records, pa.binary())], names=["number", "sha256", "record"])


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content block of a record; its length must be the header's, and two line ends its end."""
    end = record.index(_END) + len(_END)
    version, *lines = record[: end - len(_END)].decode().split(EOL)
    fields = dict(x.split(": ", 1) for x in lines)
    block = record[end : end + int(fields["Content-Length"])]
    if not version.startswith("WARC/") or record[end + len(block) :] != _END or len(block) != int(fields["Content-Length"]):
        raise ValueError(f"no whole record: {version} {fields.get('WARC-Record-ID')}")
    return fields, block


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What records say; a response's digest and length are made from its block and must be its header's."""

    def page(value: str | None) -> int | None:
        m = _PAGE.fullmatch(value or "")
        return int(m[1]) if m else None

    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for b in batches:
        rows = []
        for name, record in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            f, block = parse_record(record)
            sha1, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
            if f["WARC-Type"] == "response" and (hashlib.sha1(block).hexdigest() != sha1 or len(block) != size):
                raise ValueError(f"header and payload disagree: {name}")
            rows.append((name, page(f["WARC-Record-ID"]), size, sha1, f["WARC-Type"], page(f.get("WARC-Refers-To")), f.get("WARC-Target-URI")))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests and zstd frame of each payload. rows: number, page_id, url, payload."""
    packer = zstandard.ZstdCompressor(level=3)
    for b in batches:
        payloads = [x.as_py().encode() for x in b.column(3)]
        made = [[hashlib.sha256(p).hexdigest() for p in payloads], [hashlib.sha1(p).hexdigest() for p in payloads], [len(p) for p in payloads], [packer.compress(p) for p in payloads]]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=["number", "page_id", "url", "sha256", "sha1", "payload_bytes", "frame"])


def write_archive(pages: DataFrame, folder: str | None = None) -> Archive:
    """Archive a record for each row of ``pages`` (page_id, url, html; other columns are not read).

    Payload: html in UTF-8, null as empty. Of records with equal payloads of at least 1000 bytes that
    with the largest page_id is a response and the others revisit it; shorter payloads are responses.
    Repeated rows are archived one by one, each under a number of its own; among equal page_ids all are responses. A null
    page_id is never a revisit's target unless no other is there; a null url leaves its line out. An empty
    table gives an empty archive.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or workspace(spark, "warc")
    rows = pages.select(F.monotonically_increasing_id().alias("number"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    schema = "number long, page_id long, url string, sha256 string, sha1 string, payload_bytes long, frame binary"
    facts, path = stage(rows.mapInArrow(_digests, schema), "warc-facts")
    # Equal digests have equal bytes, and reading proves that digest and bytes agree: any frame will do.
    facts.groupBy("sha256").agg(F.first("frame").alias("frame")).write.option("compression", "uncompressed").parquet(f"{folder}/payloads")
    facts = facts.drop("frame")
    newest, path2 = stage(facts.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("sha256").agg(F.max("page_id").alias("newest")), "warc-newest")
    typed = facts.join(newest, "sha256", "left")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    c = {k: F.col(k) for k in ("number", "page_id", "url", "sha1", "payload_bytes", "record_type", "refers_to")}
    typed = typed.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("newest")))
    typed.select("number", "sha256", "record_type", _header(c).alias("header")).write.parquet(f"{folder}/headers")
    drop(spark, path, path2)
    return Archive(spark, folder)


def digest(archive: Archive) -> DataFrame:
    return archive.read().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), f AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest,
         max(page_id) OVER (PARTITION BY b) AS newest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM f
"""
