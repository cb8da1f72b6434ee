"""Content-addressed WARC archive: payload bytes once by SHA-256, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, narrow

#: Payloads of fewer bytes are always written as responses.
MIN_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line; empty for a null value, control characters percent-encoded."""
    clean = value.cast("string")
    for code in (13, 10, 0):
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(_EOL)), F.lit(""))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, payload, digest, size, target and exact header of each page's record.

    Of equal payloads of at least least bytes the one with the smallest id is the
    response, the others are revisits that refer to it; rows that repeat that id
    are responses as well.  A null payload is an empty one; a null id is ordered
    last, so that it is a response only where all ids of its payload are null.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("target"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # only digests and ids are shuffled to plan; payload bytes move if the marks are too many to be broadcast
    keys = rows.filter(F.col("size") >= least).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    first = materialize(first, "first")
    copies = materialize(keys.join(narrow(first), "digest").groupBy("page_id", "digest", "first_id").count(), "copies")
    # marks: rows that revisit another, and digests whose responses repeat one id
    marks = copies.filter("NOT (page_id <=> first_id)").select(F.col("page_id").alias("mark_id"), F.col("digest").alias("mark"), "first_id", F.lit(True).alias("revisit"))
    marks = marks.unionAll(copies.filter("page_id <=> first_id AND count > 1").select("page_id", "digest", "first_id", F.lit(False)))
    rows = rows.join(narrow(marks), F.col("page_id").eqNullSafe(F.col("mark_id")) & (F.col("digest") == F.col("mark")), "left")
    rows = rows.withColumn("repeated", (F.col("revisit") == F.lit(False)) | (F.col("size") < least)).fillna(False, ["revisit", "repeated"])
    revisit = F.col("revisit")
    header = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        F.when(revisit, F.lit(f"WARC-Type: revisit{_EOL}")).otherwise(F.lit(f"WARC-Type: response{_EOL}")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}{_EOL}"),
        _line("WARC-Target-URI", F.col("target")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("first_id")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}{_EOL}")).otherwise(F.lit("")),
        F.lit(f"Content-Type: text/html; charset=utf-8{_EOL}"),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size"))),
        F.lit(_EOL),
    )
    return rows.select("page_id", "payload", "digest", "size", "revisit", "repeated", header.cast("binary").alias("header"))


def write_archive(pages: DataFrame, path: str, **options: object) -> None:
    """Write pages below path as two tables: headers (digest, header) and payloads (digest, payload), each payload once."""
    plan = plan_records(pages, **options)
    headers = plan.select("digest", "header")
    headers.write.parquet(f"{path}/headers")
    # a revisit's payload is stored with its response; only short ones and those of repeated ids must be made distinct
    kept = plan.filter("NOT revisit").select("digest", "payload", "repeated")
    once = kept.filter("repeated").select("digest", "payload").dropDuplicates(["digest"])
    kept.filter("NOT repeated").select("digest", "payload").unionAll(once).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild every record of an archive: parsed header fields, the header's and the full payload's bytes.

    Each stored payload's digest is computed anew; a payload that is missing or
    that does not match its address stops the read with an error.  The join is of two
    plain exchanges, so AQE splits the headers of a digest that many pages share;
    readers that leave out the payload shuffle none.
    """
    headers = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    # computed before the join, so that a reader of digests and sizes alone shuffles no payload
    rows = headers.join(payloads.withColumn("actual", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long")), "digest", "left")
    rows = rows.withColumn("size", F.when(F.col("actual") == F.col("digest"), F.col("size")).otherwise(F.raise_error(F.concat(F.lit("payload missing or changed: "), F.col("digest")))))
    text = F.col("header").cast("string")

    def field(name: str) -> Column:
        got = F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(got != "", got)

    def page(name: str) -> Column:
        got = F.regexp_extract(text, rf"\r\n{name}: <urn:record:(-?\d+)>\r\n", 1)
        return F.when(got != "", got).cast("long")

    return rows.select(
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("target"),
        F.regexp_extract(text, r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n", 1).alias("payload_digest"),
        field("Content-Length").cast("long").alias("content_length"),
        F.col("size").alias("payload_bytes"),
        "header",
        "payload",
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """The original record of each row of read_archive, byte for byte: header, block (none for a revisit) and two line ends."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))


def export_warc(records: DataFrame, path: str) -> None:
    """Write plain .warc text files: the records of read_archive, one after the other in each part."""
    text = record_bytes(records).select(F.expr("substring(record, 1, octet_length(record) - 4)").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").text(path)
