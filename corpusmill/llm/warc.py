"""A content-addressed web archive.

The archive is two tables in a folder.  ``payloads`` holds the bytes of every distinct
payload once, under their SHA-256.  ``headers`` holds the exact header of every record
beside that digest.  A join gives the original records back, byte for byte, and fails
if stored bytes don't have their digest.  Records can also be written as WARC files.

Of records with equal payloads of at least ``least`` bytes, the one with the largest id is
a response and the others are revisits that refer to it; smaller ones are responses.

Defined cases: a null payload is empty; a record without an id is a revisit if another
of its group has one, else a response; a null URL gives no such header line; control
characters of a URL are percent-encoded; a repeated row repeats its record; other
columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import fail_unless

LEAST = 1000
ID_PREFIX = "urn:page:"
_EOL = "\r\n"


def _header(id: Column, url: Column, type: Column, refers: Column, sha256: Column, n: Column, date: str) -> Column:
    """Header lines, with the empty line that ends them."""
    name = lambda value: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(value.cast("string"), F.lit("none")), F.lit(">"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1f\x7f]", "%20")
    revisit = type == "revisit"
    return F.concat_ws(
        _EOL,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), type),
        F.concat(F.lit("WARC-Record-ID: "), name(id)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), sha256),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(refers))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(n).cast("string")),
        F.lit(""),
        F.lit(""),
    )


def write_archive(
    pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Write ``payloads`` and ``headers`` below ``folder``.

    Digests are made once, next to the scan, and all decisions are on narrow rows.
    Payloads with equal digests are combined before they are shuffled.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")
    )
    digests = rows.select("id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("n"))
    digests.write.parquet(f"{folder}/digests")
    digests = spark.read.schema(digests.schema).parquet(f"{folder}/digests")
    # Equal strong digests with another digest or length would be different payloads.
    groups = (
        digests.groupBy("sha256")
        .agg(F.max("id").alias("lead"), F.min("sha1").alias("a"), F.max("sha1").alias("b"), F.min("n").alias("c"), F.max("n").alias("d"), F.count("*").alias("copies"))
        .where(fail_unless((F.col("a") == F.col("b")) & (F.col("c") == F.col("d")), F.concat(F.lit("payloads differ under "), F.col("sha256"))))
    )
    shared = groups.where((F.col("copies") > 1) & (F.col("c") >= least)).select("sha256", "lead")
    typed = digests.join(shared, "sha256", "left").select(
        "*",
        F.when(F.col("lead").isNull() | F.col("id").eqNullSafe(F.col("lead")), "response").otherwise("revisit").alias("type"),
    )
    header = _header(F.col("id"), F.col("url"), F.col("type"), F.col("lead"), F.col("sha256"), F.col("n"), date)
    typed.select("id", F.encode(header, "UTF-8").alias("header"), "sha256").write.parquet(f"{folder}/headers")
    (
        rows.select(F.sha2("payload", 256).alias("sha256"), "payload")
        .groupBy("sha256")
        .agg(F.first("payload").alias("payload"))
        .write.option("compression", "zstd")
        .parquet(f"{folder}/payloads")
    )


def header_field(header: Column, name: str) -> Column:
    """A field of a header, null if it isn't there."""
    value = F.regexp_extract(header.cast("string"), rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(id, header, payload, record): every original record by a join, and the payload it stands for.

    ``record`` is the header with the payload of a response; a revisit's has no more
    than the header.  Stored bytes are checked against their digest before the join.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads").where(
        fail_unless(F.sha2("payload", 256) == F.col("sha256"), F.concat(F.lit("damaged payload "), F.col("sha256")))
    )
    body = F.when(header_field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return headers.join(payloads, "sha256").select("id", "header", "payload", F.concat("header", body).alias("record"))


def described(records: DataFrame) -> DataFrame:
    """What records say of themselves: (id, payload_bytes, payload_digest, record_type, refers_to)."""
    header = F.col("header")
    refers = F.regexp_extract(header_field(header, "WARC-Refers-To"), rf"<{ID_PREFIX}(.*)>", 1)
    return records.select(
        "id",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        header_field(header, "WARC-Type").alias("record_type"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
    )


def write_warc_files(records: DataFrame, path: str) -> None:
    """Records as gzipped WARC files: each is followed by two line ends."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _EOL + _EOL).option("compression", "gzip").text(path)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """(record) of the WARC files of a folder, cut by their Content-Length.

    One task holds a file, so files should be of bounded size, as WARC files are.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                data, at, out = gzip.decompress(value.as_py()), 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    length = next(int(line[15:]) for line in data[at:end].split(b"\r\n") if line.lower().startswith(b"content-length:"))
                    out.append(data[at : end + length])
                    at = end + length + 4
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return spark.read.format("binaryFile").load(f"{path}/*.gz").select("content").mapInArrow(parse, "record binary")
