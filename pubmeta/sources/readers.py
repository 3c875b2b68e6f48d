"""Inputs as DataFrames. Every reader states its schema; none infers one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeta.schemas import CROSSREF_WORK_DDL, EVENT_ROWS_DDL, TABLES, TEI_DOCS_DDL, struct_type


# Content types by file extension, and what a PDF begins with.
CONTENT_TYPES = {
    "pdf": "application/pdf",
    "txt": "text/plain",
    "md": "text/markdown",
    "htm": "text/html",
    "html": "text/html",
    "xml": "application/xml",
    "json": "application/json",
    "zip": "application/zip",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
}
OTHER_TYPE = "application/octet-stream"
PDF_MAGIC = b"%PDF-"


def read_uploads(spark: SparkSession, path: str, with_bytes: bool = False) -> DataFrame:
    """Files under ``path`` as ``(file_name, content_type, length, modified_at, path)``.

    Spark's file readers pass over files without a byte, so those do not appear (a manifest lists them). The type
    follows from the extension, in any case. Without bytes only the listing is read. ``with_bytes`` adds
    ``content``, and the type is measured: what begins like a PDF is one, and what only has its name is not.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    named = F.coalesce(known[extension], F.lit(OTHER_TYPE))
    is_pdf = F.substring("content", 1, len(PDF_MAGIC)) == F.lit(PDF_MAGIC)
    measured = F.when(is_pdf, CONTENT_TYPES["pdf"]).when(named == CONTENT_TYPES["pdf"], OTHER_TYPE).otherwise(named)
    return files.select(
        name.alias("file_name"),
        (measured if with_bytes else named).alias("content_type"),
        "length",
        F.col("modificationTime").alias("modified_at"),
        "path",
        *(["content"] if with_bytes else []),
    )


def read_upload_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Uploads listed in a table instead of a folder."""
    return spark.read.schema(
        "paper_id BIGINT, version_id BIGINT, file_name STRING, content_type STRING, length BIGINT, title STRING"
    ).parquet(path)


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, xml)`` from Parquet."""
    return spark.read.schema(TEI_DOCS_DDL).parquet(path)


def read_tei_files(spark: SparkSession, path: str) -> DataFrame:
    """One TEI file per document; the leading number of the file name is the document id."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    name = F.substring_index("file", "/", -1)
    return files.select(
        F.regexp_extract(name, r"^(\d+)", 1).try_cast("bigint").alias("doc_id"), F.col("value").alias("xml")
    )


def parse_works(json_rows: DataFrame, column: str = "value") -> DataFrame:
    """JSON text ``{"message": {...}}`` to work columns; rows without a usable message are dropped."""
    schema = T.StructType([T.StructField("message", struct_type(CROSSREF_WORK_DDL))])
    envelope = F.from_json(column, schema)
    return json_rows.select(envelope.alias("e")).where("e.message IS NOT NULL").select("e.message.*")


def read_crossref(spark: SparkSession, path: str) -> DataFrame:
    """Bibliographic snapshot: one JSON envelope per line, gzip or plain."""
    return parse_works(spark.read.text(path))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One relational table. Columns added later read as NULL from older files."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLES["ocr_pages"]).parquet(path)


def stream_events(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 1000) -> DataFrame:
    """File stream of Kafka-shaped rows ``(key, value)``."""
    return (
        spark.readStream.format(fmt).schema(EVENT_ROWS_DDL).option("maxFilesPerTrigger", max_files).load(path)
    )


def stream_kafka_events(spark: SparkSession, servers: str, topic: str, max_offsets: int = 1_000_000) -> DataFrame:
    """The same rows from a topic, from the earliest offset. Needs the Kafka connector package."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
