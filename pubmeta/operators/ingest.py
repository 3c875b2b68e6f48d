"""Upload batches: validation and the rows one upload creates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeta.functions.blank import is_blank
from pubmeta.functions.text import file_stem, safe_file_name, trim_all
from pubmeta.operators.quality import write_observed
from pubmeta.schemas import (
    AUTHOR_DDL,
    EMPTY_FILE,
    INVALID_PDF,
    METADATA_FIELDS_DDL,
    PENDING,
    REFERENCE_DDL,
    UPLOAD_EVENT_TYPE,
    UPLOAD_TOPIC,
    struct_type,
)


def is_pdf(file_name: Column, content_type: Column) -> Column:
    named = F.lower(file_name).endswith(".pdf")
    return F.coalesce(named & (F.lower(content_type) == "application/pdf"), F.lit(False))


def reject_empty(length: Column) -> Column:
    return F.when(length == 0, F.lit(EMPTY_FILE))


def rejection_reason(file_name: Column, content_type: Column, length: Column) -> Column:
    """First failed check, PDF before emptiness; NULL for an accepted upload."""
    return F.when(~is_pdf(file_name, content_type), F.lit(INVALID_PDF)).otherwise(reject_empty(length))


def with_reason(uploads: DataFrame) -> DataFrame:
    return uploads.withColumn(
        "reason", rejection_reason(F.col("file_name"), F.col("content_type"), F.col("length"))
    )


def validate_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; rejected rows keep their ``reason``."""
    checked = with_reason(uploads)
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def write_judged(uploads: DataFrame, path: str) -> DataFrame:
    """Write uploads with their ``reason`` and count the accepted and rejected ones on the way: ``(reason, rows)``."""
    judged = with_reason(uploads)
    conditions = {("reason", r): F.col("reason") == r for r in (INVALID_PDF, EMPTY_FILE)}
    conditions[("reason", "accepted")] = F.col("reason").isNull()
    counts = write_observed(judged, path, conditions)
    return counts.where(F.col("column") == "reason").select(F.col("problem").alias("reason"), "rows")


def paper_title(title: Column, file_name: Column) -> Column:
    return F.when(is_blank(title), file_stem(file_name)).otherwise(trim_all(title))


def pdf_key(paper_id: Column, file_name: Column) -> Column:
    """Storage key of the PDF. The token is a hash of its inputs, so a rerun gives the same key."""
    pid = paper_id.cast("string")
    token = F.md5(F.concat_ws("/", pid, file_name))
    return F.concat(F.lit("papers/pdf/"), pid, F.lit("/"), token, F.lit("-"), safe_file_name(file_name))


def markdown_key(version_id: Column, file_name: Column) -> Column:
    token = F.md5(version_id.cast("string"))
    stem = safe_file_name(file_stem(file_name))
    return F.concat(F.lit("papers/markdown/"), token, F.lit("-"), stem, F.lit(".md"))


def audit_stamp(df: DataFrame, is_new: Column | bool, now: Column, actor: str | None = None) -> DataFrame:
    """Creation and update times for new rows, only the update time for changed ones."""
    new = is_new if isinstance(is_new, Column) else F.lit(is_new)
    have = set(df.columns)

    def kept(name: str, dtype: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(dtype)

    return df.withColumns(
        {
            "created_at": F.when(new, now).otherwise(kept("created_at", "timestamp")),
            "updated_at": now,
            "deleted": F.coalesce(kept("deleted", "boolean"), F.lit(False)),
            "created_by": F.when(new, F.lit(actor)).otherwise(kept("created_by", "string")),
            "updated_by": F.lit(actor).cast("string"),
        }
    )


def apply_soft_delete(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Set ``deleted`` on the listed ids; all other rows stay as they are."""
    hits = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    flag = F.when(F.col("_hit"), F.lit(True)).otherwise(F.col("deleted"))
    return df.join(hits, key, "left").withColumn("deleted", flag).drop("_hit")


def active(df: DataFrame) -> DataFrame:
    return df.where(~F.col("deleted"))


def build_papers(accepted: DataFrame) -> DataFrame:
    return accepted.select(
        F.col("paper_id").alias("id"),
        paper_title(F.col("title"), F.col("file_name")).alias("title"),
        F.lit(1).alias("current_version"),
    )


def build_version_rows(accepted: DataFrame) -> DataFrame:
    """First version of each paper. The version id arrives as ``version_id``."""
    return accepted.select(
        F.col("version_id").alias("id"),
        "paper_id",
        F.lit(1).alias("version_number"),
        F.col("file_name").alias("original_file_name"),
        pdf_key(F.col("paper_id"), F.col("file_name")).alias("pdf_key"),
        F.lit(None).cast("string").alias("markdown_key"),
        F.lit(PENDING).alias("conversion_status"),
        F.lit(None).cast("timestamp").alias("converted_at"),
        F.lit(None).cast("string").alias("conversion_error"),
    )


def build_metadata_placeholder(accepted: DataFrame) -> DataFrame:
    """One Pending metadata row per paper with empty lists."""
    empty = {
        "keywords": F.array().cast("array<string>"),
        "authors": F.array().cast(f"array<struct<{AUTHOR_DDL}>>"),
        "references": F.array().cast(f"array<struct<{REFERENCE_DDL}>>"),
    }
    columns = [
        empty.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in struct_type(METADATA_FIELDS_DDL)
    ]
    return accepted.select(
        F.col("paper_id").alias("id"),
        "paper_id",
        *columns,
        F.lit(None).cast("string").alias("raw_tei"),
        F.lit(PENDING).alias("extraction_status"),
        F.lit(None).cast("string").alias("extraction_error"),
        F.lit(None).cast("timestamp").alias("extracted_at"),
    )


def build_outbox_rows(versions: DataFrame, now: Column, topic: str = UPLOAD_TOPIC) -> DataFrame:
    """One Pending upload event per version; NULL payload fields are written."""
    payload = F.struct(
        F.col("paper_id").alias("paperId"),
        F.col("id").alias("paperVersionId"),
        F.col("pdf_key").alias("pdfS3Key"),
        F.col("original_file_name").alias("originalFileName"),
        now.alias("uploadedAt"),
    )
    return versions.select(
        "id",
        F.lit(topic).alias("topic"),
        F.col("paper_id").cast("string").alias("key"),
        F.lit(UPLOAD_EVENT_TYPE).alias("type"),
        F.to_json(payload, {"ignoreNullFields": "false", "timeZone": "UTC"}).alias("payload"),
        F.lit(PENDING).alias("status"),
        F.lit(0).alias("retry_count"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(None).cast("timestamp").alias("published_at"),
    )


def ingest_frames(uploads: DataFrame, now: Column, topic: str = UPLOAD_TOPIC) -> dict[str, DataFrame]:
    """All row sets of one upload batch, derived from one validated frame."""
    accepted, rejected = validate_uploads(uploads)
    versions = build_version_rows(accepted)
    frames = {
        "papers": build_papers(accepted),
        "paper_versions": versions,
        "paper_metadata": build_metadata_placeholder(accepted),
        "outbox_messages": build_outbox_rows(versions, now, topic),
    }
    stamped = {name: audit_stamp(df, True, now) for name, df in frames.items()}
    return stamped | {"rejected": rejected}


def ingest_response(papers: DataFrame, versions: DataFrame) -> DataFrame:
    """What the uploader gets back: paper and version in one row."""
    v = versions.select(
        F.col("id").alias("paper_version_id"),
        "paper_id",
        "version_number",
        "original_file_name",
        "pdf_key",
        "markdown_key",
        "conversion_status",
        "converted_at",
        "conversion_error",
    )
    return papers.select(F.col("id").alias("paper_id"), "title").join(v, "paper_id")
