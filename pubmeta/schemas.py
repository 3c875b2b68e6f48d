"""Table schemas (as DDL text, which needs no session) and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T


def struct_type(ddl: str) -> T.StructType:
    """DDL text as a type object; needs an active session."""
    return T.StructType.fromDDL(ddl)


AUTHOR_DDL = (
    "first_name STRING, middle_name STRING, last_name STRING, "
    "full_name STRING, email STRING, affiliation STRING"
)
REFERENCE_DDL = (
    f"title STRING, authors ARRAY<STRUCT<{AUTHOR_DDL}>>, journal STRING, publisher STRING, "
    "publication_year INT, volume STRING, issue STRING, pages STRING, raw_text STRING, doi STRING"
)

AUDIT_DDL = "created_at TIMESTAMP, updated_at TIMESTAMP, deleted BOOLEAN, created_by STRING, updated_by STRING"

# Bibliographic fields in the order of the metadata table.
METADATA_FIELDS_DDL = (
    "title STRING, abstract STRING, doi STRING, arxiv_id STRING, journal STRING, publisher STRING, "
    "venue STRING, conference_name STRING, publication_year INT, volume STRING, issue STRING, pages STRING, "
    "corresponding_author STRING, metadata_source STRING, doi_source STRING, journal_source STRING, "
    f"keywords ARRAY<STRING>, authors ARRAY<STRUCT<{AUTHOR_DDL}>>, references ARRAY<STRUCT<{REFERENCE_DDL}>>"
)

TABLES: dict[str, str] = {
    "papers": f"id BIGINT, title STRING, current_version INT, {AUDIT_DDL}",
    "paper_versions": ("id BIGINT, paper_id BIGINT, version_number INT, original_file_name STRING, pdf_key STRING, "
        "markdown_key STRING, conversion_status STRING, converted_at TIMESTAMP, conversion_error STRING, "
        f"{AUDIT_DDL}"),
    "paper_metadata": (f"id BIGINT, paper_id BIGINT, {METADATA_FIELDS_DDL}, raw_tei STRING, extraction_status STRING, "
        f"extraction_error STRING, extracted_at TIMESTAMP, {AUDIT_DDL}"),
    "outbox_messages": ("id BIGINT, topic STRING, key STRING, type STRING, payload STRING, status STRING, retry_count INT, "
        f"last_error STRING, published_at TIMESTAMP, {AUDIT_DDL}"),
    "users": f"id STRING, full_name STRING, email STRING, {AUDIT_DDL}",
    "roles": f"id BIGINT, name STRING, description STRING, {AUDIT_DDL}",
    "permissions": f"id BIGINT, name STRING, description STRING, {AUDIT_DDL}",
    "user_roles": "role_id BIGINT, user_id STRING",
    "role_permissions": "permission_id BIGINT, role_id BIGINT",
    "ocr_pages": ("doc_id BIGINT, page_number INT, prediction STRING, repeats INT, markdown STRING, "
        "success BOOLEAN, error STRING, attempts INT"),
}

TEI_DOCS_DDL = "doc_id BIGINT, xml STRING"

_DATE_PARTS = "STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>"
CROSSREF_WORK_DDL = (
    "title ARRAY<STRING>, abstract STRING, DOI STRING, `container-title` ARRAY<STRING>, "
    f"`short-container-title` ARRAY<STRING>, publisher STRING, issued {_DATE_PARTS}, "
    f"`published-print` {_DATE_PARTS}, `published-online` {_DATE_PARTS}, published {_DATE_PARTS}, "
    "volume STRING, issue STRING, page STRING, "
    "author ARRAY<STRUCT<given: STRING, family: STRING, name: STRING, affiliation: ARRAY<STRUCT<name: STRING>>>>"
)

# The projected bibliographic record joined onto extracted metadata.
CROSSREF_RECORD_DDL = (
    "doi STRING, title STRING, abstract STRING, journal STRING, publisher STRING, publication_year INT, "
    f"volume STRING, issue STRING, pages STRING, authors ARRAY<STRUCT<{AUTHOR_DDL}>>"
)

# Kafka-shaped rows, used by every event source and sink.
EVENT_ROWS_DDL = "key STRING, value STRING"

# Statuses and the event contract.
PENDING, PROCESSING, COMPLETED, FAILED, PUBLISHED = "Pending", "Processing", "Completed", "Failed", "Published"
CONVERSION_STATUSES = (PENDING, PROCESSING, COMPLETED, FAILED)
EXTRACTION_STATUSES = (PENDING, PROCESSING, COMPLETED, FAILED)
OUTBOX_STATUSES = (PENDING, PROCESSING, PUBLISHED, FAILED)
UPLOAD_TOPIC = "paper.uploaded.v1"
UPLOAD_EVENT_TYPE = "PaperUploadedIntegrationEvent"

# Messages.
INVALID_PDF = "Only PDF files are supported."
EMPTY_FILE = "Uploaded file is empty."
PAPER_NOT_FOUND = "Paper was not found."
METADATA_NOT_FOUND = "Paper metadata was not found."
INVALID_TEI = "GROBID service returned an invalid response."
EMPTY_PDF = "Uploaded PDF is empty."
EMPTY_MARKDOWN = "Nougat returned empty markdown."
ROLE_NOT_FOUND = "Role not found"
ROLE_EXISTS = "Role already exists"
ROLE_NAME_REQUIRED = "Role name is required"
ADMIN_ROLE_KEPT = "ADMIN role cannot be deleted"
PERMISSION_NOT_FOUND = "Permission not found: "
USER_NOT_FOUND = "User not found"
EMAIL_EXISTS = "Email already exists"
USER_ID_REQUIRED = "User id must be Cognito sub"

# Longest error text a table keeps.
# Length that a quality check reports as too long; texts are stored whole.
MAX_ERROR_LENGTH = 4000
