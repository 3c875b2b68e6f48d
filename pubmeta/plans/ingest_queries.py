"""Sources, sinks and upload ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeta.operators import ingest as I
from pubmeta.plans.base import Source, query
from pubmeta.sources import readers, sinks
from pubmeta.sources.keyed import write_keyed
from pubmeta.sources.workspace import new_folder

NOW = "TIMESTAMP '2026-01-01 00:00:00Z'"


def now():
    return F.expr(NOW)


PDF = "(lower(file_name) LIKE '%.pdf' AND lower(content_type) = 'application/pdf')"
REASON = f"CASE WHEN NOT {PDF} THEN 'Only PDF files are supported.' WHEN length = 0 THEN 'Uploaded file is empty.' END"
ACCEPTED = f"(SELECT * FROM uploads WHERE {PDF} AND length > 0)"
BASE = "regexp_replace(file_name, '^.*/', '')"
STEM = f"regexp_replace({BASE}, '\\.[^.]*$', '')"
TITLE = f"CASE WHEN title IS NULL OR trim(title) = '' THEN {STEM} ELSE trim(title) END"
SAFE = "replace(file_name, '/', '_')"
PID = "CAST(paper_id AS VARCHAR)"
KEY = f"'papers/pdf/' || {PID} || '/' || md5({PID} || '/' || file_name) || '-' || {SAFE}"


# --- sources ----------------------------------------------------------------


@query("src1_read_uploads", "SELECT paper_id, version_id, file_name, content_type, length, title FROM uploads")
def _(s: Source) -> DataFrame:
    path = new_folder(s.spark, "uploads")
    s.view("uploads").write.parquet(path)
    return readers.read_upload_manifest(s.spark, path)


@query("src1_read_upload_files")
def _(s: Source) -> DataFrame:
    return readers.read_uploads(s.spark, s.folder).select("file_name", "content_type", "length")


@query(
    "src1_uploaded_bytes",
    """SELECT CAST(n_nationkey AS BIGINT) AS upload, 'text/plain' AS content_type, CAST(octet_length(encode(line)) + 1 AS BIGINT) AS length,
         sha256(line || chr(10)) AS sha256
       FROM (SELECT n_nationkey, n_name || ' ' || CAST(n_regionkey AS VARCHAR) AS line FROM nation)""",
)
def _(s: Source) -> DataFrame:
    """Nations as uploaded text files, one each, read back with their bytes."""
    path = new_folder(s.spark, "uploaded")
    line = F.concat_ws(" ", "n_name", F.col("n_regionkey").cast("string")).alias("line")
    s.table("nation").select("n_nationkey", line).write.partitionBy("n_nationkey").text(path)
    files = readers.read_uploads(s.spark, path, with_bytes=True)
    return files.select(
        F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("bigint").alias("upload"),
        "content_type",
        "length",
        F.sha2("content", 256).alias("sha256"),
    )


@query(
    "src3_read_crossref",
    """SELECT '10.1000/p' || CAST(p_partkey AS VARCHAR) AS doi, 'CR ' || p_name AS title, '1-9' AS page, 3 AS authors FROM part""",
)
def _(s: Source) -> DataFrame:
    path = new_folder(s.spark, "works")
    s.view("crossref_json").select("value").write.option("compression", "gzip").text(path)
    works = readers.read_crossref(s.spark, path)
    return works.select(
        F.col("DOI").alias("doi"), F.element_at("title", 2).alias("title"), "page", F.size("author").alias("authors")
    )


@query("src4_read_table", "SELECT id, full_name, email, deleted, CAST(NULL AS VARCHAR) AS created_by FROM users")
def _(s: Source) -> DataFrame:
    root = new_folder(s.spark, "tables")
    s.view("users").write.parquet(f"{root}/users")
    return readers.read_table(s.spark, root, "users").select("id", "full_name", "email", "deleted", "created_by")


@query(
    "src6_read_ocr_pages",
    "SELECT doc_id, page_number, prediction, repeats, success FROM ocr_pages",
)
def _(s: Source) -> DataFrame:
    path = new_folder(s.spark, "pages")
    s.view("ocr_pages").write.parquet(path)
    return readers.read_ocr_pages(s.spark, path).select("doc_id", "page_number", "prediction", "repeats", "success")


# --- sinks ------------------------------------------------------------------


@query(
    "snk1_outbox_topic_rows",
    """SELECT id, key, payload AS value, topic, 'event-type' AS header, type AS header_value FROM outbox_messages""",
)
def _(s: Source) -> DataFrame:
    outbox = s.view("outbox_messages")
    header = sinks.topic_header()
    return outbox.select("id", *sinks.topic_columns()).select(
        "id",
        "key",
        "value",
        "topic",
        header["key"].alias("header"),
        F.decode(header["value"], "UTF-8").alias("header_value"),
    )


@query(
    "snk2_write_markdown",
    """SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS key, 0 AS part, text AS content FROM documents""",
)
def _(s: Source) -> DataFrame:
    path = new_folder(s.spark, "markdown")
    key = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    sinks.write_markdown(
        s.table("documents").select(key.alias("key"), F.lit(0).alias("part"), F.col("text").alias("content")), path
    )
    return s.spark.read.schema("key STRING, part INT, content STRING").parquet(path)


CHANGED = """
    SELECT id, upper(full_name) AS full_name, email, deleted FROM users WHERE deleted
    UNION ALL
    SELECT 's' || CAST(s_suppkey AS STRING), s_name, lower(s_name) || '@example.org', FALSE FROM supplier
"""


@query(
    "ing3_observed_rejections",
    f"""SELECT coalesce({REASON}, 'accepted') AS reason, count(*) AS rows FROM uploads GROUP BY 1""",
)
def _(s: Source) -> DataFrame:
    return I.write_judged(s.view("uploads"), new_folder(s.spark, "judged"))


def new_users(s: Source) -> DataFrame:
    return s.table("supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_name").alias("full_name"),
        F.concat(F.lower("s_name"), F.lit("@example.org")).alias("email"),
        F.lit(False).alias("deleted"),
    )


@query(
    "snk3_upsert_buckets",
    f"""WITH changed AS ({CHANGED})
        SELECT * FROM changed UNION ALL
        SELECT id, full_name, email, deleted FROM users u WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.id = u.id)""",
)
def _(s: Source) -> DataFrame:
    """The same upsert into a keyed table, twice over: only buckets that changes fall into are rewritten."""
    users = s.view("users")
    table = write_keyed(users, new_folder(s.spark, "users-keyed"), "id", 32)
    changed = users.where("deleted").withColumn("full_name", F.upper("full_name"))
    table.upsert(changed.unionByName(new_users(s)))
    table.upsert(new_users(s))
    return table.table()


@query(
    "snk3_upsert_table",
    f"""WITH changed AS ({CHANGED})
        SELECT * FROM changed UNION ALL
        SELECT id, full_name, email, deleted FROM users u WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.id = u.id)""",
)
def _(s: Source) -> DataFrame:
    users = s.view("users")
    changed = users.where("deleted").withColumn("full_name", F.upper("full_name"))
    added = new_users(s)
    root = new_folder(s.spark, "users")
    path = sinks.write_snapshot(sinks.upsert_table(users, changed.unionByName(added), "id"), root, 2)
    return s.spark.read.parquet(path)


@query(
    "snk4_to_response_json",
    """SELECT '{"paperId":' || CAST(paper_id AS VARCHAR) || ',' ||
         CASE WHEN publication_year IS NULL THEN '' ELSE '"publicationYear":' || CAST(publication_year AS VARCHAR) || ',' END ||
         '"extractionStatus":"Completed"' || CASE WHEN doi IS NULL THEN '' ELSE ',"doi":"' || doi || '"' END || '}' AS json
       FROM metadata_raw""",
)
def _(s: Source) -> DataFrame:
    rows = s.view("metadata_raw").select(
        "paper_id", "publication_year", F.lit("Completed").alias("extraction_status"), "doi"
    )
    return sinks.to_response_json(rows)


# --- ingest -----------------------------------------------------------------


@query("ing1_is_pdf", f"SELECT paper_id, {PDF} AS pdf FROM uploads")
def _(s: Source) -> DataFrame:
    return s.view("uploads").select(
        "paper_id", I.is_pdf(F.col("file_name"), F.col("content_type")).alias("pdf")
    )


@query(
    "ing2_reject_empty",
    "SELECT paper_id, CASE WHEN length = 0 THEN 'Uploaded file is empty.' END AS reason FROM uploads",
)
def _(s: Source) -> DataFrame:
    return s.view("uploads").select("paper_id", I.reject_empty(F.col("length")).alias("reason"))


@query("ing3_validate_uploads", f"SELECT paper_id, {REASON} AS reason FROM uploads")
def _(s: Source) -> DataFrame:
    accepted, rejected = I.validate_uploads(s.view("uploads"))
    return (
        accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected).select("paper_id", "reason")
    )


@query("ing4_paper_title", f"SELECT paper_id, {TITLE} AS title FROM uploads")
def _(s: Source) -> DataFrame:
    return s.view("uploads").select(
        "paper_id", I.paper_title(F.col("title"), F.col("file_name")).alias("title")
    )


@query("ing5_safe_name", f"SELECT paper_id, {SAFE} AS safe_name FROM uploads")
def _(s: Source) -> DataFrame:
    name = F.concat(F.lit("//"), F.replace("file_name", F.lit("/"), F.lit("/\x00")))
    return s.view("uploads").select("paper_id", I.safe_file_name(name).alias("safe_name"))


@query("ing6_pdf_key", f"SELECT paper_id, {KEY} AS pdf_key FROM uploads")
def _(s: Source) -> DataFrame:
    return s.view("uploads").select(
        "paper_id", I.pdf_key(F.col("paper_id"), F.col("file_name")).alias("pdf_key")
    )


@query(
    "ing7_markdown_key",
    f"""SELECT paper_id, 'papers/markdown/' || md5(CAST(version_id AS VARCHAR)) || '-' || {STEM} || '.md' AS markdown_key
        FROM uploads""",
)
def _(s: Source) -> DataFrame:
    return s.view("uploads").select(
        "paper_id", I.markdown_key(F.col("version_id"), F.col("file_name")).alias("markdown_key")
    )


@query(
    "ing8_build_version_rows",
    f"""SELECT version_id AS id, paper_id, 1 AS version_number, file_name AS original_file_name, {KEY} AS pdf_key,
          'Pending' AS conversion_status FROM {ACCEPTED}""",
)
def _(s: Source) -> DataFrame:
    accepted, _ = I.validate_uploads(s.view("uploads"))
    return I.build_version_rows(accepted).select(
        "id", "paper_id", "version_number", "original_file_name", "pdf_key", "conversion_status"
    )


@query(
    "ing9_metadata_placeholder",
    f"""SELECT paper_id, CAST(NULL AS VARCHAR) AS title, 0 AS keywords, 0 AS authors, 0 AS refs,
          'Pending' AS extraction_status FROM {ACCEPTED}""",
)
def _(s: Source) -> DataFrame:
    accepted, _ = I.validate_uploads(s.view("uploads"))
    return I.build_metadata_placeholder(accepted).select(
        "paper_id",
        "title",
        F.size("keywords").alias("keywords"),
        F.size("authors").alias("authors"),
        F.size("references").alias("refs"),
        "extraction_status",
    )


@query(
    "ing10_build_outbox_rows",
    f"""SELECT 'paper.uploaded.v1' AS topic, {PID} AS key, 'PaperUploadedIntegrationEvent' AS type,
          '{{"paperId":' || {PID} || ',"paperVersionId":' || CAST(version_id AS VARCHAR) || ',"pdfS3Key":"' || {KEY}
          || '","originalFileName":"' || file_name || '","uploadedAt":"2026-01-01T00:00:00.000Z"}}' AS payload,
          'Pending' AS status, 0 AS retry_count
        FROM {ACCEPTED}""",
)
def _(s: Source) -> DataFrame:
    accepted, _ = I.validate_uploads(s.view("uploads"))
    return I.build_outbox_rows(I.build_version_rows(accepted), now()).select(
        "topic", "key", "type", "payload", "status", "retry_count"
    )


@query(
    "ing11_ingest_batch",
    f"""SELECT paper_id, {TITLE} AS title, 1 AS versions, 1 AS placeholders, 1 AS messages,
          CAST(NULL AS VARCHAR) AS reason FROM {ACCEPTED}
        UNION ALL
        SELECT paper_id, title, 0, 0, 0, {REASON} FROM uploads WHERE NOT ({PDF} AND length > 0)""",
)
def _(s: Source) -> DataFrame:
    run = sinks.ingest_batch(s.view("uploads"), new_folder(s.spark, "ingest"), now())

    def tally(name: str, as_name: str) -> DataFrame:
        return run[name].groupBy("paper_id").agg(F.count(F.lit(1)).cast("int").alias(as_name))

    messages = run["outbox_messages"].groupBy(F.col("key").cast("bigint").alias("paper_id"))
    rows = (
        run["papers"]
        .select(F.col("id").alias("paper_id"), "title")
        .join(tally("paper_versions", "versions"), "paper_id", "left")
        .join(tally("paper_metadata", "placeholders"), "paper_id", "left")
        .join(messages.agg(F.count(F.lit(1)).cast("int").alias("messages")), "paper_id", "left")
        .withColumn("reason", F.lit(None).cast("string"))
    )
    zero = F.lit(0)
    rejected = run["rejected"].select(
        "paper_id", "title", zero.alias("versions"), zero.alias("placeholders"), zero.alias("messages"), "reason"
    )
    return rows.unionByName(rejected)


@query(
    "ing12_ingest_response",
    f"""SELECT paper_id, version_id AS paper_version_id, {TITLE} AS title, 1 AS version_number,
          file_name AS original_file_name, {KEY} AS pdf_key, 'Pending' AS conversion_status FROM {ACCEPTED}""",
)
def _(s: Source) -> DataFrame:
    accepted, _ = I.validate_uploads(s.view("uploads"))
    return I.ingest_response(I.build_papers(accepted), I.build_version_rows(accepted)).select(
        "paper_id", "paper_version_id", "title", "version_number", "original_file_name", "pdf_key", "conversion_status"
    )


@query(
    "ing13_audit_stamp",
    """SELECT id, CASE WHEN deleted THEN '2026-01-01' ELSE '2020-05-05' END AS created_on, '2026-01-01' AS updated_on,
         CASE WHEN deleted THEN 'job' ELSE 'seed' END AS created_by, 'job' AS updated_by FROM users""",
)
def _(s: Source) -> DataFrame:
    old = s.view("users").withColumns(
        {"created_at": F.expr("TIMESTAMP '2020-05-05 00:00:00Z'"), "created_by": F.lit("seed")}
    )
    stamped = I.audit_stamp(old, F.col("deleted"), now(), "job")

    def day(c: str):
        return F.date_format(F.to_utc_timestamp(F.col(c), F.current_timezone()), "yyyy-MM-dd")

    return stamped.select(
        "id", day("created_at").alias("created_on"), day("updated_at").alias("updated_on"), "created_by", "updated_by"
    )


@query(
    "ing14_soft_delete",
    """SELECT id, deleted OR id IN (SELECT user_id FROM user_roles WHERE role_id = 2) AS deleted FROM users""",
)
def _(s: Source) -> DataFrame:
    ids = s.view("user_roles").where("role_id = 2").select(F.col("user_id").alias("id"))
    return I.apply_soft_delete(s.view("users"), ids).select("id", "deleted")


@query("ing14_active", "SELECT id FROM users WHERE NOT deleted")
def _(s: Source) -> DataFrame:
    return I.active(s.view("users")).select("id")
