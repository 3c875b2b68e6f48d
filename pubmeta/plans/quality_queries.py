"""Table rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeta.operators import quality as Q
from pubmeta.plans.base import Source, query
from pubmeta.sources.workspace import new_folder


@query(
    "q1_length_violations",
    """SELECT doc_id AS id, 'title' AS "column", CAST(length(text) AS INTEGER) AS length, 500 AS max_length
       FROM documents WHERE length(text) > 500
       UNION ALL
       SELECT doc_id, 'corresponding_author', CAST(length(text) + length(source) AS INTEGER), 500
       FROM documents WHERE length(text) + length(source) > 500
       UNION ALL
       SELECT doc_id, 'doi', CAST(length(text) AS INTEGER), 255 FROM documents WHERE length(text) > 255""",
)
def _(s: Source) -> DataFrame:
    rows = s.table("documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("title"),
        F.col("text").alias("doi"),
        F.concat("text", "source").alias("corresponding_author"),
    )
    return Q.length_violations(rows, "paper_metadata")


STATUSES = """
    SELECT event_id AS id, CASE WHEN event_type = 'view' THEN NULL ELSE 'topic' END AS topic, 'k' AS key, 't' AS type,
      CASE WHEN value > 50 THEN NULL ELSE props END AS payload, 1 AS retry_count,
      CASE event_type WHEN 'signup' THEN NULL WHEN 'click' THEN 'Processing' WHEN 'error' THEN 'failed' ELSE 'Pending' END AS status
    FROM {events}
"""


@query(
    "q2_required_violations",
    f"""WITH t AS ({STATUSES.format(events='events')})
        SELECT id, 'topic' AS "column", 'missing' AS problem FROM t WHERE topic IS NULL
        UNION ALL SELECT id, 'payload', 'missing' FROM t WHERE payload IS NULL
        UNION ALL SELECT id, 'status', 'missing' FROM t WHERE status IS NULL
        UNION ALL SELECT id, 'status', 'not allowed' FROM t
          WHERE status NOT IN ('Pending', 'Processing', 'Published', 'Failed')""",
)
def _(s: Source) -> DataFrame:
    return Q.required_violations(s.sql(STATUSES), "outbox_messages")


@query(
    "q2_observed_on_write",
    f"""WITH t AS ({STATUSES.format(events='events')})
        SELECT 'id' AS "column", 'missing' AS problem, count_if(id IS NULL) AS rows FROM t
        UNION ALL SELECT 'topic', 'missing', count_if(topic IS NULL) FROM t
        UNION ALL SELECT 'payload', 'missing', count_if(payload IS NULL) FROM t
        UNION ALL SELECT 'status', 'missing', count_if(status IS NULL) FROM t
        UNION ALL SELECT 'status', 'not allowed', count_if(status NOT IN ('Pending', 'Processing', 'Published', 'Failed')) FROM t
        UNION ALL SELECT '*', 'rows', count(*) FROM t""",
)
def _(s: Source) -> DataFrame:
    """The value rules counted while the batch is written."""
    names = ["id", "topic", "payload", "status", "*"]
    counts = Q.write_checked(s.sql(STATUSES), "outbox_messages", new_folder(s.spark, "checked"))
    return counts.where(F.col("column").isin(names) & (F.col("problem") != "too long")).select(
        "column", "problem", F.col("rows").cast("bigint").alias("rows")
    )


@query(
    "q3_unique_violations",
    """SELECT paper_id, version_number, count(*) AS rows FROM paper_versions
       GROUP BY paper_id, version_number HAVING count(*) > 1""",
)
def _(s: Source) -> DataFrame:
    return Q.unique_violations(s.view("paper_versions"), Q.UNIQUE_KEYS["paper_versions"])


PAPERS = "SELECT user_id AS id, CAST(max(event_id % 3) + min(event_id % 2) AS INT) AS current_version FROM {events} GROUP BY user_id"


@query(
    "q4_current_version_mismatch",
    f"""SELECT p.id, p.current_version, v.newest_version FROM ({PAPERS.format(events='events')}) p
        LEFT JOIN (SELECT paper_id, max(version_number) AS newest_version FROM paper_versions GROUP BY paper_id) v
          ON v.paper_id = p.id
        WHERE p.current_version IS DISTINCT FROM coalesce(v.newest_version, 0)""",
)
def _(s: Source) -> DataFrame:
    return Q.current_version_mismatch(s.sql(PAPERS), s.view("paper_versions"))


@query(
    "q5_orphans",
    """SELECT user_id, role_id FROM user_roles
       WHERE user_id NOT IN (SELECT id FROM users WHERE NOT deleted)""",
)
def _(s: Source) -> DataFrame:
    return Q.orphans(s.view("user_roles"), s.view("users").where("NOT deleted"), "user_id").select("user_id", "role_id")


@query(
    "q5_cascade_delete",
    """SELECT user_id, role_id FROM user_roles WHERE user_id NOT IN (SELECT id FROM users WHERE deleted)""",
)
def _(s: Source) -> DataFrame:
    left = Q.cascade_delete(s.view("user_roles"), s.view("users").where("deleted"), "user_id")
    return left.select("user_id", "role_id")


REGISTRATIONS = """
    SELECT c_custkey AS id,
      CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'a@b@c' WHEN 'MACHINERY' THEN '@' || c_name WHEN 'BUILDING' THEN NULL
        ELSE c_name || '@x' END AS email,
      CASE WHEN c_acctbal < 0 THEN ' ' WHEN c_acctbal > 9000 THEN repeat(c_name, 20) ELSE c_name END AS full_name
    FROM {customer}
"""


@query(
    "q6_user_input_errors",
    f"""WITH r AS ({REGISTRATIONS.format(customer='customer')})
        SELECT id, 'Email cannot be empty' AS message FROM r WHERE email IS NULL
        UNION ALL SELECT id, 'Invalid email format' FROM r WHERE NOT regexp_full_match(email, '[^@]+@[^@]+')
        UNION ALL SELECT id, 'Full name cannot be empty' FROM r WHERE trim(full_name) = ''
        UNION ALL SELECT id, 'Full name cannot exceed 255 characters' FROM r WHERE length(full_name) > 255""",
)
def _(s: Source) -> DataFrame:
    return Q.user_input_errors(s.sql(REGISTRATIONS))
