"""Table rules run in bulk: lengths, required values, uniqueness, parents, input format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pubmeta.functions.blank import is_blank
from pubmeta.schemas import CONVERSION_STATUSES, EXTRACTION_STATUSES, OUTBOX_STATUSES

# Longest text per column.
MAX_LENGTHS = {
    "users": {"id": 100, "full_name": 255},
    "roles": {"name": 100},
    "permissions": {"name": 100},
    "papers": {"title": 500},
    "paper_versions": {
        "original_file_name": 500,
        "pdf_key": 1024,
        "markdown_key": 1024,
        "conversion_status": 50,
        "conversion_error": 4000,
    },
    "paper_metadata": {
        "title": 500,
        "doi": 255,
        "journal": 500,
        "publisher": 500,
        "volume": 100,
        "issue": 100,
        "pages": 100,
        "corresponding_author": 500,
        "metadata_source": 100,
        "doi_source": 100,
        "journal_source": 100,
        "extraction_status": 50,
        "extraction_error": 4000,
    },
    "outbox_messages": {"topic": 255, "key": 255, "type": 500, "status": 50, "last_error": 4000},
}
# Columns that must be set.
REQUIRED = {
    "users": ("id", "full_name", "email"),
    "roles": ("id", "name"),
    "permissions": ("id", "name"),
    "papers": ("id", "title", "current_version"),
    "paper_versions": ("id", "paper_id", "version_number", "original_file_name", "pdf_key", "conversion_status"),
    "paper_metadata": ("id", "paper_id", "keywords", "authors", "references", "extraction_status"),
    "outbox_messages": ("id", "topic", "key", "type", "payload", "status", "retry_count"),
}
# Allowed values per status column.
DOMAINS = {
    "paper_versions": {"conversion_status": CONVERSION_STATUSES},
    "paper_metadata": {"extraction_status": EXTRACTION_STATUSES},
    "outbox_messages": {"status": OUTBOX_STATUSES},
}
# Unique keys.
UNIQUE_KEYS = {
    "users": ("email",),
    "roles": ("name",),
    "permissions": ("name",),
    "paper_versions": ("paper_id", "version_number"),
    "paper_metadata": ("paper_id",),
}
# Messages of the user input rules.
EMAIL_REQUIRED = "Email cannot be empty"
EMAIL_INVALID = "Invalid email format"
NAME_REQUIRED = "Full name cannot be empty"
NAME_TOO_LONG = "Full name cannot exceed 255 characters"
PASSWORD_REQUIRED = "Password cannot be empty"


def _violations(df: DataFrame, key: str, checks: list[Column]) -> DataFrame:
    """One pass over the table: each check is NULL or a struct describing a violation."""
    hits = F.array_compact(F.array(*checks))
    return df.select(F.col(key).alias("id"), F.explode(hits).alias("v")).select("id", "v.*")


def _too_long(df: DataFrame, table: str) -> list[tuple[str, int, Column]]:
    return [(c, limit, F.length(c) > limit) for c, limit in MAX_LENGTHS.get(table, {}).items() if c in df.columns]


def _not_as_required(df: DataFrame, table: str) -> list[tuple[str, str, Column]]:
    found = [(c, "missing", F.col(c).isNull()) for c in REQUIRED.get(table, ()) if c in df.columns]
    domains = DOMAINS.get(table, {}).items()
    return found + [(c, "not allowed", ~F.col(c).isin(*allowed)) for c, allowed in domains if c in df.columns]


def length_violations(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    """``(id, column, length, max_length)`` for every text longer than its column allows."""
    checks = [
        F.when(
            broken,
            F.struct(
                F.lit(name).alias("column"), F.length(name).alias("length"), F.lit(limit).alias("max_length")
            ),
        )
        for name, limit, broken in _too_long(df, table)
    ]
    return _violations(df, key, checks)


def required_violations(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    """``(id, column, problem)`` for missing required values and statuses out of their domain."""
    checks = [
        F.when(broken, F.struct(F.lit(name).alias("column"), F.lit(problem).alias("problem")))
        for name, problem, broken in _not_as_required(df, table)
    ]
    return _violations(df, key, checks)


def write_observed(
    df: DataFrame, path: str, conditions: dict[tuple[str, str], Column], mode: str = "overwrite"
) -> DataFrame:
    """Write a batch and count the rows that meet each condition while it is written: ``(column, problem, rows)``.

    The counts are taken as the rows pass on their way to the files, so nothing is read or computed twice, and they
    are of what was written. A last row, ``* / rows``, counts all rows.
    """
    names = list(conditions)
    counts = [F.count_if(F.coalesce(conditions[n], F.lit(False))).alias(f"c{i}") for i, n in enumerate(names)]
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.mode(mode).parquet(path)
    found = seen.get
    rows = [(*n, int(found[f"c{i}"])) for i, n in enumerate(names)] + [("*", "rows", int(found["rows"]))]
    return df.sparkSession.createDataFrame(rows, "column STRING, problem STRING, rows BIGINT")


def write_checked(df: DataFrame, table: str, path: str, mode: str = "overwrite") -> DataFrame:
    """Write rows of a table and count, on the way, what the length and value rules find in them."""
    conditions = {(c, "too long"): broken for c, _, broken in _too_long(df, table)}
    conditions |= {(c, problem): broken for c, problem, broken in _not_as_required(df, table)}
    return write_observed(df, path, conditions, mode)


def unique_violations(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys held by more than one row, with their row count. NULL keys never collide."""
    present = df.dropna(subset=list(keys))
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def current_version_mismatch(papers: DataFrame, versions: DataFrame) -> DataFrame:
    """Papers whose ``current_version`` is not their newest version number."""
    newest = versions.groupBy(F.col("paper_id").alias("id")).agg(F.max("version_number").alias("newest_version"))
    joined = papers.select("id", "current_version").join(newest, "id", "left")
    return joined.where(~F.col("current_version").eqNullSafe(F.coalesce("newest_version", F.lit(0))))


def orphans(child: DataFrame, parent: DataFrame, foreign_key: str, parent_key: str = "id") -> DataFrame:
    """Child rows with a foreign key that no parent row has."""
    keys = parent.select(F.col(parent_key).alias(foreign_key))
    return child.where(F.col(foreign_key).isNotNull()).join(keys, foreign_key, "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, foreign_key: str, parent_key: str = "id") -> DataFrame:
    """Child rows left after their parents are removed."""
    return child.join(deleted.select(F.col(parent_key).alias(foreign_key)), foreign_key, "left_anti")


def email_format(email: Column) -> Column:
    """Exactly one ``@``, neither first nor last, no line break."""
    return F.coalesce(email.rlike(r"\A[^@\r\n]+@[^@\r\n]+\z"), F.lit(False))


def user_input_errors(df: DataFrame, key: str = "id", with_password: bool = False) -> DataFrame:
    """``(id, message)`` for each broken input rule of a registration."""

    def found(condition: Column, message: str) -> Column:
        return F.when(condition, F.struct(F.lit(message).alias("message")))

    email, name = F.col("email"), F.col("full_name")
    checks = [
        found(is_blank(email), EMAIL_REQUIRED),
        found(email.isNotNull() & ~email_format(email), EMAIL_INVALID),
        found(is_blank(name), NAME_REQUIRED),
        found(F.length(name) > 255, NAME_TOO_LONG),
    ]
    if with_password:
        checks.append(found(is_blank(F.col("password")), PASSWORD_REQUIRED))
    return _violations(df, key, checks)
