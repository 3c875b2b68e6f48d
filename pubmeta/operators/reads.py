"""Point and bulk reads over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeta.functions.collections import parse_json_or_empty
from pubmeta.operators.access import page, roles_with_permissions, users_with_roles
from pubmeta.schemas import METADATA_NOT_FOUND, PAPER_NOT_FOUND, struct_type


def decode_lists(metadata: DataFrame, lists: dict[str, str]) -> DataFrame:
    """JSON text columns to arrays: ``{column: element type}``; bad JSON reads as an empty list."""
    element = {name: struct_type(f"e {ddl}")["e"].dataType for name, ddl in lists.items()}
    return metadata.withColumns({name: parse_json_or_empty(F.col(name), dtype) for name, dtype in element.items()})


def get_metadata(paper_ids: DataFrame, papers: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata of each asked ``paper_id`` with ``error`` for an unknown paper or missing record."""
    known = papers.select(F.col("id").alias("paper_id"), F.lit(True).alias("_paper"))
    record = metadata.withColumn("_record", F.lit(True))
    error = F.when(F.col("_paper").isNull(), PAPER_NOT_FOUND).when(F.col("_record").isNull(), METADATA_NOT_FOUND)
    joined = paper_ids.select("paper_id").join(known, "paper_id", "left").join(record, "paper_id", "left")
    return joined.withColumn("error", error).drop("_paper", "_record")


def find_roles(roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame, condition: Column) -> DataFrame:
    """Roles by id or name, deleted ones included. The filter runs before the joins."""
    return roles_with_permissions(roles.where(condition), role_permissions, permissions)


def find_users(
    users: DataFrame,
    user_role: DataFrame,
    roles: DataFrame,
    role_permissions: DataFrame,
    permissions: DataFrame,
    condition: Column,
) -> DataFrame:
    """Users by id or address, deleted ones included, with nested roles."""
    return users_with_roles(users.where(condition), user_role, roles, role_permissions, permissions)


def list_roles(
    roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame, number: int, size: int
) -> DataFrame:
    """One page of roles, deleted ones included; only that page is joined."""
    return roles_with_permissions(page(roles, number, size), role_permissions, permissions)


def list_users(
    users: DataFrame,
    user_role: DataFrame,
    roles: DataFrame,
    role_permissions: DataFrame,
    permissions: DataFrame,
    number: int,
    size: int,
) -> DataFrame:
    """One page of users who are not deleted; only that page is joined."""
    chosen = page(users.where(~F.col("deleted")), number, size)
    return users_with_roles(chosen, user_role, roles, role_permissions, permissions)
