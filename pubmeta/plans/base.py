"""Query registry: a Spark plan and, where SQL can say the same, its check query."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pubmeta.plans.fixtures import VIEWS

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Source:
    """Tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        """SQL with ``{table}`` placeholders over the Parquet files."""
        return self.spark.sql(text.format(**{t: f"parquet.`{self.path(t)}`" for t in TABLES}))


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Source], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a builder; ``oracle`` may use tables and views by name."""

    def register(build: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, None if oracle is None else with_views(oracle))
        return build

    return register


def with_views(sql: str) -> str:
    """Prefix the views a check query uses as common table expressions."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES}).strip()})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
