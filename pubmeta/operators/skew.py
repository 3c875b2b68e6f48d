"""Lookup of per-key facts by rows of which very many may share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a task may get before the key is split.
HOT_ROWS = 1_000_000


def lookup_facts(
    rows: DataFrame, facts: DataFrame, key: str, row_id: str, weight: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join of ``rows`` to ``facts``, which has one row per key and its row count ``weight``.

    A key with more than ``hot_rows`` rows is spread over as many salts as it
    has multiples of that, and its facts are repeated once per salt. Rows without
    a key match nothing and get salts of their own. There are at most
    (rows / ``hot_rows``) hot keys; Spark broadcasts them if they are small.
    """
    salts = F.ceil(F.col(weight) / hot_rows).cast("int")
    hot = facts.where(F.col(weight) > hot_rows).select(key, salts.alias("_salts"))
    spread = F.pmod(F.xxhash64(row_id), F.col("_salts")).cast("int")
    alone = F.pmod(F.xxhash64(row_id), F.lit(1 << 30)).cast("int")
    salt = F.when(F.col(key).isNull(), alone).otherwise(F.coalesce(spread, F.lit(0)))
    left = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)).alias("_salt")
    right = facts.select("*", copies).drop(weight)
    return left.join(right, [key, "_salt"], "left").drop("_salt")
