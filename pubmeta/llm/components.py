"""Connected components by hooking and contraction, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeta.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` for every id of ``edges(src, dst)``; component is the smallest id that can be reached.

    Each round hooks every component to its smallest neighbour, follows the hooks one step more, and rewrites the
    edges to component ids. Edges inside a component go. It ends when none is left; a star ends after one round.
    """
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    pair = scratch.table(pair.distinct(), "edges")
    labels = scratch.table(
        pair.select(F.col("a").alias("id")).union(pair.select("b")).distinct().withColumn("component", F.col("id")),
        "labels",
    )
    while not pair.isEmpty():
        up = pair.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        # follow two hooks: node -> up -> up of up
        above = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        hook = scratch.table(
            up.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("to")), "hooks"
        )
        labels = scratch.table(
            labels.join(hook, labels.component == hook.node, "left").select(
                "id", F.coalesce("to", "component").alias("component")
            ),
            "labels",
        )
        first, second = hook.toDF("a", "a_to"), hook.toDF("b", "b_to")
        moved = (
            pair.join(first, "a", "left")
            .join(second, "b", "left")
            .select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
            .where("a <> b")
        )
        pair = scratch.table(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels
