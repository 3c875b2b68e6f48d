"""Preference formatting: the common turns of two conversations once as prompt, the rest as two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeta.llm.common import Scratch

#: Position given to a turn without a number: after all others.
LAST = (1 << 63) - 1


def rendered(role: Column, text: Column) -> Column:
    """One turn as text: a line with the role, the text, and an end mark."""
    return F.concat(
        F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n")
    )


def preference_segments(turns: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """Render pairs of conversations turn by turn.

    Takes ``pair_id, side`` (``chosen`` or ``rejected``; other sides do not count), ``turn, role, text`` (more columns
    are ignored) and returns ``pair_id, part, turn, role, segment, learn``. Parts are ``prompt`` (turns both sides begin
    with, once), ``chosen`` and ``rejected`` (each side from the first turn on that differs in number, role or text).
    ``learn`` is the loss mask of a segment: true for turns of ``learned_role`` in a completion. The text of a part is
    its segments in the order of turn, role, segment; this is the form that a conversation of any length can take, as no
    task ever holds one whole.

    Null roles and texts are equal to each other and rendered empty. A null turn comes last. Exact repeats of a turn are
    one turn; different rows under one number are all part of it. A pair with one side only, or with no common turn,
    has no prompt. Null pair_ids are a pair like any other. An empty table gives an empty result.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    pair = F.coalesce(F.col("pair_id").cast("string"), F.lit("")).alias("key")
    sides = turns.where(F.col("side").isin("chosen", "rejected")).select(
        pair,
        "pair_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        "role",
        "text",
        (F.col("side") == "chosen").alias("chosen"),
    )
    # one row per turn with the sides that have it; repeats go on the map side
    each = sides.groupBy("key", "pair_id", "turn", "role", "text").agg(
        F.max("chosen").alias("chosen"), F.max(~F.col("chosen")).alias("rejected")
    )
    each = scratch.table(each, "turns")
    first = each.where(~(F.col("chosen") & F.col("rejected"))).groupBy("key", F.col("pair_id").isNull().alias("none"))
    first = scratch.table(first.agg(F.min("turn").alias("cut")), "cuts").select(
        F.concat_ws(" ", F.col("none").cast("string"), "key").alias("name"), "cut"
    )
    named = each.withColumn("name", F.concat_ws(" ", F.col("pair_id").isNull().cast("string"), "key"))
    both = named.join(first, "name", "left")
    common = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    parts = F.when(common, F.array(F.lit("prompt"))).otherwise(
        F.filter(
            F.array(
                F.when(F.col("chosen"), "chosen").otherwise(""), F.when(F.col("rejected"), "rejected").otherwise("")
            ),
            lambda p: p != "",
        )
    )
    out = both.withColumn("part", F.explode(parts))
    return scratch.finish(
        out.select(
            "pair_id",
            "part",
            F.when(F.col("turn") < LAST, F.col("turn")).alias("turn"),
            "role",
            rendered(F.col("role"), F.col("text")).alias("segment"),
            ((F.col("part") != "prompt") & F.coalesce(F.col("role") == learned_role, F.lit(False))).alias("learn"),
        )
    )


def preference_examples(segments: DataFrame) -> DataFrame:
    """Segments put together for training: one row per pair with the prompt, both completions, and their masks.

    A mask is a list of ``[begin, end)`` character ranges to learn from. Only for conversations that fit in a row.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(LAST)).alias("turn"), "role", "segment", "learn")))
    parts = segments.groupBy("pair_id", "part").agg(ordered.alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["segment"]), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("ranges"))

    def step(state: Column, t: Column) -> Column:
        end = (state["at"] + F.length(t["segment"])).cast("int")
        ranges = F.when(t["learn"], F.concat(state["ranges"], F.array(F.array(state["at"], end)))).otherwise(state["ranges"])
        return F.struct(end.alias("at"), ranges.alias("ranges"))

    mask = F.aggregate("turns", start, step, lambda s: s["ranges"])
    done = parts.select("pair_id", "part", text.alias("text"), mask.alias("mask"))
    return done.groupBy("pair_id").agg(
        F.coalesce(F.max(F.when(F.col("part") == "prompt", F.col("text"))), F.lit("")).alias("prompt"),
        *(
            F.max(F.when(F.col("part") == side, F.col(c))).alias(f"{side}{suffix}")
            for side in ("chosen", "rejected")
            for c, suffix in (("text", ""), ("mask", "_mask"))
        ),
    )


def with_other_answers(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """Preference pairs from conversations alone: chosen is a conversation, rejected ends in another one's answer.

    The rejected side has the turns before the last one of ``role``, and then the last such turn of the partner:
    conversations 2k and 2k + 1 are each other's. A conversation without such a turn, or without a partner that has
    one, gives no pair. Returns ``pair_id`` (the conversation), ``side, turn, role, text``.
    """
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    last = turns.where(F.col("role") == role).groupBy("conv_id").agg(F.max("turn").alias("last"))
    known = turns.join(last.withColumnRenamed("conv_id", "_id"), F.col("conv_id") == F.col("_id")).drop("_id")
    partner = F.col("conv_id").bitwiseXOR(F.lit(1).cast("long"))
    answers = known.where((F.col("turn") == F.col("last")) & (F.col("role") == role))
    # one answer where a number is used twice
    answers = answers.groupBy(partner.alias("pair_id")).agg(F.max("text").alias("answer"))
    paired = known.join(answers, known["conv_id"] == answers["pair_id"]).drop("pair_id")
    chosen = paired.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    before = paired.where(F.col("turn") < F.col("last"))
    before = before.select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    ends = last.join(answers, last["conv_id"] == answers["pair_id"])
    ends = ends.select("pair_id", F.lit("rejected").alias("side"), F.col("last").alias("turn"), F.lit(role).alias("role"), F.col("answer").alias("text"))
    return chosen.unionByName(before).unionByName(ends)
