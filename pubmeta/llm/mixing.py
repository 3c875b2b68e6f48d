"""Mix sources to target weights: shares by weight, and subset sums over exact lengths to meet them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubmeta.llm.common import Scratch, free_names, n_words

#: A document is taken at most so often, and a source at most so many times its size.
MOST = 3
WEIGHTS = (1, 2, 3)
#: Words left for the dynamic programme, which runs over sums up to twice this. A document longer than what is left
#: can only be nearest by itself, so it is compared apart.
WINDOW = 1 << 15


def target_shares(sizes: dict, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict:
    """Target per source: the total by weight, cut at ``most`` times the size, the excess shared out again.

    Sources go by code point, null last, and take the weights in turn.
    """
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in (s for s in names if s in full):  # in one order, as floating sums depend on it
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the words come nearest to the budget, from below on a tie.

    Every length first gives its share of the budget, rounded down, and then the longest that fit are added until less
    than WINDOW is left. What is left is a bounded knapsack over the documents not yet taken of at most that length:
    each length is split into packets of 1, 2, 4, ... documents, the reachable sums are bits of one integer, and the
    nearest reachable sum is traced back. If the shortest longer document overshoots by less, it is taken instead.
    """
    total = int((lengths * counts).sum())
    taken = (counts * min(budget, total) // max(total, 1)).astype(np.int64)
    left = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths):
        if left <= WINDOW or lengths[i] == 0:
            break
        more = min(int(counts[i] - taken[i]), left // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    packets: list[tuple[int, int, int]] = []
    for i in np.flatnonzero((counts > taken) & (lengths > 0) & (lengths <= max(left, 1))):
        free, k = min(int(counts[i] - taken[i]), left // max(int(lengths[i]), 1) + 1), 1
        while free > 0:
            packets.append((int(i), min(k, free), int(lengths[i]) * min(k, free)))
            free, k = free - k, k * 2
    mask = (1 << (2 * left + 1)) - 1
    reached = [1]
    for _, _, words in packets:
        reached.append((reached[-1] | reached[-1] << words) & mask)
        if reached[-1] >> left & 1:
            break
    sums = [s for d in range(left + 1) for s in (left - d, left + d) if reached[-1] >> s & 1][:1]
    goal = sums[0] if sums else 0
    longer = np.flatnonzero((counts > taken) & (lengths > left))
    if left > 0 and len(longer):
        i = longer[np.argmin(lengths[longer])]
        if int(lengths[i]) - left < abs(left - goal):
            taken[i] += 1
            return taken
    for (i, k, words), before in zip(packets[: len(reached) - 1][::-1], reached[:-1][::-1], strict=True):
        if not before >> goal & 1:
            taken[i] += k
            goal -= words
    return taken


def _fit_source(targets: dict, sizes: dict):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        # the fit depends on the order of lengths, and rows arrive in any order
        cells = cells.sort_values("size", kind="stable")
        source = cells["source"].iloc[0]
        source = None if pd.isna(source) else source
        size, target = sizes[source], targets[source]
        whole = int(min(MOST, target // size)) if size else 0
        budget = round(target) - whole * size
        extra = np.zeros(len(cells), np.int64)
        if whole < MOST and budget > 0:
            extra = fit_lengths(cells["size"].to_numpy(np.int64), cells["rows"].to_numpy(np.int64), budget)
        return cells.assign(whole=whole, extra=extra)[["source", "size", "rows", "whole", "extra"]]

    return run


def _hash(seed: int, *columns: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _name(source: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def _order(seed: int) -> Column:
    return _hash(seed, F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def _taken_classes(light: DataFrame, scratch: Scratch, seed: int) -> tuple[DataFrame, dict, dict]:
    """How often each class of rows with the same source, id and text is taken; sizes and targets of the sources.

    ``name, size, order, rows, whole, extra``: all of its rows go ``whole`` times, and ``extra`` of them once more.
    """
    cells = light.groupBy("source", "size").agg(F.count("*").alias("rows"))
    sizes = {
        r["source"]: int(r["words"])
        for r in cells.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words")).collect()
    }
    targets = target_shares(sizes)
    fitted = scratch.table(
        cells.groupBy("source").applyInPandas(
            _fit_source(targets, sizes), "source string, size long, rows long, whole int, extra long"
        ),
        "fitted",
    )
    decided = fitted.select(
        _name("source").alias("name"),
        "size",
        "whole",
        F.col("extra").alias("wanted"),
        F.ceil(F.sqrt("rows")).cast("long").alias("cuts"),
    )
    classes = light.groupBy(_name("source").alias("name"), "size", "order").agg(F.count("*").alias("rows"))
    # the cut is one more scramble of the order, so that parts are of like size
    keyed = classes.join(decided, ["name", "size"]).withColumn("cut", F.pmod(_hash(seed + 1, "order"), "cuts"))
    keyed = scratch.table(keyed.drop("cuts"), "keyed")
    parts = keyed.where("wanted > 0").groupBy("name", "size", "cut", "wanted").agg(F.sum("rows").alias("rows"))
    sofar = Window.partitionBy("name", "size").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(sofar), F.lit(0)))
    quota = scratch.table(
        parts.select(
            "name", "size", "cut", F.greatest(F.lit(0), F.least("rows", F.col("wanted") - F.col("before"))).alias("quota")
        ),
        "quota",
    )
    within = Window.partitionBy("name", "size", "cut").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(quota, ["name", "size", "cut"], "left").withColumn(
        "sofar", F.coalesce(F.sum("rows").over(within), F.lit(0))
    )
    extra = F.greatest(F.lit(0), F.least("rows", F.coalesce("quota", F.lit(0)) - F.col("sofar")))
    nothing = F.col("size") == 0
    out = out.select(
        "name",
        "size",
        "order",
        "rows",
        F.when(nothing, 0).otherwise(F.col("whole")).cast("int").alias("whole"),
        F.when(nothing, 0).otherwise(extra).cast("long").alias("extra"),
    )
    return scratch.table(out, "taken"), sizes, targets


def _with_times(rows: DataFrame, classes: DataFrame, scratch: Scratch, name: str, order: str, place: str, times: str) -> DataFrame:
    """Rows with how often each is taken, of the classes that are given.

    A class that goes once more in part only (at most one on the border of a source and length) picks its rows by
    their place in the input: counts per partition tell which of those go whole, and only inside one are rows numbered.
    """
    whole, extra, n, source, text = free_names(rows, "_whole", "_extra", "_n", "_source", "_text")
    known = classes.select("name", "order", "whole", "extra", "rows").toDF(source, text, whole, extra, n)
    joined = rows.join(known.hint("shuffle_hash"), (F.col(name) == F.col(source)) & (F.col(order) == F.col(text)))
    joined = joined.drop(source, text)
    plain = joined.withColumn(times, F.col(whole) + (F.col(extra) > 0).cast("int"))
    if classes.where("extra > 0 and extra < rows").isEmpty():
        return plain
    split = (F.col(extra) > 0) & (F.col(extra) < F.col(n))
    at, count, before = free_names(joined, "_at", "_count", "_before")
    counts = joined.where(split).groupBy(name, order, place).agg(F.count("*").alias(count))
    sofar = Window.partitionBy(name, order).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col(name).alias(source),
        F.col(order).alias(text),
        F.col(place).alias(at),
        F.coalesce(F.sum(count).over(sofar), F.lit(0)).alias(before),
    )
    mine = joined.where(split).join(
        scratch.table(counts, "border"),
        (F.col(name) == F.col(source)) & (F.col(order) == F.col(text)) & (F.col(place) == F.col(at)),
    )
    nth = F.row_number().over(Window.partitionBy(name, order, place).orderBy(F.lit(0))) + F.col(before)
    mine = mine.withColumn(times, F.col(whole) + (nth <= F.col(extra)).cast("int"))
    return plain.where(~split).unionByName(mine.select(*[F.col(f"`{c}`") for c in plain.columns]))


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """How often the mix takes each document.

    Takes ``doc_id, text, source`` (more columns are ignored) and returns ``doc_id, size, source_size, target, taken,
    times``, one row per input row, where ``taken`` is ``times`` times the size. A null text has size 0 and is never
    taken. A null source is a source of its own. Rows that repeat source, id and text are one class; which of them goes
    once more than the others makes no difference. An empty table gives an empty result. The result does not depend on
    the order or partitions of the rows.

    A source is taken whole as often as its target allows, and what remains is a subset sum over its documents
    (``fit_lengths``) on counts per exact length. A length gives the documents with the smallest seeded hash. To find
    them, a cell of one source and length is cut into about the square root of its rows by that hash; counts decide
    which parts go whole, and only the one part on the border is ranked.

    The driver holds one number per source.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    light = scratch.table(_light(docs, seed), "light")
    classes, sizes, targets = _taken_classes(light, scratch, seed)
    rows = light.withColumn("name", _name("source"))
    timed = _with_times(rows, classes, scratch, "name", "order", "place", "times")
    numbers = spark.createDataFrame(
        [("-" if s is None else f"={s}", int(n), float(targets[s])) for s, n in sizes.items()],
        "name string, source_size long, target double",
    )
    return scratch.finish(
        timed.join(numbers, "name").select(
            "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times"
        )
    )


def _light(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"),
        _order(seed).alias("order"),
        F.spark_partition_id().alias("place"),
    )


def mixed_rows(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The documents of the mix with all their columns, whatever their names, each as often as it is taken.

    Nulls, repeated rows and the empty table are treated as in ``mixed_documents``. A row is known by its source, id
    and text, so a document that occurs under two sources is taken as the mix of each source says.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    light = scratch.table(_light(docs, seed), "light")
    classes, _, _ = _taken_classes(light, scratch, seed)
    name, order, place, times, copy = free_names(docs, "_name", "_order", "_place", "_times", "_copy")
    keyed = docs.withColumns(
        {name: _name(F.col("source").cast("string")), order: _order(seed), place: F.spark_partition_id()}
    )
    timed = _with_times(keyed, classes.where("whole > 0 or extra > 0"), scratch, name, order, place, times)
    return timed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
