"""Repair of conversations: cheapest edits that make the turns ``(s?(ua)+)?``, by Wagner-Fischer alignment."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pubmeta.llm.common import SMALL_ROWS, Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns up to which a conversation is aligned as a whole in one task. Longer ones are cut into blocks of 2**BLOCK_BITS
#: turns, which are joined by what it costs to go from one state of the grammar to another.
LONG = 2048
BLOCK_BITS = 10
#: More than any alignment of LONG turns costs.
_INF = np.int32(1 << 28)
_NEVER = 1 << 60
_WHITE = " \t\n\x0b\x0c\r"
_TURNS = "array<struct<role:string,text:string>>"
_NAMES = {"u": "user", "a": "assistant"}


#: 0 nothing yet, 1 after s, 2 after u, 3 after a. The cheapest way on depends on the state alone, not on the length.
_NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
_STATES = range(4)
#: Cost to end in each state: after s two turns are missing, after u one.
_END = [0, 2 * INSERT, INSERT, 0]


def _due(state: int) -> str:
    return "a" if state == 2 else "u"


def _keep_cost(fault: str) -> int:
    return TRUNCATED if fault == "t" else 0


# one conversation as a whole


def _incumbent(initials: list[str], faults: list[str]) -> int:
    """Cost of one plain repair: faulty turns go, others are kept or given the role that is due, the end is filled up."""
    cost, state = 0, 0
    for initial, fault in zip(initials, faults, strict=True):
        if fault:
            cost += DELETE
        else:
            fits = initial in _NEXT[state]
            cost += KEEP if fits else REROLE
            state = _NEXT[state][initial if fits else _due(state)]
    return min(cost + _END[state], DELETE * len(initials))


def _suffix_costs(initials: list[str], faults: list[str], bound: int) -> np.ndarray:
    """``table[i, l]``: least cost to make turns i and later the last l letters of ``...uaua``.

    The targets of all feasible lengths share their last letters, so one table holds the alignments with all of them. A
    row is filled only in Ukkonen's band: a cell whose turns and letters differ so in number that deletions or
    insertions alone exceed the bound stays infinite.
    """
    n = len(initials)
    forced = [f in ("b", "d") for f in faults]
    must = [*accumulate(reversed(forced), initial=0)][::-1]  # forced deletions from i on

    spare = bound - DELETE * must[0]

    def band(i: int) -> tuple[int, int]:
        free = n - i - must[i]
        return max(0, free - spare // DELETE), free + spare // INSERT

    width = max(band(i)[1] for i in range(n + 1)) + 1
    table = np.full((n + 1, width), _INF, np.int32)
    letters = np.arange(width, dtype=np.int32)
    table[n, : band(n)[1] + 1] = INSERT * letters[: band(n)[1] + 1]
    for i in range(n - 1, -1, -1):
        lo, hi = band(i)
        below = table[i + 1]
        row = below + DELETE
        if not forced[i]:
            # l letters left: the next one is u when l is even
            fits = letters[1:] % 2 == {"u": 0, "a": 1}.get(initials[i], 2)
            change = np.where(fits, KEEP, REROLE) + _keep_cost(faults[i])
            row[1:] = np.minimum(row[1:], below[:-1] + change.astype(np.int32))
        row[:lo] = _INF
        # insertions only add letters, so they are a running minimum
        row = np.minimum.accumulate(row - INSERT * letters) + INSERT * letters
        row[:lo], row[hi + 1 :] = _INF, _INF
        table[i] = np.minimum(row, _INF)
    return table


def _backtrace(table: np.ndarray, initials: list[str], faults: list[str], i: int, left: int) -> str:
    """The ASCII-least of the cheapest audits from turn i on with ``left`` letters to come: D before I before K before R."""
    out: list[str] = []
    n = len(faults)
    while i < n or left:
        here = table[i, left]
        if i < n and table[i + 1, left] + DELETE == here:
            out.append("D")
            i += 1
        elif left and table[i, left - 1] + INSERT == here:
            out.append("I")
            left -= 1
        else:
            due = "u" if left % 2 == 0 else "a"
            out.append("K" if initials[i] == due else "R")
            i, left = i + 1, left - 1
    return "".join(out)


def align(initials: list[str], faults: list[str]) -> tuple[int, str]:
    """Least cost and its audit; ``faults`` holds b, d, t or nothing for each turn.

    Feasible targets are the empty one, ``(ua)+`` of each length in the band, and those with an s before, which only
    a kept system turn with nothing but deletions before it can give. Audits of equal cost are compared.
    """
    if not initials:
        return 0, ""
    bound = _incumbent(initials, faults)
    table = _suffix_costs(initials, faults, bound)
    starts = [(int(table[0, k]), 0, k, "") for k in range(0, table.shape[1], 2)]
    for i, (initial, fault) in enumerate(zip(initials, faults, strict=True)):
        before = DELETE * i + _keep_cost(fault)
        if before > bound:
            break
        if initial == "s" and fault in ("", "t"):
            starts += [(before + int(table[i + 1, k]), i + 1, k, "D" * i + "K") for k in range(2, table.shape[1], 2)]
    cost = min(s[0] for s in starts)
    audits = (head + _backtrace(table, initials, faults, i, k) for c, i, k, head in starts if c == cost)
    return cost, min(audits)


def repaired_turns(turns: list[tuple[str, str]], audit: str, state: int = 0) -> list[dict]:
    """Carry out an audit; ``state`` says what came before (see ``_STATES``)."""
    out: list[dict] = []
    rows = iter(turns)
    for edit in audit:
        row = next(rows) if edit != "I" else None
        if edit == "D":
            continue
        if edit == "K":
            state = _NEXT[state][row[0][:1]]
            out.append({"role": row[0], "text": row[1]})
            continue
        due = _due(state)
        state = _NEXT[state][due]
        out.append({"role": _NAMES[due], "text": row[1] if row else ""})
    return out


# long conversations


def _with_inserts(cost: list[int]) -> list[int]:
    for _ in range(2):
        cost = [min(cost[q], INSERT + cost[_NEXT[q][_due(q)]]) for q in _STATES]
    return cost


def _costs_to_go(initials: list[str], faults: list[str], repeats: list[int], end: list[int]) -> list[list[int]]:
    """Per turn and state the least cost from there to the end of the block, and ``end`` after it.

    A turn with repeats stands for itself and that many copies, which are to be deleted.
    """
    out = [list(end)]
    for initial, fault, more in zip(reversed(initials), reversed(faults), reversed(repeats), strict=True):
        after, now = out[-1], []
        for q in _STATES:
            best = after[q] + DELETE
            if fault not in ("b", "d"):
                best = min(best, after[_NEXT[q][_due(q)]] + REROLE + _keep_cost(fault))
                if initial in _NEXT[q]:
                    best = min(best, after[_NEXT[q][initial]] + KEEP + _keep_cost(fault))
            now.append(best + DELETE * more)
        out.append(_with_inserts(now))
    return out[::-1]


def _walk(
    initials: list[str], faults: list[str], repeats: list[int], end: list[int], state: int, last: bool
) -> tuple[str, int]:
    """The ASCII-least cheapest audit of a block from a state, and the state after it."""
    costs = _costs_to_go(initials, faults, repeats, end)
    out: list[str] = []
    i, n = 0, len(initials)
    while i < n or last and state in (1, 2):
        due = _due(state)
        here = costs[i][state] - (DELETE * repeats[i] if i < n else 0)
        if i < n and costs[i + 1][state] + DELETE == here:
            edit = "D"
        elif i == n or costs[i][_NEXT[state][due]] + INSERT == costs[i][state]:
            edit = "I"
        elif (
            faults[i] not in ("b", "d")
            and initials[i] in _NEXT[state]
            and costs[i + 1][_NEXT[state][initials[i]]] + KEEP + _keep_cost(faults[i]) == here
        ):
            edit = "K"
        else:
            edit = "R"
        out.append(edit)
        if edit != "D":
            state = _NEXT[state][initials[i] if edit == "K" else due]
        if edit != "I":
            out.append("D" * repeats[i])
            i += 1
    return "".join(out), state


# tables


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


_RESULT = (
    "conv_id {id}, part long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    f"audit string, repaired {_TURNS}"
)


def _whole(schema: pa.Schema):
    """Sorted turns in, one row per conversation out."""

    def judge(conv, rows: list[tuple]) -> dict:
        turns, faults, seen = [], [], set()
        for _, role, text, fault in rows:
            if fault != "b" and (role, text) in seen:
                fault = "d"
            seen.add((role, text))
            turns.append((role, text))
            faults.append(fault)
        initials = [r[:1] for r, _ in turns]
        known = {r[0] for r in rows if r[0] is not None}
        cost, audit = align(initials, faults)
        return {
            "conv_id": conv,
            "part": 0,
            "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
            "blank": faults.count("b"),
            "duplicate": faults.count("d"),
            "truncated": faults.count("t"),
            "illegal": _illegal(initials),
            "cost": cost,
            "audit": audit,
            "repaired": repaired_turns(turns, audit),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        current, begun = None, False
        out: list[dict] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "present")]
            for conv, *row, present in zip(*columns, strict=True):
                if begun and conv != current:
                    out.append(judge(current, rows))
                    rows = []
                current, begun = conv, True
                if present:
                    rows.append(tuple(row))
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if begun:
            out.append(judge(current, rows))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _faults(rows: DataFrame) -> DataFrame:
    """Turns without nulls in role and text, and their fault as far as a turn alone shows it."""
    bare = F.rtrim(F.col("text"), F.lit(_WHITE))
    fault = F.when(bare == "", "b").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    return rows.withColumn("fault", fault)


def repaired_conversations(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """The cheapest repair of each conversation and what was wrong with it.

    Takes ``conv_id, turn integer, role, text`` (more columns are ignored, whatever their names) and returns ``conv_id,
    part, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired``. A conversation is one row with part 0;
    one of more than LONG turns is a row for each block, by ascending part, whose audits and turns follow each other
    and whose numbers stand in its first part (part 0), the others having 0.

    Turns go by number, nulls first, then by role and text. Nulls in role and text read as one space. The null conv_id
    is a conversation. Rows that repeat everything are duplicates of each other. Rows for which ``present`` does not
    hold are left out but make their conversation appear. An empty table gives an empty result.

    A conversation of up to LONG turns meets in one task and is aligned there (``align``). Of a longer one no task sees
    more than a block: turns are range-sorted, each block gives its costs between all states of the grammar, these are
    chained backwards, and the audit of each block is walked from the state the block before left. What a task chains is
    16 numbers per block.
    """
    whole, blocks = _repaired(conversations, present)
    return whole if blocks is None else whole.unionByName(blocks)


def _repaired(conversations: DataFrame, present: Column | None) -> tuple[DataFrame, DataFrame | None]:
    """Repairs of conversations up to LONG turns, and those of longer ones where there are any."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "repair")
    every = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    kind = conversations.schema["conv_id"].dataType
    rows = every.where("present")
    many = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > LONG)
    many = scratch.table(many.select(F.col("conv_id").alias("long_id")), "many")
    n_many = many.count()
    short = rows
    if present is not None:  # conversations that may have no turn left
        left_out = every.where("not present").select("conv_id", "present").distinct()
        short = rows.unionByName(left_out, allowMissingColumns=True)

    def among_many(df: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(many) if n_many <= SMALL_ROWS else many.hint("shuffle_hash")
        return df.join(side, df["conv_id"].eqNullSafe(many["long_id"]), how)

    fields = [pa.field(c, pa.int64()) for c in ("part", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    schema = pa.schema(
        [pa.field("conv_id", to_arrow_type(kind)), *fields, pa.field("audit", pa.string()), pa.field("repaired", turns)]
    )
    short = _faults(among_many(short, "left_anti") if n_many else short)
    short = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    whole = short.mapInArrow(_whole(schema), _RESULT.format(id=kind.simpleString()))
    return whole, _in_blocks(among_many(rows, "left_semi"), kind.simpleString(), scratch) if n_many else None


def _in_blocks(rows: DataFrame, kind: str, scratch: Scratch) -> DataFrame:
    """Repair of long conversations, block by block."""
    # rows that repeat everything lie side by side, so they travel as one with their number
    classes = scratch.table(_faults(rows).groupBy("conv_id", "turn", "role", "text", "fault").agg(F.count("*").alias("n")), "classes")
    content = F.sha2(F.concat_ws("\x00", F.sha2(F.col("role"), 256), F.sha2(F.col("text"), 256)), 256)
    keyed = classes.withColumn("content", content).withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    first = keyed.groupBy("conv_id", "content").agg(F.min("at").alias("first"))
    first = first.select(F.col("conv_id").alias("first_id"), F.col("content").alias("first_content"), "first")
    judged = keyed.join(
        first, keyed["conv_id"].eqNullSafe(first["first_id"]) & (F.col("content") == F.col("first_content"))
    ).withColumn("again", ~F.col("at").eqNullSafe(F.col("first")))
    judged = judged.withColumn("fault", F.when((F.col("fault") != "b") & F.col("again"), "d").otherwise(F.col("fault")))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = ["conv_id", "turn", "role", "text"]
    placed = judged.select(*ordered, "fault", (F.col("n") - 1).alias("more"))
    placed = placed.repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered)
    placed = scratch.table(placed.withColumn("seq", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("block", F.shiftright("seq", BLOCK_BITS))
    light = placed.select("conv_id", "block", "seq", F.left("role", F.lit(1)).alias("initial"), "fault", "more")

    def summary(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        initials, faults, more = (group[c].tolist() for c in ("initial", "fault", "more"))
        costs = []
        for q in _STATES:
            end = [0 if s == q else _NEVER for s in _STATES]
            costs += [min(_NEVER, x) for x in _costs_to_go(initials, faults, more, end)[0]]
        # copies of a blank turn are blank, those of any other are duplicates
        blank = sum(1 + n for f, n in zip(faults, more, strict=True) if f == "b")
        duplicate = sum((f == "d") + n for f, n in zip(faults, more, strict=True) if f != "b")
        illegal = _illegal(initials) + sum(more)
        numbers = [blank, duplicate, faults.count("t"), illegal]
        return pd.DataFrame([[key[0], key[1], costs, *numbers, initials[0], initials[-1]]])

    id_ = f"conv_id {kind}"
    tables = scratch.table(
        light.groupBy("conv_id", "block").applyInPandas(
            summary,
            f"{id_}, block long, costs array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string",
        ),
        "tables",
    )

    def chained(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Backwards: what the rest of the conversation costs after each block."""
        group = group.sort_values("block").reset_index(drop=True)
        end, ends = list(_END), []
        for costs in group["costs"][::-1]:
            ends.append(end)
            table = np.asarray(costs, np.int64).reshape(4, 4)  # [state at the end, state at the beginning]
            end = [int(x) for x in np.minimum((table + np.asarray(end, np.int64)[:, None]).min(axis=0), _NEVER)]
        borders = sum(a + b not in ("su", "ua", "au") for a, b in zip(group["last"], group["first"][1:], strict=False))
        out = group[["conv_id", "block"]].copy()
        out["part"], out["last"] = range(len(group)), [k == len(group) - 1 for k in range(len(group))]
        out["ending"] = ends[::-1]
        out["cost"] = [end[0] if k == 0 else 0 for k in range(len(group))]
        for name, more in (("blank", 0), ("duplicate", 0), ("truncated", 0), ("illegal", borders)):
            out[name] = [int(group[name].sum()) + more if k == 0 else 0 for k in range(len(group))]
        return out

    chain = scratch.table(
        tables.groupBy("conv_id").applyInPandas(
            chained,
            f"{id_}, block long, part long, last boolean, ending array<long>, cost long, blank long, duplicate long, "
            "truncated long, illegal long",
        ),
        "chain",
    )

    def on_block(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("conv_id", "right_id").withColumnRenamed("block", "right_block")
        same = (F.col("block") == F.col("right_block")) & F.col("conv_id").eqNullSafe(F.col("right_id"))
        return left.join(right, same).drop("right_id", "right_block")

    def exits(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """The state that the walk through the block ends in, for each it may begin in."""
        group = group.sort_values("seq")
        turns = [group[c].tolist() for c in ("initial", "fault", "more")]
        end, last = [int(x) for x in group["ending"].iloc[0]], bool(group["last"].iloc[0])
        to = [_walk(*turns, end, q, last)[1] for q in _STATES]
        return pd.DataFrame([[key[0], key[1], int(group["part"].iloc[0]), to]])

    steps = scratch.table(
        on_block(light, chain.select("conv_id", "block", "part", "last", "ending"))
        .groupBy("conv_id", "block")
        .applyInPandas(exits, f"{id_}, block long, part long, to array<int>"),
        "steps",
    )

    def entered(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part").reset_index(drop=True)
        states = [0]
        for to in group["to"][:-1]:
            states.append(int(to[states[-1]]))
        return group[["conv_id", "block"]].assign(state=states)

    entries = steps.groupBy("conv_id").applyInPandas(entered, f"{id_}, block long, state int")
    known = scratch.table(on_block(chain, entries), "known")
    gaps = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("all_gaps")
    )

    def walked(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        turns = list(zip(group["role"], group["text"], strict=True))
        one = group.iloc[0]
        faults, more = group["fault"].tolist(), group["more"].tolist()
        end, state = [int(x) for x in one["ending"]], int(one["state"])
        audit, _ = _walk([r[:1] for r, _ in turns], faults, more, end, state, bool(one["last"]))
        turns = [t for t, n in zip(turns, more, strict=True) for t in (t, *[t] * n)]
        numbers = [int(one[c]) for c in ("part", "cost", "blank", "duplicate", "truncated", "illegal")]
        return pd.DataFrame([[key[0], *numbers, audit, repaired_turns(turns, audit, state)]])

    found = on_block(placed.select("conv_id", "block", "seq", "role", "text", "fault", "more"), known).groupBy("conv_id", "block")
    found = found.applyInPandas(
        walked,
        f"{id_}, part long, cost long, blank long, duplicate long, truncated long, illegal long, audit string, repaired {_TURNS}",
    )
    gaps = gaps.withColumnRenamed("conv_id", "gap_id")
    return found.join(gaps, found["conv_id"].eqNullSafe(gaps["gap_id"])).select(
        "conv_id",
        "part",
        F.when(F.col("part") == 0, F.col("all_gaps")).otherwise(F.lit(0)).cast("long").alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        "cost",
        "audit",
        "repaired",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults made by the CRC of ``conv_id:turn``; a dropped turn stays as a row not ``present``."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    space = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", "turn", *space, (F.crc32(key.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair_digest(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation with the SHA-256 of its repaired turns instead of the turns.

    The parts of a long conversation are put together in its row, as a digest asks for.
    """
    whole, blocks = _repaired(conversations, present)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])).alias("lines")
    digest = F.sha2(F.array_join("lines", "\n").cast("binary"), 256).alias("repaired_sha256")
    out = whole.select("conv_id", *numbers, "audit", lines).select("conv_id", *numbers, "audit", digest)
    if blocks is None:
        return out
    parts = blocks.select("conv_id", *numbers, F.struct("part", "audit", lines).alias("piece")).groupBy("conv_id")
    parts = parts.agg(*(F.sum(c).alias(c) for c in numbers), F.sort_array(F.collect_list("piece")).alias("pieces"))
    audit = F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit")
    lines = F.flatten(F.transform("pieces", lambda p: p["lines"])).alias("lines")
    return out.unionByName(parts.select("conv_id", *numbers, audit, lines).select("conv_id", *numbers, "audit", digest))


def oracle() -> str:
    """The same in SQL: turns from the last to the first, each state of the grammar with its cheapest rest."""
    crc = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        crc.append(n)
    white = r"[\x20\x09-\x0D]".replace("\\", "\\")

    def best(*options: str) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"

    def edit(sign: str, cost: str, rest: str, line: str | None, when: str | None = None) -> str:
        lines = f"list_prepend({line}, {rest}.lines)" if line else f"{rest}.lines"
        made = f"{{'cost': {rest}.cost + {cost}, 'audit': '{sign}' || {rest}.audit, 'lines': {lines}}}"
        return f"CASE WHEN {when} THEN {made} END" if when else made

    states = {"n": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    due = {"n": "u", "s": "u", "u": "a", "a": "u"}
    free, extra = "fault NOT IN ('b', 'd')", "(CASE fault WHEN 't' THEN 5 ELSE 0 END)"
    steps = []
    for q, kept in states.items():
        options = [edit("D", "2", f"w.{q}", None)]
        options += [edit("K", extra, f"w.{k}", "role || ':' || text", f"{free} AND initial = '{k}'") for k in kept]
        role = _NAMES[due[q]]
        options.append(edit("R", f"1 + {extra}", f"w.{due[q]}", f"'{role}:' || text", free))
        steps.append(f"{best(*options)} AS {q}0")
    inserts = lambda q, t, old: best(f"{q}{old}", edit("I", "5", f"{t}{old}", f"'{_NAMES[t]}:'"))
    once = ", ".join(f"{inserts(q, due[q], 0)} AS {q}1" for q in states)
    twice = ", ".join(f"{inserts(q, due[q], 1)} AS {q}2" for q in states)
    end = {
        "n": (0, "", []),
        "s": (10, "II", ["user:", "assistant:"]),
        "u": (5, "I", ["assistant:"]),
        "a": (0, "", []),
    }
    ends = ", ".join(
        f"'{q}': {{'cost': CAST({c} AS BIGINT), 'audit': '{a}', 'lines': CAST({lines} AS VARCHAR[])}}" for q, (c, a, lines) in end.items()
    )
    return rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
marked AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(k) + 1), lambda i: CAST(ord(k[i]) AS BIGINT))),
    lambda c, b: xor(c >> 8, CAST({crc} AS BIGINT[])[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) % 20 AS kind FROM given),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM marked WHERE kind <> 0),
ordered AS (
  SELECT *, coalesce(conv_id, -1) AS g, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
    WHEN regexp_matches(text, '[^.!? 	-
][ 	-
]*\z') THEN 't' ELSE '' END AS fault,
    lead(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS next FROM ordered),
walk(g, pos, w) AS (
  SELECT g, max(pos), {{{ends}}} FROM judged GROUP BY g
  UNION ALL
  SELECT g, pos - 1, {{'n': n2, 's': s2, 'u': u2, 'a': a2}} FROM (
    SELECT g, pos, {twice} FROM (
      SELECT g, pos, {once} FROM (
        SELECT walk.g, walk.pos, {', '.join(steps)} FROM walk JOIN judged ON walk.g = judged.g AND walk.pos = judged.pos)))),
numbers AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank,
    count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated,
    count_if(next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY g)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.n.cost, 0) AS BIGINT) AS cost,
  coalesce(w.n.audit, '') AS audit, sha256(coalesce(array_to_string(w.n.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN numbers ON numbers.g = coalesce(conv_id, -1) LEFT JOIN walk ON walk.g = coalesce(conv_id, -1) AND walk.pos = 0
"""
