"""Tables laid out for what reads them: page ranks, outbox slots, work buckets, counts taken on the way."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pubmeta.operators import crossref as CR
from pubmeta.operators import quality as Q
from pubmeta.sources import ranked
from pubmeta.sources.ranked import RankedTable, write_ranked
from pubmeta.streaming import outbox_store
from pubmeta.streaming.outbox_store import SLOT, OutboxStore


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ranked pages


def _pages(table, n, size=7):
    return [[r["k"] for r in table.page(i, size).collect()] for i in range(n // size + 2)]


def test_pages_by_rank(spark, tmp_path):
    rng = random.Random(1)
    keys = rng.sample(range(1000), 120)
    df = spark.createDataFrame([(k, f"v{k}") for k in keys] + [(None, "no key")], "k BIGINT, v STRING")
    table = write_ranked(df, str(tmp_path), "k", rows_per_range=20)
    want = sorted(keys)
    assert _pages(table, 120) == [want[i : i + 7] for i in range(0, 120, 7)] + [[]] * (120 // 7 + 2 - len(range(0, 120, 7)))
    assert [r["k"] for r in table.page(-3, 0).collect()] == want[:1]
    deep = plan(table.page(10, 7))
    read = deep.split(f"{ranked.RANGE}")[1].split("IN (")
    assert "PartitionFilters" in deep and (len(read) == 1 or len(read[1].split(")")[0].split(",")) <= 2)


def test_pages_after_changes(spark, tmp_path):
    rng = random.Random(2)
    rows = {k: "old" for k in rng.sample(range(2000), 100)}
    table = write_ranked(spark.createDataFrame(list(rows.items()), "k BIGINT, v STRING"), str(tmp_path), "k", rows_per_range=25)
    before = {r[0]: r[2] for r in table.ranges()}
    some = sorted(rows)[:3]
    changes = {k: "new" for k in some} | {-5: "low"}
    touched = table.upsert(spark.createDataFrame(list(changes.items()), "k BIGINT, v STRING"))
    rows |= changes
    assert touched == [table.ranges()[0][0]]
    assert {r[0]: r[2] for r in table.ranges()} == before | {touched[0]: before[touched[0]] + 1}
    # one range grows until it is split
    more = {k: "many" for k in range(3000, 3090)}
    table.upsert(spark.createDataFrame(list(more.items()), "k BIGINT, v STRING"))
    rows |= more
    reopened = RankedTable(spark, str(tmp_path), "k", 25)
    assert len(reopened.ranges()) > len(before) and sum(r[2] for r in reopened.ranges()) == len(rows)
    want = sorted(rows.items())
    for i in (0, 5, 20, 27):
        assert [tuple(r) for r in reopened.page(i, 7).select("k", "v").collect()] == want[i * 7 : i * 7 + 7]
    assert reopened.upsert(spark.createDataFrame([(None, "x")], "k BIGINT, v STRING")) == []


def test_changes_to_all_ranges_keep_to_the_most_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranked, "MOST_RANGES", 6)
    keys = spark.range(300).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    table = write_ranked(keys, str(tmp_path), "k", rows_per_range=10)
    assert len(table.ranges()) == 6
    table.upsert(keys.where("k % 10 = 3").withColumn("v", F.lit("new")))
    found = table.ranges()
    assert len(found) == 6 and sum(r[2] for r in found) == 300
    want = [(k, "new" if k % 10 == 3 else "old") for k in range(300)]
    assert [tuple(r) for r in table.page(11, 20).select("k", "v").collect()] == want[220:240]


def test_an_empty_ranked_table(spark, tmp_path):
    table = write_ranked(spark.createDataFrame([], "k STRING, v STRING"), str(tmp_path), "k")
    assert table.ranges() == []
    table.upsert(spark.createDataFrame([("b", "1"), ("a", "2")], "k STRING, v STRING"))
    assert [r["k"] for r in table.page(0, 5).collect()] == ["a", "b"]


# outbox by status

DDL = "id BIGINT, topic STRING, key STRING, type STRING, payload STRING, status STRING, retry_count INT, created_at TIMESTAMP"
T0 = dt.datetime(2026, 1, 1)


def _message(i, minutes, status="Pending"):
    at = None if minutes is None else T0 + dt.timedelta(minutes=minutes)
    return (i, "t", f"k{i}", "T", "{}", status, 0, at)


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(outbox_store, "SLOT_ROWS", 5)
    return OutboxStore(spark, str(tmp_path / "outbox"))


def _send(fail=()):
    def send(chosen):
        return chosen.select("id", F.when(F.col("id").isin(list(fail)), "no route").alias("error"))

    return send


def _ids(df):
    return sorted(r["id"] for r in df.collect())


def now():
    return F.lit("2026-02-01").cast("timestamp")


def test_a_tick_reads_the_oldest_slots_only(spark, store):
    store.add(spark.createDataFrame([_message(i, i) for i in range(40)] + [_message(100, 0, "Published")], DDL))
    slots = store.slots()
    assert len(slots) >= 6
    chosen, read = store.pending(3)
    assert _ids(chosen) == [0, 1, 2] and len(read) <= 2 < len(slots)
    shown = plan(chosen)
    assert SLOT in shown.split("PartitionFilters: [")[1].split("]")[0] and slots[-1] not in shown
    assert _ids(store.pending(12)[0]) == list(range(12))
    assert _ids(store.published()) == [100]


def test_ticks_move_messages(spark, store):
    store.add(spark.createDataFrame([_message(i, i, "Failed" if i % 3 == 0 else "Pending") for i in range(12)], DDL))
    first = store.tick(0, _send(fail=[1]), now(), 4)
    assert {r["id"]: r["status"] for r in first.collect()} == {0: "Published", 1: "Failed", 2: "Published", 3: "Published"}
    # the one that failed is still the oldest
    second = store.tick(1, _send(), now(), 4)
    assert _ids(second) == [1, 4, 5, 6]
    assert {r["id"]: r["retry_count"] for r in second.collect()}[1] == 1
    assert _ids(store.published()) == list(range(7))
    assert _ids(store.open_rows(store.slots())) == list(range(7, 12))
    # late and undated messages come in their order
    store.add(spark.createDataFrame([_message(50, 2), _message(51, None)], DDL))
    assert _ids(store.pending(3)[0]) == [7, 50, 51]
    for n in range(2, 6):
        store.tick(n, _send(), now(), 4)
    assert store.slots() == [] and store.pending(4) == (None, []) and store.tick(9, _send(), now(), 4) is None
    assert _ids(store.published()) == [*range(12), 50, 51]


def test_a_replayed_tick_changes_nothing(spark, store):
    store.add(spark.createDataFrame([_message(i, i) for i in range(8)], DDL))
    sent = []

    def send(chosen):
        sent.append(_ids(chosen))
        return _send()(chosen)

    store.tick(0, send, now(), 3)
    store.tick(0, send, now(), 3)
    assert sent == [[0, 1, 2]]
    assert _ids(store.published()) == [0, 1, 2] and _ids(store.open_rows(store.slots())) == [3, 4, 5, 6, 7]


def test_a_tick_that_is_lost_before_the_slots_are_written(spark, store, monkeypatch):
    store.add(spark.createDataFrame([_message(i, i) for i in range(8)], DDL))

    def lost(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(OutboxStore, "_replace", lost)
        with pytest.raises(RuntimeError):
            store.tick(0, _send(), now(), 3)
    store.tick(0, _send(), now(), 3)
    assert _ids(store.published()) == [0, 1, 2] and _ids(store.open_rows(store.slots())) == [3, 4, 5, 6, 7]


# bucketed works


def test_a_bucketed_snapshot_is_not_shuffled(spark, tmp_path):
    works = spark.createDataFrame([(f"10.1/{i}", f"P{i}") for i in range(300)] + [("10.1/A", "x"), ("10.1/a ", "y")], "doi STRING, publisher STRING")
    path = str(tmp_path / "works")
    stored = CR.write_bucketed_works(works, "bucketed_works_test", path, 4)
    rows = [(i, f"10.1/{i}") for i in range(100)] + [(1000 + i, "10.1/7") for i in range(60)] + [(2000, None), (2001, " "), (2002, "10.1/zz")]
    metadata = spark.createDataFrame(rows, "paper_id BIGINT, doi STRING").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hot in (10, 1_000_000):
            found = CR.lookup_bucketed(metadata, stored, hot_rows=hot)
            got = {r["paper_id"]: r["cr"] and r["cr"]["publisher"] for r in found.collect()}
            assert len(got) == found.count() == len(rows)
            assert got == {i: f"P{d[5:]}" if d and d[5:].isdigit() else None for i, d in rows}
        shown = plan(CR.lookup_bucketed(metadata, stored))
        scan = shown[shown.index("FileScan") :]
        assert "Bucketed: true" in scan
        # one exchange, of the metadata; none between the scan of the works and the join
        assert shown.count("Exchange hashpartitioning") == 1
        reopened = CR.open_bucketed_works(spark, "bucketed_works_again", path, 4)
        assert "Bucketed: true" in plan(CR.lookup_bucketed(metadata, reopened))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("bucketed_works_test", "bucketed_works_again"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


# counts on the way


def test_counts_on_write_equal_the_violations(spark, tmp_path):
    rows = [(i, "x" * (300 if i % 3 == 0 else 3), None if i % 4 == 0 else "k", "T", "{}", ["Pending", "Odd", None][i % 3], 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id BIGINT, topic STRING, key STRING, type STRING, payload STRING, status STRING, retry_count INT")
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counts = Q.write_checked(df.mapInArrow(pass_on, df.schema), "outbox_messages", str(tmp_path / "t"))
    got = {(r["column"], r["problem"]): r["rows"] for r in counts.collect()}
    assert seen.value == 60  # computed once, for the files
    want = {}
    for v in Q.required_violations(df, "outbox_messages").collect():
        want[v["column"], v["problem"]] = want.get((v["column"], v["problem"]), 0) + 1
    for v in Q.length_violations(df, "outbox_messages").collect():
        want[v["column"], "too long"] = want.get((v["column"], "too long"), 0) + 1
    assert {k: n for k, n in got.items() if n} == want | {("*", "rows"): 60}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 60
