import os

import pytest
from pyspark.sql import functions as F

from pubmeta.operators import events as E
from pubmeta.operators import outbox as O
from pubmeta.sources import keyed as keyed_tables
from pubmeta.sources.keyed import KeyedTable, whole_table, write_keyed
from pubmeta.sources.readers import stream_events
from pubmeta.sources.sinks import latest_changes, topic_rows
from pubmeta.sources.workspace import CLEANUP, SETTING, shuffles_dropped, workspace
from pubmeta.streaming import jobs as S
from pubmeta.streaming.state import PROVIDER_SETTING, ROCKSDB, skip_finished, use_keyed_state


def parse(spark, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n INT, value STRING")
    return [tuple(r) for r in E.parse_event(df).orderBy("n").select("valid", "paper_id", "paper_version_id").collect()]


def test_parse_event(spark):
    assert parse(
        spark,
        '{"paperId":1,"paperVersionId":2}',
        '{"PAPERID":"1","paperversionid":"2"}',
        '{"paperId":1,"PaperId":5,"paperVersionId":2}',
        '{"paperId":"x","paperVersionId":2}',
        '{"paperId":1.5}',
        '{"paperId":null,"paperVersionId":2}',
        '{"paperId":1,"uploadedAt":"soon"}',
        "{}",
        "null",
        "[1]",
        "nope",
        None,
    ) == [
        (True, 1, 2),
        (True, 1, 2),
        (True, 5, 2),
        (False, None, 2),
        (False, None, None),
        (False, None, 2),
        (False, 1, None),
        (True, None, None),
        (False, None, None),
        (False, None, None),
        (False, None, None),
        (False, None, None),
    ]


def test_parse_event_is_strict(spark):
    rest = '"paperId":1,"paperVersionId":2'
    good = [
        "{%s}" % rest,
        ' {%s,"pdfS3Key":null,"other":{"a":[1]}} ' % rest,
        '{%s,"uploadedAt":"2026-01-02T03:04:05.123Z"}' % rest,
        '{%s,"uploadedAt":"2026-01-02T03:04:05+01:00"}' % rest,
        '{"paperId":9,%s}' % rest,
    ]
    bad = [
        "{%s} junk" % rest,
        "{%s},{}" % rest,
        "{%s}]" % rest,
        "{%s" % rest,
        '{%s,"pdfS3Key":5}' % rest,
        '{%s,"pdfS3Key":{"a":"b"}}' % rest,
        '{%s,"originalFileName":["a"]}' % rest,
        '{%s,"uploadedAt":"2026"}' % rest,
        '{%s,"uploadedAt":2026}' % rest,
        '{%s,"uploadedAt":null}' % rest,
        '{"paperId":1.0,"paperVersionId":2}',
        '{"paperId":" 1","paperVersionId":2}',
        '{"paperId":true,"paperVersionId":2}',
    ]
    assert [r[0] for r in parse(spark, *good)] == [True] * len(good)
    assert [r[0] for r in parse(spark, *bad)] == [False] * len(bad)


def test_hot_version_is_matched_once(spark):
    events = spark.createDataFrame([(True, 7, 1)] * 500 + [(True, 8, 2), (False, 7, 1)], "valid BOOLEAN, paper_version_id BIGINT, paper_id BIGINT")
    versions = spark.createDataFrame([(7, 1, "a.pdf"), (8, 3, "b.pdf")], "id BIGINT, paper_id BIGINT, original_file_name STRING")
    assert [tuple(r) for r in E.match_versions(events, versions).collect()] == [(7, 1, "a.pdf")]


def test_first_completed_else_last_failure(spark):
    df = spark.createDataFrame(
        [(1, 10, "Failed"), (1, 11, "Completed"), (1, 12, "Completed"), (2, 20, "Failed"), (2, 21, "Failed")],
        "paper_id BIGINT, version BIGINT, status STRING",
    )
    got = E.one_result_per_key(df, "paper_id", "version", "status").orderBy("paper_id").collect()
    assert [(r["paper_id"], r["version"]) for r in got] == [(1, 11), (2, 21)]


def test_outbox_transition(spark):
    ddl = "id BIGINT, status STRING, retry_count INT, last_error STRING, published_at TIMESTAMP"
    outbox = spark.createDataFrame([(1, "Processing", 0, "old", None), (2, "Failed", 4, "old", None), (3, "Pending", 0, None, None)], ddl)
    results = spark.createDataFrame([(1, None), (2, "x" * 5000)], "id BIGINT, error STRING")
    a, b, c = O.outbox_transition(outbox, results, F.current_timestamp()).orderBy("id").collect()
    assert (a["status"], a["retry_count"], a["last_error"]) == ("Published", 0, None) and a["published_at"] is not None
    assert (b["status"], b["retry_count"], len(b["last_error"]), b["published_at"]) == ("Failed", 5, 5000, None)
    assert (c["status"], c["published_at"]) == ("Pending", None)


def test_topic_rows(spark):
    outbox = spark.createDataFrame([("k", "{}", "t", "Type")], "key STRING, payload STRING, topic STRING, type STRING")
    row = topic_rows(outbox).first()
    assert (row["key"], row["value"], row["topic"]) == ("k", "{}", "t")
    assert [(h["key"], bytes(h["value"])) for h in row["headers"]] == [("event-type", b"Type")]


def test_pending_takes_oldest_with_limit_in_plan(spark):
    df = spark.range(100).select("id", F.lit("Failed").alias("status"), (-F.col("id")).cast("timestamp").alias("created_at"))
    top = O.pending_outbox(df)
    assert [r["id"] for r in top.collect()] == list(range(99, 79, -1))
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T{n}</title></titleStmt></fileDesc></teiHeader></TEI>'


@pytest.fixture
def metadata_job(spark, tmp_path):
    versions = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (30, 3), (40, 4)], "id BIGINT, paper_id BIGINT")
    docs = spark.createDataFrame(
        [(10, "<broken"), (11, TEI.format(n=11)), (20, TEI.format(n=20)), (30, TEI.format(n=30))], "doc_id BIGINT, xml STRING"
    )
    works = spark.createDataFrame([], "doi STRING, doi_key STRING, title STRING, abstract STRING, journal STRING, publisher STRING, "
                                  "publication_year INT, volume STRING, issue STRING, pages STRING, "
                                  "authors ARRAY<STRUCT<first_name STRING, middle_name STRING, last_name STRING, full_name STRING, email STRING, affiliation STRING>>")
    completed = spark.createDataFrame([(3, "Completed")], "paper_id BIGINT, extraction_status STRING")
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")

    def deliver(name, *ids):
        values = [(str(p), f'{{"paperId":{p},"paperVersionId":{v}}}') for p, v in ids]
        spark.createDataFrame(values, "key STRING, value STRING").coalesce(1).write.json(f"{inbox}/{name}")

    def run():
        events = stream_events(spark, f"{inbox}/*")
        lookups = whole_table(versions, "id"), completed, whole_table(docs, "doc_id"), whole_table(works, "doi_key")
        writer = S.metadata_stream(events, *lookups, out, f"{out}/cp", F.current_timestamp())
        writer.trigger(availableNow=True).start().awaitTermination()
        changes = S.read_changes(spark, f"{out}/metadata", S.METADATA_CHANGES_DDL)
        return {
            r["paper_id"]: (r["paper_version_id"], r["extraction_status"], r["title"])
            for r in latest_changes(changes, "paper_id", "batch_id").collect()
        }

    return deliver, run, out


def test_metadata_stream_restart_and_redelivery(spark, metadata_job):
    deliver, run, out = metadata_job
    deliver("d1", (1, 10), (1, 10), (3, 30), (2, 99))
    assert run() == {1: (10, "Failed", None)}
    deliver("d2", (1, 11), (2, 20), (4, 40))
    want = {1: (11, "Completed", "T11"), 2: (20, "Completed", "T20"), 4: (40, "Failed", None)}
    assert run() == want
    deliver("d3", (1, 10), (2, 20))
    assert run() == want
    lost = spark.read.parquet(f"{out}/dead_letters").collect()
    assert [(r["paper_id"], r["paper_version_id"], r["reason"]) for r in lost] == [(2, 99, "version not found")]


def test_one_parse_per_scan(spark, tmp_path):
    """Filters on parsed columns do not copy the parse into the predicates."""
    path = str(tmp_path / "events")
    spark.createDataFrame([("1", "{}")], "key STRING, value STRING").write.parquet(path)
    versions = spark.createDataFrame([(7, 1, "a.pdf")], "id BIGINT, paper_id BIGINT, original_file_name STRING")
    parsed = E.parse_event(spark.read.parquet(path))

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    for df in (parsed, parsed.where("valid"), E.match_versions(parsed, versions)):
        assert plan(df).count("from_json") == 1
    lost = plan(E.unmatched_events(parsed, versions))
    assert lost.count("from_json") == lost.count("parquet") == 2


# keyed state


@pytest.fixture
def skipping(spark, tmp_path):
    """A stream that hands on ids and counts them as finished from its next run on."""
    use_keyed_state(spark)
    assert spark.conf.get(PROVIDER_SETTING) == ROCKSDB
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    S.ensure_folder(spark, out, "id BIGINT, note STRING")
    before = spark.createDataFrame([(5,), (None,), (6,)], "id BIGINT")

    def run(name, rows, fails=False):
        if rows:
            spark.createDataFrame(rows, "id BIGINT, note STRING").repartition(3).write.parquet(f"{inbox}/{name}")
        events = spark.readStream.schema("id BIGINT, note STRING").parquet(f"{inbox}/*")
        finished = spark.readStream.schema("id BIGINT").parquet(f"{out}/batch_id=*")
        got = []

        def each(batch, batch_id):
            got.extend((r["id"], r["note"]) for r in batch.collect())
            if fails:
                raise RuntimeError("lost before the results were written")
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

        writer = skip_finished(events, finished, "id", ["note"], before).writeStream.foreachBatch(each)
        q = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            assert fails
        return sorted(got, key=repr), q.recentProgress

    return run


BIG = (1 << 62) + 1


def test_finished_keys_are_skipped_across_restarts(skipping):
    first, _ = skipping("d1", [(1, "a")] * 40 + [(1, "b"), (2, None), (5, "x"), (None, "n"), (BIG, "big")])
    assert first == sorted([(1, "a"), (1, "b"), (2, None), (BIG, "big")], key=repr)
    # repeats of what is finished, the seeded keys, and something new
    assert skipping("d2", [(1, "a"), (2, "later"), (6, "x"), (3, "c"), (3, "c"), (BIG, "big")])[0] == [(3, "c")]
    assert skipping("d3", [(3, "c"), (1, "z")])[0] == []


def test_a_lost_batch_is_handed_on_again(skipping):
    assert skipping("d1", [(1, "a"), (5, "x")], fails=True)[0] == [(1, "a")]
    assert skipping("", [])[0] == [(1, "a")]
    assert skipping("d2", [(1, "a"), (2, "b")])[0] == [(2, "b")]


def test_a_batch_reads_its_own_rows_whatever_the_history(skipping):
    skipping("d1", [(i, "a") for i in range(100, 4100)])
    skipping("d2", [(100, "a")])  # takes in what the first run finished
    _, progress = skipping("d3", [(i, "a") for i in range(4090, 4110)])
    read = sum(p["numInputRows"] for p in progress)
    assert 20 <= read <= 2 * 20 + 5
    assert sum(s["numRowsUpdated"] for p in progress for s in p["stateOperators"]) <= 25


# keyed tables


def _scan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_work_list_reads_its_buckets_only(spark, tmp_path):
    rows = spark.range(2000).select("id", (F.col("id") * 10).alias("n"))
    table = write_keyed(rows, str(tmp_path / "t"), "id", 64)
    assert table.table().count() == 2000 and table.table().columns == ["id", "n"]
    keys = spark.createDataFrame([(7,), (7,), (1999,), (None,), (5000,)], "k BIGINT")
    found = table.rows_for(keys, "k")
    assert sorted(tuple(r) for r in found.collect()) == [(7, 70), (1999, 19990)]
    plan = _scan(found)
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [" in plan and "In(id" in plan
    read = plan.split("_bucket")[1].split("IN (")[1].split(")")[0].split(",")
    assert len(read) <= 3 < len(table.table().inputFiles())
    assert table.rows_for(spark.createDataFrame([], "k BIGINT"), "k").count() == 0


def test_a_hot_key_is_many_files(spark, tmp_path):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("doc_id"), F.col("id").alias("page"))
    table = write_keyed(rows, str(tmp_path / "t"), "doc_id", 4, "page")
    found = table.rows_for(spark.createDataFrame([(1,)], "doc_id BIGINT"))
    assert found.count() == rows.where("doc_id = 1").count()
    hot = spark.read.parquet(str(tmp_path / "t")).where("doc_id = 1").select(F.input_file_name().alias("f")).distinct().count()
    assert hot > 1


def test_only_changed_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    table = write_keyed(spark.range(200).select("id", F.lit("old").alias("v")), path, "id", 8)
    changed = spark.createDataFrame([(3, "new"), (900, "new")], "id BIGINT, v STRING")
    before = {f: os.stat(f.removeprefix("file:").replace("//", "/")).st_mtime_ns for f in table.table().inputFiles()}
    written = table.upsert(changed)
    assert 1 <= len(written) <= 2
    want = {i: "old" for i in range(200)} | {3: "new", 900: "new"}
    assert {r["id"]: r["v"] for r in KeyedTable(spark, path, "id", 8).table().collect()} == want
    same = [f for f in before if f"_bucket={written[0]}/" not in f and f"_bucket={written[-1]}/" not in f]
    assert same and all(os.stat(f.removeprefix("file:").replace("//", "/")).st_mtime_ns == before[f] for f in same)


class FakeSession:
    def __init__(self, setting, master):
        self.conf = {SETTING: setting} if setting else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"{setting}-{master}"})


def test_workspace_follows_the_session():
    assert workspace(FakeSession("hdfs:///shared/", "yarn")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        workspace(FakeSession(None, "yarn"))
    made = workspace(FakeSession(None, "local[8]"))
    assert os.path.isdir(made) and workspace(FakeSession(None, "local[8]")) == made


def test_a_large_work_list_does_not_shuffle_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_tables, "NAMED_KEYS", 10)
    rows = spark.range(6000).select((F.col("id") % 3000).alias("id"), F.concat(F.lit("wide "), "id").alias("v"))
    table = write_keyed(rows, str(tmp_path / "t"), "id", 4)
    keys = spark.range(0, 9000, 2).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("k"))
    want = sorted(tuple(r) for r in rows.where("id % 2 = 0 AND id % 7 > 0").collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # below the size of the list, above that of the keys of a bucket
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12k")
    try:
        found = table.rows_for(keys, "k")
        assert sorted(tuple(r) for r in found.collect()) == want and found.columns == ["id", "v"]
        assert "SortMergeJoin" not in _scan(found) and "BroadcastHashJoin" in _scan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dealt_rows_are_written_without_a_shuffle(spark, tmp_path):
    rows = spark.range(0, 2000, 1, 5).select((F.col("id") % 700).alias("id"), F.col("id").alias("n"))
    plain = write_keyed(rows, str(tmp_path / "a"), "id", 8)
    dealt = write_keyed(rows, str(tmp_path / "b"), "id", 8, dealt=True)
    keys = spark.createDataFrame([(7,), (699,), (None,), (9000,)], "id BIGINT")
    for read in (lambda t: t.table(), lambda t: t.rows_for(keys)):
        assert sorted(map(tuple, read(dealt).collect())) == sorted(map(tuple, read(plain).collect()))
    files = [p.name for p in (tmp_path / "b").rglob("*.parquet")]
    assert len(files) == 5 * 8 and all(".zstd." in f for f in files)


def test_documents_by_bucket_are_the_documents(spark):
    from pubmeta.plans.base import Source
    from pubmeta.plans.tei_queries import tei_docs

    s = Source(spark, "/root/testdata/sf0.001")
    docs = tei_docs(s, 8)
    lines = docs._jdf.queryExecution().executedPlan().toString().splitlines()
    built = max(k for k, line in enumerate(lines) if "<TEI xmlns" in line)
    assert built < min(k for k, line in enumerate(lines) if "Sort [_bucket" in line)
    assert docs.where(F.col("_bucket") != keyed_tables.bucket_of(F.col("doc_id"), 8)).isEmpty()
    plain = tei_docs(s)
    assert docs.drop("_bucket").exceptAll(plain).isEmpty() and plain.exceptAll(docs.drop("_bucket")).isEmpty()


def test_shuffles_go_with_their_statement(spark, tmp_path):
    before = spark.conf.get(CLEANUP, None)
    with pytest.raises(ZeroDivisionError), shuffles_dropped(spark):
        assert spark.conf.get(CLEANUP) == "true"
        spark.range(100).groupBy("id").count().write.parquet(str(tmp_path / "t"))
        raise ZeroDivisionError
    assert spark.conf.get(CLEANUP, None) == before and spark.read.parquet(str(tmp_path / "t")).count() == 100
