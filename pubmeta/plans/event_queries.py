"""Outbox, event tables and the streaming jobs run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeta.operators import events as E
from pubmeta.operators import outbox as O
from pubmeta.operators.crossref import doi_key
from pubmeta.plans.base import Source, query
from pubmeta.plans.biblio_queries import records
from pubmeta.plans.tei_queries import DOI, PUBLISHER, TEI, TITLE, tei_docs
from pubmeta.sources.keyed import KeyedTable, write_keyed
from pubmeta.sources.readers import stream_events
from pubmeta.sources.sinks import latest_changes, upsert_table
from pubmeta.sources.workspace import new_folder, shuffles_dropped
from pubmeta.streaming import jobs as S
from pubmeta.streaming.outbox_store import OutboxStore, publish_store
from pubmeta.streaming.state import skip_finished, use_keyed_state

NOW = "TIMESTAMP '2026-01-01 00:00:00Z'"

# What a reader of the event table makes of each event.
EVENTS = """
    SELECT e.event_id, e.user_id AS paper_id, e.event_id % 10 IN (2, 3, 5, 6, 7, 8, 9) AS valid,
      e.event_id % 10 IN (2, 5, 6, 7, 8, 9) AS has_ids, v.id AS version_id, v.conversion_status
    FROM events e LEFT JOIN paper_versions v ON v.id = e.event_id AND v.paper_id = e.user_id
      AND e.event_id % 10 IN (2, 5, 6, 7, 8, 9)
"""


# --- tables -----------------------------------------------------------------


@query(
    "topk1_pending_outbox",
    "SELECT id, status FROM outbox_messages WHERE status <> 'Published' ORDER BY created_at, id LIMIT 20",
)
def _(s: Source) -> DataFrame:
    return O.pending_outbox(s.view("outbox_messages")).select("id", "status")


@query(
    "str2_outbox_transition",
    """SELECT id, CASE status WHEN 'Pending' THEN 'Published' WHEN 'Failed' THEN 'Failed' ELSE status END AS status,
         CASE status WHEN 'Failed' THEN retry_count + 1 ELSE retry_count END AS retry_count,
         CASE status WHEN 'Failed' THEN 'no route: ' || key END AS last_error, status = 'Pending' AS stamped
       FROM outbox_messages""",
)
def _(s: Source) -> DataFrame:
    outbox = s.view("outbox_messages")
    sent = outbox.where("status IN ('Pending', 'Failed')").select(
        "id", F.when(F.col("status") == "Failed", F.concat(F.lit("no route: "), "key")).alias("error")
    )
    return O.outbox_transition(outbox, sent, F.expr(NOW)).select(
        "id", "status", "retry_count", "last_error", F.col("published_at").isNotNull().alias("stamped")
    )


@query(
    "str3_parse_event",
    f"""SELECT event_id, valid, CASE WHEN has_ids THEN paper_id END AS paper_id,
          CASE WHEN has_ids THEN event_id END AS paper_version_id,
          CASE WHEN event_id % 10 >= 5 THEN 'a.pdf' END AS original_file_name, event_id % 10 >= 5 AS dated
        FROM ({EVENTS})""",
)
def _(s: Source) -> DataFrame:
    return E.parse_event(s.view("paper_events")).select(
        "event_id",
        "valid",
        "paper_id",
        "paper_version_id",
        "original_file_name",
        F.col("uploaded_at").isNotNull().alias("dated"),
    )


@query("j1_event_version", f"SELECT version_id AS paper_version_id, paper_id, conversion_status FROM ({EVENTS}) WHERE version_id IS NOT NULL")
def _(s: Source) -> DataFrame:
    return E.match_versions(E.parse_event(s.view("paper_events")), s.view("paper_versions")).select(
        "paper_version_id", "paper_id", "conversion_status"
    )


@query(
    "str11_unmatched_events",
    f"""SELECT event_id, CASE WHEN valid THEN 'version not found' ELSE 'invalid payload' END AS reason
        FROM ({EVENTS}) WHERE version_id IS NULL""",
)
def _(s: Source) -> DataFrame:
    parsed = E.parse_event(s.view("paper_events"))
    return E.unmatched_events(parsed, s.view("paper_versions")).select("event_id", "reason")


@query(
    "j6_events_without_version",
    f"SELECT event_id FROM ({EVENTS}) WHERE valid AND version_id IS NULL",
)
def _(s: Source) -> DataFrame:
    lost = E.unmatched_events(E.parse_event(s.view("paper_events")).where("valid"), s.view("paper_versions"))
    return lost.select("event_id")


TODO = f"SELECT DISTINCT version_id AS paper_version_id, paper_id FROM ({EVENTS}) WHERE version_id IS NOT NULL AND conversion_status <> 'Completed'"


@query("str6_idempotent_skip", TODO)
def _(s: Source) -> DataFrame:
    versions = s.view("paper_versions")
    twice = s.view("paper_events").unionAll(s.view("paper_events"))
    matched = E.match_versions(E.parse_event(twice), versions).select("paper_version_id", "paper_id")
    done = versions.withColumnRenamed("id", "paper_version_id")
    return E.skip_completed(matched, done, "paper_version_id", "conversion_status")


@query(
    "str10_pages_by_key",
    f"""SELECT doc_id, page_number, success FROM ocr_pages
        WHERE doc_id IN (SELECT paper_version_id FROM ({TODO}) WHERE paper_version_id % 3 = 0)""",
)
def _(s: Source) -> DataFrame:
    """The pages of a work list, read from the parts of the page table that hold its keys."""
    todo = s.view("paper_events").where("event_id % 3 = 0 AND event_id % 10 IN (2, 5, 6, 7, 8, 9)").select("event_id", F.col("key").cast("bigint").alias("paper_id"))
    versions = keyed(s, s.view("paper_versions"), "id").rows_for(todo, "event_id").where("conversion_status <> 'Completed'")
    wanted = todo.join(versions, (F.col("event_id") == F.col("id")) & (todo["paper_id"] == versions["paper_id"]), "left_semi")
    pages = keyed(s, s.view("ocr_pages"), "doc_id", "page_number")
    return pages.rows_for(wanted, "event_id").select("doc_id", "page_number", "success")


# --- streams ----------------------------------------------------------------


def deliver(events: DataFrame, folder: str, name: str) -> None:
    """Put events into the folder a stream watches, as one finished delivery."""
    events.select("key", "value").write.mode("overwrite").parquet(f"{folder}/{name}")


def half(s: Source) -> DataFrame:
    """The earlier half of the events, by id."""
    events = s.view("paper_events")
    middle = events.agg((F.max("event_id") / 2).alias("middle"))
    return events.join(middle, F.col("event_id") <= F.col("middle"), "left_semi")


def run(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def twice(s: Source, start) -> None:
    """Run a job over the earlier half, then restart it on a delivery that repeats every event."""
    inbox = new_folder(s.spark, "inbox")
    deliver(half(s), inbox, "d1")
    run(start(stream_events(s.spark, f"{inbox}/*", "parquet")))
    deliver(s.view("paper_events"), inbox, "d2")
    run(start(stream_events(s.spark, f"{inbox}/*", "parquet")))


@query("src5_stream_events", "SELECT key, value FROM paper_events")
def _(s: Source) -> DataFrame:
    inbox, out = new_folder(s.spark, "inbox"), new_folder(s.spark, "out")
    deliver(s.view("paper_events"), inbox, "d1")
    stream = stream_events(s.spark, f"{inbox}/*", "parquet")
    run(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state"))
    return s.spark.read.parquet(out)


@query(
    "str4_fan_out",
    "SELECT 'metadata' AS consumer, event_id FROM events UNION ALL SELECT 'ocr', event_id FROM events",
)
def _(s: Source) -> DataFrame:
    inbox = new_folder(s.spark, "inbox")
    tagged = s.view("paper_events").select(F.col("event_id").cast("string").alias("key"), "value")
    deliver(tagged, inbox, "d1")
    seen = []
    for consumer in ("metadata", "ocr"):
        out = new_folder(s.spark, consumer)
        stream = stream_events(s.spark, f"{inbox}/*", "parquet")
        run(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state"))
        seen.append(
            s.spark.read.parquet(out).select(F.lit(consumer).alias("consumer"), F.col("key").cast("bigint").alias("event_id"))
        )
    return seen[0].unionByName(seen[1])


@query("str5_at_least_once", "SELECT key, value FROM paper_events")
def _(s: Source) -> DataFrame:
    inbox, out = new_folder(s.spark, "inbox"), new_folder(s.spark, "out")
    early = half(s)
    deliver(early, inbox, "d1")

    def start() -> None:
        stream = stream_events(s.spark, f"{inbox}/*", "parquet")
        run(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state"))

    start()
    late = s.view("paper_events").join(early.select("event_id"), "event_id", "left_anti")
    deliver(late, inbox, "d2")
    start()
    return s.spark.read.parquet(out)


@query(
    "str1_publish_slots",
    """SELECT id, key, payload AS value, topic, status = 'Failed' AS was_failed FROM outbox_messages WHERE status <> 'Published'
       ORDER BY created_at, id LIMIT 40""",
)
def _(s: Source) -> DataFrame:
    """Two ticks over an outbox stored by status: each reads the slots with the oldest open messages only."""
    inbox, root, topic = (new_folder(s.spark, n) for n in ("ticks", "outbox-store", "topic"))
    base = s.view("outbox_messages")
    store = OutboxStore(s.spark, root)
    store.add(base)
    for tick in ("t1", "t2"):
        deliver(s.spark.createDataFrame([(tick, tick)], "key STRING, value STRING"), inbox, tick)
        ticks = stream_events(s.spark, f"{inbox}/*", "parquet")
        run(publish_store(ticks, store, S.send_to_table(topic), f"{root}-state", now=F.expr(NOW)))
    sent = store.published().where("published_at IS NOT NULL").withColumnRenamed("payload", "value")
    rows = s.spark.read.parquet(topic).groupBy("key", "value", "topic").agg(F.count(F.lit(1)).alias("sent"))
    before = base.select("id", (F.col("status") == "Failed").alias("was_failed"))
    return sent.join(rows, ["key", "value", "topic"]).join(before, "id").select("id", "key", "value", "topic", "was_failed")


@query(
    "str1_publish_outbox",
    """SELECT id, key, payload AS value, topic FROM outbox_messages WHERE status <> 'Published'
       ORDER BY created_at, id LIMIT 40""",
)
def _(s: Source) -> DataFrame:
    inbox, state, topic = (new_folder(s.spark, n) for n in ("ticks", "outbox", "topic"))
    base = s.view("outbox_messages")
    ddl = "id BIGINT, status STRING, retry_count INT, last_error STRING, published_at TIMESTAMP"
    S.ensure_folder(s.spark, state, ddl)

    def outbox() -> DataFrame:
        changes = latest_changes(S.read_changes(s.spark, state, ddl), "id", "batch_id")
        changed = base.drop("status", "retry_count").join(changes, "id")
        return upsert_table(base, changed, "id")

    def save(changed: DataFrame, batch_id: int) -> None:
        names = ["id", "status", "retry_count", "last_error", "published_at"]
        changed.select(*names).write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")

    for tick in ("t1", "t2"):
        deliver(s.spark.createDataFrame([(tick, tick)], "key STRING, value STRING"), inbox, tick)
        ticks = stream_events(s.spark, f"{inbox}/*", "parquet")
        run(S.publish_outbox(ticks, outbox, S.send_to_table(topic), save, f"{state}-state", now=F.expr(NOW)))
    sent = outbox().where("published_at IS NOT NULL")
    rows = s.spark.read.parquet(topic).groupBy("key", "value", "topic").agg(F.count(F.lit(1)).alias("sent"))
    return sent.withColumnRenamed("payload", "value").join(rows, ["key", "value", "topic"]).select(
        "id", "key", "value", "topic"
    )


def keyed(s: Source, df: DataFrame, key: str, *order: str, buckets: int = 32) -> KeyedTable:
    return write_keyed(df, new_folder(s.spark, f"keyed-{key}"), key, buckets, *order)


def metadata_run(s: Source, buckets: int = 32) -> str:
    out = new_folder(s.spark, "metadata-stream")
    completed = s.table("customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("paper_id"), F.lit("Completed").alias("extraction_status")
    )
    with shuffles_dropped(s.spark):
        works = records(s).withColumn("doi", F.replace(F.lower("doi"), F.lit("/p"), F.lit("/o")))
        works = keyed(s, works.withColumn("doi_key", doi_key(F.col("doi"))), "doi_key")
        docs = write_keyed(tei_docs(s, buckets), new_folder(s.spark, "keyed-doc_id"), "doc_id", buckets, dealt=True)
        versions = keyed(s, s.view("paper_versions"), "id")

        def start(events: DataFrame):
            return S.metadata_stream(
                events, versions.rows_for, completed, docs.rows_for, works.rows_for, out, f"{out}/checkpoint", F.expr(NOW)
            )

        twice(s, start)
    return out


# Per paper: its first readable version, else its last one.
FINAL = f"""
    WITH {TEI}, todo AS (
      SELECT x.paper_id, x.version_id, t.failed, {TITLE} AS title, {DOI} AS doi, {PUBLISHER} AS publisher, t.k
      FROM (SELECT DISTINCT paper_id, version_id FROM ({EVENTS}) WHERE version_id IS NOT NULL) x JOIN tei t ON t.k = x.version_id
      WHERE x.paper_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
    final AS (
      SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN failed THEN 1 ELSE 0 END,
        CASE WHEN failed THEN -version_id ELSE version_id END) AS n FROM todo)
"""


@query("str6_keyed_state", TODO)
def _(s: Source) -> DataFrame:
    """The skip as keyed state: versions finished at the start seed it, what each run hands on counts as finished
    for the next, and the second run repeats every event of the first."""
    use_keyed_state(s.spark)
    inbox, out = new_folder(s.spark, "inbox"), new_folder(s.spark, "handed-on")
    ddl = "paper_version_id BIGINT, paper_id BIGINT"
    S.ensure_folder(s.spark, out, ddl)
    versions = keyed(s, s.view("paper_versions"), "id")
    before = s.view("paper_versions").where("conversion_status = 'Completed'").select(F.col("id").alias("paper_version_id"))

    def start(events: DataFrame):
        finished = s.spark.readStream.schema(ddl).parquet(f"{out}/batch_id=*")
        ids = E.parse_event(events).where("valid")
        waiting = skip_finished(ids, finished, "paper_version_id", ["paper_id"], before)

        def each(batch: DataFrame, batch_id: int) -> None:
            ids = batch.select("paper_version_id", "paper_id", F.lit(True).alias("valid")).persist()
            try:
                matched = E.match_versions(ids, versions.rows_for(ids, "paper_version_id"))
                matched.select("paper_version_id", "paper_id").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
            finally:
                ids.unpersist()

        return waiting.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}-state")

    twice(s, start)
    return s.spark.read.parquet(out).select("paper_version_id", "paper_id")


def metadata_rows(s: Source) -> DataFrame:
    changes = S.read_changes(s.spark, f"{metadata_run(s)}/metadata", S.METADATA_CHANGES_DDL)
    return latest_changes(changes, "paper_id", "batch_id")


@query(
    "str7_extraction_status",
    f"""{FINAL} SELECT paper_id, CASE WHEN failed THEN 'Failed' ELSE 'Completed' END AS extraction_status,
          failed AS has_error, NOT failed AS extracted FROM final WHERE n = 1""",
)
def _(s: Source) -> DataFrame:
    return metadata_rows(s).select(
        "paper_id",
        "extraction_status",
        F.col("extraction_error").isNotNull().alias("has_error"),
        F.col("extracted_at").isNotNull().alias("extracted"),
    )


# A record counts as used when it fills the year or the publisher; the documents have all other fields.
@query(
    "str9_metadata_stream",
    f"""{FINAL} SELECT f.paper_id, f.version_id AS paper_version_id, CASE WHEN NOT failed THEN f.title END AS title,
          CASE WHEN NOT failed THEN f.doi END AS doi, w.doi IS NOT NULL AND NOT failed
            AND (f.k % 10 = 0 OR (f.publisher IS NULL AND w.publisher IS NOT NULL)) AS enriched
        FROM final f LEFT JOIN crossref_works w ON replace(w.doi, '/p', '/o') = lower(f.doi) WHERE n = 1""",
)
def _(s: Source) -> DataFrame:
    return metadata_rows(s).select(
        "paper_id",
        "paper_version_id",
        "title",
        "doi",
        F.coalesce(F.col("metadata_source") == "GROBID+CROSSREF", F.lit(False)).alias("enriched"),
    )


@query(
    "j8_stream_static_dead_letters",
    f"SELECT DISTINCT value, CASE WHEN valid THEN 'version not found' ELSE 'invalid payload' END AS reason "
    f"FROM ({EVENTS}) JOIN paper_events USING (event_id) WHERE version_id IS NULL",
)
def _(s: Source) -> DataFrame:
    return s.spark.read.parquet(f"{metadata_run(s)}/dead_letters").select("value", "reason").distinct()


def ocr_run(s: Source) -> str:
    """Every version whose id is a conversation has pages; the others have none and fail."""
    out = new_folder(s.spark, "ocr-stream")
    versions = keyed(s, s.view("paper_versions"), "id")
    pages = keyed(s, s.view("ocr_pages"), "doc_id", "page_number")
    converted = s.view("paper_versions").select(F.col("id").alias("paper_version_id"), "conversion_status")

    def start(events: DataFrame):
        return S.ocr_stream(
            events, versions.rows_for, converted, pages.rows_for, out, f"{out}/checkpoint", F.expr(NOW)
        )

    twice(s, start)
    return out


CONVERTED = f"""
    WITH bad AS (
      SELECT doc_id, 'OCR failed for page(s): ' || string_agg(CAST(page_number AS VARCHAR), ', ' ORDER BY page_number) AS error
      FROM ocr_pages WHERE NOT success GROUP BY doc_id),
    paged AS (SELECT doc_id, count(*) AS pages FROM ocr_pages GROUP BY doc_id),
    t AS ({TODO}),
    r AS (
      SELECT t.paper_version_id, t.paper_id, paged.pages,
        coalesce(bad.error, CASE WHEN paged.doc_id IS NULL THEN 'Nougat returned empty markdown.' END) AS error
      FROM t LEFT JOIN bad ON bad.doc_id = t.paper_version_id LEFT JOIN paged ON paged.doc_id = t.paper_version_id)
"""
MARKDOWN_KEY = """'papers/markdown/' || md5(CAST(paper_version_id AS VARCHAR)) || '-file_' || CAST(paper_version_id AS VARCHAR) || '.md'"""


@query(
    "str8_conversion_status",
    f"""{CONVERTED} SELECT paper_version_id, CASE WHEN error IS NULL THEN 'Completed' ELSE 'Failed' END AS conversion_status,
          error AS conversion_error, CASE WHEN error IS NULL THEN {MARKDOWN_KEY} END AS markdown_key, error IS NULL AS converted FROM r""",
)
def _(s: Source) -> DataFrame:
    changes = S.read_changes(s.spark, f"{ocr_run(s)}/versions", S.OCR_CHANGES_DDL)
    return latest_changes(changes, "paper_version_id", "batch_id").select(
        "paper_version_id",
        "conversion_status",
        "conversion_error",
        "markdown_key",
        F.col("converted_at").isNotNull().alias("converted"),
    )


@query(
    "str10_ocr_stream",
    f"{CONVERTED} SELECT {MARKDOWN_KEY} AS key, 0 AS part FROM r WHERE error IS NULL",
)
def _(s: Source) -> DataFrame:
    return s.spark.read.parquet(f"{ocr_run(s)}/markdown").select("key", "part")
