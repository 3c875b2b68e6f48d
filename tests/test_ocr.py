import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pubmeta.operators import ocr as O

DDL = "doc_id BIGINT, page_number INT, prediction STRING, repeats INT, success BOOLEAN"


def brute_force(pages):
    """The whole-document rule, page by page."""
    texts = []
    for _, number, prediction, repeats, success in sorted(pages, key=lambda p: p[1]):
        if not success:
            continue
        if prediction.strip() == "[MISSING_PAGE_POST]":
            prediction = f"\n\n[MISSING_PAGE_EMPTY:{number}]\n\n"
        elif repeats is not None:
            prediction = f"\n\n[MISSING_PAGE_{'FAIL' if repeats > 0 else 'EMPTY'}:{number}]\n\n"
        texts.append(prediction.strip())
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(texts).strip()).strip()


def make_pages(seed=7):
    rng = random.Random(seed)
    words = ["a", "b\n\n\n\nc", " \n", "", "\n\nd\n", "[MISSING_PAGE_POST] ", "e "]
    out = []
    for doc in range(30):
        # The first document holds about a third of all pages.
        for number in range(1, (400 if doc == 0 else rng.randint(1, 40)) + 1):
            out.append((doc, number, rng.choice(words), rng.choice([None, None, None, 0, 2]), rng.random() > 0.1))
    rng.shuffle(out)
    return out


def test_parts_join_to_the_whole_document(spark):
    pages = make_pages()
    df = O.page_markdown(spark.createDataFrame(pages, DDL).repartition(8))
    for size in (1, 7, 1000):
        parts = O.assemble_pages(df, pages_per_part=size).collect()
        assert max(r["pages"] for r in parts) <= size
        for doc in range(30):
            mine = sorted((r["part"], r["markdown"]) for r in parts if r["doc_id"] == doc)
            whole = "\n\n".join(m for _, m in mine if m)
            assert whole == brute_force([p for p in pages if p[0] == doc])


def test_failed_pages_in_order(spark):
    pages = [(1, n, "x", None, n not in (11, 2, 5)) for n in range(1, 12)] + [(2, 1, "x", None, True)]
    got = O.failed_pages(spark.createDataFrame(pages, DDL)).collect()
    assert [tuple(r) for r in got] == [(1, "OCR failed for page(s): 2, 5, 11")]


def test_long_failure_message_is_whole(spark):
    pages = [(1, n, "x", None, False) for n in range(1, 5001)]
    (row,) = O.failed_pages(spark.createDataFrame(pages, DDL)).collect()
    assert row["error"] == "OCR failed for page(s): " + ", ".join(str(n) for n in range(1, 5001))


def test_parts_without_text(spark):
    pages = [(1, 1, "a", None, True), (1, 2, " ", None, True), (1, 3, "c", None, True), (2, 1, "x", None, False)]
    parts = O.assemble_pages(O.page_markdown(spark.createDataFrame(pages, DDL)), pages_per_part=1)
    assert {tuple(r) for r in O.whole_markdown(parts).collect()} == {(1, "a\n\nc"), (2, "")}


def test_unreadable_answers_fail_their_pages_only(spark):
    pages = spark.createDataFrame([(1, n, f"p{n}") for n in (1, 2, 3)], "doc_id BIGINT, page_number INT, image STRING")

    def model(inputs):
        if "p1" in inputs:
            return None
        return {"predictions": inputs, "repeats": ["many" if "p2" in inputs else 0]}

    got = O.infer_pages(pages, model, batch_size=1).orderBy("page_number").collect()
    assert [(r["success"], r["attempts"]) for r in got] == [(False, 3), (False, 3), (True, 1)]


def test_outcomes(spark):
    docs = spark.createDataFrame(
        [(1, "text/plain", 5), (2, "application/pdf", 0), (3, "application/x-pdf", 5), (4, "application/pdf", 5), (5, "application/pdf", 5), (6, "application/pdf", 5)],
        "doc_id BIGINT, content_type STRING, length BIGINT",
    )
    pages = [(3, 1, "ok", None, True), (4, 1, " ", None, True), (4, 2, "\n", None, True), (5, 1, "x", None, False), (5, 2, "y", None, True)]
    got = O.ocr_outcome(docs, O.page_markdown(spark.createDataFrame(pages, DDL))).orderBy("doc_id").collect()
    assert [(r["success"], r["pages"], r["error"]) for r in got] == [
        (False, None, "Only PDF files are supported."),
        (False, None, "Uploaded PDF is empty."),
        (True, 1, None),
        (False, 2, "Nougat returned empty markdown."),
        (False, None, "OCR failed for page(s): 1"),
        (False, 0, "Nougat returned empty markdown."),
    ]


def test_infer_pages(spark):
    pages = spark.createDataFrame([(1, n, f"p{n}") for n in range(1, 6)], "doc_id BIGINT, page_number INT, image STRING")

    def model(inputs):
        if "p3" in inputs:
            raise RuntimeError("bad batch")
        return {"predictions": inputs[:1], "repeats": [3]}

    got = O.infer_pages(pages, model, batch_size=2, max_retry=3).orderBy("page_number").collect()
    assert [(r["prediction"], r["repeats"], r["success"], r["error"], r["attempts"]) for r in got] == [
        ("p1", 3, True, None, 1),
        (None, None, False, O.NO_PREDICTION, 1),
        (None, None, False, "bad batch", 3),
        (None, None, False, "bad batch", 3),
        ("p5", 3, True, None, 1),
    ]


def _calls(path):
    return [eval(line) for line in open(path).read().splitlines()] if os.path.exists(path) else []


def test_batches_are_formed_across_arrow_batches(spark, tmp_path):
    """Pages that are laid out are not shuffled; the model is loaded once and sees whole batches."""
    log = str(tmp_path / "calls")
    rows = [(d, n, None if (d, n) == (2, 3) else f"{d}.{n}") for d in (1, 2) for n in range(1, 8)]
    pages = spark.createDataFrame(rows, "doc_id BIGINT, page_number INT, image STRING").coalesce(1)

    def load():
        with open(log, "a") as out:
            out.write("'loaded'\n")

        def model(inputs):
            with open(log, "a") as out:
                out.write(f"{inputs!r}\n")
            return {"predictions": inputs, "repeats": []}

        return model

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = O.infer_pages(pages, load=load, batch_size=3, laid_out=True)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        got = {(r["doc_id"], r["page_number"]): (r["success"], r["error"], r["attempts"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 14 and got.pop((2, 3)) == (False, O.EMPTY_SAMPLE, 3)
    assert set(got.values()) == {(True, None, 1)}
    assert _calls(log) == [
        "loaded", ["1.1", "1.2", "1.3"], ["1.4", "1.5", "1.6"], ["1.7"], ["2.1", "2.2"], ["2.4", "2.5", "2.6"], ["2.7"]
    ]


def test_a_named_model_is_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        return lambda inputs: {"predictions": inputs, "repeats": []}

    pages = spark.range(40).select(
        F.col("id").alias("doc_id"), F.lit(1).alias("page_number"), F.lit("x").alias("image")
    ).repartition(20)
    for _ in range(2):
        assert O.infer_pages(pages, load=load, name=f"m{os.path.basename(tmp_path)}", laid_out=True).where("success").count() == 40
    loads = _calls(log)
    assert 1 <= len(loads) == len(set(loads))


def test_empty_samples_and_one_model(spark):
    pages = spark.createDataFrame([(1, 1, None), (1, None, "x")], "doc_id BIGINT, page_number INT, image STRING")
    got = O.infer_pages(pages, lambda inputs: {"predictions": inputs}, max_retry=2).collect()
    assert {(r["page_number"], r["success"], r["error"], r["attempts"]) for r in got} == {
        (1, False, O.EMPTY_SAMPLE, 2), (None, True, None, 1)
    }
    with pytest.raises(ValueError):
        O.infer_pages(pages)
    assert O.infer_pages(pages.where("false"), lambda inputs: {}).count() == 0


def test_no_text_is_shuffled_for_outcomes(spark):
    pages = O.page_markdown(spark.createDataFrame(make_pages(), DDL))
    docs = pages.select("doc_id").distinct().select("doc_id", F.lit("application/pdf").alias("content_type"), F.lit(1).alias("length"))
    plan = O.ocr_outcome(docs, pages)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(markdown" not in plan
