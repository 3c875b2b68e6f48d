"""Per-page OCR output to ordered Markdown documents."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeta.functions.text import collapse_blank_lines, strip_ocr
from pubmeta.schemas import EMPTY_MARKDOWN, EMPTY_PDF, INVALID_PDF

# The batching travels with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pages joined into one row of Markdown. Longer documents come in several parts,
# so no row grows with the length of a document.
PAGES_PER_PART = 1000

# Content types and markers of the OCR contract.
OCR_CONTENT_TYPES = ("application/pdf", "application/x-pdf")
MISSING_PAGE = "[MISSING_PAGE_POST]"
NO_PREDICTION = "Nougat did not return a prediction for this page."
EMPTY_SAMPLE = "Nougat dataloader returned empty sample."


def normalize_prediction(prediction: Column, repeats: Column, page_number: Column) -> Column:
    """Model output of one page as Markdown; skipped and repeating pages become a marker."""

    def marker(kind: str) -> Column:
        return F.concat(F.lit(f"\n\n[MISSING_PAGE_{kind}:"), page_number.cast("string"), F.lit("]\n\n"))

    return (
        F.when(strip_ocr(prediction) == MISSING_PAGE, marker("EMPTY"))
        .when(repeats > 0, marker("FAIL"))
        .when(repeats <= 0, marker("EMPTY"))
        .otherwise(prediction)
    )


def page_markdown(pages: DataFrame) -> DataFrame:
    return pages.withColumn(
        "markdown", normalize_prediction(F.col("prediction"), F.col("repeats"), F.col("page_number"))
    )


def assemble_pages(pages: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """Pages to ``(doc_id, part, markdown, pages)``.

    Joining stripped pages by a blank line and collapsing newline runs equals
    joining the collapsed non-blank pages, so the clean-up runs per page before
    the shuffle. Part ``n`` holds the ``n``-th run of ``pages_per_part`` page
    numbers; a part without text is empty. ``whole_markdown`` joins the others.
    """
    clean = F.when(F.col("success"), F.nullif(collapse_blank_lines(F.col("markdown")), F.lit("")))
    part = F.floor((F.col("page_number") - 1) / pages_per_part).cast("int")
    rows = pages.select("doc_id", part.alias("part"), "page_number", clean.alias("md"))
    kept = F.when(F.col("md").isNotNull(), F.struct("page_number", "md"))
    ordered = F.transform(F.array_sort(F.collect_list(kept)), lambda p: p["md"])
    return rows.groupBy("doc_id", "part").agg(
        F.array_join(ordered, "\n\n").alias("markdown"), F.count(F.lit(1)).alias("pages")
    )


def whole_markdown(parts: DataFrame) -> DataFrame:
    """``(doc_id, markdown)`` from the parts of each document: those with text, joined by a blank line."""
    texts = F.when(F.col("markdown") != "", F.struct("part", "markdown"))
    ordered = F.transform(F.array_sort(F.collect_list(texts)), lambda p: p["markdown"])
    return parts.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("markdown"))


def failed_pages(pages: DataFrame) -> DataFrame:
    """Documents with a failed page, and the message naming all of them in page order.

    Only page numbers are collected, four bytes for each failed page of a document.
    """
    bad = pages.where(~F.col("success")).select("doc_id", "page_number")
    numbers = F.array_join(F.array_sort(F.collect_list("page_number")).cast("array<string>"), ", ")
    message = F.concat(F.lit("OCR failed for page(s): "), numbers)
    return bad.groupBy("doc_id").agg(message.alias("error"))


def ocr_outcome(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``(doc_id, content_type, length)`` and its pages to success or the first failure reason.

    All counts combine on the map side; no page text is shuffled here.
    """
    text = F.nullif(collapse_blank_lines(F.col("markdown")), F.lit(""))
    stats = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count(F.when(F.col("success") & text.isNotNull(), True)).alias("_with_text"),
    )
    joined = documents.join(stats, "doc_id", "left").join(
        failed_pages(pages).withColumnRenamed("error", "_failed"), "doc_id", "left"
    )
    n_pages = F.coalesce("pages", F.lit(0))
    error = (
        F.when(~F.coalesce(F.col("content_type").isin(*OCR_CONTENT_TYPES), F.lit(False)), F.lit(INVALID_PDF))
        .when(F.col("length") == 0, F.lit(EMPTY_PDF))
        .when(F.col("_failed").isNotNull(), F.col("_failed"))
        .when(F.coalesce("_with_text", F.lit(0)) == 0, F.lit(EMPTY_MARKDOWN))
    )
    return joined.select(
        "doc_id",
        error.isNull().alias("success"),
        F.when(error.isNull() | (error == EMPTY_MARKDOWN), n_pages).alias("pages"),
        error.alias("error"),
    )


_INFERRED = (
    "doc_id BIGINT, page_number INT, prediction STRING, repeats INT, success BOOLEAN, error STRING, attempts INT"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("page_number", pa.int32()),
        ("prediction", pa.string()),
        ("repeats", pa.int32()),
        ("success", pa.bool_()),
        ("error", pa.string()),
        ("attempts", pa.int32()),
    ]
)


def _answered(rows: list[tuple], model: Callable[[list], dict], max_retry: int) -> list[dict]:
    """Results of one batch of pages ``(doc_id, page_number, input)``."""

    def page(row: tuple, **found) -> dict:
        blank = {"prediction": None, "repeats": None, "success": False, "error": None, "attempts": max_retry}
        return {"doc_id": row[0], "page_number": row[1]} | blank | found

    out = [page(r, error=EMPTY_SAMPLE) for r in rows if r[2] is None]
    rows = [r for r in rows if r[2] is not None]
    problem: Exception | None = None
    for attempt in range(1, max_retry + 1) if rows else ():
        try:
            answer = model([r[2] for r in rows])
            predictions, repeats = answer.get("predictions", []), answer.get("repeats", [])
            texts = [predictions[i] if i < len(predictions) else None for i in range(len(rows))]
            texts = [None if t is None else str(t) for t in texts]
            counts = [repeats[i] if i < len(repeats) else None for i in range(len(rows))]
            counts = [None if c is None else int(c) for c in counts]
        except Exception as raised:
            problem = raised
            continue
        return out + [
            page(r, prediction=t, repeats=c, success=t is not None, error=None if t is not None else NO_PREDICTION, attempts=attempt)
            for r, t, c in zip(rows, texts, counts, strict=True)
        ]
    return out + [page(r, error=str(problem)) for r in rows]


def _kept_model(name: str | None, load: Callable[[], Callable[[list], dict]]) -> Callable[[list], dict]:
    """The model of this worker process: loaded once under a name, and kept for the tasks that the worker runs later."""
    if name is None:
        return load()
    kept = sys.modules.setdefault("_page_models", types.ModuleType("_page_models"))
    if not hasattr(kept, name):
        setattr(kept, name, load())
    return getattr(kept, name)


def infer_pages(
    pages: DataFrame,
    model: Callable[[list], dict] | None = None,
    batch_size: int = 2,
    max_retry: int = 3,
    input_column: str = "image",
    *,
    load: Callable[[], Callable[[list], dict]] | None = None,
    name: str | None = None,
    laid_out: bool = False,
) -> DataFrame:
    """Run a page model over ``(doc_id, page_number, <input>)`` in batches of consecutive pages.

    ``model(inputs)`` returns ``{"predictions": [...], "repeats": [...]}``. A
    batch that raises, or gets an answer that cannot be read, is tried again; after ``max_retry`` attempts all its pages
    fail with the last error. A page the model says nothing about fails alone. Pages without input are not given to
    the model and fail as an empty sample.

    A task streams its pages and forms the batches as they pass, across Arrow batches, so it holds one model batch.
    Instead of a model a function that loads one may be given; it is called once per task, or once per worker
    process where the model has a ``name``.

    ``laid_out`` says that the pages of a document lie together and in order, as in a table written by
    ``write_keyed(pages, path, "doc_id", buckets, "batch", sort=("page_number",))``. Then images are not shuffled; a
    batch that lies across two splits of a large file is two calls. Otherwise pages are shuffled once, by document and runs of
    PAGES_PER_PART pages, so that one document holding most pages is many tasks.
    """
    if (model is None) == (load is None):
        raise ValueError("give a model or a function that loads one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = model if load is None else _kept_model(name, load)
        held: list[tuple] = []
        current = None
        for batch in batches:
            found: list[dict] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (row[0], None if row[1] is None else (row[1] - 1) // batch_size)
                if held and key != current:
                    found += _answered(held, answer, max_retry)
                    held = []
                current = key
                held.append(row)
            if found:
                yield pa.RecordBatch.from_pylist(found, _ARROW)
        if held:
            yield pa.RecordBatch.from_pylist(_answered(held, answer, max_retry), _ARROW)

    given = pages.select(F.col("doc_id").cast("long"), F.col("page_number").cast("int"), F.col(input_column))
    if not laid_out:
        # whole model batches per run, whatever the batch size
        run_of = F.floor((F.col("page_number") - 1) / (batch_size * max(PAGES_PER_PART // batch_size, 1)))
        given = given.repartition("doc_id", run_of).sortWithinPartitions("doc_id", "page_number")
    return given.mapInArrow(run, _INFERRED)
