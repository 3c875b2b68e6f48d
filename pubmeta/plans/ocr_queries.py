"""Page normalisation, assembly and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeta.operators import ocr as O
from pubmeta.plans.base import Source, query
from pubmeta.sources.keyed import write_keyed
from pubmeta.sources.workspace import new_folder

MARKDOWN = """
    CASE WHEN trim(prediction) = '[MISSING_PAGE_POST]'
           THEN chr(10) || chr(10) || '[MISSING_PAGE_EMPTY:' || CAST(page_number AS VARCHAR) || ']' || chr(10) || chr(10)
         WHEN repeats > 0
           THEN chr(10) || chr(10) || '[MISSING_PAGE_FAIL:' || CAST(page_number AS VARCHAR) || ']' || chr(10) || chr(10)
         WHEN repeats <= 0
           THEN chr(10) || chr(10) || '[MISSING_PAGE_EMPTY:' || CAST(page_number AS VARCHAR) || ']' || chr(10) || chr(10)
         ELSE prediction END
"""
STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
JOINED = (
    "regexp_replace(string_agg("
    + STRIP.format(c="markdown")
    + r", chr(10) || chr(10) ORDER BY page_number) FILTER (WHERE success), '\n{{3,}}', chr(10) || chr(10), 'g')"
).replace("{{3,}}", "{3,}")


def pages(s: Source) -> DataFrame:
    return O.page_markdown(s.view("ocr_pages"))


def uploads(s: Source) -> DataFrame:
    """Documents of the page table and of the text table, some of them not PDFs or empty."""
    kind = F.when(F.col("doc_id") % 11 == 2, "text/plain").otherwise("application/x-pdf")
    size = F.when(F.col("doc_id") % 13 == 0, F.lit(0)).otherwise(F.col("n_chars"))
    return s.table("documents").select("doc_id", kind.alias("content_type"), size.alias("length"))


@query(
    "agg1_assemble_pages",
    f"""SELECT doc_id, 0 AS part, coalesce({STRIP.format(c=JOINED)}, '') AS markdown, count(*) AS pages
        FROM (SELECT *, {MARKDOWN} AS markdown FROM ocr_pages) GROUP BY doc_id""",
)
def _(s: Source) -> DataFrame:
    return O.assemble_pages(pages(s))


@query(
    "agg1_assemble_in_parts",
    f"""SELECT doc_id, CAST((page_number - 1) // 3 AS INTEGER) AS part, coalesce({STRIP.format(c=JOINED)}, '') AS markdown,
          count(*) AS pages
        FROM (SELECT *, {MARKDOWN} AS markdown FROM ocr_pages) GROUP BY doc_id, CAST((page_number - 1) // 3 AS INTEGER)""",
)
def _(s: Source) -> DataFrame:
    return O.assemble_pages(pages(s), pages_per_part=3)


@query(
    "topk3_page_order",
    """SELECT doc_id, string_agg('page ' || CAST(page_number AS VARCHAR), chr(10) || chr(10) ORDER BY page_number) AS page_order
       FROM ocr_pages GROUP BY doc_id""",
)
def _(s: Source) -> DataFrame:
    numbered = F.concat(F.lit("page "), F.col("page_number").cast("string"))
    named = s.view("ocr_pages").select("doc_id", "page_number", F.lit(True).alias("success"), numbered.alias("markdown"))
    return O.assemble_pages(named).select("doc_id", F.col("markdown").alias("page_order"))


@query("agg2_normalize_prediction", f"SELECT doc_id, page_number, {MARKDOWN} AS markdown FROM ocr_pages")
def _(s: Source) -> DataFrame:
    return pages(s).select("doc_id", "page_number", "markdown")


FAILED = """
    SELECT doc_id, 'OCR failed for page(s): ' || string_agg(CAST(page_number AS VARCHAR), ', ' ORDER BY page_number) AS error
    FROM ocr_pages WHERE NOT success GROUP BY doc_id
"""


@query("agg3_failed_pages", FAILED)
def _(s: Source) -> DataFrame:
    return O.failed_pages(s.view("ocr_pages"))


@query(
    "agg4_ocr_outcome",
    f"""
    WITH p AS (SELECT doc_id, count(*) AS pages FROM ocr_pages GROUP BY doc_id), f AS ({FAILED}),
    r AS (
      SELECT d.doc_id, p.pages, CASE WHEN d.doc_id % 11 = 2 THEN 'Only PDF files are supported.'
          WHEN d.doc_id % 13 = 0 THEN 'Uploaded PDF is empty.' WHEN f.error IS NOT NULL THEN f.error
          WHEN p.pages IS NULL THEN 'Nougat returned empty markdown.' END AS error
      FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id)
    SELECT doc_id, error IS NULL AS success,
      CASE WHEN error IS NULL OR error LIKE 'Nougat%' THEN coalesce(pages, 0) END AS pages, error FROM r
    """,
)
def _(s: Source) -> DataFrame:
    return O.ocr_outcome(uploads(s), pages(s))


INFERRED = """
    WITH b AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_number, text, turn // 2 AS batch,
        turn % 11 = 7 AS lost FROM conversations),
    bad AS (SELECT DISTINCT doc_id, batch FROM b WHERE contains(text, 'è') AND NOT lost)
    SELECT b.doc_id, b.page_number, bad.batch IS NULL AND NOT lost AS success,
      CASE WHEN bad.batch IS NULL AND NOT lost THEN 1 ELSE 3 END AS attempts,
      CASE WHEN lost THEN 'Nougat dataloader returned empty sample.' WHEN bad.batch IS NOT NULL THEN 'unreadable batch' END AS error,
      CASE WHEN bad.batch IS NULL AND NOT lost THEN CAST(length(b.text) AS INTEGER) END AS chars
    FROM b LEFT JOIN bad ON bad.doc_id = b.doc_id AND bad.batch = b.batch
"""


def images(s: Source) -> DataFrame:
    """Every eleventh page of a document has lost its image."""
    return s.table("conversations").select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
        F.when(F.col("turn") % 11 != 7, F.col("text")).alias("image"),
    )


def loader():
    """A function that loads the model; local ones travel with the task."""

    def load():
        def model(inputs: list) -> dict:
            if any("è" in text for text in inputs):
                raise ValueError("unreadable batch")
            return {"predictions": list(inputs), "repeats": []}

        return model

    return load


def inferred(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "page_number", "success", "attempts", "error", F.length("prediction").alias("chars"))


@query("udf2_infer_pages", INFERRED)
def _(s: Source) -> DataFrame:
    return inferred(O.infer_pages(images(s), loader()()))


@query("udf2_infer_stored_pages", INFERRED)
def _(s: Source) -> DataFrame:
    """The same from a table laid out by document: no image is shuffled, the model is loaded once per worker."""
    pages = images(s).withColumn("batch", F.floor((F.col("page_number") - 1) / 2))
    table = write_keyed(pages, new_folder(s.spark, "images"), "doc_id", 4, "batch", sort=("page_number",)).table()
    return inferred(O.infer_pages(table, load=loader(), name="marks", laid_out=True))
