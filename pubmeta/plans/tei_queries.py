"""Record extraction over one TEI document per order.

The documents are written from the given tables so that every rule has cases
that reach each of its alternatives; the check SQL derives the expected fields
from the same columns without looking at any XML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeta.operators.tei import cited_works, extract_metadata
from pubmeta.operators.tei_parse import tei_parse
from pubmeta.plans.base import Source, query
from pubmeta.sources.keyed import BUCKET
from pubmeta.sources.readers import read_tei
from pubmeta.sources.workspace import new_folder

REFERENCES = """
    SELECT l_orderkey, array_join(transform(
        array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_linestatus))),
        r -> '<biblStruct> <analytic> <title level="a">Part ' || r.l_partkey || '</title> <author> <persName>'
          || '<forename type="first">Supplier</forename> <surname>' || r.l_suppkey || '</surname> </persName> </author> </analytic>'
          || ' <monogr> <title level="j">J ' || r.l_returnflag || '</title> <imprint> <publisher>Pub ' || r.l_linestatus
          || '</publisher> <date when="' || date_format(r.l_shipdate, 'yyyy-MM-dd') || '"/> <biblScope unit="volume">'
          || r.l_linenumber || '</biblScope> <biblScope unit="page" from="' || r.l_partkey || '" to="' || (r.l_partkey + 9)
          || '"/> </imprint> </monogr> '
          || CASE WHEN r.l_partkey % 2 = 1 THEN '<idno type="DOI">10.1000/p' || r.l_partkey || '</idno>' ELSE '' END
          || ' </biblStruct>'), ' ') AS refs
    FROM {lineitem} GROUP BY l_orderkey
"""

DOCUMENTS = f"""
    WITH refs AS ({REFERENCES}),
    base AS (
      SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderpriority, date_format(o_orderdate, 'yyyy-MM-dd') AS day,
        substr(c_name, 10) AS surname, c_mktsegment AS seg, c_nationkey AS nation, coalesce(refs, '') AS refs
      FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey LEFT JOIN refs ON l_orderkey = o_orderkey),
    parts AS (SELECT *,
      CASE k % 6 WHEN 1 THEN '<title> </title> <title>Second</title>' ELSE '<title>Head ' || k || '</title>' END AS head,
      CASE k % 6 WHEN 1 THEN '<title level="m">Plain ' || k || '</title>' WHEN 2 THEN ''
        WHEN 3 THEN '<title level="A">Order\xa0 ' || k || '</title>' ELSE '<title level="a">Order ' || k || '</title>' END AS atitle,
      CASE k % 4 WHEN 1 THEN '<idno type="DOI">https://doi.org/10.1000/O' || k || '.</idno>'
        WHEN 2 THEN '<idno type="DOI">https://dx.doi.org/10.1000/o' || k || '</idno>' ELSE '' END AS aidno,
      CASE k % 4 WHEN 3 THEN '<idno type="doi">doi: 10.1000/o' || k || '</idno>' ELSE '' END AS midno,
      CASE k % 3 WHEN 0 THEN '<idno type="arXiv">arXiv:2204.' || k || 'v1[cs.DL]</idno>' ELSE '' END AS arxiv,
      CASE k % 8 WHEN 4 THEN ' available at doi:10.1000/b' || k || '. ' ELSE '' END AS body_doi,
      CASE k % 7 WHEN 0 THEN '<title level="m">Proceedings ' || k || '</title>' WHEN 1 THEN '<meeting>Meeting ' || k || '</meeting>'
        ELSE '<title level="j">Journal ' || o_orderpriority || '</title>' END AS mtitle,
      CASE k % 7 WHEN 1 THEN '<title>Series ' || o_orderstatus || '</title>' ELSE '' END AS ptitle,
      CASE k % 9 WHEN 0 THEN '<publisher>Pub ' || o_orderstatus || '</publisher>' ELSE '<publisher/>' END AS ppub,
      CASE k % 9 WHEN 1 THEN '<publisher>Mono ' || o_orderstatus || '</publisher>' ELSE '' END AS mpub,
      CASE WHEN k % 9 = 2 THEN ' Association for Computing Machinery ' ELSE '' END
        || CASE WHEN k % 11 = 0 THEN ' In Proceedings of the ' || (k % 90 + 4) || 'th ACM International Conference on ' || seg
          || ' Research (VEN ' || k % 100 || ') ' ELSE '' END AS acm,
      CASE k % 10 WHEN 0 THEN '<date when="">1990</date>' WHEN 1 THEN '<date>1997-03</date>'
        ELSE '<date when="' || day || '"/>' END AS date,
      CASE k % 2 WHEN 0 THEN '<biblScope unit="issue">' || left(o_orderpriority, 1) || '</biblScope>' ELSE '' END AS issue,
      CASE k % 3 WHEN 0 THEN '<biblScope unit="pp">12-15</biblScope>'
        WHEN 1 THEN '<biblScope unit="page" from="' || o_custkey || '" to="' || (o_custkey + 5) || '"/>'
        ELSE '<biblScope unit="page" from="' || o_custkey || '"/>' END AS page,
      CASE k % 5 WHEN 0 THEN ' role="corresp"' ELSE '' END AS c1, CASE k % 5 WHEN 1 THEN ' corresp="yes"' ELSE '' END AS c2,
      CASE k % 5 WHEN 2 THEN ' corresp="true"' ELSE '' END AS c3
      FROM base),
    docs AS (SELECT k,
      '<TEI xmlns="http://www.tei-c.org/ns/1.0"> <teiHeader> <fileDesc> <titleStmt> ' || head || ' </titleStmt> <publicationStmt> '
      || ppub || ' ' || ptitle || ' </publicationStmt> <sourceDesc> <biblStruct> <analytic> ' || atitle
      || ' <author' || c1 || '> <persName> <forename type="first">Customer</forename> <surname>' || surname || '</surname> </persName> <email>c'
      || o_custkey || '@example.org</email> <affiliation> <orgName>R&amp;D ' || seg || '</orgName> <orgName>r&amp;d ' || lower(seg)
      || '</orgName> <address> <addrLine>Street ' || k || '</addrLine> <country>NATION_' || nation || '</country> <postCode>1</postCode> </address> </affiliation> </author>'
      || ' <author' || c2 || '> <persName> <forename>Second</forename> <surname>Author</surname> </persName> </author> '
      || CASE k % 3 WHEN 0 THEN '<author' || c3 || '> <affiliation>Institute ' || k || '</affiliation> </author>'
           WHEN 1 THEN '<author> <persName>Solo ' || k || '</persName> </author>' ELSE '' END
      || ' ' || aidno || ' </analytic> <monogr> ' || mtitle || ' <imprint> ' || mpub || ' <biblScope unit="volume">' || o_custkey
      || '</biblScope> ' || issue || ' ' || page || ' ' || date || ' </imprint> ' || midno || ' </monogr> ' || arxiv
      || ' </biblStruct> </sourceDesc> </fileDesc> <profileDesc> <abstract> <p>Abstract of ' || k || '</p> </abstract> <textClass> <keywords> <term>'
      || lower(seg) || ' learning NLP, ' || o_orderpriority || '</term> <term>nlp,Extra</term> </keywords> </textClass> </profileDesc> </teiHeader>'
      || ' <text> <body> <p>' || body_doi || acm || '</p> </body> <back> <listBibl> ' || refs || ' </listBibl> </back> </text> </TEI>' AS xml
      FROM parts)
    SELECT k AS doc_id, CASE k % 50 WHEN 7 THEN left(xml, length(xml) - 20) WHEN 8 THEN ' ' WHEN 9 THEN NULL ELSE xml END AS xml
    FROM docs
"""


def tei_docs(s: Source, buckets: int | None = None) -> DataFrame:
    """The documents, spread evenly: the tables are dealt by order before the XML is built, so that it is not shuffled.

    With ``buckets`` they have the bucket of their key as ``BUCKET`` and each task has them sorted by it and the key,
    ready for ``write_keyed``: rows are sorted before the XML is built, too.
    """
    spark = s.spark
    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = DOCUMENTS
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        text = text.replace(f"{{{table}}}", f"(SELECT /*+ REPARTITION({parts}, {key}) */ * FROM {{{table}}})")
    if buckets is not None:
        bucket = f"CAST(pmod(xxhash64(o_orderkey), {buckets}) AS INT) AS {BUCKET}"
        text = text.replace("SELECT o_orderkey AS k,", f"SELECT {bucket}, o_orderkey AS k,")
        text = text.replace("ON l_orderkey = o_orderkey)", f"ON l_orderkey = o_orderkey SORT BY {BUCKET}, k)")
        text = text.replace("docs AS (SELECT k,", f"docs AS (SELECT {BUCKET}, k,")
        text = text.replace("SELECT k AS doc_id,", f"SELECT {BUCKET}, k AS doc_id,")
    return s.sql(text)


# Expected fields, computed from the columns. {tei} is the CTE all checks share.
TEI = """
    cited AS (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
        l_returnflag, l_linestatus) - 1 AS position FROM lineitem),
    cited_doi AS (
      SELECT l_orderkey, '10.1000/p' || CAST(arg_min(l_partkey, position) AS VARCHAR) AS doi FROM cited
      WHERE l_partkey % 2 = 1 GROUP BY l_orderkey),
    tei AS (
      SELECT o_orderkey AS k, *, CAST(o_orderkey AS VARCHAR) AS t, substr(c_name, 10) AS surname,
        'R&D ' || c_mktsegment || ', Street ' || CAST(o_orderkey AS VARCHAR) || ', NATION_' || CAST(c_nationkey AS VARCHAR) AS aff,
        o_orderkey % 50 IN (7, 8, 9) AS failed
      FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN cited_doi ON l_orderkey = o_orderkey)
"""


def expect(columns: str, where: str = "") -> str:
    """Check query giving ``columns`` per readable document and NULLs per unreadable one."""
    fields = [c.rsplit(" AS ", 1) for c in columns.split(" ;; ")]
    body = ", ".join(f"CASE WHEN failed THEN NULL ELSE {expr} END AS {name}" for expr, name in fields)
    return f"WITH {TEI} SELECT k AS doc_id, {body} FROM tei {where}"


DOI = """CASE k % 4 WHEN 1 THEN '10.1000/O' || t WHEN 2 THEN '10.1000/o' || t WHEN 3 THEN '10.1000/o' || t
    ELSE CASE WHEN k % 8 = 4 THEN '10.1000/b' || t ELSE doi END END"""
DOI_SOURCE = f"CASE WHEN k % 4 IN (1, 3) THEN 'GROBID' WHEN ({DOI}) IS NOT NULL THEN 'REGEX' END"
TITLE = "CASE k % 6 WHEN 1 THEN 'Plain ' || t WHEN 2 THEN 'Head ' || t ELSE 'Order ' || t END"
JOURNAL = "CASE k % 7 WHEN 0 THEN 'Proceedings ' || t WHEN 1 THEN 'Series ' || o_orderstatus ELSE 'Journal ' || o_orderpriority END"
PUBLISHER = """CASE k % 9 WHEN 0 THEN 'Pub ' || o_orderstatus WHEN 1 THEN 'Mono ' || o_orderstatus
    ELSE CASE WHEN k % 9 = 2 OR k % 11 = 0 THEN 'ACM' END END"""
VENUE = """CASE WHEN k % 7 = 1 THEN 'Meeting ' || t WHEN k % 11 = 0 THEN 'VEN ' || CAST(k % 100 AS VARCHAR)
    WHEN k % 7 = 0 THEN 'Proceedings ' || t END"""
CONFERENCE = """CASE WHEN k % 11 = 0 THEN CAST(k % 90 + 4 AS VARCHAR) || 'th ACM International Conference on '
    || c_mktsegment || ' Research' END"""
YEAR = "CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN 1997 ELSE CAST(extract(year FROM o_orderdate) AS INTEGER) END"
PAGES = """CASE k % 3 WHEN 0 THEN '12-15' WHEN 1 THEN CAST(o_custkey AS VARCHAR) || '-' || CAST(o_custkey + 5 AS VARCHAR)
    ELSE CAST(o_custkey AS VARCHAR) END"""
CORRESPONDING = """CASE k % 5 WHEN 0 THEN 'Customer ' || surname || ' <c' || CAST(o_custkey AS VARCHAR) || '@example.org>'
    WHEN 1 THEN 'Second Author' END"""
ISSUE = "CASE k % 2 WHEN 0 THEN left(o_orderpriority, 1) END"
ARXIV = "CASE k % 3 WHEN 0 THEN '2204.' || t || 'v1' END"


def header(s: Source, wanted: tuple[str, ...], *columns) -> DataFrame:
    return extract_metadata(tei_docs(s), references=False, wanted=wanted).select("doc_id", *columns)


def register_header(name: str, columns: str, *names: str) -> None:
    query(name, expect(columns))(lambda s: header(s, names, *names))


@query(
    "src2_read_tei",
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 50 IN (8, 9) THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS number
       FROM orders""",
)
def _(s: Source) -> DataFrame:
    path = new_folder(s.spark, "tei")
    tei_docs(s).write.parquet(path)
    number = F.coalesce(F.regexp_extract("xml", r"<abstract> <p>Abstract of (\d+)", 1), F.lit(""))
    return read_tei(s.spark, path).select("doc_id", number.alias("number"))


@query(
    "udf1_tei_parse",
    f"""WITH {TEI}, n AS (SELECT l_orderkey AS lk, count(*) AS refs FROM lineitem GROUP BY l_orderkey)
        SELECT k AS doc_id, failed, CASE WHEN NOT failed THEN CAST(CASE k % 3 WHEN 2 THEN 2 ELSE 3 END AS INTEGER) END AS authors,
          CASE WHEN NOT failed THEN CAST(coalesce(n.refs, 0) AS INTEGER) END AS refs
        FROM tei LEFT JOIN n ON n.lk = k""",
)
def _(s: Source) -> DataFrame:
    parsed = tei_parse(tei_docs(s), fields=("authors", "refs"))
    ok = F.col("raw.err").isNull()
    return parsed.select(
        "doc_id",
        (~ok).alias("failed"),
        F.when(ok, F.size("raw.authors")).alias("authors"),
        F.when(ok, F.size("raw.refs")).alias("refs"),
    )


@query("tei0_anchors", expect("t AS number ;; surname AS surname ;; CAST(o_custkey AS VARCHAR) AS volume"))
def _(s: Source) -> DataFrame:
    raw = tei_parse(tei_docs(s), fields=("abstracts", "authors", "scopes"))
    surname = F.get("raw.authors", F.lit(0))["pers"]["surname"]
    number = F.regexp_extract(F.get("raw.abstracts", F.lit(0)), r"(\d+)", 1)
    volume = F.get(F.filter("raw.scopes", lambda x: x["unit"] == "volume"), F.lit(0))["text"]
    return raw.select("doc_id", number.alias("number"), surname.alias("surname"), volume.alias("volume"))


register_header("tei1_title", f"{TITLE} AS title", "title")
register_header("tei2_doi", f"{DOI} AS doi ;; {DOI_SOURCE} AS doi_source", "doi", "doi_source")
register_header("tei3_arxiv_id", f"{ARXIV} AS arxiv_id", "arxiv_id")
register_header("tei4_journal", f"{JOURNAL} AS journal ;; 'GROBID' AS journal_source", "journal", "journal_source")
register_header("tei5_publisher", f"{PUBLISHER} AS publisher", "publisher")
register_header("tei6_venue", f"{VENUE} AS venue", "venue")
register_header("tei7_conference_name", f"{CONFERENCE} AS conference_name", "conference_name")
register_header("tei8_publication_year", f"{YEAR} AS publication_year", "publication_year")
register_header("tei9_volume_issue", f"CAST(o_custkey AS VARCHAR) AS volume ;; {ISSUE} AS issue", "volume", "issue")
register_header("tei10_pages", f"{PAGES} AS pages", "pages")
register_header("tei11_abstract", "'Abstract of ' || t AS abstract", "abstract")
register_header("tei17_corresponding_author", f"{CORRESPONDING} AS corresponding_author", "corresponding_author")


@query(
    "tei12_keywords",
    expect("lower(c_mktsegment) || ' learning|NLP|' || o_orderpriority || '|Extra' AS keywords"),
)
def _(s: Source) -> DataFrame:
    return header(s, ("keywords",), F.array_join("keywords", "|").alias("keywords"))


AUTHOR_ROWS = f"""
    WITH {TEI}
    SELECT k AS doc_id, 0 AS position, 'Customer' AS first_name, surname AS last_name, 'Customer ' || surname AS full_name,
      'c' || CAST(o_custkey AS VARCHAR) || '@example.org' AS email, aff AS affiliation FROM tei WHERE NOT failed
    UNION ALL
    SELECT k, 1, 'Second', 'Author', 'Second Author', NULL, CASE k % 3 WHEN 0 THEN 'Institute ' || t ELSE aff END
    FROM tei WHERE NOT failed
    UNION ALL
    SELECT k, 2, NULL, NULL, 'Solo ' || t, NULL, aff FROM tei WHERE NOT failed AND k % 3 = 1
"""


def author_rows(s: Source, *columns: str) -> DataFrame:
    # an inner explode would be given a filter on the size of the list, which works the list out a second time
    rows = header(s, ("authors",), F.posexplode_outer("authors").alias("position", "author"))
    return rows.where("position IS NOT NULL").select("doc_id", "position", *[f"author.{c}" for c in columns])


def pick(columns: str) -> str:
    return f"SELECT doc_id, position, {columns} FROM ({AUTHOR_ROWS})"


@query("tei13_authors", pick("full_name, affiliation"))
def _(s: Source) -> DataFrame:
    return author_rows(s, "full_name", "affiliation")


@query("tei14_person", pick("first_name, last_name, full_name, email"))
def _(s: Source) -> DataFrame:
    return author_rows(s, "first_name", "last_name", "full_name", "email")


@query("tei15_format_affiliation", f"WITH {TEI} SELECT k AS doc_id, aff AS affiliation FROM tei WHERE NOT failed")
def _(s: Source) -> DataFrame:
    return author_rows(s, "affiliation").where("position = 0").select("doc_id", "affiliation")


@query(
    "tei16_affiliation_fallback",
    f"""WITH {TEI} SELECT k AS doc_id, CASE k % 3 WHEN 0 THEN 'Institute ' || t ELSE aff END AS affiliation
        FROM tei WHERE NOT failed""",
)
def _(s: Source) -> DataFrame:
    return author_rows(s, "affiliation").where("position = 1").select("doc_id", "affiliation")


CITED = f"""
    WITH {TEI}
    SELECT k AS doc_id, CAST(c.position AS INTEGER) AS position, 'Part ' || CAST(c.l_partkey AS VARCHAR) AS title,
      'Supplier ' || CAST(c.l_suppkey AS VARCHAR) AS author, 'J ' || c.l_returnflag AS journal, 'Pub ' || c.l_linestatus AS publisher,
      CAST(extract(year FROM c.l_shipdate) AS INTEGER) AS publication_year, CAST(c.l_linenumber AS VARCHAR) AS volume,
      CAST(c.l_partkey AS VARCHAR) || '-' || CAST(c.l_partkey + 9 AS VARCHAR) AS pages,
      CASE WHEN c.l_partkey % 2 = 1 THEN '10.1000/p' || CAST(c.l_partkey AS VARCHAR) END AS doi,
      'Part ' || CAST(c.l_partkey AS VARCHAR) || ' Supplier ' || CAST(c.l_suppkey AS VARCHAR) || ' J ' || c.l_returnflag || ' Pub '
        || c.l_linestatus || ' ' || CAST(c.l_linenumber AS VARCHAR)
        || CASE WHEN c.l_partkey % 2 = 1 THEN ' 10.1000/p' || CAST(c.l_partkey AS VARCHAR) ELSE '' END AS raw_text
    FROM tei JOIN cited c ON c.l_orderkey = k WHERE NOT failed
"""


@query("tei18_references", CITED)
def _(s: Source) -> DataFrame:
    names = ("title", "authors", "journal", "publisher", "publication_year", "volume", "pages", "doi", "raw_text")
    rows = cited_works(tei_docs(s), names).where("position IS NOT NULL")
    author = F.get("authors", F.lit(0))["full_name"].alias("author")
    return rows.select("doc_id", "position", *[author if n == "authors" else n for n in names])


@query(
    "tei19_explode_references",
    f"""SELECT o_orderkey AS doc_id, position, title, doi FROM orders LEFT JOIN ({CITED}) ON doc_id = o_orderkey""",
)
def _(s: Source) -> DataFrame:
    return cited_works(tei_docs(s), ("title", "doi"))


@query(
    "tei20_extract_with_status",
    f"""WITH {TEI} SELECT k AS doc_id, CASE WHEN failed THEN 'Failed' ELSE 'Completed' END AS extraction_status,
          CASE WHEN k % 50 IN (8, 9) THEN 'GROBID service returned an invalid response.' WHEN failed THEN 'parse error' END AS message
        FROM tei""",
)
def _(s: Source) -> DataFrame:
    rows = extract_metadata(tei_docs(s), wanted=())
    message = F.when(F.col("extraction_error").startswith("GROBID"), F.col("extraction_error")).when(
        F.length("extraction_error") > 0, F.lit("parse error")
    )
    return rows.select("doc_id", "extraction_status", message.alias("message"))
