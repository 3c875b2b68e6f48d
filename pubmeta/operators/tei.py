"""Bibliographic record rules over parsed TEI documents.

Within each rule only the first matching node counts: when its text is blank
the next rule is tried, never the next node.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeta.functions.collections import bind, distinct_ignore_case
from pubmeta.functions.text import (
    acm_conference,
    acm_venue,
    attr_equals,
    extract_doi,
    format_pages,
    mentions_acm,
    normalize_arxiv,
    normalize_doi,
    parse_year,
    split_keywords,
)
from pubmeta.operators.tei_parse import tei_parse
from pubmeta.schemas import (
    AUTHOR_DDL,
    COMPLETED,
    FAILED,
    INVALID_TEI,
    METADATA_FIELDS_DDL,
    struct_type,
)


def _at(arr: Column, i: int = 0) -> Column:
    return F.get(arr, F.lit(i))


def _first_where(nodes: Column, attr: str, *values: str) -> Column:
    def matches(node: Column) -> Column:
        hit = attr_equals(node[attr], values[0])
        for value in values[1:]:
            hit = hit | attr_equals(node[attr], value)
        return hit

    return _at(F.filter(nodes, matches))


def _text_where(nodes: Column, attr: str, *values: str) -> Column:
    return _first_where(nodes, attr, *values)["text"]


# --- people -----------------------------------------------------------------


def format_affiliation(aff: Column) -> Column:
    """Organisations (distinct, ignoring case), then address parts; none gives the whole text."""
    parts = F.concat(distinct_ignore_case(aff["orgs"]), aff["addr"])
    return F.coalesce(F.nullif(F.array_join(parts, ", "), F.lit("")), aff["text"])


def _names(pers: Column) -> tuple[Column, Column, Column]:
    first = F.coalesce(_text_where(pers["forenames"], "type", "first"), _at(pers["forenames"])["text"])
    middle = _text_where(pers["forenames"], "type", "middle")
    return first, middle, pers["surname"]


def _full_name(pers: Column) -> Column:
    """Parsed names are trimmed already, and NULL when blank."""
    return F.coalesce(F.nullif(F.concat_ws(" ", *_names(pers)), F.lit("")), pers["text"])


def person(author: Column) -> Column:
    """Author node with a name as an author struct."""
    first, middle, last = _names(author["pers"])
    return F.struct(
        first.alias("first_name"),
        middle.alias("middle_name"),
        last.alias("last_name"),
        _full_name(author["pers"]).alias("full_name"),
        author["email"].alias("email"),
        format_affiliation(_at(author["affs"])).alias("affiliation"),
    )


def parse_authors(nodes: Column) -> Column:
    """Named authors; one without an affiliation borrows from the pool of all author nodes.

    A pool of one serves everybody. A larger pool is read at the author's own
    position among the accepted authors.
    """
    affiliations = F.transform(F.flatten(F.transform(nodes, lambda n: n["affs"])), format_affiliation)
    pool = distinct_ignore_case(F.filter(affiliations, lambda a: a.isNotNull()))
    named = F.filter(nodes, lambda n: n["pers"].isNotNull())
    people = F.filter(F.transform(named, person), lambda p: p["full_name"].isNotNull())

    def fill(shared: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            borrowed = F.when(F.size(shared) == 1, _at(shared)).otherwise(F.get(shared, i))
            return p.withField("affiliation", F.coalesce(p["affiliation"], borrowed))

        return F.transform(people, one)

    return F.coalesce(bind(pool, fill), F.array().cast(f"array<struct<{AUTHOR_DDL}>>"))


def corresponding_author(nodes: Column) -> Column:
    """``Full Name <email>`` of the first author marked as corresponding."""

    def marked(n: Column) -> Column:
        return (
            attr_equals(n["role"], "corresp") | attr_equals(n["corresp"], "yes") | attr_equals(n["corresp"], "true")
        )

    author = _at(F.filter(nodes, marked))
    name = _full_name(author["pers"])
    with_mail = F.concat(F.coalesce(name, F.lit("")), F.lit(" <"), author["email"], F.lit(">"))
    return F.when(author["pers"].isNotNull(), F.coalesce(with_mail, name))


# --- header fields ----------------------------------------------------------


def title(raw: Column) -> Column:
    return F.coalesce(
        _text_where(raw["analytic_titles"], "level", "a"),
        _at(raw["titlestmt_titles"]),
        _at(raw["analytic_titles"])["text"],
    )


def header_doi(raw: Column) -> Column:
    return normalize_doi(
        F.coalesce(_text_where(raw["idnos_analytic"], "type", "doi"), _text_where(raw["idnos_bibl"], "type", "doi"))
    )


def arxiv_id(raw: Column) -> Column:
    return normalize_arxiv(_text_where(raw["idnos_bibl"], "type", "arxiv"))


def journal(raw: Column) -> Column:
    return F.coalesce(
        _text_where(raw["monogr_titles"], "level", "j"),
        _at(raw["pubstmt_titles"]),
        _text_where(raw["sourcedesc_titles"], "level", "j"),
        _at(raw["monogr_titles"])["text"],
    )


def publisher(raw: Column) -> Column:
    return F.coalesce(
        _at(raw["pubstmt_publishers"]),
        _at(raw["monogr_publishers"]),
        F.when(mentions_acm(raw["all_text"]), F.lit("ACM")),
    )


def venue(raw: Column, conference: Column) -> Column:
    """A generic or missing venue gives way to the short name in an ACM proceedings line."""
    stated = F.coalesce(_text_where(raw["monogr_titles"], "level", "m"), _at(raw["meetings"]))
    replaceable = stated.isNull() | stated.rlike("(?i)Proceedings|Conference")
    return F.when(conference.isNotNull() & replaceable, acm_venue(raw["all_text"])).otherwise(stated)


def year(dates: Column) -> Column:
    date = _at(dates)
    return parse_year(date["when"], date["text"])


def pages(scopes: Column) -> Column:
    ranged = _first_where(scopes, "unit", "page")
    return format_pages(_text_where(scopes, "unit", "page", "pp"), ranged["first"], ranged["last"])


#: What each column of a cited work reads of a parsed reference, and its rule.
REFERENCE_RULES = {
    "title": (
        ("analytic_titles", "text"),
        lambda ref: F.coalesce(
            _text_where(ref["analytic_titles"], "level", "a"), _at(ref["analytic_titles"])["text"], ref["text"]
        ),
    ),
    "authors": (("authors",), lambda ref: parse_authors(ref["authors"])),
    "journal": (
        ("monogr_titles",),
        lambda ref: F.coalesce(_text_where(ref["monogr_titles"], "level", "j"), _at(ref["monogr_titles"])["text"]),
    ),
    "publisher": (("publishers",), lambda ref: _at(ref["publishers"])),
    "publication_year": (("dates",), lambda ref: year(ref["dates"])),
    "volume": (("scopes",), lambda ref: _text_where(ref["scopes"], "unit", "volume")),
    "issue": (("scopes",), lambda ref: _text_where(ref["scopes"], "unit", "issue")),
    "pages": (("scopes",), lambda ref: pages(ref["scopes"])),
    "raw_text": (("text",), lambda ref: ref["text"]),
    "doi": (("idnos",), lambda ref: normalize_doi(_text_where(ref["idnos"], "type", "doi"))),
}


def reference(ref: Column) -> Column:
    return F.struct(*[rule(ref).alias(name) for name, (_, rule) in REFERENCE_RULES.items()])


# --- the job ----------------------------------------------------------------

#: What each metadata column reads of a parsed document.
READS = {
    "title": ("analytic_titles", "titlestmt_titles"),
    "abstract": ("abstracts",),
    "doi": ("idnos_analytic", "idnos_bibl", "all_text"),
    "arxiv_id": ("idnos_bibl",),
    "journal": ("monogr_titles", "pubstmt_titles", "sourcedesc_titles"),
    "publisher": ("pubstmt_publishers", "monogr_publishers", "all_text"),
    "venue": ("monogr_titles", "meetings", "all_text"),
    "conference_name": ("all_text",),
    "publication_year": ("dates",),
    "volume": ("scopes",),
    "issue": ("scopes",),
    "pages": ("scopes",),
    "corresponding_author": ("authors",),
    "metadata_source": (),
    "doi_source": ("idnos_analytic", "idnos_bibl", "all_text"),
    "journal_source": ("monogr_titles", "pubstmt_titles", "sourcedesc_titles"),
    "keywords": ("terms",),
    "authors": ("authors",),
    "references": ("refs",),
}
#: Columns that need a search of the text.
SEARCHED = {"_doi": {"doi", "doi_source"}, "_text_doi": {"doi", "doi_source"}, "_conference": {"venue", "conference_name"}}


@lru_cache(maxsize=2)
def _record_columns(application_id: str) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """The rule expressions: text searches, the search that depends on them, the fields.

    Putting them together takes seconds of calls into the JVM, and they are the
    same for every input, so a streaming job does it once and not per batch.
    """
    raw = F.col("raw")
    searches = {"_doi": header_doi(raw), "_conference": acm_conference(raw["all_text"])}
    fallback = {"_text_doi": F.when(F.col("_doi").isNull(), normalize_doi(extract_doi(raw["all_text"])))}
    stated_journal = journal(raw)
    fields = {
        "title": title(raw),
        "abstract": _at(raw["abstracts"]),
        "doi": F.coalesce("_doi", "_text_doi"),
        "arxiv_id": arxiv_id(raw),
        "journal": stated_journal,
        "publisher": publisher(raw),
        "venue": venue(raw, F.col("_conference")),
        "conference_name": F.col("_conference"),
        "publication_year": year(raw["dates"]),
        "volume": _text_where(raw["scopes"], "unit", "volume"),
        "issue": _text_where(raw["scopes"], "unit", "issue"),
        "pages": pages(raw["scopes"]),
        "corresponding_author": corresponding_author(raw["authors"]),
        "metadata_source": F.lit("GROBID"),
        "doi_source": F.when(F.col("_doi").isNotNull(), "GROBID").when(F.col("_text_doi").isNotNull(), "REGEX"),
        "journal_source": F.when(stated_journal.isNotNull(), "GROBID"),
        "keywords": split_keywords(raw["terms"]),
        "authors": parse_authors(raw["authors"]),
        "references": F.transform(raw["refs"], reference),
    }
    return searches, fallback, fields


def _metadata_fields(wanted: Collection[str] | None) -> list:
    return [f for f in struct_type(METADATA_FIELDS_DDL) if wanted is None or f.name in wanted]


def extract_record(parsed: DataFrame, wanted: Collection[str] | None = None) -> DataFrame:
    """``raw`` of each parsed document to the metadata columns (all, or those ``wanted``) plus ``parse_error``."""
    keep = [c for c in parsed.columns if c != "raw"]
    searches, fallback, fields = _record_columns(parsed.sparkSession.sparkContext.applicationId)
    # The text searches run once per document; the fields only read their results.
    searched = parsed
    for columns in (searches, fallback):
        needed = {n: c for n, c in columns.items() if wanted is None or SEARCHED[n] & set(wanted)}
        searched = searched.withColumns(needed) if needed else searched
    columns = [fields[f.name].cast(f.dataType).alias(f.name) for f in _metadata_fields(wanted)]
    return searched.select(*keep, *columns, F.col("raw.err").alias("parse_error"))


def extract_metadata(
    docs: DataFrame, references: bool = True, keep_xml: bool = False, wanted: Collection[str] | None = None
) -> DataFrame:
    """TEI documents ``(doc_id, xml)`` to one metadata row each, with a status.

    A blank or malformed document gives a Failed row with a message; it never
    fails the job. ``wanted`` names the metadata columns to return, all by
    default; of the documents only what these read is listed.
    """
    reads = None if wanted is None else {raw for name in wanted for raw in READS[name]}
    record = extract_record(tei_parse(docs, references, keep_xml, reads), wanted)
    failed = F.col("parse_error").isNotNull()
    columns = [F.when(~failed, F.col(f.name)).alias(f.name) for f in _metadata_fields(wanted)]
    keep = [c for c in record.columns if c in ("doc_id", "xml")]
    return record.select(
        *keep,
        *columns,
        F.when(failed, FAILED).otherwise(COMPLETED).alias("extraction_status"),
        F.coalesce(F.nullif("parse_error", F.lit("")), F.when(failed, F.lit(INVALID_TEI))).alias("extraction_error"),
    )


def explode_references(metadata: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per cited work with its position in the list; papers without references keep one row."""
    return metadata.select(id_column, F.posexplode_outer("references").alias("position", "reference")).select(
        id_column, "position", "reference.*"
    )


def cited_works(docs: DataFrame, wanted: Collection[str] | None = None) -> DataFrame:
    """``explode_references`` of the records of ``docs``, with the columns ``wanted`` of a cited work.

    The parsed references become rows before the rules are applied, so only the
    wanted columns are read and worked out, each once per reference.
    """
    names = [n for n in REFERENCE_RULES if wanted is None or n in wanted]
    reads = {raw for n in names for raw in REFERENCE_RULES[n][0]}
    parsed = tei_parse(docs, fields=("refs",), reference_fields=reads)
    rows = parsed.select("doc_id", F.posexplode_outer("raw.refs").alias("position", "ref"))
    ref, types = F.col("ref"), struct_type(METADATA_FIELDS_DDL)["references"].dataType.elementType
    columns = [REFERENCE_RULES[n][1](ref).cast(types[n].dataType) for n in names]
    return rows.select("doc_id", "position", *[F.when(ref.isNotNull(), c).alias(n) for n, c in zip(names, columns)])
