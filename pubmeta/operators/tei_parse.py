"""XML to nested columns: the one step the JVM-side functions cannot do exactly.

The parser only lists candidate nodes with their text and attributes, in
document order. Which candidate wins is decided by column expressions in
``pubmeta.operators.tei``.
"""

from __future__ import annotations

import re
import sys
import xml.etree.ElementTree as ET
from collections.abc import Collection, Iterable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pubmeta.schemas import INVALID_TEI, struct_type

# Executors receive these functions by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NS = "{http://www.tei-c.org/ns/1.0}"
_ANALYTIC, _MONOGR, _IDNO_TAG, _PUBLISHER, _EMAIL = (NS + n for n in ("analytic", "monogr", "idno", "publisher", "email"))
_TITLE_TAG, _AUTHOR_TAG, _DATE_TAG, _SCOPE_TAG = (NS + n for n in ("title", "author", "date", "biblScope"))
_PERSON, _FORENAME, _SURNAME, _AFFILIATION = (NS + n for n in ("persName", "forename", "surname", "affiliation"))
ADDRESS_PARTS = {NS + name for name in ("addrLine", "settlement", "region", "country")}

#: The elements below which a field is looked for, where these are a small part of most documents.
HOLDERS = {"abstracts": "profileDesc", "terms": "textClass"}

#: What may be listed of a reference.
REFERENCE_FIELDS = ("text", "analytic_titles", "authors", "monogr_titles", "idnos", "publishers", "dates", "scopes")

#: The element that a field of a document's header is read from, which is below its ``fileDesc``.
HEADER_ELEMENTS = {
    "analytic_titles": "title",
    "titlestmt_titles": "title",
    "pubstmt_titles": "title",
    "sourcedesc_titles": "title",
    "monogr_titles": "title",
    "meetings": "meeting",
    "idnos_analytic": "idno",
    "idnos_bibl": "idno",
    "pubstmt_publishers": "publisher",
    "monogr_publishers": "publisher",
    "dates": "date",
    "scopes": "biblScope",
    "authors": "author",
}
_HEADER_PARTS = ("fileDesc", "titleStmt", "publicationStmt", "sourceDesc", "biblStruct", "analytic", "monogr")

_ROOT_TAG = re.compile(r"\s*(?:<\?[^<>]*\?>\s*)?<([^\s/<>!?]+)[^<>]*>")

# Parsed documents held as Python objects at one time.
DOCUMENTS_PER_STEP = 128

_TITLE = "STRUCT<level: STRING, text: STRING>"
_IDNO = "STRUCT<type: STRING, text: STRING>"
_DATE = "STRUCT<`when`: STRING, text: STRING>"
_SCOPE = "STRUCT<unit: STRING, text: STRING, first: STRING, last: STRING>"
_AUTHOR = (
    "STRUCT<role: STRING, corresp: STRING, "
    "pers: STRUCT<text: STRING, forenames: ARRAY<STRUCT<type: STRING, text: STRING>>, surname: STRING>, "
    "email: STRING, affs: ARRAY<STRUCT<orgs: ARRAY<STRING>, addr: ARRAY<STRING>, text: STRING>>>"
)
_REF = (
    f"STRUCT<text: STRING, analytic_titles: ARRAY<{_TITLE}>, authors: ARRAY<{_AUTHOR}>, "
    f"monogr_titles: ARRAY<{_TITLE}>, publishers: ARRAY<STRING>, idnos: ARRAY<{_IDNO}>, "
    f"dates: ARRAY<{_DATE}>, scopes: ARRAY<{_SCOPE}>>"
)
RAW_DDL = (
    f"err STRING, all_text STRING, analytic_titles ARRAY<{_TITLE}>, titlestmt_titles ARRAY<STRING>, "
    f"pubstmt_titles ARRAY<STRING>, sourcedesc_titles ARRAY<{_TITLE}>, monogr_titles ARRAY<{_TITLE}>, "
    f"meetings ARRAY<STRING>, idnos_analytic ARRAY<{_IDNO}>, idnos_bibl ARRAY<{_IDNO}>, "
    f"pubstmt_publishers ARRAY<STRING>, monogr_publishers ARRAY<STRING>, dates ARRAY<{_DATE}>, "
    f"scopes ARRAY<{_SCOPE}>, abstracts ARRAY<STRING>, terms ARRAY<STRING>, authors ARRAY<{_AUTHOR}>, "
    f"refs ARRAY<{_REF}>"
)


def _text(el: ET.Element | None) -> str | None:
    if el is None:
        return None
    text = "".join(el.itertext()) if len(el) else el.text
    return (" ".join(text.split()) or None) if text else None


def _children(el: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if el is None else el.findall(NS + name)


def _child(el: ET.Element | None, name: str) -> ET.Element | None:
    return None if el is None else el.find(NS + name)


def _below(el: ET.Element | None, *names: str) -> list[ET.Element]:
    """Elements reached by going down to each name in turn, once each, in document order."""
    found = [] if el is None else [x for x in el.iter(NS + names[0]) if x is not el]
    for name in names[1:]:
        tag = NS + name
        found = list(dict.fromkeys(x for up in found for x in up.iter(tag) if x is not up))
    return found


def _texts(elements: list[ET.Element]) -> list[str | None]:
    return [_text(x) for x in elements]


def _titles(parent: ET.Element | None) -> list[dict]:
    return [{"level": x.get("level"), "text": _text(x)} for x in _children(parent, "title")]


def _idnos(elements: Iterable[ET.Element]) -> list[dict]:
    return [{"type": x.get("type"), "text": _text(x)} for x in elements]


def _dates(monogr: ET.Element | None) -> list[dict]:
    return [{"when": x.get("when"), "text": _text(x)} for x in _below(monogr, "date")]


def _scopes(monogr: ET.Element | None) -> list[dict]:
    return [
        {"unit": x.get("unit"), "text": _text(x), "first": x.get("from"), "last": x.get("to")}
        for x in _below(monogr, "biblScope")
    ]


def _affiliation(aff: ET.Element) -> dict:
    address = _child(aff, "address")
    parts = [] if address is None else [_text(x) for x in address if x.tag in ADDRESS_PARTS]
    orgs = _texts(_children(aff, "orgName"))
    return {"orgs": [t for t in orgs if t], "addr": [t for t in parts if t], "text": _text(aff)}


def _author(author: ET.Element) -> dict:
    named, affs = None, []
    for x in author:
        if x.tag == _AFFILIATION:
            affs.append(_affiliation(x))
        elif x.tag == _PERSON and named is None:
            forenames, surname = [], None
            for part in x:
                if part.tag == _FORENAME:
                    forenames.append({"type": part.get("type"), "text": _text(part)})
                elif part.tag == _SURNAME and surname is None:
                    surname = part
            named = {"text": _text(x), "forenames": forenames, "surname": _text(surname)}
    email = next(author.iter(_EMAIL), None)
    return {
        "role": author.get("role"),
        "corresp": author.get("corresp"),
        "pers": named,
        "email": None if email is None else _text(email),
        "affs": affs,
    }


def _reference(bibl: ET.Element, fields: Collection[str]) -> dict:
    """``fields`` of a reference, each of its elements being looked at once."""
    listed: dict = {name: [] for name in fields}
    if "text" in fields:
        listed["text"] = _text(bibl)
    if "idnos" in fields:
        listed["idnos"] = _idnos(bibl.iter(_IDNO_TAG))
    analytic, monogr = bibl.find(_ANALYTIC), bibl.find(_MONOGR)
    if analytic is not None:
        titles, authors = listed.get("analytic_titles"), listed.get("authors")
        for x in analytic:
            if x.tag == _TITLE_TAG:
                if titles is not None:
                    titles.append({"level": x.get("level"), "text": _text(x)})
            elif x.tag == _AUTHOR_TAG and authors is not None:
                authors.append(_author(x))
    if monogr is not None:
        if "monogr_titles" in fields:
            listed["monogr_titles"] = _titles(monogr)
        publishers, dates, scopes = listed.get("publishers"), listed.get("dates"), listed.get("scopes")
        if publishers is None and dates is None and scopes is None:
            return listed
        for x in monogr.iter():
            tag = x.tag
            if tag == _SCOPE_TAG:
                if scopes is not None:
                    scopes.append({"unit": x.get("unit"), "text": _text(x), "first": x.get("from"), "last": x.get("to")})
            elif tag == _DATE_TAG:
                if dates is not None:
                    dates.append({"when": x.get("when"), "text": _text(x)})
            elif tag == _PUBLISHER and publishers is not None:
                publishers.append(_text(x))
    return listed


def _read_text(xml: str, keep: bool) -> str | None:
    """The text of a document read to its end without a tree; None unless ``keep``."""
    parser = expat.ParserCreate(namespace_separator="}")
    pieces: list[str] = []
    if keep:
        parser.buffer_text = True
        parser.CharacterDataHandler = pieces.append
    parser.Parse(xml, True)
    return " ".join("".join(pieces).split()) or None


def _holders_only(xml: str, fields: Collection[str]) -> str | None:
    """``xml`` cut down to its root and the elements that hold ``fields``; None where that is not plain to see.

    Without comments, CDATA, declarations and instructions each ``<`` begins a tag, so in a well-formed
    document a name that begins one start tag is one whole element. Namespaces must come from the root.
    """
    root = _ROOT_TAG.match(xml)
    if root is None or not fields or not HOLDERS.keys() >= set(fields):
        return None
    names = {HOLDERS[f] for f in fields}
    found = []
    for name in names:
        start = xml.find("<" + name, root.end())
        if start >= 0:
            end = xml.find("</" + name, start)
            if end < 0:
                return None
            found.append((start, xml.find(">", end) + 1))
    body, done = "", 0
    for start, end in sorted(found):
        if end > done:
            body += xml[start:end]
            done = end
    # this and the reading of the whole text must be less work than the whole tree
    if 4 * len(body) > len(xml) or xml.find("xmlns", root.end()) >= 0:
        return None
    if ("!" in xml and "<!" in xml) or ("?" in xml and xml.rfind("<?") > root.start(1)):
        return None
    if any(root[1].startswith(n) or xml.count("<" + n) > 1 or ("xmlns:" in root[0] and ":" + n in xml) for n in names):
        return None
    return f"{root[0]}{body}</{root[1]}>"


def _read_header(xml: str, fields: tuple[str, ...]) -> tuple[ET.Element, str | None] | None:
    """The tree of a document down to the last element that ``fields`` are read from, and its text if that is wanted.

    The document is read once and to its end. Nodes are built up to the end of the ``fileDesc`` and of the last
    element that holds ``fields``, and not of authors where no field reads them. Without comments, CDATA and
    instructions each ``<`` begins a tag. None where this is not plain to see, or the document is not well-formed.
    """
    names = [HEADER_ELEMENTS[f] for f in fields if f in HEADER_ELEMENTS]
    held = [HOLDERS[f] for f in fields if f in HOLDERS]
    keep = "all_text" in fields
    if not names or len(names) + len(held) + keep < len(fields):
        return None
    start = xml.find("<fileDesc")
    end = xml.find("</fileDesc", start) if start >= 0 else -1
    close = xml.find(">", end) + 1 if end >= 0 else 0
    stop = max([close, *(xml.find(">", xml.rfind(name)) + 1 for name in held if name in xml)])
    if not close or xml.find("<!", 0, stop) >= 0 or xml.rfind("<?", 0, stop) > 0:
        return None
    first = xml.find("<author", start, end) if "author" not in names and not held else -1
    done = xml.rfind("</author>", first, end) + 9 if first >= 0 else 0
    if done < 9 or any(xml.find(name, first, done) >= 0 for name in (*_HEADER_PARTS, *names)):
        done = 0
    parser, builder = expat.ParserCreate(namespace_separator="}"), ET.TreeBuilder()
    parser.buffer_text = True

    def build(wanted: bool, text: list[str]) -> None:
        parser.CharacterDataHandler = builder.data if wanted else text.append if keep else None
        parser.StartElementHandler = builder.start if wanted else None
        parser.EndElementHandler = builder.end if wanted else None

    unbuilt, rest, closed, left_out = [], [], [], None
    try:
        above = builder.start("", {})
        build(True, rest)
        if done:
            parser.Parse(xml[:first], False)
            left_out = builder.start("", {})
            builder.end("")
            build(False, unbuilt)
            parser.Parse(xml[first:done], False)
            build(True, rest)
        parser.Parse(xml[done:end], False)
        parser.EndElementHandler = lambda tag: closed.append(builder.end(tag))
        parser.Parse(xml[end:close], False)
        if stop > close:
            build(True, rest)
            parser.Parse(xml[close:stop], False)
        build(False, rest)
        parser.Parse(xml[stop:], True)
    except (expat.ExpatError, ValueError, IndexError):
        return None
    root = above[0]
    for x in root.iter():
        x.tag = "{" + x.tag
    file_desc = next((x for x in root.iter(NS + "fileDesc") if x is not root), None)
    if closed != [file_desc]:
        return None
    if left_out is not None:
        # what was left out must lie directly in this part, so that no other text lacks it
        part = file_desc
        for name in ("sourceDesc", "biblStruct", "analytic"):
            part = _child(part, name)
        if part is None or left_out not in list(part):
            return None
        left_out.text = "".join(unbuilt)
    return root, (" ".join("".join([*root.itertext(), *rest]).split()) or None) if keep else None


def parse_document(
    xml: str | None, fields: tuple[str, ...], reference_fields: Collection[str] = REFERENCE_FIELDS
) -> dict:
    """One document as a dict with ``fields``, which are some of ``RAW_DDL``, or with ``err``."""
    if xml is None or not xml.strip():
        return {"err": INVALID_TEI}
    if fields in ((), ("all_text",)) and "<!DOCTYPE" not in xml:
        try:
            text = _read_text(xml, keep=bool(fields))
            return {"all_text": text} if fields else {}
        except (expat.ExpatError, ValueError):
            pass  # the tree parser below words the error
    read = _read_header(xml, fields)
    if read is not None:
        root, text = read
        listed = _listed(root, [f for f in fields if f != "all_text"], reference_fields)
        return listed | {"all_text": text} if "all_text" in fields else listed
    part = _holders_only(xml, fields)
    if part is not None:
        try:
            _read_text(xml, keep=False)
            return _listed(ET.fromstring(part), fields, reference_fields)
        except (expat.ExpatError, ET.ParseError, ValueError):
            pass  # as above
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, ValueError) as problem:
        return {"err": str(problem) or INVALID_TEI}
    return _listed(root, fields, reference_fields)


#: What is listed of a document, from its root and the elements of its header.
FIELDS = {
    "all_text": lambda root, file_desc, source_desc, bibl, analytic, monogr: _text(root),
    "analytic_titles": lambda root, file_desc, source_desc, bibl, analytic, monogr: _titles(analytic),
    "titlestmt_titles": lambda root, file_desc, source_desc, bibl, analytic, monogr: _texts(
        [t for stmt in _below(file_desc, "titleStmt") for t in _children(stmt, "title")]
    ),
    "pubstmt_titles": lambda root, file_desc, source_desc, bibl, analytic, monogr: _texts(
        _below(file_desc, "publicationStmt", "title")
    ),
    "sourcedesc_titles": lambda root, file_desc, source_desc, bibl, analytic, monogr: [
        {"level": x.get("level"), "text": _text(x)} for x in _below(source_desc, "title")
    ],
    "monogr_titles": lambda root, file_desc, source_desc, bibl, analytic, monogr: _titles(monogr),
    "meetings": lambda root, file_desc, source_desc, bibl, analytic, monogr: _texts(_below(monogr, "meeting")),
    "idnos_analytic": lambda root, file_desc, source_desc, bibl, analytic, monogr: _idnos(_children(analytic, "idno")),
    "idnos_bibl": lambda root, file_desc, source_desc, bibl, analytic, monogr: _idnos(_below(bibl, "idno")),
    "pubstmt_publishers": lambda root, file_desc, source_desc, bibl, analytic, monogr: _texts(
        _below(file_desc, "publicationStmt", "publisher")
    ),
    "monogr_publishers": lambda root, file_desc, source_desc, bibl, analytic, monogr: _texts(_below(monogr, "publisher")),
    "dates": lambda root, file_desc, source_desc, bibl, analytic, monogr: _dates(monogr),
    "scopes": lambda root, file_desc, source_desc, bibl, analytic, monogr: _scopes(monogr),
    "abstracts": lambda root, file_desc, source_desc, bibl, analytic, monogr: _texts(
        _below(root, "profileDesc", "abstract")
    ),
    "terms": lambda root, file_desc, source_desc, bibl, analytic, monogr: _texts(
        _below(root, "textClass", "keywords", "term")
    ),
    "authors": lambda root, file_desc, source_desc, bibl, analytic, monogr: [
        _author(a) for a in _children(analytic, "author")
    ],
}


def _listed(root: ET.Element, fields: Collection[str], reference_fields: Collection[str]) -> dict:
    """``fields`` of the tree below ``root``."""
    if not fields:
        return {}
    file_desc = next((x for x in root.iter(NS + "fileDesc") if x is not root), None)
    source_desc = _child(file_desc, "sourceDesc")
    bibl = None if source_desc is None else next(source_desc.iter(NS + "biblStruct"), None)
    parts = (root, file_desc, source_desc, bibl, _child(bibl, "analytic"), _child(bibl, "monogr"))
    return {
        name: [_reference(b, reference_fields) for b in _below(root, "listBibl", "biblStruct")]
        if name == "refs"
        else FIELDS[name](*parts)
        for name in fields
    }


def tei_parse(
    docs: DataFrame,
    references: bool = True,
    keep_xml: bool = False,
    fields: Collection[str] | None = None,
    reference_fields: Collection[str] | None = None,
) -> DataFrame:
    """``(doc_id, xml)`` to ``(doc_id, raw)``; a bad document becomes ``raw.err``.

    ``references=False`` skips the reference list, usually most of a document,
    when only header fields are wanted. ``fields`` names those of ``RAW_DDL`` that
    are wanted; ``raw`` then has these and ``err``, and ``reference_fields`` names those
    of a reference. Every document is parsed to its end in any case.
    """
    columns = ["doc_id", "xml"] if keep_xml else ["doc_id"]
    cited = tuple(n for n in REFERENCE_FIELDS if reference_fields is None or n in reference_fields)
    of_reference = [f for f in struct_type(RAW_DDL)["refs"].dataType.elementType if f.name in cited]
    all_fields = [
        T.StructField(f.name, T.ArrayType(T.StructType(of_reference))) if f.name == "refs" else f
        for f in struct_type(RAW_DDL)
        if fields is None or f.name in fields or f.name == "err"
    ]
    wanted = tuple(f.name for f in all_fields if f.name != "err" and (references or f.name != "refs"))
    raw = T.StructField("raw", T.StructType(all_fields))
    unread = {} if references or "refs" not in raw.dataType.names else {"refs": []}
    schema = T.StructType([docs.schema[c] for c in columns] + [raw])
    raw_type = to_arrow_schema(T.StructType([raw])).field("raw").type

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, DOCUMENTS_PER_STEP):
                step = batch.slice(start, DOCUMENTS_PER_STEP)
                parsed = [parse_document(xml, wanted, cited) for xml in step.column("xml").to_pylist()]
                if unread:
                    parsed = [x if "err" in x else x | unread for x in parsed]
                arrays = [step.column(c) for c in columns] + [pa.array(parsed, type=raw_type)]
                yield pa.RecordBatch.from_arrays(arrays, names=columns + ["raw"])

    return docs.select("doc_id", "xml").mapInArrow(parse, schema)
