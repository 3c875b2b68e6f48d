import re

import pytest

from pubmeta.operators.tei import cited_works, explode_references, extract_metadata

NS = 'xmlns="http://www.tei-c.org/ns/1.0"'


@pytest.fixture(scope="module")
def extract(spark):
    def run(*documents):
        df = spark.createDataFrame(list(enumerate(documents)), "doc_id BIGINT, xml STRING")
        return [r.asDict(recursive=True) for r in extract_metadata(df).orderBy("doc_id").collect()]

    return run


@pytest.fixture(scope="module")
def published_cases(extract):
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with open(f"{root}/FIXTURES.md", encoding="utf8") as f:
        return extract(*re.findall(r"```xml\n(.*?)```", f.read(), re.S))


def test_full_paper(published_cases):
    row = published_cases[0]
    assert row["title"] == "Hammer PDF: An Intelligent PDF Reader for Scientific Papers"
    assert row["doi"] is None and row["doi_source"] is None
    assert row["arxiv_id"] == "2204.02809v2"
    assert row["publication_year"] == 2022
    assert row["publisher"] == "ACM"
    assert row["venue"] == "CIKM '22"
    assert row["conference_name"] == "31st ACM International Conference on Information and Knowledge Management"
    pooled = "Beijing Institute of Technology, Haidian Distr., Beijing, China"
    assert [a["affiliation"] for a in row["authors"]] == [pooled] * 3
    assert row["keywords"].count("Information extraction") == 1 and "PDF Reader" in row["keywords"]
    (ref,) = row["references"]
    assert (ref["publisher"], ref["publication_year"], ref["doi"]) == ("Test Publisher", 2020, None)


def test_doi_url(published_cases):
    assert (published_cases[1]["doi"], published_cases[1]["doi_source"]) == ("10.1145/example", "GROBID")


def test_body_doi(published_cases):
    row = published_cases[2]
    assert (row["doi"], row["doi_source"]) == ("10.1000/xyz123", "REGEX")
    assert (row["journal"], row["publisher"]) == ("Journal of Metadata Systems", "Metadata Press")
    assert (row["publication_year"], row["volume"], row["issue"], row["pages"]) == (2025, "12", "4", "101-120")
    assert row["corresponding_author"] == "Ada Lovelace <ada@example.org>"


def header(analytic="", monogr="", rest="", bibl=""):
    return (
        f"<TEI {NS}><teiHeader><fileDesc><sourceDesc><biblStruct><analytic>{analytic}</analytic>"
        f"<monogr>{monogr}</monogr>{bibl}</biblStruct></sourceDesc></fileDesc></teiHeader> {rest}</TEI>"
    )


def test_bad_documents_fail_alone(extract):
    rows = extract("<a><b>", "", None, "\n ", "<TEI/> junk", f"<TEI {NS}/>")
    assert [r["extraction_status"] for r in rows] == ["Failed"] * 5 + ["Completed"]
    assert all(r["extraction_error"] for r in rows[:5]) and rows[5]["extraction_error"] is None
    assert rows[1]["extraction_error"] == "GROBID service returned an invalid response."


def test_blank_first_match_moves_to_next_rule(extract):
    first_blank = '<title level="a"> </title><title level="a">Second</title>'
    assert extract(header(first_blank))[0]["title"] is None


def test_dx_doi_is_found_again_as_text(extract):
    row = extract(header('<idno type="DOI">https://dx.doi.org/10.1000/a</idno>'))[0]
    assert (row["doi"], row["doi_source"]) == ("10.1000/a", "REGEX")


def test_doi_only_in_a_reference(extract):
    cited = '<listBibl><biblStruct><idno type="DOI">10.5555/cited</idno></biblStruct></listBibl>'
    row = extract(header(rest=cited))[0]
    assert (row["doi"], row["doi_source"]) == ("10.5555/cited", "REGEX")
    assert row["references"][0]["doi"] == "10.5555/cited"


def person(name, *affs, attrs=""):
    return f"<author{attrs}><persName><surname>{name}</surname></persName>{''.join(affs)}</author>"


def aff(text):
    return f"<affiliation><orgName>{text}</orgName></affiliation>"


def test_pool_is_read_by_author_position(extract):
    row = extract(header(person("A", aff("One")) + person("B", aff("Two"), aff("ONE")) + person("C")))[0]
    assert [a["affiliation"] for a in row["authors"]] == ["One", "Two", None]
    row = extract(header(person("A") + person("B") + f"<author>{aff('One')}{aff('Two')}</author>"))[0]
    assert [a["affiliation"] for a in row["authors"]] == ["One", "Two"]


def test_rejected_author_does_not_shift_positions(extract):
    nameless = "<author><persName> </persName></author>"
    row = extract(header(nameless + person("A") + f"<author>{aff('One')}{aff('Two')}</author>"))[0]
    assert [(a["full_name"], a["affiliation"]) for a in row["authors"]] == [("A", "One")]


def test_affiliation_without_parts_is_whole_text(extract):
    row = extract(header(person("A", "<affiliation>  Some  Lab </affiliation>")))[0]
    assert row["authors"][0]["affiliation"] == "Some Lab"


@pytest.mark.parametrize(
    "scope, want",
    [
        ('<biblScope unit="pp">7-9</biblScope>', "7-9"),
        ('<biblScope unit="page" to="9"/>', None),
        ('<biblScope unit="PAGE" from="7" to="9"/>', "7-9"),
        ('<biblScope unit="pp"/><biblScope unit="page" from="3"/>', "3"),
    ],
)
def test_pages(extract, scope, want):
    assert extract(header(monogr=scope))[0]["pages"] == want


def test_empty_when_hides_text(extract):
    assert extract(header(monogr='<date when="">1990</date>'))[0]["publication_year"] is None


def test_corresponding_without_name(extract):
    row = extract(header('<author corresp="true"><email>x@y</email></author>' + person("B", attrs=' role="corresp"')))[0]
    assert row["corresponding_author"] is None


def test_corresponding_email_only(extract):
    blank = '<author corresp="YES"><persName/><email>x@y</email></author>'
    assert extract(header(blank))[0]["corresponding_author"] == " <x@y>"


def test_nested_reference_lists_count_once(extract):
    nested = "<listBibl><listBibl><biblStruct><note>x</note></biblStruct></listBibl></listBibl>"
    assert len(extract(header(rest=nested))[0]["references"]) == 1


def test_explode_references_keeps_papers_without_any(spark):
    docs = spark.createDataFrame(
        [(1, header()), (2, header(rest="<listBibl><biblStruct>a</biblStruct><biblStruct>b</biblStruct></listBibl>"))],
        "doc_id BIGINT, xml STRING",
    )
    rows = explode_references(extract_metadata(docs)).orderBy("doc_id", "position").collect()
    assert [(r["doc_id"], r["position"], r["title"]) for r in rows] == [(1, None, None), (2, 0, "a"), (2, 1, "b")]


def test_wanted_columns_are_those_of_the_whole_record(spark, extract):
    import os
    import re

    from pubmeta.operators import tei

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with open(f"{root}/FIXTURES.md", encoding="utf8") as f:
        documents = [*re.findall(r"```xml\n(.*?)```", f.read(), re.S), "<a><b>", None]
    whole = extract(*documents)
    docs = spark.createDataFrame(list(enumerate(documents)), "doc_id BIGINT, xml STRING")
    for wanted in (("title", "venue"), ("doi_source", "pages"), ("authors", "journal_source"), ("references",), ()):
        rows = extract_metadata(docs, wanted=wanted).orderBy("doc_id").collect()
        kept = ("doc_id", *wanted, "extraction_status", "extraction_error")
        assert [r.asDict(recursive=True) for r in rows] == [{c: r[c] for c in r if c in kept} for r in whole]
    raw = tei.tei_parse(docs, fields=tei.READS["title"]).schema["raw"].dataType
    assert raw.names == ["err", "analytic_titles", "titlestmt_titles"]


def test_documents_are_built_after_the_shuffles(spark):
    from pubmeta.plans.base import Source
    from pubmeta.plans.tei_queries import tei_docs

    docs = tei_docs(Source(spark, "/root/testdata/sf0.001"))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    built = max(k for k, line in enumerate(lines) if "<TEI xmlns" in line)
    assert built < min(k for k, line in enumerate(lines) if "Exchange" in line)


@pytest.mark.parametrize("name", ["tei13_authors", "tei14_person", "tei15_format_affiliation", "tei16_affiliation_fallback"])
def test_authors_are_worked_out_once(spark, name):
    from pubmeta.plans.base import Source
    from pubmeta.plans.catalog import catalog

    plan = catalog()[name].build(Source(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("raw#" in line and ".authors" in line for line in plan.splitlines()) == 1


ODD = [
    f"<TEI {NS}>a<!-- b -->c<?p d?>e<![CDATA[f < g]]>&amp;\r\n\u00a0h<x>i</x>j</TEI>",
    f"<?xml version='1.0' encoding='latin1'?><TEI {NS}>\u00e9<y/></TEI>",
    f"<!DOCTYPE TEI [<!ENTITY e 'f <z>g</z>'>]><TEI {NS}>&e;</TEI>",
    "<TEI>&e;</TEI>",
    "<a:b>x</a:b>",
    "<a x='1' x='2'/>",
    "<a>&#1;</a>",
    "<a/> junk",
    "<a><b></a>",
    "<a> \n </a>",
    "<a>" + "word " * 5000 + "</a>",
]


@pytest.mark.parametrize("xml", ODD)
def test_text_without_a_tree_is_that_of_the_tree(xml, monkeypatch):
    from pubmeta.operators import tei_parse

    with_tree = tei_parse.parse_document(xml, ("all_text", "authors"))
    built = []
    tree = tei_parse.ET.fromstring
    monkeypatch.setattr(tei_parse.ET, "fromstring", lambda x: built.append(x) or tree(x))
    found = tei_parse.parse_document(xml, ("all_text",))
    assert found == {k: v for k, v in with_tree.items() if k != "authors"}
    assert tei_parse.parse_document(xml, ()) == {k: v for k, v in with_tree.items() if k == "err"}
    assert bool(built) == ("err" in with_tree or "DOCTYPE" in xml)


def test_cited_works_are_the_exploded_references(spark):
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with open(f"{root}/FIXTURES.md", encoding="utf8") as f:
        published = re.findall(r"```xml\n(.*?)```", f.read(), re.S)
    author = f"<analytic>{person('A', aff('One'))}{person('B')}</analytic>"
    listed = f"<listBibl><biblStruct>{author}</biblStruct><biblStruct>b<note/> c</biblStruct><biblStruct/></listBibl>"
    documents = [*published, header(), header(rest=listed), "<a><b>", None]
    docs = spark.createDataFrame(list(enumerate(documents)), "doc_id BIGINT, xml STRING")
    whole = explode_references(extract_metadata(docs))
    assert cited_works(docs).schema.simpleString() == whole.schema.simpleString()
    for wanted in (None, ("title", "doi"), ("authors", "raw_text")):
        names = ["doc_id", "position", *[n for n in whole.columns[2:] if wanted is None or n in wanted]]
        got = cited_works(docs, wanted).orderBy("doc_id", "position").collect()
        assert got == whole.select(names).orderBy("doc_id", "position").collect()


def test_a_cited_work_lists_only_what_is_read(spark):
    docs = spark.createDataFrame([(1, header())], "doc_id BIGINT, xml STRING")
    plan = cited_works(docs, ("title", "doi"))._jdf.queryExecution().optimizedPlan().toString()
    assert "idnos" in plan and "scopes" not in plan and "forenames" not in plan


PROFILE = "<profileDesc><abstract><p>A &amp; b</p></abstract><textClass><keywords><term>c, d</term></keywords></textClass></profileDesc>"
BODY = "<text>" + "<p>word</p>" * 100 + "</text>"
HELD = [
    # document, whether what is read is plain to see
    (f"<TEI {NS}>{PROFILE}{BODY}</TEI>", True),
    (f"<?xml version='1.0'?>\n<TEI {NS} a='&lt;'><teiHeader>{PROFILE}</teiHeader>{BODY}? !</TEI>\n", True),
    (f"<TEI {NS}>{BODY}</TEI>", True),
    (f"<TEI>{PROFILE}{BODY}</TEI>", True),
    (f"<t:TEI xmlns:t='http://www.tei-c.org/ns/1.0'>{PROFILE.replace('</', '</t:').replace('<p', '<t:p')}{BODY}</t:TEI>", False),
    (f"<t:TEI xmlns:t='http://www.tei-c.org/ns/1.0'><t:profileDesc><t:abstract>x</t:abstract><t:textClass/></t:profileDesc>{BODY}</t:TEI>", False),
    (f"<TEI {NS}>{PROFILE}{BODY}{PROFILE}</TEI>", False),
    (f"<TEI {NS}><profileDesc/><textClass/>{BODY}</TEI>", False),
    (f"<TEI {NS}><!-- {PROFILE} -->{BODY}</TEI>", False),
    (f"<TEI {NS}><![CDATA[{PROFILE}]]>{BODY}</TEI>", False),
    (f"<TEI {NS}><?x {PROFILE}?>{BODY}</TEI>", False),
    (f"<TEI><teiHeader {NS}>{PROFILE}</teiHeader>{BODY}</TEI>", False),
    (f"<profileDesc {NS}><abstract>root</abstract><textClass><keywords><term>r</term></keywords></textClass><textClass/>{BODY}</profileDesc>", False),
    (f"<TEI {NS} a='x>y'>{PROFILE}{BODY}</TEI>", True),
    (f"<TEI {NS}>{PROFILE}{BODY}</TEI> junk", True),
    (f"<TEI {NS}>{PROFILE}{BODY}<p></TEI>", True),
    (f"<TEI {NS}>{PROFILE}{BODY}&no;</TEI>", True),
    (f"<TEI {NS}>{PROFILE}<x:p/>{BODY}</TEI>", True),
    (f"<TEI {NS}>{PROFILE}</TEI>", False),
]


@pytest.mark.parametrize("field", ["abstracts", "terms"])
def test_a_field_is_read_from_its_holder_as_from_the_whole_tree(field, monkeypatch):
    from pubmeta.operators import tei_parse

    found = [tei_parse.parse_document(xml, (field,)) for xml, _ in HELD]
    for xml, plain in HELD:
        part = tei_parse._holders_only(xml, (field,))
        assert (part is not None) == plain and (part is None or 2 * len(part) < len(xml))
    monkeypatch.setattr(tei_parse, "_holders_only", lambda xml, fields: None)
    assert found == [tei_parse.parse_document(xml, (field,)) for xml, _ in HELD]
    assert found[0][field] and not found[2][field] and all("err" in x for x in found[-5:-1])


AUTHORS = f"{person('A', aff('One'))} x {person('B')}"
LISTED = "<text>" + "<listBibl><biblStruct><analytic><title>t</title></analytic></biblStruct></listBibl>" * 3 + "tail &lt;</text>"
MONOGR = '<title level="j">J &amp; K</title><imprint><publisher>P</publisher><date when="2001"/><biblScope unit="page">3</biblScope></imprint>'
STATED = "<titleStmt><title>Head <hi>of</hi> it</title></titleStmt><publicationStmt><publisher>Q</publisher><title>S</title></publicationStmt>"


def whole(source, before="", after="", root=f"TEI {NS}"):
    return f"<{root}>{before}<teiHeader><fileDesc>{STATED}<sourceDesc>{source}</sourceDesc></fileDesc>{PROFILE}</teiHeader>{LISTED}{after}</TEI>"


def struct(analytic, monogr=MONOGR):
    return f"<biblStruct><analytic>{analytic}</analytic><monogr>{monogr}</monogr><idno type='DOI'>10.1/a</idno></biblStruct>"


HEADERS = [
    # document, whether its header is plain to see
    (whole(struct(f"<title level='a'>T</title>{AUTHORS}<title>U</title><idno>i</idno>")), True),
    (whole(struct("<title level='a'>T</title>")), True),
    (whole(struct("<author/>" + AUTHORS)), True),
    (whole(struct(AUTHORS + "<list>" + AUTHORS + "</list><title>U</title>")), False),
    (whole(struct(f"{AUTHORS}<title>U</title>{AUTHORS}")), True),
    (whole(struct(AUTHORS, f"{AUTHORS}{MONOGR}")), True),
    (whole(struct("<author><idno>o</idno><title>Dr</title><date/></author>")), True),
    (whole(struct(f"{AUTHORS}</analytic><analytic>{AUTHORS}<title>second</title>")), True),
    (whole(f"<x>{AUTHORS}</x>{struct('<title>T</title>')}"), False),
    (whole(f"<title>by {AUTHORS}</title>{struct('<title>T</title>')}"), False),
    (whole(struct(f"<title>by {AUTHORS}</title>")), False),
    (whole(struct(f"<list>{AUTHORS}</list><list>{AUTHORS}</list><title>T</title>")), False),
    (whole(struct(f"<list>{AUTHORS}</list>{AUTHORS}<title>T</title>")), False),
    (whole(struct(f"{AUTHORS}<list>{AUTHORS}</list><title>T</title>")), False),
    (whole(struct(AUTHORS), after=PROFILE + "<fileDesc><titleStmt><title>late</title></titleStmt></fileDesc>"), True),
    (whole(struct(AUTHORS), before="<fileDesc/>"), False),
    (whole(struct(AUTHORS), before="<fileDesc x='></fileDesc>'/>"), False),
    (whole(struct(f"{AUTHORS}<!-- </author></fileDesc> --><title>T</title>")), False),
    (whole(struct(f"{AUTHORS}<![CDATA[</fileDesc>]]><title>T</title>")), False),
    (whole(struct(f"{AUTHORS}<?x </author> ?><title>T</title>")), False),
    ("<?xml version='1.0'?>" + whole(struct(AUTHORS)), True),
    (whole(struct(AUTHORS)).replace("<text>", "<text><!-- <fileDesc> --><![CDATA[<x>]]>"), True),
    (f"<!DOCTYPE TEI [<!ENTITY e 'f'>]>{whole(struct(AUTHORS), after='&e;')}", False),
    (whole(struct(AUTHORS), root="TEI"), False),
    (whole(struct(AUTHORS)).replace("<fileDesc>", "<fileDesc><fileDesc><note/></fileDesc>"), False),
    (whole(struct(AUTHORS)).replace("<fileDesc>", f"<fileDesc {NS}>").replace(f"<TEI {NS}>", "<TEI>"), True),
    (f"<fileDesc {NS}><fileDesc>{STATED}</fileDesc></fileDesc>", True),
    (whole(struct(AUTHORS))[:-20], False),
    (whole(struct(AUTHORS), after="<p>"), False),
    (whole(struct(AUTHORS), after="&no;"), False),
    (whole(struct(AUTHORS)) + "junk", False),
    (whole(struct(AUTHORS)).replace("<persName>", "<x:persName>").replace("</persName>", "</x:persName>"), False),
    (f"<TEI {NS}>{LISTED}</TEI>", False),
]


@pytest.mark.parametrize(
    "fields",
    [
        ("analytic_titles", "titlestmt_titles"),
        ("monogr_titles", "pubstmt_titles", "sourcedesc_titles"),
        ("idnos_analytic", "idnos_bibl", "all_text"),
        ("pubstmt_publishers", "monogr_publishers", "all_text"),
        ("dates", "scopes"),
        ("authors",),
        ("abstracts", "authors", "scopes"),
        ("dates", "terms", "all_text"),
    ],
)
def test_a_header_is_read_as_from_the_whole_tree(fields, monkeypatch):
    from pubmeta.operators import tei_parse

    trees = []
    tree = tei_parse.ET.fromstring
    monkeypatch.setattr(tei_parse.ET, "fromstring", lambda x: trees.append(x) or tree(x))
    found = [tei_parse.parse_document(xml, fields) for xml, _ in HEADERS]
    assert HEADERS[0][0] not in trees
    if fields == ("analytic_titles", "titlestmt_titles"):
        assert {xml for xml, plain in HEADERS if not plain} == set(trees)
    monkeypatch.setattr(tei_parse, "_read_header", lambda xml, fields: None)
    assert found == [tei_parse.parse_document(xml, fields) for xml, _ in HEADERS]


def test_nothing_of_a_reference_or_unread_author_is_built():
    from pubmeta.operators import tei_parse

    root, text = tei_parse._read_header(HEADERS[0][0], ("analytic_titles", "titlestmt_titles"))
    names = [x.tag.removeprefix(tei_parse.NS) for x in root.iter()]
    assert text is None and names.count("biblStruct") == 1 and not {"persName", "affiliation", "listBibl"} & set(names)


def test_an_odd_reference_is_listed_part_by_part():
    from pubmeta.operators import tei_parse

    author = (
        "<author role='r'><note><email>in@x</email></note><persName><forename type='first'>A</forename><surname>B</surname>"
        "<surname>no</surname></persName><persName>no</persName><email>no</email><affiliation>One <orgName>Org</orgName>"
        "<address><country>C</country><postCode>1</postCode></address></affiliation></author>"
    )
    bibl = (
        f"<biblStruct><note><title>no</title><idno type='DOI'>1</idno></note><analytic><title level='a'>T <hi>x</hi></title>{author}</analytic>"
        "<analytic><title>no</title></analytic><monogr><title level='j'>J</title><imprint><title>no</title><publisher>P</publisher>"
        "<date when='2001'/><biblScope unit='page' from='1' to='2'/></imprint><idno>2</idno></monogr><monogr><date>no</date></monogr></biblStruct>"
    )
    listed = tei_parse.parse_document(f"<TEI {NS}><listBibl>{bibl}</listBibl></TEI>", ("refs",))["refs"][0]
    person = {"text": "ABno", "forenames": [{"type": "first", "text": "A"}], "surname": "B"}
    aff = {"orgs": ["Org"], "addr": ["C"], "text": "One OrgC1"}
    assert listed.pop("text") == "no1T xin@xABnononoOne OrgC1noJnoP2no"
    assert listed == {
        "analytic_titles": [{"level": "a", "text": "T x"}],
        "authors": [{"role": "r", "corresp": None, "pers": person, "email": "in@x", "affs": [aff]}],
        "monogr_titles": [{"level": "j", "text": "J"}],
        "idnos": [{"type": "DOI", "text": "1"}, {"type": None, "text": "2"}],
        "publishers": ["P"],
        "dates": [{"when": "2001", "text": None}],
        "scopes": [{"unit": "page", "text": None, "first": "1", "last": "2"}],
    }
