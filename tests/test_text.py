import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeta.functions import collections as C
from pubmeta.functions import text as X


@pytest.mark.parametrize(
    "raw, want",
    [("  a\t\n b  c ", "a b c"), ("　  ", None), ("", None), (None, None), ("x", "x")],
)
def test_normalize_spaces(value, raw, want):
    assert value(X.normalize_spaces, raw) == want


@pytest.mark.parametrize("raw, want", [("  a b  ", "a b"), ("\t", None), (None, None)])
def test_null_if_blank(value, raw, want):
    assert value(X.null_if_blank, raw) == want


def test_join_non_empty(value):
    assert value(X.join_non_empty, " Ada ", None, "Lovelace") == "Ada Lovelace"
    assert value(X.join_non_empty, " ", None, "") is None


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://doi.org/10.1145/example", "10.1145/example"),
        (" DOI: 10.1/x.,; ", "10.1/x"),
        ("10.1/ahttp://DOI.org/b", "10.1/ab"),
        ("https://dx.doi.org/10.1/x", None),
        ("XXXXXXX.XXXXXXX", None),
        ("  ", None),
        (None, None),
    ],
)
def test_normalize_doi(value, raw, want):
    assert value(X.normalize_doi, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("at doi:10.1000/xyz123.", "10.1000/xyz123."),
        ("(see http://dx.doi.org/10.1234/a(b)c)", "10.1234/a(b)c)"),
        ("10.123/x then 10.12345/y", "10.12345/y"),
        ("none", None),
        (None, None),
    ],
)
def test_extract_doi(value, raw, want):
    assert value(X.extract_doi, raw) == want


@pytest.mark.parametrize(
    "raw, want", [("arXiv:2204.02809v2[cs.DL]", "2204.02809v2"), (" ARXIV: 1 ", "1"), ("[x]", None), (None, None)]
)
def test_normalize_arxiv(value, raw, want):
    assert value(X.normalize_arxiv, raw) == want


@pytest.mark.parametrize(
    "attr, text, want",
    [
        ("2025-03-01", "1999", 2025),
        (None, "1999 May", 1999),
        ("", "1999", None),
        ("May 1999", None, None),
        ("99", None, 99),
        ("20.5", None, None),
        (None, None, None),
    ],
)
def test_parse_year(value, attr, text, want):
    assert value(X.parse_year, attr, text) == want


def test_acm_rules(value):
    text = "In Proceedings of the 31st ACM International Conference on Information (CIKM '22) ..."
    assert value(X.acm_conference, text) == "31st ACM International Conference on Information"
    assert value(X.acm_venue, text) == "CIKM '22"
    assert value(X.mentions_acm, "an acm venue") is True
    assert value(X.mentions_acm, "ACME") is False
    assert value(X.mentions_acm, None) is False


def test_split_keywords(value):
    fn = lambda a, b: X.split_keywords(F.array(a, b))
    assert value(fn, "Information extraction PDF Reader, Literature Search", "information Extraction,,") == [
        "Information extraction",
        "PDF Reader",
        "Literature Search",
    ]
    assert value(fn, None, " , ") == []


@pytest.mark.parametrize(
    "raw, want",
    [("<p>a <b>b</b></p> ", "a b"), ("<p></p>", ""), (" ", None), ("a<x\ny>b", "a<x\ny>b"), ("<\r>z", "z")],
)
def test_strip_markup(value, raw, want):
    assert value(X.strip_markup, raw) == want


def test_role_name_and_email(value):
    assert value(X.normalize_role_name, " lab  leader ") == "LAB_LEADER"
    assert value(X.normalize_role_name, " ") is None
    assert value(X.normalize_email, " A@B.c ") == "a@b.c"


@pytest.mark.parametrize(
    "text, first, last, want",
    [("5", "1", "2", "5"), (" ", "1", "2", "1-2"), (None, "1", None, "1"), (None, None, "2", None), (None, " ", "2", None)],
)
def test_format_pages(value, text, first, last, want):
    assert value(X.format_pages, text, first, last) == want


def test_collapse_blank_lines(value):
    assert value(X.collapse_blank_lines, "\n\na\n\n\n\nb\n\nc\x1c\n") == "a\n\nb\n\nc"


def test_file_names(value):
    assert value(X.file_stem, "dir/a.b.pdf") == "a.b"
    assert value(X.file_stem, ".pdf") == ""
    assert value(X.safe_file_name, "/a//b\x00c") == "a_b_c"


def test_distinct_ignore_case_keeps_first_spelling(value):
    fn = lambda *cs: C.distinct_ignore_case(F.array(*cs))
    assert value(fn, "b", "A", "B", "a", "c") == ["b", "A", "c"]


def test_json_lists(value):
    fn = lambda c: C.parse_json_or_empty(c, T.StringType())
    assert value(fn, '["a","b"]') == ["a", "b"]
    for bad in ("", None, "{}", '{"a":1}', "[1", "null"):
        assert value(fn, bad) == []


def test_claims(value):
    assert value(C.split_scopes, "a  b") == ["SCOPE_a", "SCOPE_b"]
    assert value(C.split_scopes, " ") == []
    groups = lambda *cs: C.prefix_groups(F.array(*cs))
    assert value(groups, "X", "ROLE_Y", " ", "role_z") == ["ROLE_X", "ROLE_Y", "ROLE_role_z"]


def test_first_year(value):
    fn = lambda c: C.first_year(F.from_json(c, "array<array<int>>"))
    assert value(fn, "[[2024,5],[1]]") == 2024
    for none in ("[[0]]", "[[null]]", "[[]]", "[]", None):
        assert value(fn, none) is None


def test_a_sharp_s_is_not_two_letters(value):
    words = ["ß", "SS", "ss", "Straße", "STRASSE", "straẞe", "ﬁn", "FIN", "𐐨ß", "𐐀ß", "é", "É"]
    first = ["ß", "SS", "Straße", "STRASSE", "ﬁn", "FIN", "𐐨ß", "é"]
    assert value(C.distinct_ignore_case, words, ddl="ARRAY<STRING>") == first
