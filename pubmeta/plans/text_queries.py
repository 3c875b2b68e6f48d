"""Text and array functions over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeta.functions import collections as C
from pubmeta.functions import text as X
from pubmeta.plans.base import Source, query

# Unicode whitespace as a character class of the checking database.
WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def TRIM(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


@query(
    "txt1_normalize_spaces",
    f"""SELECT doc_id, nullif({TRIM(f"regexp_replace(chr(160) || text || chr(10), '{WS}+', ' ', 'g')")}, '') AS text
        FROM documents""",
)
def _(s: Source) -> DataFrame:
    padded = F.concat(F.lit("\xa0"), "text", F.lit("\n"))
    return s.table("documents").select("doc_id", X.normalize_spaces(padded).alias("text"))


@query("txt2_null_if_blank", f"SELECT doc_id, nullif({TRIM('doi')}, '') AS doi FROM raw_ids")
def _(s: Source) -> DataFrame:
    return s.view("raw_ids").select("doc_id", X.null_if_blank(F.col("doi")).alias("doi"))


@query(
    "txt3_join_non_empty",
    f"""SELECT doc_id, nullif(concat_ws(' ', nullif({TRIM('doi')}, ''), nullif({TRIM('arxiv')}, '')), '') AS joined
        FROM raw_ids""",
)
def _(s: Source) -> DataFrame:
    return s.view("raw_ids").select("doc_id", X.join_non_empty(F.col("doi"), F.col("arxiv")).alias("joined"))


NORM_DOI = (
    "rtrim(trim(regexp_replace(regexp_replace(regexp_replace(trim({c}), '(?i)https://doi\\.org/', '', 'g'), "
    "'(?i)http://doi\\.org/', '', 'g'), '(?i)doi:', '', 'g')), '.,;')"
)
DOI_RE = r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"


@query(
    "txt4_normalize_doi",
    f"""SELECT doc_id, CASE WHEN starts_with(d, '10.') THEN d END AS doi
        FROM (SELECT doc_id, {NORM_DOI.format(c='doi')} AS d FROM raw_ids)""",
)
def _(s: Source) -> DataFrame:
    return s.view("raw_ids").select("doc_id", X.normalize_doi(F.col("doi")).alias("doi"))


@query(
    "txt5_extract_doi",
    f"SELECT doc_id, nullif(regexp_extract(text, '{DOI_RE}', 1), '') AS doi FROM doi_text",
)
def _(s: Source) -> DataFrame:
    return s.view("doi_text").select("doc_id", X.extract_doi(F.col("text")).alias("doi"))


@query(
    "txt6_normalize_arxiv",
    """SELECT doc_id, nullif(trim(split_part(trim(regexp_replace(trim(arxiv), '(?i)arXiv:', '', 'g')), '[', 1)), '') AS arxiv_id
       FROM raw_ids""",
)
def _(s: Source) -> DataFrame:
    return s.view("raw_ids").select("doc_id", X.normalize_arxiv(F.col("arxiv")).alias("arxiv_id"))


DATED = """
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'n.d.'
        ELSE CAST(extract(year FROM o_orderdate) AS STRING) || '-05' END AS when_attr,
      CASE o_orderkey % 3 WHEN 0 THEN 'May 1999' ELSE CAST(o_custkey AS STRING) END AS txt
    FROM {orders}
"""


@query(
    "txt7_parse_year",
    f"""SELECT o_orderkey, TRY_CAST(left(coalesce(when_attr, txt), 4) AS INTEGER) AS year
        FROM ({DATED.format(orders='orders')})""",
)
def _(s: Source) -> DataFrame:
    return s.sql(DATED).select("o_orderkey", X.parse_year(F.col("when_attr"), F.col("txt")).alias("year"))


ACM_RE = (
    r"(?i)(?:In\s+)?(?:Proceedings\s+of\s+the\s+)?"
    r"(\d{1,2}(?:st|nd|rd|th)\s+ACM\s+International\s+Conference\s+on\s+[^()]+?)\s*\(([^)]+)\)"
)


@query(
    "txt8_acm_venue",
    f"""SELECT doc_id,
          nullif(trim(regexp_replace(regexp_extract(text, '{ACM_RE}', 1), '\\s+', ' ', 'g')), '') AS conference,
          nullif(trim(regexp_replace(regexp_extract(text, '{ACM_RE}', 2), '\\s+', ' ', 'g')), '') AS venue
        FROM acm_text""",
)
def _(s: Source) -> DataFrame:
    text = F.col("text")
    return s.view("acm_text").select(
        "doc_id", X.acm_conference(text).alias("conference"), X.acm_venue(text).alias("venue")
    )


@query(
    "txt9_mentions_acm",
    r"""SELECT doc_id,
          regexp_matches(text, '(?i)\b(ACM|Association for Computing Machinery|ACM Reference Format)\b') AS acm
        FROM acm_text""",
)
def _(s: Source) -> DataFrame:
    return s.view("acm_text").select("doc_id", X.mentions_acm(F.col("text")).alias("acm"))


TERMS = """
    SELECT p_partkey, p_name || ' ' || p_type || ' , ,' AS t1, p_brand || ',' || upper(p_name) || ',  ' || p_type AS t2
    FROM {part}
"""


@query(
    "txt10_split_keywords",
    f"""
    WITH pieces AS (
      SELECT p_partkey, trim(unnest(k)) AS kw, generate_subscripts(k, 1) AS pos FROM (
        SELECT p_partkey, string_split(regexp_replace(t1 || ',' || t2, '([a-z])\\s+([A-Z]{{2,}}\\b)', '\\1,\\2', 'g'), ',') AS k
        FROM ({TERMS.format(part='part')}))),
    firsts AS (
      SELECT *, row_number() OVER (PARTITION BY p_partkey, upper(kw) ORDER BY pos) AS n FROM pieces WHERE kw <> '')
    SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY pos) - 1 AS INTEGER) AS position, kw AS keyword
    FROM firsts WHERE n = 1
    """,
)
def _(s: Source) -> DataFrame:
    keywords = X.split_keywords(F.array("t1", "t2"))
    return s.sql(TERMS).select("p_partkey", F.posexplode(keywords).alias("position", "keyword"))


@query(
    "txt11_strip_markup",
    f"SELECT page_id, {TRIM("regexp_replace(html, '<.*?>', '', 'g')")} AS text FROM pages WHERE {TRIM('html')} <> ''",
)
def _(s: Source) -> DataFrame:
    return s.table("pages").select("page_id", X.strip_markup(F.col("html")).alias("text")).where("text IS NOT NULL")


@query("txt12_normalize_email", "SELECT id, lower(full_name) || '@example.org' AS email FROM users")
def _(s: Source) -> DataFrame:
    raw = F.concat(F.lit(" \t"), F.upper("full_name"), F.lit("@Example.org\xa0"))
    return s.view("users").select("id", X.normalize_email(raw).alias("email"))


@query(
    "txt13_normalize_role_name",
    "SELECT p_partkey, regexp_replace(upper(trim('  ' || p_name || '   ' || p_type || ' ')), ' +', '_', 'g') AS role_name FROM part",
)
def _(s: Source) -> DataFrame:
    raw = F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" "))
    return s.table("part").select("p_partkey", X.normalize_role_name(raw).alias("role_name"))


PAGED = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN l_returnflag = 'A' THEN 'p. ' || CAST(l_partkey AS STRING) WHEN l_returnflag = 'N' THEN ' ' END AS txt,
      CASE WHEN l_linestatus = 'F' THEN CAST(l_partkey AS STRING) END AS first_page,
      CASE WHEN l_linenumber > 2 THEN CAST(l_partkey + l_linenumber AS STRING) END AS last_page
    FROM {lineitem}
"""


@query(
    "txt14_format_pages",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN trim(txt) <> '' THEN txt
          WHEN first_page IS NOT NULL AND last_page IS NOT NULL THEN first_page || '-' || last_page
          ELSE first_page END AS pages
        FROM ({PAGED.format(lineitem='lineitem')})""",
)
def _(s: Source) -> DataFrame:
    pages = X.format_pages(F.col("txt"), F.col("first_page"), F.col("last_page"))
    return s.sql(PAGED).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pages.alias("pages"))


@query("txt15_attr_equals", "SELECT c_custkey, c_mktsegment ILIKE 'household' AS household FROM customer")
def _(s: Source) -> DataFrame:
    return s.table("customer").select("c_custkey", X.attr_equals(F.col("c_mktsegment"), "Household").alias("household"))


SPACED = "SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10)) || chr(10) AS text FROM {documents}"


@query(
    "txt16_collapse_blank_lines",
    f"""SELECT doc_id, {TRIM(r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')")} AS text
        FROM ({SPACED.format(documents='documents')})""",
)
def _(s: Source) -> DataFrame:
    return s.sql(SPACED).select("doc_id", X.collapse_blank_lines(F.col("text")).alias("text"))


# --- arrays, structs, JSON --------------------------------------------------


@query(
    "f1_distinct_ci",
    """
    WITH words AS (
      SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS pos
      FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)),
    firsts AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id, turn, upper(word) ORDER BY pos) AS n FROM words)
    SELECT conv_id, turn, string_agg(word, ' ' ORDER BY pos) AS words FROM firsts WHERE n = 1 GROUP BY conv_id, turn
    """,
)
def _(s: Source) -> DataFrame:
    words = C.distinct_ignore_case(F.split("text", " "))
    return s.table("conversations").select("conv_id", "turn", F.array_join(words, " ").alias("words"))


@query(
    "f2_first_non_blank",
    "SELECT doc_id, coalesce(nullif(trim(arxiv), ''), CASE WHEN trim(doi) <> '' THEN doi END) AS first_value FROM ("
    "SELECT doc_id, doi, CASE WHEN trim(arxiv) <> '' THEN trim(arxiv) END AS arxiv FROM raw_ids)",
)
def _(s: Source) -> DataFrame:
    values = F.array(F.lit(" "), F.trim("arxiv"), "doi")
    return s.view("raw_ids").select("doc_id", C.first_non_blank(values).alias("first_value"))


@query(
    "f3_first_year",
    "SELECT doi, CASE WHEN print_year > 0 THEN print_year END AS year FROM crossref_works",
)
def _(s: Source) -> DataFrame:
    parts = F.array(F.array(F.col("print_year"), F.lit(5)))
    return s.view("crossref_works").select("doi", C.first_year(parts).alias("year"))


@query(
    "f4_join_nonblank",
    """SELECT doi, concat_ws('; ', CASE WHEN trim(publisher) <> '' THEN publisher END, author_name,
         CASE WHEN trim(container_title) <> '' THEN container_title END) AS joined FROM crossref_works""",
)
def _(s: Source) -> DataFrame:
    values = F.array("publisher", F.lit(" "), "author_name", "container_title")
    return s.view("crossref_works").select("doi", C.join_non_blank(values, "; ").alias("joined"))


@query(
    "f5_parse_json_or_empty",
    """SELECT event_id, CASE event_id % 10 WHEN 4 THEN 2 ELSE 0 END AS items,
         CASE event_id % 10 WHEN 4 THEN CAST(1 AS BIGINT) END AS first_item FROM paper_events""",
)
def _(s: Source) -> DataFrame:
    from pyspark.sql import types as T

    items = C.parse_json_or_empty(F.col("value"), T.LongType())
    return s.view("paper_events").select(
        "event_id", F.size(items).alias("items"), F.get(items, F.lit(0)).alias("first_item")
    )


@query(
    "f6_to_json_web",
    """SELECT id, '{"firstName":"' || full_name || '","middleName":null,"lastName":null,"fullName":"' || full_name
         || '","email":' || CASE WHEN deleted THEN 'null' ELSE '"' || email || '"' END || ',"affiliation":null}' AS json
       FROM users""",
)
def _(s: Source) -> DataFrame:
    from pubmeta.schemas import AUTHOR_DDL, struct_type

    none = F.lit(None).cast("string")
    author = F.struct(
        F.col("full_name").alias("first_name"),
        none.alias("middle_name"),
        none.alias("last_name"),
        F.col("full_name").alias("full_name"),
        F.when(~F.col("deleted"), F.col("email")).alias("email"),
        none.alias("affiliation"),
    )
    return s.view("users").select("id", C.to_json_web(author, struct_type(AUTHOR_DDL)).alias("json"))


PRINCIPALS = """
    SELECT CAST(c_custkey AS STRING) AS sub,
      CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ADMIN' WHEN 2 THEN 'ROLE_' || c_mktsegment ELSE lower(c_mktsegment) END AS grp,
      CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'read  ' || lower(c_mktsegment) END AS scope
    FROM {customer}
"""


@query(
    "f7_scope_group_claims",
    f"""SELECT sub, CASE WHEN grp IS NULL THEN '' WHEN starts_with(grp, 'ROLE_') THEN grp ELSE 'ROLE_' || grp END AS roles,
          CASE WHEN trim(scope) <> '' THEN 'SCOPE_read SCOPE_' || split_part(scope, '  ', 2) ELSE '' END AS scopes
        FROM ({PRINCIPALS.format(customer='customer')})""",
)
def _(s: Source) -> DataFrame:
    roles = F.array_join(C.prefix_groups(F.array("grp", F.lit(" "))), " ")
    scopes = F.array_join(C.split_scopes(F.col("scope")), " ")
    return s.sql(PRINCIPALS).select("sub", roles.alias("roles"), scopes.alias("scopes"))


@query(
    "f8_position_pick",
    """SELECT conv_id, turn, string_split(text, ' ')[CAST(turn * 12 AS INTEGER) + 1] AS word FROM conversations""",
)
def _(s: Source) -> DataFrame:
    word = C.position_pick(F.split("text", " "), (F.col("turn") * 12).cast("int"))
    return s.table("conversations").select("conv_id", "turn", word.alias("word"))
