"""Derived views: the given tables recast as papers, events, pages and entitlements.

The SQL runs unchanged in Spark and in the checking database. ``{name}`` stands
for a given table.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "users": """
        SELECT CAST(c_custkey AS STRING) AS id, c_name AS full_name, lower(c_name) || '@example.org' AS email,
          c_custkey % 10 = 0 AS deleted
        FROM {customer}
    """,
    "roles": """
        SELECT CAST(r_regionkey AS BIGINT) AS id,
          CASE r_regionkey WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'LAB_LEADER' WHEN 2 THEN 'SENIOR_RESEARCHER'
            WHEN 3 THEN 'RESEARCHER' ELSE 'AI_QUALITY_ASSISTANT' END AS name,
          'Role for ' || r_name AS description, r_regionkey = 3 AS deleted
        FROM {region}
    """,
    "permissions": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, 'PERM_' || n_name AS name FROM {nation}
    """,
    "role_permissions": """
        SELECT CAST(n_nationkey AS BIGINT) AS permission_id, CAST(n_regionkey AS BIGINT) AS role_id FROM {nation}
        UNION
        SELECT CAST(s_nationkey AS BIGINT), CAST(s_suppkey % 4 AS BIGINT) FROM {supplier}
    """,
    "user_roles": """
        SELECT DISTINCT CAST(o_custkey AS STRING) AS user_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS role_id
        FROM {orders}
    """,
    "uploads": """
        SELECT doc_id AS paper_id, doc_id AS version_id,
          CASE WHEN doc_id % 7 = 3 THEN 'notes_' || CAST(doc_id AS STRING) || '.txt'
               WHEN doc_id % 7 = 5 THEN 'Paper.' || CAST(doc_id AS STRING) || '.PDF'
               ELSE 'dir/paper_' || CAST(doc_id AS STRING) || '.pdf' END AS file_name,
          CASE WHEN doc_id % 11 = 2 THEN 'text/plain' WHEN doc_id % 11 = 4 THEN 'Application/PDF'
               ELSE 'application/pdf' END AS content_type,
          CASE WHEN doc_id % 13 = 0 THEN CAST(0 AS BIGINT) ELSE n_chars END AS length,
          CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '   ' ELSE '  ' || source || ' ' END AS title
        FROM {documents}
    """,
    "doi_text": """
        SELECT doc_id,
          text || CASE doc_id % 6
            WHEN 0 THEN ' see https://doi.org/10.1234/Abc.' || CAST(doc_id AS STRING) || '.'
            WHEN 1 THEN ' (doi: 10.5555/x-' || CAST(doc_id AS STRING) || ');'
            WHEN 2 THEN ' http://dx.doi.org/10.123456789/q;' || CAST(doc_id AS STRING) || ','
            WHEN 3 THEN ' not a doi 10.12/' || CAST(doc_id AS STRING)
            WHEN 4 THEN ' 10.1000/first' || CAST(doc_id AS STRING) || ' and 10.1000/second'
            ELSE '' END AS text
        FROM {documents}
    """,
    "acm_text": """
        SELECT doc_id,
          text || CASE doc_id % 4
            WHEN 0 THEN '  In Proceedings of the ' || CAST(doc_id % 90 + 4 AS STRING)
              || 'th ACM International  Conference on ' || lang || ' Systems (' || upper(source) || '  24) '
            WHEN 1 THEN ' by the Association for Computing Machinery.'
            WHEN 2 THEN ' printed by acm.'
            ELSE ' ACME and acmx' END AS text
        FROM {documents}
    """,
    "raw_ids": """
        SELECT doc_id,
          CASE doc_id % 6
            WHEN 0 THEN '  HTTPS://DOI.ORG/10.1000/A' || CAST(doc_id AS STRING) || '.,; '
            WHEN 1 THEN 'doi: 10.1000/b' || CAST(doc_id AS STRING)
            WHEN 2 THEN 'https://dx.doi.org/10.1000/c' || CAST(doc_id AS STRING)
            WHEN 3 THEN '   '
            WHEN 4 THEN NULL
            ELSE 'XXXXXXX.' || CAST(doc_id AS STRING) END AS doi,
          CASE doc_id % 4
            WHEN 0 THEN 'arXiv:2204.' || CAST(doc_id AS STRING) || 'v2[cs.DL]'
            WHEN 1 THEN ' ARXIV: 1901.' || CAST(doc_id AS STRING) || ' '
            WHEN 2 THEN '[cs.DL]'
            ELSE NULL END AS arxiv
        FROM {documents}
    """,
    "metadata_raw": """
        SELECT o_orderkey AS paper_id,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '  '
               ELSE 'Title ' || CAST(o_orderkey AS STRING) END AS title,
          CASE WHEN o_orderkey % 4 = 0 THEN NULL
               ELSE '10.1000/P' || CAST(CAST(floor(o_orderkey / 5.0) AS BIGINT) AS STRING) END AS doi,
          CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'REGEX' ELSE 'GROBID' END AS doi_source,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Journal ' || o_orderpriority END AS journal,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'GROBID' END AS journal_source,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Publisher ' || o_orderstatus END AS publisher,
          CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(extract(year FROM o_orderdate) AS INT) END AS publication_year,
          CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'Author ' || CAST(o_custkey AS STRING) END AS author_name
        FROM {orders}
    """,
    "crossref_works": """
        SELECT '10.1000/p' || CAST(p_partkey AS STRING) AS doi, 'CR ' || p_name AS title,
          CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_type END AS container_title,
          CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'short ' || p_type END AS short_container_title,
          '<jats:p>About <b>' || p_name || '</b></jats:p>' AS abstract,
          CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS publisher,
          CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1990 + p_size END AS issued_year,
          CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 2000 + p_size END AS print_year,
          p_brand || ' Author' AS author_name
        FROM {part}
    """,
    "crossref_json": """
        SELECT p_partkey, '{{"status":"ok","message":{{"title":["","CR ' || p_name || '"],"DOI":"10.1000/p'
          || CAST(p_partkey AS STRING) || '","abstract":"<jats:p>About <b>' || p_name || '</b></jats:p> ",'
          || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '"container-title":[" ","' || p_type || '"],' END
          || '"short-container-title":["short ' || p_type || '"],'
          || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '"publisher":"' || p_brand || '",' END
          || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '"issued":{{"date-parts":[[' || CAST(1990 + p_size AS STRING) || ',5]]}},' END
          || '"published-print":{{"date-parts":[[' || CASE WHEN p_partkey % 6 = 0 THEN '0' ELSE CAST(2000 + p_size AS STRING) END
          || ']]}},"volume":"' || CAST(p_size AS STRING) || '","page":"1-9","author":[{{"given":" ' || p_type
          || ' ","family":"Doe","affiliation":[{{"name":"' || p_brand || '"}},{{"name":" "}},{{"name":"Lab"}}]}},'
          || '{{"name":"' || p_brand || ' Group","affiliation":[]}},{{"given":" ","family":""}}]}}}}' AS value
        FROM {part}
    """,
    "ocr_pages": """
        SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number,
          CASE WHEN (conv_id * 31 + turn) % 17 = 0 THEN ' [MISSING_PAGE_POST] ' ELSE text END AS prediction,
          CASE WHEN (conv_id * 31 + turn) % 19 = 0 THEN 1 WHEN (conv_id * 31 + turn) % 23 = 0 THEN 0
               ELSE NULL END AS repeats,
          (conv_id * 7 + turn) % 29 <> 0 AS success
        FROM {conversations}
    """,
    "outbox_messages": """
        SELECT event_id AS id, 'paper-uploaded' AS topic, CAST(user_id AS STRING) AS key, 'PaperUploaded' AS type,
          props AS payload,
          CASE event_type WHEN 'purchase' THEN 'Published' WHEN 'click' THEN 'Processing' WHEN 'error' THEN 'Failed'
            ELSE 'Pending' END AS status,
          CAST(event_id % 4 AS INT) AS retry_count, ts AS created_at
        FROM {events}
    """,
    "paper_events": """
        SELECT event_id, CAST(user_id AS STRING) AS key,
          CASE event_id % 10
            WHEN 0 THEN 'not json'
            WHEN 1 THEN 'null'
            WHEN 2 THEN '{{"PaperId":"' || CAST(user_id AS STRING) || '","PAPERVERSIONID":' || CAST(event_id AS STRING) || '}}'
            WHEN 3 THEN '{{"other":1}}'
            WHEN 4 THEN '[1,2]'
            ELSE '{{"paperId":' || CAST(user_id AS STRING) || ',"paperVersionId":' || CAST(event_id AS STRING)
              || ',"pdfS3Key":"k","originalFileName":"a.pdf","uploadedAt":"2026-01-01T00:00:00Z"}}' END AS value
        FROM {events}
    """,
    "paper_versions": """
        SELECT event_id AS id, user_id AS paper_id, CAST(1 + event_id % 3 AS INT) AS version_number,
          CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Failed' WHEN 'click' THEN 'Processing'
            ELSE 'Pending' END AS conversion_status,
          'file_' || CAST(event_id AS STRING) || '.pdf' AS original_file_name
        FROM {events} WHERE event_type <> 'signup'
    """,
}
