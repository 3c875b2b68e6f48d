import random
import re

import pytest
from pyspark.sql import functions as F

from pubmeta.operators import access as A
from pubmeta.operators import ingest as I
from pubmeta.operators import quality as Q
from pubmeta.operators import reads as R
from pubmeta.operators.skew import lookup_facts
from pubmeta.schemas import TABLES, struct_type
from pubmeta.sources import readers, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize(
    "name, kind, length, want",
    [
        ("a.PDF", "Application/PDF", 1, None),
        ("a.pdf", "text/plain", 0, "Only PDF files are supported."),
        ("a.pdf.txt", "application/pdf", 1, "Only PDF files are supported."),
        ("a.pdf", None, 1, "Only PDF files are supported."),
        ("a.pdf", "application/pdf", 0, "Uploaded file is empty."),
    ],
)
def test_rejection_reason(spark, name, kind, length, want):
    df = spark.createDataFrame([(name, kind, length)], "file_name STRING, content_type STRING, length BIGINT")
    assert I.with_reason(df).first()["reason"] == want


def test_ingest_run_is_repeatable_and_committed_last(spark, tmp_path):
    uploads = spark.createDataFrame(
        [(1, 10, "x/a.pdf", "application/pdf", 5, None), (2, 20, "b.txt", "text/plain", 5, "T")],
        "paper_id BIGINT, version_id BIGINT, file_name STRING, content_type STRING, length BIGINT, title STRING",
    )
    run = str(tmp_path / "run")
    now = F.expr("TIMESTAMP '2026-01-01 00:00:00Z'")
    with pytest.raises(Exception):
        sinks.read_ingest_run(spark, run)
    first = {k: sorted(map(str, v.collect())) for k, v in sinks.ingest_batch(uploads, run, now).items()}
    again = {k: sorted(map(str, v.collect())) for k, v in sinks.ingest_batch(uploads, run, now).items()}
    assert first == again
    assert {k: len(v) for k, v in first.items()} == {
        "papers": 1, "paper_versions": 1, "paper_metadata": 1, "outbox_messages": 1, "rejected": 1,
    }
    for name in ("papers", "paper_versions", "paper_metadata", "outbox_messages"):
        stored = set(spark.read.parquet(f"{run}/{name}").columns)
        assert stored == {f.name for f in struct_type(TABLES[name])}


def test_old_files_read_with_new_columns(spark, tmp_path):
    spark.createDataFrame([(1, "t")], "id BIGINT, title STRING").write.parquet(f"{tmp_path}/papers")
    row = readers.read_table(spark, str(tmp_path), "papers").first()
    assert (row["id"], row["title"], row["current_version"], row["deleted"]) == (1, "t", None, None)


def test_binary_and_text_readers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "7.pdf").write_bytes(b"%PDF")
    got = readers.read_uploads(spark, str(tmp_path / "in")).first()
    assert (got["file_name"], got["length"], got["content_type"]) == ("7.pdf", 4, "application/pdf")
    (tmp_path / "tei").mkdir()
    (tmp_path / "tei" / "12.tei.xml").write_text("<a>\n</a>")
    assert tuple(readers.read_tei_files(spark, str(tmp_path / "tei")).first()) == (12, "<a>\n</a>")


def test_upsert_and_latest_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id BIGINT, v STRING")
    log = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id BIGINT, v STRING, batch_id BIGINT")
    changes = sinks.latest_changes(log, "id", "batch_id")
    assert rows(sinks.upsert_table(base, changes, "id"), "id") == [(1, "a"), (2, "y"), (3, "z")]


def test_soft_delete_keeps_earlier_deletes(spark):
    df = spark.createDataFrame([(1, False), (2, True), (3, False)], "id BIGINT, deleted BOOLEAN")
    ids = spark.createDataFrame([(1,), (1,), (9,)], "id BIGINT")
    assert rows(I.apply_soft_delete(df, ids), "id") == [(1, True), (2, True), (3, False)]


def test_hot_keys_are_spread_and_nothing_is_lost(spark):
    rows_in = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("name"))
    facts = rows_in.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    out = lookup_facts(rows_in, facts, "name", "id", "n", hot_rows=50)
    want = rows_in.join(facts.drop("n"), "name", "left")
    assert sorted(map(tuple, out.select("id", "name", "first").collect())) == sorted(map(tuple, want.select("id", "name", "first").collect()))
    null_name = spark.createDataFrame([(1, None)], "id BIGINT, name STRING")
    assert lookup_facts(null_name, facts, "name", "id", "n").count() == 1


# --- access -----------------------------------------------------------------


@pytest.fixture
def graph(spark):
    users = spark.createDataFrame([("u1", "a@x", False), ("u2", "b@x", True)], "id STRING, email STRING, deleted BOOLEAN")
    roles = spark.createDataFrame(
        [(1, "ADMIN", False), (2, "READER", True), (3, "EMPTY", False)], "id BIGINT, name STRING, deleted BOOLEAN"
    )
    perms = spark.createDataFrame([(1, "P1"), (2, "P2")], "id BIGINT, name STRING")
    rp = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (2, 2)], "permission_id BIGINT, role_id BIGINT")
    ur = spark.createDataFrame([("u1", 2), ("u1", 3), ("u2", 1), ("u2", 1)], "user_id STRING, role_id BIGINT")
    return users, ur, roles, rp, perms


def test_permissions_ignore_soft_deletes(graph):
    users, ur, roles, rp, perms = graph
    assert rows(A.effective_permissions(ur, rp, perms), "user_id", "permission") == [("u1", "P2"), ("u2", "P1"), ("u2", "P2")]


def test_nested_lists_are_sets(graph):
    users, ur, roles, rp, perms = graph
    got = {r["id"]: r["roles"] for r in A.users_with_roles(users, ur, roles, rp, perms).collect()}
    assert [(r["id"], r["permissions"]) for r in got["u1"]] == [(2, ["P2"]), (3, [])]
    assert [(r["id"], r["permissions"]) for r in got["u2"]] == [(1, ["P1", "P2"])]


def test_role_lookup_can_be_split_or_broadcast(graph):
    """Both inputs of the join on the role id must come straight from a shuffle of their own."""
    users, ur, roles, rp, perms = graph
    spark = users.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A.user_roles(users, ur, roles, rp, perms)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = [line.strip(" :+-") for line in plan.split("\n")]
    top = next(i for i, line in enumerate(lines) if line.startswith("SortMergeJoin [role_id"))
    indent = lambda i: len(plan.split("\n")[i]) - len(plan.split("\n")[i].lstrip(" :+-"))
    children = [i for i in range(top + 1, len(lines)) if lines[i] and indent(i) == indent(top) + 3]
    for child in children[:2]:
        assert lines[child].startswith("Sort [role_id"), plan
        assert lines[child + 1].startswith("Exchange hashpartitioning(role_id"), plan


def test_replace_roles_is_all_or_nothing(spark, graph):
    users, ur, roles, *_ = graph
    requests = spark.createDataFrame([("u1", [1, 1]), ("u2", [1, 99]), ("nobody", [1])], "user_id STRING, role_ids ARRAY<BIGINT>")
    assert rows(A.replacement_status(requests, users, roles).select("user_id", "error"), "user_id") == [
        ("nobody", "User not found"), ("u1", None), ("u2", "Role not found"),
    ]
    assert rows(A.replace_user_roles(ur, requests, users, roles).select("user_id", "role_id"), "user_id", "role_id") == [
        ("u1", 1), ("u2", 1),
    ]


def test_replace_by_nothing_removes_all(spark, graph):
    users, ur, roles, *_ = graph
    requests = spark.createDataFrame([("u1", None), ("u2", [])], "user_id STRING, role_ids ARRAY<BIGINT>")
    assert A.replace_user_roles(ur, requests, users, roles).count() == 0


def test_create_roles_in_request_order(spark, graph):
    _, _, roles, _, perms = graph
    requests = spark.createDataFrame(
        [
            (1, "new role", None, ["P9", "P8"]),
            (2, "New  Role", None, ["P1"]),
            (3, "new role", None, None),
            (4, " ", None, None),
            (5, "admin", None, ["P9"]),
        ],
        "request_id BIGINT, name STRING, description STRING, permissions ARRAY<STRING>",
    )
    got = rows(A.create_roles(requests, roles, perms).select("request_id", "role_name", "error"), "request_id")
    assert got == [
        (1, "NEW_ROLE", "Permission not found: P9"),
        (2, "NEW_ROLE", None),
        (3, "NEW_ROLE", "Role already exists"),
        (4, None, "Role name is required"),
        (5, "ADMIN", "Role already exists"),
    ]


def test_create_users_checks_address_before_id(spark, graph):
    users = graph[0]
    requests = spark.createDataFrame(
        [(1, None, "n", "a@x"), (2, " ", "n", "new@x"), (3, "u3", "n", "new@x"), (4, " ", "n", "new@x"), (5, "u5", "n", "A@x")],
        "request_id BIGINT, id STRING, full_name STRING, email STRING",
    )
    got = rows(A.create_users(requests, users).select("request_id", "error"), "request_id")
    assert got == [
        (1, "Email already exists"), (2, "User id must be Cognito sub"), (3, None), (4, "Email already exists"), (5, None),
    ]


def test_delete_roles(spark, graph):
    _, ur, roles, *_ = graph
    new_roles, edges, rejected = A.delete_roles(roles, ur, spark.createDataFrame([(1,), (3,), (8,)], "id BIGINT"))
    assert rows(new_roles.select("id", "deleted"), "id") == [(1, False), (2, True), (3, True)]
    assert ("u1", 3) not in rows(edges.select("user_id", "role_id"), "user_id")
    assert rows(rejected, "id") == [(1, "ADMIN role cannot be deleted"), (8, "Role not found")]


def test_page_clamps(spark):
    df = spark.range(10)
    assert [r[0] for r in A.page(df, -1, 3).collect()] == [0, 1, 2]
    assert [r[0] for r in A.page(df, 1, 3).collect()] == [3, 4, 5]
    assert [r[0] for r in A.page(df, 2, 0).collect()] == [2]


def test_deep_page_keeps_few_rows(spark):
    found = A.page(spark.range(200_000), 9_000, 20)
    assert [r[0] for r in found.collect()] == list(range(180_000, 180_020))
    kept = re.findall(r"TakeOrderedAndProject\(limit=(\d+)", found._jdf.queryExecution().toString())
    assert kept and all(int(n) <= 10_020 for n in kept)


@pytest.mark.parametrize("number", [0, 1, 4, 9, 29, 30, 32, 33, 500])
def test_deep_page_of_null_and_repeated_keys(spark, number):
    keys = [None] * 30 + [i // 40 for i in range(200)] + list(range(5, 105))
    df = spark.createDataFrame([(k,) for k in keys], "id INT").repartition(5)
    want = sorted(keys, key=lambda k: (k is not None, k))[10 * number : 10 * number + 10]
    assert [r[0] for r in A.page(df, number, 10, shallow=7).collect()] == want


def test_deep_page_of_an_empty_table(spark):
    assert A.page(spark.range(0), 50, 20, shallow=7).collect() == []


def test_page_after(spark):
    assert [r[0] for r in A.page_after(spark.range(50), 41, 5).collect()] == [42, 43, 44, 45, 46]
    assert A.page_after(spark.range(50), 49, 5).collect() == []


def test_role_matrix_sizes():
    assert {k: len(set(v)) for k, v in A.ROLE_MATRIX.items()} == {
        "ADMIN": 70, "LAB_LEADER": 57, "SENIOR_RESEARCHER": 35, "RESEARCHER": 28, "AI_QUALITY_ASSISTANT": 11,
    }
    assert all(set(v) <= set(A.PERMISSIONS) for v in A.ROLE_MATRIX.values())


# --- quality and reads ------------------------------------------------------


@pytest.mark.parametrize("email, ok", [("a@b", True), ("@b", False), ("a@", False), ("a@b@c", False), ("a@b\n", False), ("", False), (None, False)])
def test_email_format(value, email, ok):
    assert value(Q.email_format, email) is ok


def test_unique_rule_skips_null_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "email STRING")
    assert rows(Q.unique_violations(df, ("email",)), "email") == [("a", 2)]


def test_required_and_domain(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, "f", "k", "Done"), (2, None, 1, "f", "k", "Pending")],
        "id BIGINT, paper_id BIGINT, version_number INT, original_file_name STRING, pdf_key STRING, conversion_status STRING",
    )
    assert rows(Q.required_violations(df, "paper_versions"), "id") == [
        (1, "conversion_status", "not allowed"), (2, "paper_id", "missing"),
    ]


def test_get_metadata_statuses(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "paper_id BIGINT")
    papers = spark.createDataFrame([(1,), (2,)], "id BIGINT")
    md = R.decode_lists(spark.createDataFrame([(1, "T", "[\"k\"]")], "paper_id BIGINT, title STRING, keywords STRING"), {"keywords": "STRING"})
    got = rows(R.get_metadata(ids, papers, md).select("paper_id", "keywords", "error"), "paper_id")
    assert got == [(1, ["k"], None), (2, None, "Paper metadata was not found."), (3, None, "Paper was not found.")]


def test_fold_keeps_what_a_change_does_not_carry(spark):
    from pubmeta.streaming.jobs import fold

    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "c", "z")], "id LONG, status STRING, owner STRING")
    ddl = "version_id LONG, status STRING, batch_id LONG"
    changes = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "added", 1)], ddl)
    got = {tuple(r) for r in fold(base, changes, "version_id", "id").collect()}
    assert got == {(1, "a", "x"), (2, "new", "y"), (None, "c", "z"), (3, "added", None)}


def test_two_roles_cannot_take_one_name(spark):
    from pubmeta.operators.access import update_roles

    roles = spark.createDataFrame([(1, "ROLE_A"), (2, "ROLE_B")], "id LONG, name STRING")
    permissions = spark.createDataFrame([(1, "p")], "id LONG, name STRING")
    ddl = "id LONG, name STRING, description STRING, permissions ARRAY<STRING>"
    requests = spark.createDataFrame([(2, "new", None, None), (1, "new", None, None)], ddl)
    got = {r["id"]: (r["name"], r["error"] is None) for r in update_roles(requests, roles, permissions).collect()}
    assert got[2] == ("ROLE_B", False) and got[1][1] and got[1][0] != "ROLE_A"


def _one_by_one(requests, roles, permissions):
    """Role updates as a loop makes them."""
    names, out = dict(roles), {}
    for key, role, name, _, wanted in sorted(requests):
        target = "_".join(name.upper().split()) if name and name.strip() else None
        missing = next((p for p in wanted or [] if p not in permissions), None)
        if role not in names:
            out[key] = (role, None, "Role not found")
            continue
        error = None
        if target is not None and target != names[role] and target in names.values():
            error = "Role already exists"
        elif missing is not None:
            error = f"Permission not found: {missing}"
        elif target is not None:
            names[role] = target
        out[key] = (role, names[role], error)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_role_updates_like_one_by_one(spark, seed):
    from pubmeta.operators.access import update_roles

    rng = random.Random(seed)
    roles = [(i, f"N{i}") for i in range(1, 9)]
    names = [f"n{i}" for i in range(1, 13)] + [None, " "]
    requests = [
        (k, rng.choice([*range(1, 9), 99] if seed else [1, 2]), rng.choice(names), None, rng.choice([None, None, [], ["p"], ["p", "q"]]))
        for k in rng.sample(range(1000), 60)
    ]
    ddl = "request_id LONG, id LONG, name STRING, description STRING, permissions ARRAY<STRING>"
    got = update_roles(
        spark.createDataFrame(requests, ddl).repartition(3),
        spark.createDataFrame(roles, "id LONG, name STRING"),
        spark.createDataFrame([(1, "p")], "id LONG, name STRING"),
        "request_id",
    ).collect()
    assert len(got) == len(requests)
    assert {r["request_id"]: (r["id"], r["name"], r["error"]) for r in got} == _one_by_one(requests, roles, {"p"})


def test_names_move_along_chains_and_are_swapped(spark):
    from pubmeta.operators.access import update_roles, updated_role_edges

    roles = [(1, "A"), (2, "B"), (3, "C")]
    requests = [
        (1, 1, "b", None, None),  # in use
        (2, 1, "spare", None, ["p"]),
        (3, 2, "a", None, None),  # given up by 1
        (4, 1, "b", None, []),  # given up by 2
        (5, 3, "spare", None, ["q"]),  # given up again
        (6, 2, "c", None, None),
        (7, 3, "spare", None, None),  # its own
    ]
    ddl = "request_id LONG, id LONG, name STRING, description STRING, permissions ARRAY<STRING>"
    permissions = spark.createDataFrame([(1, "p"), (2, "q")], "id LONG, name STRING")
    updates = update_roles(spark.createDataFrame(requests, ddl), spark.createDataFrame(roles, "id LONG, name STRING"), permissions, "request_id")
    got = {r["request_id"]: (r["name"], r["error"]) for r in updates.collect()}
    assert got == _strip(_one_by_one(requests, roles, {"p", "q"}))
    assert got[4] == ("B", None) and got[6] == ("C", None)
    edges = spark.createDataFrame([(1, 1), (2, 2), (1, 3)], "permission_id LONG, role_id LONG")
    left = updated_role_edges(edges, updates, permissions)
    assert {tuple(r) for r in left.select("permission_id", "role_id").collect()} == {(2, 2), (2, 3)}


def _strip(found):
    return {k: v[1:] for k, v in found.items()}


def test_a_name_that_all_ask_for_takes_few_rounds(spark, monkeypatch):
    from pubmeta.operators import access

    rounds = []
    settle = access._settle
    monkeypatch.setattr(access, "_settle", lambda *a: rounds.append(1) or settle(*a))
    roles = [(i, f"N{i}") for i in range(300)]
    requests = [(i, "wanted", None, None) for i in range(300)]
    ddl = "id LONG, name STRING, description STRING, permissions ARRAY<STRING>"
    got = access.update_roles(
        spark.createDataFrame(requests, ddl), spark.createDataFrame(roles, "id LONG, name STRING"), spark.createDataFrame([], "id LONG, name STRING")
    ).collect()
    assert sorted(r["id"] for r in got if r["error"] is None) == [0] and len(rounds) <= 2


@pytest.mark.parametrize("at_once", [200, 11_000])
def test_names_that_change_hands_thousands_of_times_take_few_rounds(spark, monkeypatch, at_once):
    from pubmeta.operators import access

    rounds = []
    settle = access._settle
    monkeypatch.setattr(access, "_settle", lambda *a: rounds.append(1) or settle(*a))
    monkeypatch.setattr(access, "WALKED_AT_ONCE", at_once, raising=False)
    rng = random.Random(7)
    roles = [(i, f"N{i % 5}") for i in range(6)]  # two of one name
    n = 900 if at_once == 200 else 10_000
    requests = [(k, rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 9]), rng.choice(["n0", "n1", "x", "y", "z z", " "]), None, rng.choice([None, ["q"]])) for k in range(n)]
    ddl = "request_id LONG, id LONG, name STRING, description STRING, permissions ARRAY<STRING>"
    got = access.update_roles(
        spark.createDataFrame(requests, ddl).repartition(3),
        spark.createDataFrame(roles, "id LONG, name STRING"),
        spark.createDataFrame([(1, "p")], "id LONG, name STRING"),
        "request_id",
    ).collect()
    assert len(got) == n and len(rounds) <= 4
    assert {r["request_id"]: (r["id"], r["name"], r["error"]) for r in got} == _one_by_one(requests, roles, {"p"})


@pytest.mark.parametrize("low", [1, -40_000, 32_760, 1 << 40])
def test_permission_bitmaps(spark, low):
    """Bits of ids on both sides of a bitmap's border, against plain sets."""
    from pubmeta.operators import access as A

    rng = random.Random(low)
    ids = [low + 7 * i for i in range(20)]
    permissions = spark.createDataFrame([(i, f"p{i}") for i in ids] + [(ids[-1] + 1, f"p{ids[-1]}")], "id LONG, name STRING")
    edges = [(rng.choice([*ids, ids[-1] + 1]), role) for role in range(6) for _ in range(5)]
    held = [(f"u{u}", rng.randrange(7)) for u in range(12) for _ in range(3)] + [("u1", 0)] * 5
    user_role = spark.createDataFrame(held, "user_id STRING, role_id LONG")
    role_permissions = spark.createDataFrame(edges, "permission_id LONG, role_id LONG")
    users, sets = A.permission_sets(user_role, role_permissions, permissions)
    got = {tuple(r) for r in users.join(A.permissions_of_sets(sets, permissions), "role_set").select("user_id", "permission").collect()}
    want = {tuple(r) for r in A.effective_permissions(user_role, role_permissions, permissions).collect()}
    assert got == want
    for i in (ids[0], ids[7], ids[-1]):
        holding = [r["user_id"] for r in A.users_with_permission(users, sets, i).collect()]
        assert sorted(holding) == sorted(u for u, p in want if p == f"p{i}")


def test_content_types_are_measured(spark, tmp_path):
    for name, data in {"a.PDF": b"%PDF-1.7 x", "b.pdf": b"text", "c.txt": b"%PDF-", "d.md": b"# T", "e": b"?", "f.tar.zip": b"PK"}.items():
        (tmp_path / name).write_bytes(data)
    def kinds(df):
        return {r["file_name"]: r["content_type"] for r in df.collect()}
    listed = readers.read_uploads(spark, str(tmp_path))
    assert "content" not in listed.columns
    assert kinds(listed) == {"a.PDF": "application/pdf", "b.pdf": "application/pdf", "c.txt": "text/plain", "d.md": "text/markdown", "e": "application/octet-stream", "f.tar.zip": "application/zip"}
    read = readers.read_uploads(spark, str(tmp_path), with_bytes=True)
    assert kinds(read) == {"a.PDF": "application/pdf", "b.pdf": "application/octet-stream", "c.txt": "application/pdf", "d.md": "text/markdown", "e": "application/octet-stream", "f.tar.zip": "application/zip"}
    assert {r["file_name"]: (bytes(r["content"]), r["length"]) for r in read.collect()}["a.PDF"] == (b"%PDF-1.7 x", 10)


def test_json_lists_round_trip(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from pubmeta.functions.collections import parse_json_or_empty, to_json_web

    element = T.StructType([T.StructField("first_name", T.StringType()), T.StructField("email", T.StringType())])
    df = spark.createDataFrame([([("Ada", "a@x"), (None, None)],)], T.StructType([T.StructField("v", T.ArrayType(element))]))
    back = df.select(parse_json_or_empty(to_json_web(F.col("v"), T.ArrayType(element)), element).alias("v")).first()["v"]
    assert [tuple(x) for x in back] == [("Ada", "a@x"), (None, None)]
    texts = spark.createDataFrame([('["a", 1]',), ('["a"] junk',), ('["a", null]',), ("[]",)], "t STRING")
    got = [r[0] for r in texts.select(parse_json_or_empty(F.col("t"), T.StringType())).collect()]
    assert got == [[], [], ["a", None], []]
