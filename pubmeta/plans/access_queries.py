"""Entitlement reads, set changes and request checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeta.operators import access as A
from pubmeta.operators import reads as R
from pubmeta.plans.base import Source, query
from pubmeta.plans.text_queries import PRINCIPALS
from pubmeta.sources.ranked import write_ranked
from pubmeta.sources.workspace import new_folder

# Permission names per role and per user, as the checking database sees them.
PERMS = "(SELECT DISTINCT rp.role_id, p.name FROM role_permissions rp JOIN permissions p ON p.id = rp.permission_id)"
ROLE_SETS = f"""(SELECT r.id, r.name, r.deleted, coalesce(string_agg(x.name, ',' ORDER BY x.name), '') AS permissions
    FROM roles r LEFT JOIN {PERMS} x ON x.role_id = r.id GROUP BY r.id, r.name, r.deleted)"""
USER_SETS = f"""(SELECT ur.user_id, string_agg(CAST(r.id AS VARCHAR) || ':' || r.name || '=' || r.permissions, ';' ORDER BY r.id) AS roles
    FROM user_roles ur JOIN {ROLE_SETS} r ON r.id = ur.role_id GROUP BY ur.user_id)"""


def graph(s: Source) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    return tuple(s.view(v) for v in ("users", "user_roles", "roles", "role_permissions", "permissions"))


def flat_roles(df: DataFrame) -> DataFrame:
    return df.withColumn("permissions", F.array_join("permissions", ","))


def flat_users(df: DataFrame) -> DataFrame:
    one = F.transform(
        "roles",
        lambda r: F.concat(
            r["id"].cast("string"), F.lit(":"), r["name"], F.lit("="), F.array_join(r["permissions"], ",")
        ),
    )
    return df.withColumn("roles", F.array_join(one, ";"))


@query("agg5_roles_with_permissions", f"SELECT id, name, permissions FROM {ROLE_SETS}")
def _(s: Source) -> DataFrame:
    _, _, roles, rp, p = graph(s)
    return flat_roles(A.roles_with_permissions(roles, rp, p)).select("id", "name", "permissions")


@query(
    "agg6_users_with_roles",
    f"SELECT u.id, u.email, coalesce(x.roles, '') AS roles FROM users u LEFT JOIN {USER_SETS} x ON x.user_id = u.id",
)
def _(s: Source) -> DataFrame:
    return flat_users(A.users_with_roles(*graph(s))).select("id", "email", "roles")


EFFECTIVE = f"SELECT DISTINCT ur.user_id, x.name AS permission FROM user_roles ur JOIN {PERMS} x ON x.role_id = ur.role_id"


@query("agg7_effective_permissions", EFFECTIVE)
def _(s: Source) -> DataFrame:
    _, edges, _, rp, p = graph(s)
    return A.effective_permissions(edges, rp, p)


@query("agg7_permission_bitmaps", EFFECTIVE)
def _(s: Source) -> DataFrame:
    """The same from bitmaps per distinct set of roles; users and permissions meet in the last join only."""
    _, edges, _, rp, p = graph(s)
    users, sets = A.permission_sets(edges, rp, p)
    return users.join(A.permissions_of_sets(sets, p), "role_set").select("user_id", "permission")


CLAIMS = f"""
    SELECT sub, CASE WHEN grp IS NULL THEN NULL WHEN starts_with(grp, 'ROLE_') THEN grp ELSE 'ROLE_' || grp END AS role,
      CASE WHEN trim(scope) <> '' THEN 'SCOPE_' || split_part(scope, '  ', 2) END AS scope FROM ({PRINCIPALS.format(customer='customer')})
"""


@query(
    "agg8_authorities",
    f"""
    WITH c AS ({CLAIMS}), e AS ({EFFECTIVE}),
    v AS (SELECT user_id AS sub, permission AS value FROM e
      UNION SELECT sub, role FROM c WHERE role IS NOT NULL
      UNION SELECT sub, 'SCOPE_read' FROM c WHERE scope IS NOT NULL
      UNION SELECT sub, scope FROM c WHERE scope IS NOT NULL)
    SELECT c.sub, coalesce(string_agg(v.value, ',' ORDER BY v.value), '') AS authorities
    FROM c LEFT JOIN v ON v.sub = c.sub GROUP BY c.sub
    """,
)
def _(s: Source) -> DataFrame:
    _, edges, _, rp, p = graph(s)
    held = A.effective_permissions(edges, rp, p).groupBy(F.col("user_id").alias("sub")).agg(
        F.collect_set("permission").alias("permissions")
    )
    principals = s.sql(PRINCIPALS).join(held, "sub", "left")
    values = A.authorities(F.col("permissions"), F.array("grp"), F.col("scope"))
    return principals.select("sub", F.array_join(F.array_sort(values), ",").alias("authorities"))


@query("agg9_distinct", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def _(s: Source) -> DataFrame:
    return s.table("orders").select("o_custkey", "o_orderpriority").distinct()


# --- joins ------------------------------------------------------------------


@query(
    "j4_user_role_permission",
    """SELECT u.full_name, r.name AS role, p.name AS permission FROM users u JOIN user_roles ur ON ur.user_id = u.id
       JOIN roles r ON r.id = ur.role_id JOIN role_permissions rp ON rp.role_id = r.id
       JOIN permissions p ON p.id = rp.permission_id""",
)
def _(s: Source) -> DataFrame:
    rows = A.user_roles(*graph(s))
    names = s.view("users").select(F.col("id").alias("user_id"), "full_name")
    return rows.join(names, "user_id").select(
        "full_name", F.col("role_name").alias("role"), F.explode("permissions").alias("permission")
    )


@query("j5_users_holding_role", "SELECT id, email FROM users WHERE id IN (SELECT user_id FROM user_roles WHERE role_id = 1)")
def _(s: Source) -> DataFrame:
    users, edges, *_ = graph(s)
    return A.users_holding(edges, users, 1).select("id", "email")


@query("j7_names_in_list", "SELECT id, name FROM permissions WHERE name IN (SELECT 'PERM_NATION_' || CAST(s_nationkey AS VARCHAR) FROM supplier)")
def _(s: Source) -> DataFrame:
    wanted = s.table("supplier").select(F.concat(F.lit("PERM_NATION_"), F.col("s_nationkey").cast("string")).alias("name"))
    return s.view("permissions").join(wanted, "name", "left_semi").select("id", "name")


# --- paging and reads -------------------------------------------------------


@query("topk2_page", "SELECT id, full_name FROM users ORDER BY id LIMIT 20 OFFSET 40")
def _(s: Source) -> DataFrame:
    return A.page(s.view("users"), 2, 20).select("id", "full_name")


@query("topk2_deep_page", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 1200")
def _(s: Source) -> DataFrame:
    return A.page(s.table("orders"), 60, 20, "o_orderkey", shallow=100).select("o_orderkey", "o_custkey")


@query("topk2_page_after", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 20")
def _(s: Source) -> DataFrame:
    return A.page_after(s.table("orders"), 700, 20, "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    "topk2_ranked_page",
    """SELECT o_orderkey, name FROM (
         SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'changed' ELSE o_orderpriority END AS name FROM orders
         UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 100 = 1)
       ORDER BY o_orderkey LIMIT 20 OFFSET 300""",
)
def _(s: Source) -> DataFrame:
    """A deep page by stored range counts, after changes and new keys before all others."""
    orders = s.table("orders").select("o_orderkey", F.col("o_orderpriority").alias("name"))
    table = write_ranked(orders, new_folder(s.spark, "ranked"), "o_orderkey", rows_per_range=100)
    table.upsert(orders.where("o_orderkey % 50 = 0").withColumn("name", F.lit("changed")))
    table.upsert(orders.where("o_orderkey % 100 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("new").alias("name")))
    return table.page(15, 20)


@query("rd2_find_role", f"SELECT id, name, deleted, permissions FROM {ROLE_SETS} WHERE name = 'RESEARCHER'")
def _(s: Source) -> DataFrame:
    _, _, roles, rp, p = graph(s)
    found = R.find_roles(roles, rp, p, F.col("name") == "RESEARCHER")
    return flat_roles(found).select("id", "name", "deleted", "permissions")


@query(
    "rd2_find_user",
    f"""SELECT u.id, u.email, u.deleted, coalesce(x.roles, '') AS roles FROM users u LEFT JOIN {USER_SETS} x ON x.user_id = u.id
        WHERE u.email = 'customer#000000010@example.org'""",
)
def _(s: Source) -> DataFrame:
    found = R.find_users(*graph(s), F.col("email") == "customer#000000010@example.org")
    return flat_users(found).select("id", "email", "deleted", "roles")


@query("rd3_list_roles", f"SELECT id, name, permissions FROM {ROLE_SETS} ORDER BY id LIMIT 2 OFFSET 2")
def _(s: Source) -> DataFrame:
    _, _, roles, rp, p = graph(s)
    return flat_roles(R.list_roles(roles, rp, p, 1, 2)).select("id", "name", "permissions")


@query(
    "rd3_list_users",
    f"""SELECT u.id, u.email, coalesce(x.roles, '') AS roles FROM users u LEFT JOIN {USER_SETS} x ON x.user_id = u.id
        WHERE NOT u.deleted ORDER BY u.id LIMIT 25 OFFSET 0""",
)
def _(s: Source) -> DataFrame:
    return flat_users(R.list_users(*graph(s), -3, 25)).select("id", "email", "roles")


@query(
    "rd1_get_metadata",
    """SELECT o.o_orderkey AS paper_id, m.doi, CASE WHEN l.l_orderkey IS NULL THEN 'Paper was not found.'
         WHEN m.doi IS NULL THEN 'Paper metadata was not found.' END AS error,
         CASE WHEN l.l_orderkey IS NOT NULL AND m.doi IS NOT NULL AND m.journal IS NOT NULL THEN 1 ELSE 0 END AS keywords
       FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l.l_orderkey = o.o_orderkey
       LEFT JOIN metadata_raw m ON m.paper_id = o.o_orderkey AND m.doi IS NOT NULL""",
)
def _(s: Source) -> DataFrame:
    ids = s.table("orders").select(F.col("o_orderkey").alias("paper_id"))
    papers = s.table("lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    stored = s.view("metadata_raw").where("doi IS NOT NULL")
    as_json = F.coalesce(F.to_json(F.array("journal")), F.lit("[]"))
    as_json = F.when(F.col("journal").isNull(), F.lit("not a list")).otherwise(as_json)
    decoded = R.decode_lists(stored.select("paper_id", "doi", as_json.alias("keywords")), {"keywords": "STRING"})
    known = F.col("error").isNull()
    return R.get_metadata(ids, papers, decoded).select(
        "paper_id", "doi", "error", F.when(known, F.size("keywords")).otherwise(0).alias("keywords")
    )


# --- set changes ------------------------------------------------------------

TARGET = """
    SELECT DISTINCT CAST(l_suppkey * 15 AS STRING) AS user_id, CAST(l_linenumber % 5 AS BIGINT) AS role_id FROM {lineitem}
"""


@query(
    "set1_role_changes",
    f"""WITH t AS ({TARGET.format(lineitem='lineitem')})
        SELECT user_id, role_id, 'add' AS action FROM (SELECT * FROM t EXCEPT SELECT user_id, role_id FROM user_roles)
        UNION ALL
        SELECT user_id, role_id, 'remove' FROM (SELECT user_id, role_id FROM user_roles EXCEPT SELECT * FROM t)""",
)
def _(s: Source) -> DataFrame:
    return A.role_changes(s.view("user_roles"), s.sql(TARGET))


ROLE_REQUESTS = """
    SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 10 = 0 THEN '  '
        WHEN s_suppkey % 10 = 1 THEN ' lab  leader ' ELSE 'team  ' || CAST(s_nationkey AS STRING) END AS name,
      s_name AS description,
      CASE WHEN s_acctbal < 0 THEN 'PERM_X,PERM_Y' WHEN s_acctbal < 3000 THEN 'PERM_NATION_1,PERM_Z'
        ELSE 'PERM_NATION_1,PERM_NATION_2' END AS names
    FROM {supplier}
"""
UNKNOWN = "CASE WHEN names LIKE 'PERM_X%' THEN 'PERM_X' WHEN names LIKE '%PERM_Z' THEN 'PERM_Z' END"


def role_requests(s: Source) -> DataFrame:
    return s.sql(ROLE_REQUESTS).withColumn("permissions", F.split("names", ",")).drop("names")


@query(
    "set2_missing_permissions",
    f"""SELECT request_id, {UNKNOWN} AS missing FROM ({ROLE_REQUESTS.format(supplier='supplier')})
        WHERE {UNKNOWN} IS NOT NULL""",
)
def _(s: Source) -> DataFrame:
    return A.missing_permissions(role_requests(s), s.view("permissions"))


@query(
    "set3_all_ids_exist",
    """SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_nationkey < 5 AS all_exist FROM customer""",
)
def _(s: Source) -> DataFrame:
    requests = s.table("customer").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.array(F.lit(1), F.col("c_nationkey").cast("bigint"), F.lit(1)).alias("role_ids"),
    )
    return A.all_ids_exist(requests, s.view("roles"), "user_id")


@query(
    "set4_seed_missing",
    """SELECT DISTINCT 'PERM_NATION_' || CAST(s_nationkey + s_suppkey % 7 AS VARCHAR) AS name FROM supplier
       WHERE 'PERM_NATION_' || CAST(s_nationkey + s_suppkey % 7 AS VARCHAR) NOT IN (SELECT name FROM permissions)""",
)
def _(s: Source) -> DataFrame:
    number = (F.col("s_nationkey") + F.col("s_suppkey") % 7).cast("string")
    wanted = s.table("supplier").select(F.concat(F.lit("PERM_NATION_"), number).alias("name"))
    return A.seed_missing(s.view("permissions"), wanted)


@query(
    "set5_role_matrix",
    """SELECT ur.user_id, r.name AS role, CAST(CASE r.name WHEN 'ADMIN' THEN 70 WHEN 'LAB_LEADER' THEN 57
         WHEN 'SENIOR_RESEARCHER' THEN 35 WHEN 'RESEARCHER' THEN 28 ELSE 11 END AS BIGINT) AS permissions
       FROM user_roles ur JOIN roles r ON r.id = ur.role_id""",
)
def _(s: Source) -> DataFrame:
    names = s.view("roles").select(F.col("id").alias("role_id"), F.col("name").alias("role"))
    matrix = A.role_matrix(s.spark)
    return (
        s.view("user_roles").join(names, "role_id").join(matrix, "role")
        .groupBy("user_id", "role").agg(F.count(F.lit(1)).alias("permissions"))
    )


@query(
    "set5_reseed_role_edges",
    """SELECT p.id AS permission_id, r.id AS role_id FROM permissions p, roles r
       WHERE 1 = 0
       UNION ALL SELECT permission_id, role_id FROM role_permissions
         WHERE role_id NOT IN (SELECT id FROM roles)
       UNION ALL SELECT 1000 + p_partkey, r.id FROM part, roles r WHERE p_partkey = 0 AND r.name IN ('ADMIN', 'LAB_LEADER')
       UNION ALL SELECT 1000 + p_partkey, r.id FROM part, roles r WHERE p_partkey > 0 AND r.name = 'ADMIN'""",
)
def _(s: Source) -> DataFrame:
    name = F.when(F.col("p_partkey") == 0, "USER_READ").otherwise("AUDIT_LOG_READ")
    permissions = s.table("part").select((F.col("p_partkey") + 1000).alias("id"), name.alias("name"))
    return A.reseed_role_edges(s.view("role_permissions"), s.view("roles"), permissions)


# --- entitlement jobs -------------------------------------------------------


@query(
    "ent1_user_roles",
    f"""SELECT ur.user_id, r.id AS role_id, r.name AS role_name, r.permissions FROM user_roles ur
        JOIN {ROLE_SETS} r ON r.id = ur.role_id""",
)
def _(s: Source) -> DataFrame:
    return flat_roles(A.user_roles(*graph(s))).select("user_id", "role_id", "role_name", "permissions")


@query(
    "ent2_grant",
    f"SELECT user_id, role_id FROM user_roles UNION SELECT user_id, role_id FROM ({TARGET.format(lineitem='lineitem')})",
)
def _(s: Source) -> DataFrame:
    return A.grant(s.view("user_roles"), s.sql(TARGET))


@query(
    "ent2_revoke",
    f"SELECT user_id, role_id FROM user_roles EXCEPT SELECT user_id, role_id FROM ({TARGET.format(lineitem='lineitem')})",
)
def _(s: Source) -> DataFrame:
    return A.revoke(s.view("user_roles"), s.sql(TARGET)).select("user_id", "role_id")


REPLACE = """
    SELECT CASE WHEN c_acctbal < 0 THEN 'x' || CAST(c_custkey AS STRING) ELSE CAST(c_custkey AS STRING) END AS user_id,
      CAST(c_nationkey AS BIGINT) AS nation
    FROM {customer}
"""
# Role ids asked for: the nation key (unknown from 5 on) and role 1.
REPLACE_ERROR = "CASE WHEN user_id LIKE 'x%' THEN 'User not found' WHEN nation > 4 THEN 'Role not found' END"


def replacements(s: Source) -> DataFrame:
    return s.sql(REPLACE).select("user_id", F.array("nation", F.lit(1).cast("bigint"), "nation").alias("role_ids"))


@query("ent3_replacement_status", f"SELECT user_id, {REPLACE_ERROR} AS error FROM ({REPLACE.format(customer='customer')})")
def _(s: Source) -> DataFrame:
    return A.replacement_status(replacements(s), s.view("users"), s.view("roles")).select("user_id", "error")


@query(
    "ent3_replace_user_roles",
    f"""WITH ok AS (SELECT * FROM ({REPLACE.format(customer='customer')}) WHERE {REPLACE_ERROR} IS NULL)
        SELECT user_id, role_id FROM user_roles WHERE user_id NOT IN (SELECT user_id FROM ok)
        UNION SELECT user_id, nation FROM ok UNION SELECT user_id, 1 FROM ok""",
)
def _(s: Source) -> DataFrame:
    edges = s.view("user_roles").select("user_id", "role_id")
    return A.replace_user_roles(edges, replacements(s), s.view("users"), s.view("roles"))


def _deletions(s: Source):
    ids = s.table("region").where(F.col("r_name").startswith("A")).select(F.col("r_regionkey").cast("bigint").alias("id"))
    ids = ids.unionByName(s.table("nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("id")))
    return A.delete_roles(s.view("roles"), s.view("user_roles"), ids)


@query(
    "ent4_delete_role_flags",
    """SELECT id, name, deleted OR (name <> 'ADMIN' AND id IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')) AS deleted
       FROM roles""",
)
def _(s: Source) -> DataFrame:
    return _deletions(s)[0].select("id", "name", "deleted")


@query("ent4_delete_role_edges", "SELECT user_id, role_id FROM user_roles WHERE role_id NOT IN (1, 2)")
def _(s: Source) -> DataFrame:
    return _deletions(s)[1].select("user_id", "role_id")


@query(
    "ent4_delete_role_rejected",
    """SELECT CAST(0 AS BIGINT) AS id, 'ADMIN role cannot be deleted' AS error
       UNION ALL SELECT n_nationkey + 100, 'Role not found' FROM nation""",
)
def _(s: Source) -> DataFrame:
    return _deletions(s)[2]


@query(
    "ent5_has_permission",
    f"""WITH c AS ({CLAIMS}), e AS ({EFFECTIVE})
        SELECT c.sub, coalesce(c.role = 'ROLE_ADMIN', FALSE)
          OR EXISTS (SELECT 1 FROM e WHERE e.user_id = c.sub AND e.permission = 'PERM_NATION_3') AS allowed FROM c""",
)
def _(s: Source) -> DataFrame:
    _, edges, _, rp, p = graph(s)
    held = A.effective_permissions(edges, rp, p).groupBy(F.col("user_id").alias("sub")).agg(
        F.collect_set("permission").alias("permissions")
    )
    rows = s.sql(PRINCIPALS).join(held, "sub", "left")
    return rows.select("sub", A.has_permission(F.col("permissions"), F.array("grp"), "PERM_NATION_3").alias("allowed"))


@query(
    "ent5_permission_bit",
    f"SELECT DISTINCT user_id FROM ({EFFECTIVE}) WHERE permission = 'PERM_NATION_3'",
)
def _(s: Source) -> DataFrame:
    _, edges, _, rp, p = graph(s)
    return A.users_with_permission(*A.permission_sets(edges, rp, p), 3)


@query(
    "ent6_group_claims",
    f"""WITH c AS ({CLAIMS})
        SELECT sub, 'role' AS type, role AS value FROM c WHERE role IS NOT NULL
        UNION ALL SELECT sub, 'scope', 'SCOPE_read' FROM c WHERE scope IS NOT NULL
        UNION ALL SELECT sub, 'scope', scope FROM c WHERE scope IS NOT NULL""",
)
def _(s: Source) -> DataFrame:
    return A.group_claims(s.sql(PRINCIPALS).withColumn("groups", F.array("grp")))


@query(
    "ent7_create_roles",
    f"""
    WITH q AS (
      SELECT *, nullif(regexp_replace(upper(trim(name)), ' +', '_', 'g'), '') AS role_name, {UNKNOWN} AS missing
      FROM ({ROLE_REQUESTS.format(supplier='supplier')})),
    w AS (SELECT role_name, min(request_id) AS winner FROM q
      WHERE missing IS NULL AND role_name NOT IN (SELECT name FROM roles) GROUP BY role_name)
    SELECT q.request_id, q.role_name, CASE WHEN q.role_name IS NULL THEN 'Role name is required'
        WHEN q.role_name IN (SELECT name FROM roles) OR q.request_id > w.winner THEN 'Role already exists'
        WHEN q.missing IS NOT NULL THEN 'Permission not found: ' || q.missing END AS error
    FROM q LEFT JOIN w ON w.role_name = q.role_name
    """,
)
def _(s: Source) -> DataFrame:
    return A.create_roles(role_requests(s), s.view("roles"), s.view("permissions")).select(
        "request_id", "role_name", "error"
    )


ROLE_UPDATES = """
    SELECT CAST(n_nationkey AS BIGINT) AS id, CASE n_nationkey WHEN 0 THEN ' ' WHEN 1 THEN 'admin' WHEN 2 THEN NULL
        WHEN 3 THEN 'new  name' ELSE 'RESEARCHER' END AS name,
      CASE n_nationkey WHEN 0 THEN NULL ELSE n_name END AS description,
      CASE n_nationkey WHEN 0 THEN 'PERM_NATION_7,PERM_NATION_8' WHEN 2 THEN 'PERM_NATION_7,PERM_Q' WHEN 3 THEN 'PERM_NATION_9' END AS names
    FROM {nation}
"""


def role_updates(s: Source) -> DataFrame:
    requests = s.sql(ROLE_UPDATES).withColumn("permissions", F.split("names", ",")).drop("names")
    return A.update_roles(requests, s.view("roles"), s.view("permissions"))


@query(
    "ent8_update_roles",
    f"""SELECT u.id, CASE u.id WHEN 3 THEN 'NEW_NAME' WHEN 4 THEN 'RESEARCHER' ELSE r.name END AS name, u.description,
          CASE WHEN r.id IS NULL THEN 'Role not found' WHEN u.id = 1 THEN 'Role already exists'
            WHEN u.id = 2 THEN 'Permission not found: PERM_Q' END AS error
        FROM ({ROLE_UPDATES.format(nation='nation')}) u LEFT JOIN roles r ON r.id = u.id""",
)
def _(s: Source) -> DataFrame:
    return role_updates(s).select("id", "name", "description", "error")


@query(
    "ent8_updated_role_edges",
    """SELECT permission_id, role_id FROM role_permissions WHERE role_id NOT IN (0, 3)
       UNION ALL SELECT id, 0 FROM permissions WHERE name IN ('PERM_NATION_7', 'PERM_NATION_8')
       UNION ALL SELECT id, 3 FROM permissions WHERE name = 'PERM_NATION_9'""",
)
def _(s: Source) -> DataFrame:
    return A.updated_role_edges(s.view("role_permissions"), role_updates(s), s.view("permissions"))


# Many updates of few roles: names are taken, given up and asked for again.
RENAMINGS = """
    SELECT CAST(s_suppkey AS BIGINT) AS request_id,
      CAST(CASE WHEN s_suppkey % 13 = 0 THEN 100 ELSE s_nationkey END AS BIGINT) AS id,
      CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE 'team  ' || CAST(s_suppkey * 7 % 61 AS STRING) END AS name,
      s_name AS description, CASE WHEN s_suppkey % 11 = 0 THEN 'PERM_Q' END AS names
    FROM {supplier}
"""


@query(
    "ent8_sequential_updates",
    f"""
    WITH RECURSIVE q AS (
      SELECT row_number() OVER (ORDER BY request_id) AS n, request_id, id, description, names,
        CASE WHEN trim(name) <> '' THEN upper(replace(name, '  ', '_')) END AS target
      FROM ({RENAMINGS.format(supplier='supplier')})),
    walk(n, held, request_id, id, name, error) AS (
      SELECT CAST(0 AS BIGINT), (SELECT list('TEAM_' || CAST(n_nationkey AS VARCHAR) ORDER BY n_nationkey) FROM nation),
        CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
      UNION ALL
      SELECT n, held, request_id, id, held[id + 1], error FROM (
        SELECT n, request_id, id, error,
          CASE WHEN error IS NULL AND target IS NOT NULL
            THEN held[:id] || [target] || held[id + 2:] ELSE held END AS held
        FROM (
          SELECT q.n, q.request_id, q.id, q.target, walk.held,
            CASE WHEN q.id >= len(walk.held) THEN 'Role not found'
              WHEN target IS NOT NULL AND target <> walk.held[q.id + 1] AND list_contains(walk.held, target) THEN 'Role already exists'
              WHEN names IS NOT NULL THEN 'Permission not found: PERM_Q' END AS error
          FROM walk JOIN q ON q.n = walk.n + 1)))
    SELECT request_id, id, name, error FROM walk WHERE n > 0
    """,
)
def _(s: Source) -> DataFrame:
    roles = s.table("nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.concat(F.lit("TEAM_"), F.col("n_nationkey").cast("string")).alias("name"),
    )
    requests = s.sql(RENAMINGS).withColumn("permissions", F.split("names", ",")).drop("names")
    return A.update_roles(requests, roles, s.view("permissions"), "request_id").select("request_id", "id", "name", "error")


USER_REQUESTS = """
    SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE 'u' || CAST(o_orderkey AS STRING) END AS id,
      'User ' || CAST(o_custkey AS STRING) AS full_name,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'customer#000000001@example.org' WHEN o_orderpriority = '2-HIGH' THEN 'hot@x'
        ELSE 'c' || CAST(o_custkey AS STRING) || '@x' END AS email
    FROM {orders}
"""


@query(
    "ent9_create_users",
    f"""
    WITH q AS ({USER_REQUESTS.format(orders='orders')}),
    w AS (SELECT email, min(request_id) AS winner FROM q
      WHERE trim(id) <> '' AND email NOT IN (SELECT email FROM users) GROUP BY email)
    SELECT q.request_id, q.email, CASE WHEN q.email IN (SELECT email FROM users) OR q.request_id > w.winner THEN 'Email already exists'
        WHEN trim(q.id) = '' THEN 'User id must be Cognito sub' END AS error
    FROM q LEFT JOIN w ON w.email = q.email
    """,
)
def _(s: Source) -> DataFrame:
    return A.create_users(s.sql(USER_REQUESTS), s.view("users")).select("request_id", "email", "error")


@query(
    "ent10_update_users",
    """SELECT CAST(s_suppkey * 20 AS VARCHAR) AS id, s_name AS full_name, lower(s_name) AS email,
         CASE WHEN CAST(s_suppkey * 20 AS VARCHAR) NOT IN (SELECT id FROM users) THEN 'User not found' END AS error FROM supplier""",
)
def _(s: Source) -> DataFrame:
    requests = s.table("supplier").select(
        (F.col("s_suppkey") * 20).cast("string").alias("id"),
        F.col("s_name").alias("full_name"),
        F.lower("s_name").alias("email"),
    )
    return A.update_users(requests, s.view("users"))
