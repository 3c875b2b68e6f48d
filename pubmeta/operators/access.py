"""Users, roles and permissions: graph reads and entitlement changes.

Edges are sets: (user, role) and (role, permission). A nested list is built
from distinct edges only, so it is never longer than the role or permission
table. No join is forced to broadcast; Spark does so for sides below its size
threshold and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pubmeta.functions.blank import is_blank
from pubmeta.functions.collections import prefix_groups, split_scopes
from pubmeta.functions.text import normalize_role_name
from pubmeta.operators.skew import lookup_facts
from pubmeta.schemas import (
    ADMIN_ROLE_KEPT,
    EMAIL_EXISTS,
    PERMISSION_NOT_FOUND,
    ROLE_EXISTS,
    ROLE_NAME_REQUIRED,
    ROLE_NOT_FOUND,
    USER_ID_REQUIRED,
    USER_NOT_FOUND,
)
from pubmeta.sources.workspace import new_folder, stored

ADMIN = "ADMIN"
ADMIN_CLAIM = "ROLE_ADMIN"
_STRINGS = "array<string>"
#: Open role updates that one task goes through one after another.
WALKED_AT_ONCE = 100_000


# --- reads ------------------------------------------------------------------


def permission_names(role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """Distinct ``(role_id, permission)`` pairs."""
    names = permissions.select(F.col("id").alias("permission_id"), F.col("name").alias("permission"))
    return role_permissions.join(names, "permission_id").select("role_id", "permission").distinct()


def roles_with_permissions(roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """Each role with its sorted permission names; roles without any keep an empty list."""
    names = permission_names(role_permissions, permissions).withColumnRenamed("role_id", "id")
    return (
        roles.join(names, "id", "left")
        .groupBy(*roles.columns)
        .agg(F.sort_array(F.collect_set("permission")).alias("permissions"))
    )


def user_roles(
    users: DataFrame, user_role: DataFrame, roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame
) -> DataFrame:
    """One row per user and role, with the permission set of the role.

    The role side is spread by name first, so that the join shuffles it by id on
    its own. Only then does Spark know its real size and can broadcast it, or
    else split a role that very many users hold.
    """
    nested = (
        roles_with_permissions(roles, role_permissions, permissions)
        .select(F.col("id").alias("role_id"), F.col("name").alias("role_name"), "permissions")
        .repartition("role_name")
    )
    edges = user_role.distinct().join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return edges.join(nested, "role_id")


def users_with_roles(
    users: DataFrame, user_role: DataFrame, roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame
) -> DataFrame:
    """Each user with the list of role structs, ordered by role id."""
    role = F.struct(F.col("role_id").alias("id"), F.col("role_name").alias("name"), "permissions")
    lists = (
        user_roles(users, user_role, roles, role_permissions, permissions)
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.array_sort(F.collect_list(role)).alias("roles"))
    )
    none = F.array().cast("array<struct<id: bigint, name: string, permissions: array<string>>>")
    return users.join(lists, "id", "left").withColumn("roles", F.coalesce("roles", none))


def effective_permissions(user_role: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """Distinct ``(user_id, permission)`` over all roles of a user; soft deletes do not matter."""
    names = permission_names(role_permissions, permissions)
    return user_role.distinct().join(names, "role_id").select("user_id", "permission").distinct()


#: Permission numbers that one bitmap covers; those beyond have bitmaps of their own.
BITMAP_BITS = 32_768


def permission_numbers(permissions: DataFrame) -> DataFrame:
    """``(permission, number)``: one number per name, the smallest of its ids."""
    return permissions.groupBy(F.col("name").alias("permission")).agg(F.min("id").alias("number"))


def role_bitmaps(role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """``(role_id, bucket, bits)``: the permissions of a role as bits, BITMAP_BITS of them in a row."""
    numbers = permission_numbers(permissions)
    ids = permissions.join(numbers, F.col("name") == F.col("permission")).select(F.col("id").alias("permission_id"), "number")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    return role_permissions.join(ids, "permission_id").groupBy("role_id", bucket).agg(bits)


def permission_sets(
    user_role: DataFrame, role_permissions: DataFrame, permissions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Users with the set of roles they hold, ``(user_id, role_set)``, and ``(role_set, bucket, bits)``.

    Users that hold the same roles have the same permissions, so bitmaps are merged once per distinct set of roles, not
    per user, and no row of a user and a permission is made. Sets are as many as there are combinations in use.
    """
    users = user_role.groupBy("user_id").agg(F.sort_array(F.collect_set("role_id")).alias("role_set"))
    sets = users.select("role_set").distinct().select("role_set", F.explode("role_set").alias("role_id"))
    merged = sets.join(role_bitmaps(role_permissions, permissions), "role_id").groupBy("role_set", "bucket")
    return users, merged.agg(F.bitmap_or_agg("bits").alias("bits"))


def bit_is_set(bits: Column, position: Column | int) -> Column:
    """Whether a bitmap has the bit at ``position`` (from 0)."""
    position = F.lit(position) if isinstance(position, int) else position
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0, F.lit(False))


def users_with_permission(users: DataFrame, sets: DataFrame, number: int) -> DataFrame:
    """``(user_id)`` that hold the permission of that number: a bit test per role set, then a semi join."""
    bucket, position = divmod(number - 1, BITMAP_BITS)
    if number <= 0:
        bucket, position = -(-number // BITMAP_BITS), -number % BITMAP_BITS
    else:
        bucket += 1
    holding = sets.where((F.col("bucket") == bucket) & bit_is_set(F.col("bits"), position))
    return users.join(holding.select("role_set"), "role_set", "left_semi").select("user_id")


def permissions_of_sets(sets: DataFrame, permissions: DataFrame) -> DataFrame:
    """``(role_set, permission)`` read back from the bitmaps."""
    places = F.filter(F.sequence(F.lit(0), F.lit(BITMAP_BITS - 1)), lambda i: bit_is_set(F.col("bits"), i))
    held = sets.select("role_set", "bucket", F.explode(places).alias("place"))
    number = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BITMAP_BITS + F.col("place") + 1)
    number = number.otherwise(F.col("bucket") * BITMAP_BITS - F.col("place"))
    return held.withColumn("number", number).join(permission_numbers(permissions), "number").select("role_set", "permission")


def users_holding(user_role: DataFrame, users: DataFrame, role_id: int) -> DataFrame:
    holders = user_role.where(F.col("role_id") == role_id).select(F.col("user_id").alias("id"))
    return users.join(holders, "id", "left_semi")


def group_claims(principals: DataFrame) -> DataFrame:
    """Role and scope claims of ``(sub, groups, scope)``, one row each."""
    claims = F.concat(
        F.transform(prefix_groups(F.col("groups")), lambda v: F.struct(F.lit("role").alias("type"), v.alias("value"))),
        F.transform(split_scopes(F.col("scope")), lambda v: F.struct(F.lit("scope").alias("type"), v.alias("value"))),
    )
    return principals.select("sub", F.explode(claims).alias("claim")).select("sub", "claim.type", "claim.value")


def authorities(permissions: Column, groups: Column, scope: Column) -> Column:
    """Distinct permission, role and scope values of one principal."""
    held = F.coalesce(permissions, F.array().cast(_STRINGS))
    return F.array_distinct(F.concat(held, prefix_groups(groups), split_scopes(scope)))


def has_permission(permissions: Column, groups: Column, permission: str) -> Column:
    """The permission itself, or the administrator role claim."""
    held = F.coalesce(F.array_contains(permissions, permission), F.lit(False))
    return held | F.array_contains(prefix_groups(groups), ADMIN_CLAIM)


def page(df: DataFrame, number: int, size: int, key: str = "id", shallow: int = 10_000) -> DataFrame:
    """Page ``number`` (from 0) in key order, NULL keys first; negative numbers and sizes are clamped.

    A plain offset keeps every earlier row in one task. A page that starts after more than ``shallow`` rows is
    therefore looked up by range first, so that only rows near its start are ordered; the rows are the same.
    """
    take = max(1, size)
    start = max(0, number) * take
    if start > shallow:
        df, start = _near(df, start, key, shallow)
    return df.orderBy(key).offset(start).limit(take)


def page_after(df: DataFrame, last: object, size: int, key: str = "id") -> DataFrame:
    """The page after the one that ended at key ``last``; one scan and a bounded top-n at any depth."""
    return df.where(F.col(key) > F.lit(last)).orderBy(key).limit(max(1, size))


def _near(df: DataFrame, start: int, key: str, shallow: int) -> tuple[DataFrame, int]:
    """Leave out rows before the key range that holds row ``start``, and say how many of the others still precede it.

    Each round counts the rows of every key range (one row per partition comes back) and goes on inside the range with
    the wanted row, until few rows precede it there or all rows left share one key.
    """
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    inside, low = df.select(F.col(key).alias("key")), None
    while start > shallow:
        dealt = inside.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
        counted = dealt.groupBy("part").agg(F.min("key").alias("first"), F.count("*").alias("n"))
        ranges = counted.orderBy("part").collect()
        at = 0
        while at < len(ranges) and ranges[at]["n"] <= start:
            start -= ranges[at]["n"]
            at += 1
        if at == len(ranges):
            return df.where(F.lit(False)), 0
        if at:
            low = ranges[at]["first"]
            inside = inside.where(F.col("key") >= F.lit(low))
        if at + 1 < len(ranges):
            inside = inside.where(F.col("key").isNull() | (F.col("key") < F.lit(ranges[at + 1]["first"])))
        if len(ranges) == 1:
            break
    return (df if low is None else df.where(F.col(key) >= F.lit(low))), start


# --- set changes ------------------------------------------------------------


def role_changes(current: DataFrame, target: DataFrame) -> DataFrame:
    """``add`` and ``remove`` rows that turn the current edges into the target edges."""
    keys = ["user_id", "role_id"]
    have = current.select(*keys).distinct().withColumn("_have", F.lit(True))
    want = target.select(*keys).distinct().withColumn("_want", F.lit(True))
    action = F.when(F.col("_have").isNull(), "add").when(F.col("_want").isNull(), "remove")
    return have.join(want, keys, "full_outer").select(*keys, action.alias("action")).where("action IS NOT NULL")


def missing_permissions(requests: DataFrame, permissions: DataFrame, key: str = "request_id") -> DataFrame:
    """First unknown name of each request ``(key, permissions)``; requests without one are left out."""
    known = permissions.select("name")
    asked = requests.select(key, F.posexplode("permissions").alias("position", "name"))
    unknown = asked.join(known, "name", "left_anti")
    return unknown.groupBy(key).agg(F.min_by("name", "position").alias("missing"))


def all_ids_exist(requests: DataFrame, known: DataFrame, key: str, ids: str = "role_ids") -> DataFrame:
    """Per request, whether every distinct id of the list is in ``known(id)``."""
    asked = requests.select(key, F.explode_outer(F.array_distinct(ids)).alias("id"))
    found = known.select("id", F.lit(True).alias("_found"))
    ok = F.bool_and(F.col("id").isNull() | F.coalesce("_found", F.lit(False)))
    return asked.join(found, "id", "left").groupBy(key).agg(ok.alias("all_exist"))


def seed_missing(existing: DataFrame, wanted: DataFrame, key: str = "name") -> DataFrame:
    """Wanted rows whose key is not there yet."""
    return wanted.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def grant(edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    return edges.unionByName(new_edges).distinct()


def revoke(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["user_id", "role_id"], "left_anti")


def replacement_status(requests: DataFrame, users: DataFrame, roles: DataFrame) -> DataFrame:
    """``(user_id, role_ids)`` with ``error``: unknown user first, then any unknown role."""
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_user"))
    exist = all_ids_exist(requests, roles, "user_id")
    error = F.when(F.col("_user").isNull(), USER_NOT_FOUND).when(~F.col("all_exist"), ROLE_NOT_FOUND)
    return (
        requests.join(known, "user_id", "left")
        .join(exist, "user_id", "left")
        .select("user_id", "role_ids", error.alias("error"))
    )


def replace_user_roles(edges: DataFrame, requests: DataFrame, users: DataFrame, roles: DataFrame) -> DataFrame:
    """Edge table after the valid requests; users of rejected requests keep their edges."""
    valid = replacement_status(requests, users, roles).where("error IS NULL")
    kept = edges.join(valid.select("user_id"), "user_id", "left_anti")
    target = valid.select("user_id", F.explode(F.array_distinct("role_ids")).alias("role_id"))
    return kept.unionByName(target.select(*edges.columns)).distinct()


def delete_roles(roles: DataFrame, edges: DataFrame, role_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(roles, edges, rejected)``: deleted roles lose their user edges and are only flagged."""
    asked = role_ids.select(F.col("id")).distinct()
    found = asked.join(roles.select("id", "name"), "id", "left")
    error = F.when(F.col("name").isNull(), ROLE_NOT_FOUND).when(F.col("name") == ADMIN, ADMIN_ROLE_KEPT)
    checked = found.select("id", error.alias("error"))
    gone = checked.where("error IS NULL").select("id", F.lit(True).alias("_gone"))
    new_roles = (
        roles.join(gone, "id", "left")
        .withColumn("deleted", F.coalesce("_gone", F.lit(False)) | F.col("deleted"))
        .drop("_gone")
    )
    new_edges = edges.join(gone.select(F.col("id").alias("role_id")), "role_id", "left_anti")
    return new_roles, new_edges, checked.where("error IS NOT NULL")


# --- requests ---------------------------------------------------------------


def _name_facts(requests: DataFrame, used: DataFrame, name: str, open_flag: str, key: str) -> DataFrame:
    """Per requested name: rows, whether it is in use, and the first request acceptable on its own.

    Everything combines on the map side, however many requests share a name.
    """
    asked = requests.where(F.col(name).isNotNull()).groupBy(name)
    facts = asked.agg(
        F.count(F.lit(1)).alias("_rows"), F.min(F.when(F.col(open_flag), F.col(key))).alias("_winner")
    )
    return facts.join(used.select(name, F.lit(True).alias("_used")).distinct(), name, "left")


def _taken(key: str) -> Column:
    return F.coalesce(F.col("_used"), F.col(key) > F.col("_winner"), F.lit(False))


def create_roles(requests: DataFrame, roles: DataFrame, permissions: DataFrame) -> DataFrame:
    """``(request_id, name, description, permissions)`` to the same plus normalised name and ``error``.

    Requests count as made in id order: the first acceptable one takes a name,
    later ones find it in use.
    """
    named = requests.withColumn("role_name", normalize_role_name(F.col("name")))
    checked = named.join(missing_permissions(requests, permissions), "request_id", "left")
    checked = checked.withColumn("_open", F.col("missing").isNull())
    used = roles.select(F.col("name").alias("role_name"))
    facts = _name_facts(checked, used, "role_name", "_open", "request_id")
    error = (
        F.when(F.col("role_name").isNull(), F.lit(ROLE_NAME_REQUIRED))
        .when(_taken("request_id"), F.lit(ROLE_EXISTS))
        .when(F.col("missing").isNotNull(), F.concat(F.lit(PERMISSION_NOT_FOUND), F.col("missing")))
    )
    return lookup_facts(checked, facts, "role_name", "request_id", "_rows").select(
        "request_id", "role_name", "description", "permissions", error.alias("error")
    )


def update_roles(
    requests: DataFrame, roles: DataFrame, permissions: DataFrame, order: str = "id"
) -> DataFrame:
    """Role updates as one after another would make them.

    ``requests`` is ``(id, name, description, permissions)`` and a unique ``order``, by which requests count as
    made; a role may have several. A blank name keeps the one the role has by then. The description is always
    overwritten. A NULL permission list leaves the permissions alone, an empty one clears them. A name is in use while
    a role has it: one that an earlier request gave up is free, so names move along chains and may be swapped over a
    third name. Returns the request's key, ``id``, the role's ``name`` after the request, and ``error``.

    Requests are settled in rounds. A round sees the names after all settled requests, and settles every request
    whose outcome no open one can change:

    - a name is held, and the role that holds it asks for no other name before the request: it is in use;
    - a name is free, and the request is the first acceptable one for it and the first open renaming of its role: it
      gets the name; requests before that one which lack a permission fail for that;
    - the name is the role's own, and the role asks for no other before the request: nothing to rename.

    All requests for a name in use fall in one round, but names that change hands one after another take a round
    each. So rounds go on only while more than WALKED_AT_ONCE requests are open and each round settles a quarter of
    them; the rest is walked through in order, in blocks of that size (``_walk``). Each round reads stored tables,
    combines on the map side, and joins per-name and per-role facts by ``lookup_facts``, so that neither a name nor a
    role with most of the requests is one task.
    """
    given = normalize_role_name(F.col("name"))
    asked = requests.withColumn("_at", F.col(order)).withColumn("target", given)
    lacking = missing_permissions(asked.select("_at", "permissions"), permissions, "_at")
    names = stored(roles.select("id", "name"), "role-names")
    first_names = names
    known = names.select(F.col("id").alias("_role"), F.lit(True).alias("_known"))
    asked = asked.join(lacking, "_at", "left").join(known, F.col("id") == F.col("_role"), "left")
    asked = stored(asked.drop("_role").withColumn("_known", F.coalesce("_known", F.lit(False))), "role-requests")
    open_ = asked.where("_known").select("_at", "id", "target", F.col("missing").isNull().alias("ok"))
    settled: list[DataFrame] = []
    left, before = open_.count(), None
    while left > WALKED_AT_ONCE and (before is None or before - left >= before // 4):
        now, open_ = _settle(open_, names)
        settled = [*settled, now] if len(settled) < 30 else [stored(reduce(DataFrame.unionByName, settled), "role-settled"), now]
        names = _renamed(names, now)
        before, left = left, open_.count()
    if left:
        settled.append(_walk(open_, names, -(-left // WALKED_AT_ONCE)))
    none = open_.limit(0).select("_at", "id", "target", F.lit(False).alias("in_use"), F.lit(False).alias("renamed"))
    taken = reduce(DataFrame.unionByName, settled, none)
    verdicts = taken.select(F.col("_at").alias("_verdict_at"), "in_use", "renamed")
    checked = asked.join(verdicts, F.col("_at") == F.col("_verdict_at"), "left")
    error = (
        F.when(~F.col("_known"), F.lit(ROLE_NOT_FOUND))
        .when(F.col("in_use"), F.lit(ROLE_EXISTS))
        .when(F.col("missing").isNotNull(), F.concat(F.lit(PERMISSION_NOT_FOUND), F.col("missing")))
    )
    checked = checked.withColumn("error", error)
    named = _names_after(checked.withColumn("_given", F.when(F.col("renamed"), F.col("target"))), first_names)
    keys = ["id"] if order == "id" else [order, "id"]
    return named.select(
        *keys,
        F.col("_name").alias("name"),
        "description",
        "permissions",
        F.col("permissions").isNotNull().alias("replaces_permissions"),
        "error",
    )


def _settle(open_: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over open requests ``(_at, id, target, ok)``: settled ones with ``in_use, renamed``, and the rest."""
    # per role: its name now, its number of open requests, and its first open request for another name
    mine = names.select("id", F.col("name").alias("own"))
    sizes = open_.groupBy("id").agg(F.count(F.lit(1)).alias("_rows"))
    known = lookup_facts(open_, stored(mine.join(sizes, "id"), "role-facts"), "id", "_at", "_rows")
    moves = known.where(F.col("ok") & F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("own")))
    moves = stored(moves, "role-moves")
    heads = moves.groupBy("id").agg(F.min("_at").alias("head"))
    by_role = mine.join(sizes, "id").join(heads, "id", "left")
    # per name: who has it, when that role may give it up, and the first acceptable request for it
    freed = F.when(F.count("head") == F.count(F.lit(1)), F.max("head"))
    holders = names.join(heads, "id", "left").groupBy(F.col("name").alias("target"))
    holders = holders.agg(freed.alias("freed")).withColumn("held", F.lit(True))
    firsts = moves.groupBy("target").agg(F.min("_at").alias("first"))
    wanted = open_.where(F.col("target").isNotNull()).groupBy("target").agg(F.count(F.lit(1)).alias("_rows"))
    by_name = wanted.join(holders, "target", "left").join(firsts, "target", "left")
    rows = lookup_facts(open_, stored(by_role, "role-heads"), "id", "_at", "_rows")
    rows = lookup_facts(rows, stored(by_name, "role-wanted"), "target", "_at", "_rows")
    at, before = F.col("_at"), lambda limit: F.col(limit).isNull() | (F.col("_at") < F.col(limit))
    keeps = F.col("target").isNull() | F.col("target").eqNullSafe(F.col("own"))
    held = F.coalesce("held", F.lit(False))
    wins = ~keeps & ~held & F.col("ok") & (at == F.col("first")) & (at == F.col("head"))
    lacks = ~keeps & ~held & ~F.col("ok") & before("first")
    in_use = ~keeps & held & before("freed")
    done = (keeps & before("head")) | wins | lacks | in_use
    flags = {"done": done, "in_use": in_use, "renamed": wins}
    rows = rows.select("_at", "id", "target", "ok", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])
    rows = stored(rows, "role-round")
    return rows.where("done").select("_at", "id", "target", "in_use", "renamed"), rows.where("NOT done").select(*open_.columns)


def _renamed(names: DataFrame, now: DataFrame) -> DataFrame:
    """Names of roles after settled requests: of the renamings of a role the last one."""
    new = now.where("renamed").groupBy("id").agg(F.max_by("target", "_at").alias("_new"))
    return stored(names.join(new, "id", "left").select("id", F.coalesce("_new", "name").alias("name")), "role-names")


def _walk(open_: DataFrame, names: DataFrame, blocks: int) -> DataFrame:
    """Open requests one after another: ``(_at, id, target, in_use, renamed)``.

    What a request finds depends on the one before, so blocks of requests follow each other in time. A block is one
    task, and knows the names of its own roles and how many roles have a name that it asks for, no others.
    """
    spark, path = open_.sparkSession, new_folder(open_.sparkSession, "role-blocks")
    dealt = open_.repartitionByRange(blocks, "_at").withColumn("_block", F.spark_partition_id())
    dealt.write.partitionBy("_block").parquet(path)
    table = spark.read.schema(dealt.schema).parquet(path)
    asking, wanted = open_.select("id").distinct(), open_.select(F.col("target").alias("name")).distinct()
    concerned = names.join(asking, "id", "left_semi").unionByName(
        names.join(asking, "id", "left_anti").join(wanted, "name", "left_semi").select(*names.columns)
    )
    names = stored(concerned, "role-names")
    fields = [f for f in open_.schema if f.name in ("_at", "id", "target")]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", in_use BOOLEAN, renamed BOOLEAN"

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}  # roles renamed in this block
        more: dict = {}  # how many more roles have a name than when the block began
        for batch in batches:
            in_use, renamed = [], []
            columns = [batch.column(c).to_pylist() for c in ("id", "target", "ok", "own", "held")]
            for role, target, ok, name, held in zip(*columns):
                name = own.get(role, name)
                asks = target is not None and target != name
                taken = asks and held + more.get(target, 0) > 0
                wins = asks and ok and not taken
                if wins:
                    own[role] = target
                    more[target] = more.get(target, 0) + 1
                    more[name] = more.get(name, 0) - 1
                in_use.append(taken)
                renamed.append(wins)
            kept = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(in_use, pa.bool_()), pa.array(renamed, pa.bool_())], names=[*(f.name for f in fields), "in_use", "renamed"])

    walked = []
    for k in range(blocks):
        block = table.where(F.col("_block") == k)
        holders = names.groupBy(F.col("name").alias("target")).agg(F.count(F.lit(1)).alias("held"))
        rows = block.join(names.select("id", F.col("name").alias("own")), "id").join(holders, "target", "left")
        rows = rows.select(*(f.name for f in fields), "ok", "own", F.coalesce("held", F.lit(0)).alias("held"))
        now = stored(rows.repartition(1).sortWithinPartitions("_at").mapInArrow(one_by_one, ddl), "role-walked")
        walked.append(now)
        if k + 1 < blocks:
            names = _renamed(names, now)
        if len(walked) == 30:
            walked = [stored(reduce(DataFrame.unionByName, walked), "role-walked")]
    return reduce(DataFrame.unionByName, walked)


def _names_after(requests: DataFrame, first_names: DataFrame) -> DataFrame:
    """``requests`` with ``_name``, the one that the role has after each: the last ``_given`` up to then, else its first.

    Rows are dealt by role and time; a part takes the last name that earlier parts gave to its roles, so that a role
    with most of the requests is many parts.
    """
    dealt = requests.repartitionByRange("id", "_at").withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "role-dealt")
    last = F.max_by("_given", F.when(F.col("_given").isNotNull(), F.col("_at")))
    parts = dealt.groupBy("id", "_part").agg(last.alias("_last"))
    earlier = Window.partitionBy("id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("id", "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_brought"))
    begun = first_names.select("id", F.col("name").alias("_begun"))
    rows = dealt.join(parts.join(begun, "id", "left"), ["id", "_part"], "left")
    up_to = Window.partitionBy("id", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_name", F.coalesce(F.last("_given", ignorenulls=True).over(up_to), "_brought", "_begun"))


def updated_role_edges(role_permissions: DataFrame, updates: DataFrame, permissions: DataFrame) -> DataFrame:
    """Role-permission edges after the error-free updates that carry a permission list; a role's last one counts.

    Updates of a role count in the order of their first column.
    """
    valid = updates.where("error IS NULL AND replaces_permissions")
    valid = valid.groupBy("id").agg(F.max_by("permissions", F.col(updates.columns[0])).alias("permissions"))
    kept = role_permissions.join(valid.select(F.col("id").alias("role_id")), "role_id", "left_anti")
    names = valid.select(F.col("id").alias("role_id"), F.explode("permissions").alias("name"))
    ids = permissions.select(F.col("id").alias("permission_id"), "name")
    return kept.select("permission_id", "role_id").unionByName(
        names.join(ids, "name").select("permission_id", "role_id").distinct()
    )


def create_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """``(request_id, id, full_name, email)`` with ``error``: address in use first, then a blank id."""
    checked = requests.withColumn("_open", ~is_blank(F.col("id")))
    facts = _name_facts(checked, users.select("email"), "email", "_open", "request_id")
    error = F.when(_taken("request_id"), F.lit(EMAIL_EXISTS)).when(is_blank(F.col("id")), F.lit(USER_ID_REQUIRED))
    return lookup_facts(checked, facts, "email", "request_id", "_rows").select(
        "request_id", "id", "full_name", "email", error.alias("error")
    )


def update_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Overwrite name and address of known users; addresses are not checked here (see the unique rule)."""
    known = users.select("id", F.lit(True).alias("_known"))
    error = F.when(F.col("_known").isNull(), F.lit(USER_NOT_FOUND))
    return requests.join(known, "id", "left").select("id", "full_name", "email", error.alias("error"))


# --- fixed role matrix ------------------------------------------------------

# Permission names.
PERMISSIONS = tuple(
    """
    USER_CREATE USER_READ USER_UPDATE USER_DELETE
    ROLE_CREATE ROLE_READ ROLE_UPDATE ROLE_DELETE ROLE_ASSIGN
    FILE_UPLOAD FILE_DELETE
    RESEARCH_GROUP_CREATE RESEARCH_GROUP_READ RESEARCH_GROUP_UPDATE RESEARCH_GROUP_DELETE
    RESEARCH_GROUP_MEMBER_MANAGE
    RESEARCH_PROFILE_CREATE RESEARCH_PROFILE_READ RESEARCH_PROFILE_UPDATE RESEARCH_PROFILE_DELETE
    LAB_MEMBER_CREATE LAB_MEMBER_READ LAB_MEMBER_UPDATE LAB_MEMBER_DELETE
    PAPER_CREATE PAPER_READ_OWN PAPER_READ_ALL PAPER_UPDATE_OWN PAPER_UPDATE_ALL
    PAPER_DELETE_OWN PAPER_DELETE_ALL PAPER_SUBMIT_INTERNAL_REVIEW
    PAPER_VERSION_UPLOAD PAPER_VERSION_READ PAPER_VERSION_UPDATE PAPER_VERSION_COMPARE
    PAPER_VERSION_DELETE PAPER_VERSION_RESTORE
    QUALITY_CHECK_RUN QUALITY_REPORT_READ
    INTEGRITY_CHECK_RUN INTEGRITY_REPORT_READ_OWN INTEGRITY_REPORT_READ_ALL INTEGRITY_REPORT_APPROVE
    REVIEW_CREATE REVIEW_READ_ASSIGNED REVIEW_READ_ALL REVIEW_ASSIGN REVIEW_DECISION_SUBMIT
    VENUE_RECOMMEND VENUE_CREATE VENUE_UPDATE VENUE_DELETE
    SUBMISSION_CREATE SUBMISSION_UPDATE SUBMISSION_TRACK SUBMISSION_APPROVE
    REVIEWER_RESPONSE_CREATE REVIEWER_RESPONSE_READ
    NOTIFICATION_READ NOTIFICATION_MANAGE
    ANALYTICS_READ_OWN ANALYTICS_READ_LAB ANALYTICS_READ_ALL
    KNOWLEDGE_BASE_CREATE KNOWLEDGE_BASE_READ KNOWLEDGE_BASE_UPDATE KNOWLEDGE_BASE_DELETE
    ADMIN_SETTING_MANAGE
    AUDIT_LOG_READ
    """.split()
)

# Permissions of each role; the administrator has all of them.
LAB_LEADER = tuple(
    """
    USER_READ ROLE_ASSIGN ROLE_READ
    FILE_UPLOAD FILE_DELETE
    LAB_MEMBER_CREATE LAB_MEMBER_READ LAB_MEMBER_UPDATE LAB_MEMBER_DELETE
    RESEARCH_GROUP_CREATE RESEARCH_GROUP_READ RESEARCH_GROUP_UPDATE RESEARCH_GROUP_DELETE
    RESEARCH_GROUP_MEMBER_MANAGE
    RESEARCH_PROFILE_CREATE RESEARCH_PROFILE_READ RESEARCH_PROFILE_UPDATE RESEARCH_PROFILE_DELETE
    PAPER_CREATE PAPER_READ_OWN PAPER_READ_ALL PAPER_UPDATE_OWN PAPER_UPDATE_ALL
    PAPER_DELETE_OWN PAPER_DELETE_ALL PAPER_SUBMIT_INTERNAL_REVIEW
    PAPER_VERSION_UPLOAD PAPER_VERSION_READ PAPER_VERSION_UPDATE PAPER_VERSION_COMPARE
    PAPER_VERSION_DELETE PAPER_VERSION_RESTORE
    QUALITY_CHECK_RUN QUALITY_REPORT_READ
    INTEGRITY_CHECK_RUN INTEGRITY_REPORT_READ_OWN INTEGRITY_REPORT_READ_ALL INTEGRITY_REPORT_APPROVE
    REVIEW_CREATE REVIEW_READ_ASSIGNED REVIEW_READ_ALL REVIEW_ASSIGN REVIEW_DECISION_SUBMIT
    VENUE_RECOMMEND
    SUBMISSION_CREATE SUBMISSION_UPDATE SUBMISSION_TRACK SUBMISSION_APPROVE
    REVIEWER_RESPONSE_CREATE REVIEWER_RESPONSE_READ
    NOTIFICATION_READ NOTIFICATION_MANAGE
    ANALYTICS_READ_OWN ANALYTICS_READ_LAB
    KNOWLEDGE_BASE_CREATE KNOWLEDGE_BASE_READ KNOWLEDGE_BASE_UPDATE
    """.split()
)
SENIOR_RESEARCHER = tuple(
    """
    FILE_UPLOAD LAB_MEMBER_READ RESEARCH_GROUP_READ RESEARCH_PROFILE_READ
    PAPER_CREATE PAPER_READ_OWN PAPER_UPDATE_OWN PAPER_DELETE_OWN PAPER_SUBMIT_INTERNAL_REVIEW
    PAPER_VERSION_UPLOAD PAPER_VERSION_READ PAPER_VERSION_UPDATE PAPER_VERSION_COMPARE
    PAPER_VERSION_DELETE PAPER_VERSION_RESTORE
    QUALITY_CHECK_RUN QUALITY_REPORT_READ
    INTEGRITY_CHECK_RUN INTEGRITY_REPORT_READ_OWN INTEGRITY_REPORT_APPROVE
    REVIEW_CREATE REVIEW_READ_ASSIGNED REVIEW_DECISION_SUBMIT
    VENUE_RECOMMEND
    SUBMISSION_CREATE SUBMISSION_UPDATE SUBMISSION_TRACK SUBMISSION_APPROVE
    REVIEWER_RESPONSE_CREATE REVIEWER_RESPONSE_READ
    NOTIFICATION_READ ANALYTICS_READ_OWN
    KNOWLEDGE_BASE_CREATE KNOWLEDGE_BASE_READ KNOWLEDGE_BASE_UPDATE
    """.split()
)
RESEARCHER = tuple(
    """
    FILE_UPLOAD LAB_MEMBER_READ RESEARCH_GROUP_READ RESEARCH_PROFILE_READ
    PAPER_CREATE PAPER_READ_OWN PAPER_UPDATE_OWN PAPER_DELETE_OWN PAPER_SUBMIT_INTERNAL_REVIEW
    PAPER_VERSION_UPLOAD PAPER_VERSION_READ PAPER_VERSION_UPDATE PAPER_VERSION_COMPARE
    PAPER_VERSION_DELETE PAPER_VERSION_RESTORE
    QUALITY_CHECK_RUN QUALITY_REPORT_READ
    INTEGRITY_CHECK_RUN INTEGRITY_REPORT_READ_OWN
    VENUE_RECOMMEND
    SUBMISSION_CREATE SUBMISSION_UPDATE SUBMISSION_TRACK
    REVIEWER_RESPONSE_CREATE REVIEWER_RESPONSE_READ
    NOTIFICATION_READ ANALYTICS_READ_OWN KNOWLEDGE_BASE_READ
    """.split()
)
AI_QUALITY_ASSISTANT = tuple(
    """
    PAPER_READ_ALL PAPER_VERSION_READ PAPER_VERSION_COMPARE
    QUALITY_CHECK_RUN QUALITY_REPORT_READ
    INTEGRITY_CHECK_RUN INTEGRITY_REPORT_READ_ALL
    VENUE_RECOMMEND SUBMISSION_TRACK
    NOTIFICATION_READ KNOWLEDGE_BASE_READ
    """.split()
)
ROLE_MATRIX = {
    ADMIN: PERMISSIONS,
    "LAB_LEADER": LAB_LEADER,
    "SENIOR_RESEARCHER": SENIOR_RESEARCHER,
    "RESEARCHER": RESEARCHER,
    "AI_QUALITY_ASSISTANT": AI_QUALITY_ASSISTANT,
}


def role_matrix(spark: SparkSession) -> DataFrame:
    """``(role, permission)`` pairs of the five built-in roles."""
    rows = [(role, p) for role, names in ROLE_MATRIX.items() for p in names]
    return spark.createDataFrame(rows, "role STRING, permission STRING")


def reseed_role_edges(role_permissions: DataFrame, roles: DataFrame, permissions: DataFrame) -> DataFrame:
    """Edges after a seed run: built-in roles get exactly their matrix row, other roles keep theirs."""
    matrix = role_matrix(roles.sparkSession)
    seeded = roles.join(matrix.select(F.col("role").alias("name")).distinct(), "name", "left_semi")
    kept = role_permissions.join(seeded.select(F.col("id").alias("role_id")), "role_id", "left_anti")
    fresh = (
        matrix.join(roles.select(F.col("id").alias("role_id"), F.col("name").alias("role")), "role")
        .join(permissions.select(F.col("id").alias("permission_id"), F.col("name").alias("permission")), "permission")
        .select("permission_id", "role_id")
    )
    return kept.select("permission_id", "role_id").unionByName(fresh)
