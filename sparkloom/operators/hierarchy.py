"""Hierarchies: closures over parents, distinguished names, effective permissions, trees in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def closure(edges: DataFrame, depth: int = 10) -> DataFrame:
    """(child, ancestor, steps): every ancestor over edges (child, parent) in at most depth steps, each once.

    Each step joins the newest pairs with the edges and keeps those that are new, so cycles terminate; a step is written
    before the next one starts.
    """
    up = edges.filter("child is not null and parent is not null").select("child", "parent").distinct()
    known = newest = written(up.filter("child <> parent").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")), "closure")
    for steps in range(2, depth + 1):
        ahead = newest.select("child", F.col("ancestor").alias("_at")).join(up.select(F.col("child").alias("_at"), F.col("parent").alias("ancestor")), "_at")
        fresh = ahead.filter("child <> ancestor").select("child", "ancestor").distinct().join(known, ["child", "ancestor"], "left_anti")
        newest = written(fresh.withColumn("steps", F.lit(steps)), "closure")
        if newest.isEmpty():
            break
        known = known.unionByName(newest)
    return known


def dn_ancestors(dn: Column) -> Column:
    """Suffixes of a distinguished name, the name itself first."""
    parts = F.transform(F.split(dn, ","), lambda x: F.trim(x))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ","))


def memberships(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, group_id): groups of a user, direct and nested. members: (user_id, group_id); edges: (child, parent)."""
    up = closure(edges).select(F.col("child").alias("group_id"), F.col("ancestor"))
    return members.unionByName(members.join(up, "group_id").select("user_id", F.col("ancestor").alias("group_id"))).distinct()


def effective_tools(users: DataFrame, groups: DataFrame, roles: DataFrame, grants: DataFrame, tools: DataFrame) -> DataFrame:
    """(user_id, tool): what a user may use. groups: (user_id, group_id), roles: (subject, role), grants: (role, tool).

    The role auditor takes everything away, else the role admin gives every tool, else the grants of the roles hold.
    """
    subjects = users.select("user_id", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject")).unionByName(groups.select("user_id", F.concat(F.lit("group:"), F.col("group_id").cast("string")).alias("subject")))
    held = subjects.join(roles, "subject").select("user_id", "role").distinct()
    flags = held.groupBy("user_id").agg(F.bool_or(F.col("role") == "auditor").alias("auditor"), F.bool_or(F.col("role") == "admin").alias("admin"))
    free = held.join(flags, "user_id").filter(~F.col("auditor"))
    rest = free.filter(~F.col("admin") | (F.col("role") == "admin")).select("user_id", "role")
    every = grants.filter("role <> 'admin'").select("role", "tool").unionByName(tools.select(F.lit("admin").alias("role"), "tool"))
    return rest.join(every, "role").select("user_id", "tool").distinct()


def tree_order(nodes: DataFrame) -> DataFrame:
    """(id, name, depth, path): nodes (id, parent, name) parents first, siblings by name; ascending path is the order.

    A node whose parent is missing is a root; nodes of a cycle without a root do not appear. A level is a join with the
    one above, written before the next; there is no bound on the depth.
    """
    nodes = nodes.select("id", "parent", "name")
    own = F.struct(F.col("name").alias("name"), F.col("id").alias("id"))
    ids = nodes.select(F.col("id").alias("parent")).distinct()
    level = written(nodes.join(ids, "parent", "left_anti").select("id", "name", F.lit(0).alias("depth"), F.array(own).alias("path")), "tree")
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        below = nodes.join(level.select(F.col("id").alias("parent"), F.col("path").alias("_up")), "parent")
        level = written(below.select("id", "name", F.lit(depth).alias("depth"), F.concat("_up", F.array(own)).alias("path")), "tree")
        out = out.unionByName(level)
    return out
