"""Queries over links and histories (C01): each customer's orders as the commits of a repository."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.graph import change_base
from tidemark.operators.staging import stage

from .tables import query

_ORDERS = "SELECT o_custkey, o_orderkey AS node, o_orderpriority AS p, o_orderstatus AS status, o_orderdate AS made, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders"
_PARENTS = "b.r = CASE WHEN a.p = '1-URGENT' AND a.r > 2 THEN a.r // 2 ELSE a.r - 1 END OR (a.p = '2-HIGH' AND a.r > 3 AND b.r = a.r // 3)"
_ASKED = """SELECT c_custkey AS run, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'all' WHEN 'BUILDING' THEN 'worktree' WHEN 'FURNITURE' THEN 'merge-base' ELSE 'auto' END AS requested, c_acctbal >= -500 AS is_repo,
  max(node) FILTER (WHERE status <> 'O') AS head, CASE c_nationkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN NULL ELSE 'work' END AS branch, CASE WHEN c_nationkey % 7 > 0 THEN 'main' END AS default_branch,
  max(node) FILTER (WHERE status = 'O') AS default_head, c_acctbal > 5000 AS changed FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment, c_acctbal, c_nationkey"""


@query("C01_change_base", f"""WITH RECURSIVE o AS ({_ORDERS}), l AS (SELECT a.node, b.node AS parent FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND ({_PARENTS})), q AS ({_ASKED}),
anc AS (SELECT run, side, node FROM (SELECT run, 0 AS side, head AS node FROM q WHERE head IS NOT NULL UNION ALL SELECT run, 1, default_head FROM q WHERE default_head IS NOT NULL)
  UNION SELECT run, side, parent FROM anc JOIN l USING (node)),
c AS (SELECT run, node FROM anc GROUP BY run, node HAVING count(DISTINCT side) = 2),
b AS (SELECT run, arg_max(node, {{'m': made, 'n': node}}) AS base FROM c JOIN o USING (node) WHERE (run, node) NOT IN (SELECT c.run, l.parent FROM c JOIN l USING (node)) GROUP BY run),
w AS (SELECT *, default_branch IS NOT NULL AND default_head IS NOT NULL AS comparable, coalesce(branch = default_branch, false) AS same FROM q LEFT JOIN b USING (run)),
y AS (SELECT *, CASE WHEN NOT is_repo THEN 'outside-repo' WHEN requested = 'all' THEN 'all-explicit' WHEN head IS NULL THEN 'no-commits' WHEN requested = 'worktree' THEN 'worktree-explicit'
  WHEN requested = 'merge-base' THEN CASE WHEN NOT comparable THEN 'merge-base-unavailable' WHEN same THEN 'merge-base-same-as-current' WHEN base IS NULL THEN 'merge-base-unavailable' ELSE 'merge-base-explicit' END
  WHEN NOT comparable THEN 'auto-no-default-branch' WHEN NOT same AND base IS NOT NULL THEN 'auto-since-merge-base' WHEN NOT same THEN 'auto-merge-base-unavailable'
  WHEN changed THEN 'auto-on-default-branch' ELSE 'auto-on-default-branch-clean' END AS reason FROM w)
SELECT run, requested, CASE WHEN reason = 'worktree-explicit' THEN 'worktree' WHEN reason = 'merge-base-explicit' THEN 'merge-base' WHEN reason LIKE 'auto-%' AND reason <> 'auto-on-default-branch-clean' THEN 'auto' ELSE 'all' END AS kind,
  reason, CASE WHEN reason IN ('merge-base-explicit', 'auto-since-merge-base') THEN default_branch END AS default_branch,
  CASE WHEN reason IN ('merge-base-explicit', 'auto-since-merge-base') THEN CAST(base AS VARCHAR) WHEN reason LIKE 'auto-%' AND reason <> 'auto-on-default-branch-clean' THEN 'HEAD' END AS anchor FROM y""")
def bases(t):
    """What a run over each customer's history compares with: merge bases on forks and merges of their orders."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = stage(t("orders").select("o_custkey", F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("made"), place.alias("r")), "history")
    half, third = F.floor(F.col("r") / 2).cast("int"), F.floor(F.col("r") / 3).cast("int")
    before = F.when((F.col("p") == "1-URGENT") & (F.col("r") > 2), half).otherwise(F.col("r") - 1)
    more = F.when((F.col("p") == "2-HIGH") & (F.col("r") > 3), third)
    links = o.select("o_custkey", "node", "made", F.explode(F.array_distinct(F.array(before, F.coalesce(more, before)))).alias("at"))
    parent = o.select("o_custkey", F.col("r").alias("at"), F.col("node").alias("parent"))
    commits = stage(links.join(parent, ["o_custkey", "at"], "left").select("node", "parent", "made"), "commits")

    ends = o.groupBy("o_custkey").agg(F.max(F.when(F.col("status") != "O", F.col("node"))).alias("head"), F.max(F.when(F.col("status") == "O", F.col("node"))).alias("default_head"))
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    requested = F.when(segment == "AUTOMOBILE", "all").when(segment == "BUILDING", "worktree").when(segment == "FURNITURE", "merge-base").otherwise("auto")
    branch = F.when(nation % 5 == 0, "main").when(nation % 5 == 1, None).otherwise("work")
    asked = t("customer").join(ends, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("run"), requested.alias("requested"), (F.col("c_acctbal") >= -500).alias("is_repo"), "head", branch.alias("branch"),
        F.when(nation % 7 > 0, "main").alias("default_branch"), "default_head", (F.col("c_acctbal") > 5000).alias("changed"),
    )
    return change_base(asked, commits, stage)
