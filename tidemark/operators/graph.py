"""Reachability and common ancestors on edge tables, in few rounds for long paths.

The first rounds go one link at a time, which is all that most graphs need. A round that finds at most `SHRINKS` of what
the one before found does not count: many short histories end so, sooner than a contraction pays. A graph that is not
done after `PLAIN` others is contracted: nodes that link to each other, and nodes that only one other links to (roots but for), are reached
exactly when their like are, so each connected group of them becomes one node; groups are found by alternating stars,
in rounds that grow with the logarithm of a group. Chains, trees and journals whose days link both ways vanish so.
After `DEPTH` contractions shortcuts are added: from each node its greatest and its least successor are followed 1, 2,
4, ... links ahead by joining the pointers with themselves. Neither changes what is reached; both only save rounds, and
a graph that neither fits takes a round a link. Each round is written and read again, and what was reached is
rewritten as one table every `KEEP` rounds, so that plans and file lists stay small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN = 9
KEEP = 6
DEPTH = 3
SHRINKS = 0.8


def _doubled(edges: DataFrame, stage: Callable) -> DataFrame:
    """Shortcuts (src, dst): the walk of greatest and of least successors, 2, 4, 8, ... links ahead."""
    own = edges.where("src <> dst").groupBy("src")
    jumps = own.agg(F.max("dst").alias("most"), F.min("dst").alias("least"))
    jumps = jumps.select("src", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("walk"), F.col("most").alias("dst")), F.struct(F.lit(1).alias("walk"), F.col("least").alias("dst"))))).alias("j"))
    jumps = stage(jumps.select("j.walk", "src", "j.dst"), "jumps")
    # A walk that returns to where it was goes round; 2 ** levels is more links than there are nodes.
    levels, found = max(1, edges.select("src").distinct().count()).bit_length(), []
    for _ in range(levels):
        ahead = jumps.select("walk", F.col("src").alias("dst"), F.col("dst").alias("further"))
        jumps = stage(jumps.join(ahead, ["walk", "dst"]).select("walk", "src", F.col("further").alias("dst")).where("src <> dst"), "jumps")
        if jumps.isEmpty():
            break
        found.append(jumps.select("src", "dst"))
    out = edges
    for more in found:
        out = out.unionByName(more)
    return stage(out.distinct(), "shortcuts")


def components(pairs: DataFrame, stage: Callable) -> DataFrame:
    """node, label (the least node of its group) of every node that is in a pair (a, b) with another."""
    ordered = pairs.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    edges, before = stage(ordered.distinct(), "groups"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("label")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("label"))).distinct()
        before = now
        both = edges.select(F.col("high").alias("at"), F.col("low").alias("to")).unionByName(edges.select(F.col("low").alias("at"), F.col("high").alias("to")))
        # Greater neighbours move to the least of a neighbourhood, then each node's lesser ones to the least of them.
        least = both.groupBy("at").agg(F.min("to").alias("m")).select("at", F.least("at", "m").alias("m"))
        moved = both.where("to > at").join(least, "at").select(F.col("to").alias("at"), F.col("m").alias("to")).distinct()
        low = moved.groupBy("at").agg(F.min("to").alias("m"))
        star = moved.join(low, "at").where("to <> m").select(F.col("to").alias("high"), F.col("m").alias("low"))
        edges = stage(star.unionByName(low.select(F.col("at").alias("high"), F.col("m").alias("low"))).distinct(), "groups")


def reached(edges: DataFrame, roots: DataFrame, stage: Callable, plain: int = PLAIN, depth: int = DEPTH) -> DataFrame:
    """What roots (node, and any columns that tell them apart) reach over edges (src, dst), the roots among it."""
    labels = [c for c in roots.columns if c != "node"]
    seen = frontier = roots = stage(roots.distinct(), "roots")
    edges = stage(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    slow, parts, last, jumped = -1, [seen], 0, False
    while size := frontier.count():
        slow, last = slow + (size > SHRINKS * last), size
        if slow >= plain and not jumped:
            if depth > 0:
                return _contracted(edges, roots, stage, plain, depth)
            edges, frontier, jumped = _doubled(edges, stage), seen, True  # shortcuts start anywhere
        step = edges.join(frontier, edges["src"] == frontier["node"]).select(*labels, F.col("dst").alias("node")).distinct()
        frontier = stage(step.join(seen, [*labels, "node"], "left_anti"), "frontier")
        parts.append(frontier)
        if len(parts) > KEEP:
            parts = [stage(_union(parts), "seen")]
        seen = _union(parts)
    return seen


def _contracted(edges: DataFrame, roots: DataFrame, stage: Callable, plain: int, depth: int) -> DataFrame:
    """`reached` by way of the graph in which nodes that are reached together are one."""
    mutual = edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    single = edges.groupBy("dst").agg(F.count("*").alias("n"), F.first("src").alias("src")).where("n = 1")
    single = single.join(roots.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti")
    alike = mutual.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(single.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    groups = components(alike, stage)
    if groups.isEmpty():
        return reached(edges, roots, stage, plain, 0)

    def named(df: DataFrame, column: str) -> DataFrame:
        held = groups.select(F.col("node").alias(column), "label")
        return df.join(held, column, "left").withColumn(column, F.coalesce("label", column)).drop("label")

    found = reached(named(named(edges, "src"), "dst"), named(roots, "node").select(*roots.columns), stage, plain, depth - 1)
    members = groups.select(F.col("label").alias("node"), F.col("node").alias("member"))
    whole = found.join(members, "node", "left").withColumn("node", F.coalesce("member", "node"))
    return stage(whole.select(*roots.columns), "reached")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_bases(parents: DataFrame, pairs: DataFrame, stage: Callable) -> DataFrame:
    """The best common ancestors (pair, node) of pairs (pair, a, b) on a table of parents (node, parent).

    Ancestors of both sides, themselves included, are found at once. A common ancestor with a child that is one too
    is an ancestor of a better one; the others are the best.
    """
    ends = pairs.select("pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node")), F.struct(F.lit(1).alias("side"), F.col("b").alias("node")))).alias("e")).select("pair", "e.side", "e.node").where("node is not null")
    links = parents.select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    held = reached(links, ends, stage)
    common = stage(held.groupBy("pair", "node").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select("pair", "node"), "common")
    behind = common.join(parents.where("parent is not null and parent <> node"), "node").select("pair", F.col("parent").alias("node")).distinct()
    return common.join(behind, ["pair", "node"], "left_anti")


#: What may be asked for, and the reasons that a choice can have: fixed values.
BASES = ("all", "worktree", "merge-base", "auto")
REASONS = (
    "outside-repo", "all-explicit", "no-commits", "worktree-explicit", "merge-base-explicit", "merge-base-unavailable", "merge-base-same-as-current",
    "auto-since-merge-base", "auto-merge-base-unavailable", "auto-no-default-branch", "auto-on-default-branch", "auto-on-default-branch-clean",
)


def change_base(asked: DataFrame, commits: DataFrame, stage: Callable) -> DataFrame:
    """What each run compares with, and why: kind, reason, default_branch and anchor added to `asked`.

    asked: run, requested, is_repo, head (null without commits), branch (null when detached), default_branch and its
    commit default_head (null when there is none that can be compared), changed (anything that differs from the head,
    untracked files included). commits: node, parent (a row a parent), made (an instant). A run that asks for
    something unknown has the reason unknown-base and no kind.
    """
    at_all = F.col("is_repo") & F.col("head").isNotNull()
    comparable = F.col("default_branch").isNotNull() & F.col("default_head").isNotNull()
    same = F.col("branch") == F.col("default_branch")
    apart = at_all & comparable & ~F.coalesce(same, F.lit(False)) & F.col("requested").isin("merge-base", "auto")
    bases = merge_bases(commits, asked.where(apart).select(F.col("run").alias("pair"), F.col("head").alias("a"), F.col("default_head").alias("b")), stage)
    made = commits.groupBy("node").agg(F.max("made").alias("made"))
    # Of several, the one made last: any is a point before which nothing differs.
    one = bases.join(made, "node").groupBy(F.col("pair").alias("base_of")).agg(F.max_by("node", F.struct("made", "node")).alias("base"))
    df = asked.join(one, F.col("run") == F.col("base_of"), "left").drop("base_of")
    r, has = F.col("requested"), F.col("base").isNotNull()
    reason: Column = (
        F.when(~F.coalesce(r.isin(*BASES), F.lit(False)), "unknown-base").when(~F.coalesce("is_repo", F.lit(False)), "outside-repo").when(r == "all", "all-explicit").when(F.col("head").isNull(), "no-commits")
        .when(r == "worktree", "worktree-explicit")
        .when((r == "merge-base") & ~comparable, "merge-base-unavailable").when((r == "merge-base") & same, "merge-base-same-as-current")
        .when((r == "merge-base") & ~has, "merge-base-unavailable").when(r == "merge-base", "merge-base-explicit")
        .when(~comparable, "auto-no-default-branch").when(~F.coalesce(same, F.lit(False)) & has, "auto-since-merge-base").when(~F.coalesce(same, F.lit(False)), "auto-merge-base-unavailable")
        .when(F.coalesce("changed", F.lit(False)), "auto-on-default-branch").otherwise("auto-on-default-branch-clean")
    )
    df = df.withColumn("reason", reason)
    why = F.col("reason")
    kind = F.when(why == "unknown-base", None).when(why == "worktree-explicit", "worktree").when(why == "merge-base-explicit", "merge-base")
    kind = kind.when(F.startswith(why, F.lit("auto-")) & (why != "auto-on-default-branch-clean"), "auto").otherwise("all")
    since = why.isin("merge-base-explicit", "auto-since-merge-base")
    anchor = F.when(since, F.col("base").cast("string")).when(kind == "auto", "HEAD")
    told = F.when(since, F.col("default_branch"))
    return df.select("run", "requested", kind.alias("kind"), "reason", told.alias("default_branch"), anchor.alias("anchor"))
