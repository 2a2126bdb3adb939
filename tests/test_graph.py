"""Reachability in few rounds, common ancestors, and each reason of a change base."""

import random

from tidemark.operators import graph
from tidemark.operators.staging import stage


def brute(edges, roots):
    seen, todo = set(roots), list(roots)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def run(spark, edges, roots, **more):
    df = graph.reached(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(x,) for x in roots], "node long"), stage, **more)
    got = [r.node for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_graphs_of_all_kinds(spark):
    r = random.Random(2)
    for n, m, plain, depth in ((30, 40, 0, 0), (40, 45, 1, 1), (60, 70, 0, 2)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(3, 3)]
        edges += [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(1, 100), (200 + 1, 200)]
        assert run(spark, edges, [1, 999], plain=plain, depth=depth) == brute(edges, [1, 999])


def test_a_long_chain_takes_few_rounds(spark):
    """10,000 links each way, the ways of a journal's days; off it hang leaves."""
    n = 10_000
    df = spark.range(n).selectExpr("id as src", "id + 1 as dst").union(spark.range(n).selectExpr("id + 1", "id")).union(spark.range(n).selectExpr("id", "id + 1000000"))
    calls = []
    got = graph.reached(df, spark.createDataFrame([(0,)], "node long"), lambda x, name: calls.append(name) or stage(x, name))
    assert got.count() == 2 * n + 1 and len(calls) < 40


def test_many_histories_that_end_are_not_contracted(spark):
    """300 chains of up to 15 links, fewer and fewer of each length: some rounds more, none of them rewrites the links."""
    lengths = [max(k for k in range(26) if i <= 300 * 0.7**k) for i in range(1, 301)]
    edges = [(100 * i + k, 100 * i + k + 1) for i, n in enumerate(lengths) for k in range(n)]
    calls = []
    roots = spark.createDataFrame([(100 * i,) for i in range(300)], "node long")
    got = graph.reached(spark.createDataFrame(edges, "src long, dst long"), roots, lambda x, name: calls.append(name) or stage(x, name), plain=3)
    assert got.count() == sum(lengths) + 300 and "groups" not in calls


def test_shortcuts_cross_what_cannot_be_contracted(spark):
    """Each node links to the next two: no node has one link to it, none is linked both ways."""
    n = 3000
    df = spark.range(n).selectExpr("id as src", "id + 1 as dst").union(spark.range(n).selectExpr("id", "id + 2"))
    calls = []
    got = graph.reached(df, spark.createDataFrame([(0,)], "node long"), lambda x, name: calls.append(name) or stage(x, name), depth=0)
    assert got.count() == n + 2 and len(calls) < 40


def test_roots_with_labels_are_kept_apart(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 3)], "src long, dst long")
    roots = spark.createDataFrame([("a", 1), ("b", 4), ("b", 4)], "label string, node long")
    assert sorted(tuple(r) for r in graph.reached(edges, roots, stage).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 3), ("b", 4)]


def test_best_common_ancestors(spark):
    # 1 - 2 - 3 - 5   and a criss-cross: 3 and 4 both come of 2; 7 and 8 of both 5 and 6
    parents = [(1, None), (2, 1), (3, 2), (4, 2), (5, 3), (6, 4), (7, 5), (7, 6), (8, 5), (8, 6), (20, None), (21, 20)]
    pairs = [("line", 5, 1), ("fork", 5, 6), ("cross", 7, 8), ("same", 4, 4), ("apart", 21, 5), ("none", None, 5), ("behind", 3, 7)]
    got = graph.merge_bases(spark.createDataFrame(parents, "node long, parent long"), spark.createDataFrame(pairs, "pair string, a long, b long"), stage)
    assert sorted(tuple(r) for r in got.collect()) == [("behind", 3), ("cross", 5), ("cross", 6), ("fork", 2), ("line", 1), ("same", 4)]


def test_each_reason_of_a_change_base(spark):
    commits = spark.createDataFrame([(1, None, 1), (2, 1, 2), (3, 1, 3), (9, None, 9)], "node long, parent long, made long")
    rows = [
        ("outside-repo", "auto", False, None, None, None, None, True, "all", None), ("all-explicit", "all", True, None, None, None, None, True, "all", None),
        ("no-commits", "merge-base", True, None, "m", None, None, True, "all", None), ("worktree-explicit", "worktree", True, 2, "w", "m", 3, True, "worktree", None),
        ("merge-base-explicit", "merge-base", True, 2, "w", "m", 3, True, "merge-base", "1"), ("merge-base-unavailable", "merge-base", True, 9, "w", "m", 3, True, "all", None),
        ("merge-base-unavailable", "merge-base", True, 2, "w", None, None, True, "all", None), ("merge-base-same-as-current", "merge-base", True, 3, "m", "m", 3, True, "all", None),
        ("auto-since-merge-base", "auto", True, 2, None, "m", 3, False, "auto", "1"), ("auto-merge-base-unavailable", "auto", True, 9, "w", "m", 3, True, "auto", "HEAD"),
        ("auto-no-default-branch", "auto", True, 2, "w", "m", None, True, "auto", "HEAD"), ("auto-on-default-branch", "auto", True, 3, "m", "m", 3, True, "auto", "HEAD"),
        ("auto-on-default-branch-clean", "auto", True, 3, "m", "m", 3, False, "all", None), ("unknown-base", "else", True, 3, "m", "m", 3, False, None, None),
    ]
    asked = spark.createDataFrame([(i, *x[1:8]) for i, x in enumerate(rows)], "run int, requested string, is_repo boolean, head long, branch string, default_branch string, default_head long, changed boolean")
    got = {r.run: r for r in graph.change_base(asked, commits, stage).collect()}
    assert [(got[i].reason, got[i].kind, got[i].anchor) for i in range(len(rows))] == [(x[0], x[8], x[9]) for x in rows]
    assert {x[0] for x in rows} == {*graph.REASONS, "unknown-base"}
