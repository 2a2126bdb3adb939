"""Each class of a shipped file, first sources of patterns and refusals, each verdict on listed projects."""

from tidemark.operators import inventory


def test_each_class_of_a_file(spark):
    entries = [(c, c != "seeded", "rec") for c in ("seeded", "missing", "not_regular", "unreadable", "not_in_kit", "current", "refresh", "kept", "blocked", "offer")] + [("nulls", None, None)]
    files = [("seeded", None, "x", None), ("not_regular", "not_regular", None, None), ("unreadable", "unreadable", None, None), ("not_in_kit", None, "x", None), ("current", None, "v2", "s2"), ("refresh", None, "rec", "s1"), ("kept", None, "mine", None), ("blocked", None, "mine", None), ("blocked.new", None, "v3", None), ("offer", None, "mine", "s2")]
    shipped = [(c, s, h) for c in ("seeded", "missing", "not_regular", "unreadable", "current", "refresh", "kept", "blocked", "offer", "nulls") for s, h in ((None, "v0"), ("s1", "v1"), ("s2", "v2"))] + [("kept", "s9", "rec"), ("kept", "s8", "rec")]
    got = inventory.classify_files(
        spark.createDataFrame(entries, "path string, managed boolean, recorded string"), spark.createDataFrame(files, "path string, state string, hash string, stamp string"), spark.createDataFrame(shipped, "path string, stamp string, hash string"),
    ).collect()
    assert {r.path: r["class"] for r in got} == {p: (p if p != "nulls" else "seeded") for p, _, _ in entries} and len(got) == len(entries)


def test_patterns_keep_their_first_source(spark):
    rows = [("tip", "b", "p", None), ("tip", "a", "p", None), ("working", "z", "q", None), ("default", "d", "q", None), ("carried", "c", None, None), ("carried", "e", "r", "bad"), ("what", "f", "s", None)]
    found, refused = inventory.union_patterns(spark.createDataFrame(rows, "kind string, source string, pattern string, reason string"))
    assert sorted(map(tuple, found.collect())) == [("p", "tip", "a"), ("q", "working", "z")]
    assert sorted(map(tuple, refused.collect())) == [("carried", "e", "bad"), ("what", "f", "unknown kind")]


def test_each_verdict(spark):
    row = lambda k, project, entry, own=False, waitable=False, whole=False: (k, project, entry, own, waitable, whole)
    rows = [
        row("unreadable", "a", "unreachable"), row("unreadable", "b", None), row("all_missing", "a", "file"), row("some_missing", "a", None), row("some_missing", "b", "directory"), row("some_missing", "b", "directory"),
        row("own_missing fail", "o", None, own=True), row("own_missing warn", "o", None, own=True), row("own_missing warn", "b", "directory"), row("no_sessions_yet", "o", None, True, True),
        row("some_waiting", "o", None, True, True), row("some_waiting", "b", "directory"), row("all", "a", "directory", whole=True), row("ok", "a", "directory"),
    ]
    got = inventory.project_verdicts(spark.createDataFrame(rows, "k string, project string, entry string, own boolean, waitable boolean, whole boolean"), "k").collect()
    assert all(r.verdict == r.k.split()[0] for r in got) and len(got) == 9
    assert {r.k: r.status for r in got} == {"unreadable": "fail", "all_missing": "fail", "some_missing": "warn", "own_missing fail": "fail", "own_missing warn": "warn", "no_sessions_yet": "ok", "some_waiting": "ok", "all": "ok", "ok": "ok"}
    assert {r.k: r.found for r in got}["some_missing"] == 1
