"""Block configurations case by case, fact blocks as table functions, and checks that stop no other."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import briefing, checks


def resolved(spark, value, never=("private",)):
    configs = spark.createDataFrame([("c", value if isinstance(value, str) else json.dumps(value))], "config string, blocks string")
    files = spark.createDataFrame([("a.md", True), ("b/c.md", True), ("b", False), ("private/x.md", True)], "path string, is_file boolean")
    blocks, problems = briefing.resolve_blocks(configs, list(never), files)
    return [(b.position, b.id, b.kind, list(b.read)) for b in blocks.orderBy("position").collect()], sorted((p.position or 0, p.code, p.id, p.field, p.path, p.entry) for p in problems.collect())


def custom(**more):
    return {"id": "own", "title": "T", "instruction": "I"} | more


@pytest.mark.parametrize(
    "value,blocks,problems",
    [
        ("{}", [], [(0, "not_a_list")]), ("nonsense", [], [(0, "not_a_list")]), ([], [], [(0, "empty")]),
        (["due", "nope", "due", 3, None, ["x"]], [(1, "due", "fact", [])], [(2, "unknown"), (3, "duplicate"), (4, "not_a_block"), (5, "not_a_block"), (6, "not_a_block")]),
        ([custom(id="Bad"), custom(id=5), {"title": "x"}], [], [(1, "bad_id"), (2, "bad_id"), (3, "bad_id")]),
        ([custom(id="stale"), "stale"], [(2, "stale", "fact", [])], [(1, "custom_id_taken")]),
        ([custom(), custom(), custom(id="own_2")], [(1, "own", "custom", []), (3, "own_2", "custom", [])], [(2, "duplicate")]),
        ([custom(title=" ", instruction=4), "strategy"], [(2, "strategy", "judgement", [])], [(1, "missing_field"), (1, "missing_field")]),
        ([custom(read=["a.md", "./a.md", "b/../b/c.md"])], [(1, "own", "custom", ["a.md", "b/c.md"])], []),
        ([custom(read=["", "/a.md", "~/a", "../a.md", ".", "private/x.md", "no.md", "b", 7])], [], [(1, "read_empty"), (1, "read_empty"), (1, "read_missing"), (1, "read_never_read"), (1, "read_not_file"), (1, "read_outside"), (1, "read_outside"), (1, "read_outside"), (1, "read_outside")]),
    ],
)
def test_what_a_configuration_asks_for(spark, value, blocks, problems):
    got, wrong = resolved(spark, value)
    assert got == blocks and [(p[0], p[1]) for p in wrong] == problems


def test_problems_name_what_they_are_about(spark):
    _, wrong = resolved(spark, [custom(title="", read=["private/x.md"])])
    assert wrong == [(1, "missing_field", "own", "title", None, None), (1, "read_never_read", "own", None, "private/x.md", "private")]


def test_blocks_are_functions_of_sql(spark):
    pending = spark.createDataFrame([("f", 1, "late", "1/1", "2024-01-01"), ("f", 2, "now", "", "2024-01-10"), ("f", 3, "soon", "", "2024-01-12"), ("f", 4, "far", "", "2024-03-01"), ("f", 5, "when", "some day", None)], "file string, line long, what string, raw string, deadline string")
    codes = spark.createDataFrame([("f", 1, "b"), ("f", 1, "a"), ("f", 9, "c")], "file string, line long, code string")
    notes = spark.createDataFrame([("x", "2024-01-10"), ("y", "2024-01-11"), ("z", "2024-02-30"), ("w", "2024-01-09T23:00:00Z"), ("v", "2024-01-09T23:00"), ("u", None)], "path string, stale_after string")
    told = briefing.Briefing(spark, pending=pending, pending_problems=codes, notes=notes)
    due = spark.sql(f"SELECT part, key, mark FROM {told.function('due')}(DATE '2024-01-10') WHERE text <> 'x'")
    assert sorted(map(tuple, due.collect()), key=str) == [("overdue", "f:1", "a,b"), ("today", "f:2", None)]
    assert sorted((r.part, r.key) for r in told.fact("upcoming", today="DATE '2024-01-10'", days="7").collect()) == [("later", "f:4"), ("upcoming", "f:3")]
    assert [(r.key, r.text) for r in told.fact("undated").collect()] == [("f:5", "when | some day")]
    assert sorted(r.key for r in told.fact("stale", today="DATE '2024-01-10'").collect()) == ["w", "x"]
    assert told.fact("sources").count() == told.fact("open_prs").count() == 0
    with pytest.raises(ValueError, match="no such relation"):
        briefing.Briefing(spark, other=pending)


def test_facts_of_an_empty_vault(spark):
    got = {r.fact: r.value for r in briefing.Briefing(spark).facts(F.lit("2024-02-29 10:00:00").cast("timestamp")).collect()}
    assert got == {"today": "2024-02-29", "today_human": "29/02/2024", "weekday": "thursday", "tz": "UTC"}


def test_a_slow_check_is_cancelled_and_others_go_on(spark):
    slow = F.udf(lambda x: time.sleep(60) or x, "long")
    told = {
        "slow": lambda s: s.range(4).select(F.lit("ok").alias("status"), slow("id").cast("string").alias("detail")),
        "fine": lambda s: s.range(1).select(F.lit("ok").alias("status"), F.lit("d").alias("detail")),
        "raises": lambda s: 1 / 0,
    }
    began = time.time()
    got = [(r.id, r.place, r.status, r.code) for r in checks.run_checks(spark, told, limit_s=8).orderBy("place").collect()]
    assert time.time() - began < 50
    assert got == [("slow", 0, "fail", "timed_out"), ("fine", 1, "ok", None), ("raises", 2, "fail", "crashed")]


def test_exit_codes(spark):
    made = lambda *statuses: spark.createDataFrame([("a", 0, x, None, None) for x in statuses], checks.RESULTS)
    assert [checks.exit_code(made(*x)) for x in ((), ("ok", "warn"), ("ok", "fail"), ("odd",))] == [1, 0, 1, 1]
