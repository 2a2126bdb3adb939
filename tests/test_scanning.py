"""Budgets and the patterns that need none, records found in parallel, cuts by UTF-16 units, the scanner's plan."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import gates, scan
from tidemark.sources import readers


@pytest.mark.parametrize("pattern", [*scan.BUILT_IN, r"\d{4}-\d\d", "a(b|c)?d", "a{2,5}b", "(ab)?c+", "[^]a]{3}x*", r"\[x\]"])
def test_linear_patterns(pattern):
    assert gates.is_linear(pattern)


@pytest.mark.parametrize("pattern", ["[a-z]+@x", "(a|aa)+$", "(a?){5}", "(?=x)a", r"a\1", "x*y", "a{1,2000}b", "a|b+", "(a{1,9}){2}", "a{1,9}b{1,9}c", "(?i)a"])
def test_patterns_that_are_not_proved(pattern):
    assert not gates.is_linear(pattern)


def test_a_budget_grows_with_the_work():
    assert gates.accrued(0, 0, 9) == 0 and gates.accrued(1000, 0, 9) == pytest.approx(1000 * (0.001 + 9 * 0.00004)) and gates.accrued(0, 10**6, 9) == pytest.approx(0.009)


def test_linear_patterns_are_matched_without_a_budget_and_others_stop(spark):
    texts = spark.createDataFrame([(1, "ghp_" + "a" * 30 + "\nx@y.z\n~" + "a" * 60 + "!\nx@y.z"), (2, None), (3, "\0gh\0p_" + "b" * 25)], "id long, text string")
    patterns = [("ghp_[A-Za-z0-9]{20,}", "generic"), ("~(a|aa)+$", "personal"), ("[a-z]+@[a-z.]+", "config")]
    got = sorted((r.id, r.line, r.origin, r.problem) for r in gates.budgeted(texts, "id", patterns, per_line=0.3).collect())
    assert got == [(1, 1, "generic", None), (1, 2, "config", None), (1, 3, "config", "timeout"), (1, 3, "personal", "timeout"), (1, 4, "config", None), (3, 1, "generic", None)]
    assert sorted((r.id, r.line) for r in gates.budgeted(texts, "id", patterns[:1]).collect()) == [(1, 1), (3, 1)]
    spent = gates.budgeted(texts, "id", patterns[1:], per_line=9, per_text=-9).collect()
    assert spent and all(r.problem == "timeout" for r in spent)


def test_each_pattern_is_run_once_a_line(spark):
    df = spark.createDataFrame([(1, 1, "ghp_" + "a" * 30)], "id long, line int, raw string")
    plan = scan.matches(df, "id", [(p, "generic") for p in scan.BUILT_IN])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(scan.BUILT_IN)


@pytest.mark.parametrize("size", [3, 17, 10**6])
def test_records_in_parallel_are_those_in_order(spark, tmp_path, size):
    r = random.Random(size)
    want = []
    for k in range(5):
        parts = []
        for _ in range(40):
            kind = r.choice(["blob", "commit", "tip", "ref"])
            parts += [kind, *(r.choice(["", "blob", "x" * 9, "é", "ref"]) for _ in range(readers.ARITY[kind]))]
        parts += [[], ["what", "tip", "a"], ["ref", "x"], ["blob"], ["commit", "x"]][k]
        (tmp_path / f"f{k}").write_bytes(b"".join(x.encode() + b"\0" for x in parts))
        want += [(f"f{k}", kind, tuple(fields), problem) for _, _, kind, fields, problem in readers.parse_records(f"f{k}", parts)]
    found = readers.parallel_records(readers.framed(spark, str(tmp_path), size)).orderBy("file", "place").collect()
    assert [(x.file.rsplit("/", 1)[-1], x.kind, tuple(x.fields), x.problem) for x in found] == want


def test_cuts_by_units(spark):
    def want(text, limit):
        units = text.encode("utf-16-be")
        return text if len(units) <= 2 * limit else units[: 2 * limit].decode("utf-16-be", "ignore") + "…"

    texts = ["", "abcdef", "abcdefg", "ab😀😀", "abc😀😀", "😀" * 9, "é" * 7, "abcde😀", "abcd😀", None]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(T.truncate_units(F.col("t"), 6).alias("c")).collect()
    assert [r.c for r in got] == [None if x is None else want(x, 6) for x in texts]
