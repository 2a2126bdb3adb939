"""Every query of the core library against its SQL counterpart on the smallest tables."""

import os
import re

import duckdb
import pytest

from tidemark.operators import scan as operators
from tidemark.plans import registry, scan

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_what_sql_gives(spark, tables, name):
    got = registry.QUERIES[name](spark, SF_DIR)
    want = tables.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted([plain(v) for v in row] for row in want.fetchall())
    assert sorted([plain(v) for v in row] for row in got.select(*columns).collect()) == want


def excerpt_by_hand(line, spans, at):
    """20 characters on both sides; every character of a span is masked, a run of them by one mark."""
    lo, hi = max(0, at[0] - 20), min(len(line), at[1] + 20)
    hidden = [any(a <= i < b for a, b in spans) for i in range(len(line))]
    starts = {a for a, b in spans if not any(x < a <= y for x, y in spans if (x, y) != (a, b))}
    out = ""
    for i in range(lo, hi):
        if not hidden[i]:
            out += line[i]
        elif i == lo or not hidden[i - 1] or i in starts:
            out += "[REDACTED]"
    return out


def test_excerpts_are_those_of_plain_python(spark):
    import pyarrow.parquet as pq

    want = []
    for row in pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        for n, line in enumerate(re.split("\r\n|\r|\n", (row["text"] or "").replace("\0", "")), 1):
            found = [(m.start(), m.end(), p, o) for p, o in scan.PATTERNS for m in re.finditer(p, line, re.I)]
            spans = [x[:2] for x in found]
            want += [(row["doc_id"], n, a + 1, p, o, excerpt_by_hand(line, spans, (a, b))) for a, b, p, o in found]
    got = registry.QUERIES["L05_excerpts"](spark, SF_DIR).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) >= 5


@pytest.mark.parametrize("text", ["x ghp_" + "a" * 20, "GHP_" + "b" * 30, "xſk-ant-" + "c" * 12, "AK\0IA" + "A" * 16, "none", ""])
def test_the_cheap_test_lets_all_matches_through(spark, text):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, text)], "id long, text string")
    lines = operators.lines(df, "id")
    full = operators.matches(lines, "id", scan.PATTERNS).count()
    assert not full or df.where(operators.may_match(F.col("text"), scan.PATTERNS)).count() == 1
    assert (full > 0) == (text not in ("none", ""))


def test_literals_of_patterns():
    cases = {"ab?c": "a", "a|b": None, "x(ab|cd)yz": "yz", r"\d+": None, "a{2}bc": "bc", "[]x]q": "q", r"[\]]zz": "zz", "k*": None}
    assert {p: operators.literal_of(p) for p in cases} == cases


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == registry.QUERIES["L04_first_matches"](spark, SF_DIR).count() > 0
