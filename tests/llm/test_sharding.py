"""The descent of the hash tree against plain Python, and what moves when the tree changes."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding

from .test_operators import DOCS, corpus

N = 6000


def weigh(node):
    return sum(map(weigh, node)) if isinstance(node, list) else node[1]


def draw(key, name, weight):
    u = (int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / weight if weight > 0 else math.inf


def least(key, children):
    return min(range(len(children)), key=lambda i: draw(key, *children[i]))


def descend(key, t):
    i = least(key, [(f"region/{i}", weigh(r)) for i, r in enumerate(t)])
    j = least(key, [(f"rack/{i}/{j}", weigh(k)) for j, k in enumerate(t[i])])
    return t[i][j][least(key, [(f"shard/{s}", w) for s, w in t[i][j]])][0]


def placed(spark, **trees):
    keys = spark.range(N).select(F.col("id").cast("string").alias("k")).repartition(3)
    rows = sharding.with_shards(keys, F.col("k"), trees).collect()
    return {name: {r.k: r[name] for r in rows} for name in trees}


def test_the_descent_is_that_of_plain_python(spark):
    uneven = sharding.tree(11, racks=3, regions=5, weights={0: 2.5, 4: 0.0, 7: 0.3})
    got = placed(spark, even=sharding.tree(16), uneven=uneven)
    assert got["even"] == {k: descend(k, sharding.tree(16)) for k in got["even"]}
    assert got["uneven"] == {k: descend(k, uneven) for k in got["uneven"]} and 4 not in got["uneven"].values()
    count = Counter(got["uneven"].values())
    total = sum(w for r in uneven for k in r for _, w in k)
    for r in uneven:
        for k in r:
            for s, w in k:
                assert abs(count[s] / N - w / total) < 0.02


def test_the_tree_matters(spark):
    """A flat draw of the shards alone gives another placement."""
    got = placed(spark, t=sharding.tree(16))["t"]
    flat = {k: least(k, [(f"shard/{s}", 1.0) for s in range(16)]) for k in got}
    assert sum(got[k] != flat[k] for k in got) > N / 2


def test_moves_stay_in_the_subtrees_that_change(spark):
    before, heavier = sharding.tree(16), sharding.tree(16, weights={5: 3.0})
    gone = sharding.tree(16, weights={5: 0.0})
    got = placed(spark, a=before, up=heavier, down=gone)
    region, rack = (lambda s: s // 4), (lambda s: s // 2)
    for change in ("up", "down"):
        moved = [(got["a"][k], got[change][k]) for k in got["a"] if got["a"][k] != got[change][k]]
        assert moved
        for a, b in moved:
            into, out_of = (b, a) if change == "up" else (a, b)
            assert region(into) == 1
            if region(out_of) == 1:
                assert rack(into) == 2 and (rack(out_of) != 2 or into == 5)


def test_one_more_shard_takes_only_into_itself(spark):
    t = sharding.tree(16)
    got = placed(spark, a=t, b=sharding.grown(t), c=sharding.grown(sharding.grown(t)))
    moved = {got["b"][k] for k in got["a"] if got["a"][k] != got["b"][k]}
    again = {got["c"][k] for k in got["a"] if got["b"][k] != got["c"][k]}
    assert moved == {16} and again == {17}
    assert abs(Counter(got["b"].values())[16] / N - 1 / 17) < 0.02


def test_rows_keep_the_law(spark):
    docs = spark.createDataFrame(corpus(), DOCS).repartition(3)
    odd = docs.select("*", *(F.lit(1).alias(c) for c in ("shard", "slot", "__region", "__group", "size", "law", "at")))
    rows = sharding.shard(odd).collect()
    texts = [(r[0], r[1] or "") for r in corpus()]
    want = sorted((str(i), len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    for r in rows:
        key = f"{sharding.SEED}|{'null' if r.doc_id is None else r.doc_id}"
        assert r.shard == descend(key, sharding.tree(16)) and r.grown_shard in (r.shard, 16) and r.law == "key"
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard(odd.where("false")).count() == 0


def test_shards_are_those_of_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, t) for i, t in enumerate(["", "a", "é\U0001f600", "x" * 3000, None, "a", "one two"] * 20)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(sharding.ORACLE)
    names = [re.sub(r"\W", "", c[0]) for c in found.description]
    want = sorted(tuple(map(str, r)) for r in found.fetchall())
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).select(*names).collect()
    assert sorted(tuple(map(str, r)) for r in got) == want
