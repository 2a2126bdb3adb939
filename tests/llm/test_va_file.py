"""Hard negatives against brute force, and bounds that hold and spare exact scores."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import va_file

ROWS = "vec_id long, embedding array<float>, label int, uid string, codes int"
f32 = lambda x: None if x is None else float(np.float32(x))


def table(seed=3, n=230, width=6):
    r = random.Random(seed)
    rows = [(i, [f32(r.gauss(0, 0.4)) for _ in range(width)], r.randrange(4)) for i in range(n)]
    rows += [(300, None, 1), (301, [0.1] * width, None), (302, [0.1, None] + [0.2] * (width - 2), 1), (303, [float("nan")] + [0.1] * (width - 1), 1)]
    rows += [(304, [float("inf")] + [0.1] * (width - 1), 2), (305, [f32(0.5)] * 2, 2), (306, [], 3), (None, [f32(0.3)] * width, 0), (None, [f32(0.3)] * width, 1)]
    rows += [(400 + k // 2, rows[5][1], k % 2) for k in range(30)]  # ties and repeated ids, anchor 400 twice
    rows += [(100, rows[7][1], 2), (500, [0.0] * width, 1)]
    return rows


def brute(rows):
    held = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    place = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for at, (i, lab, v) in enumerate(held):
        if i is None or i % 100:
            continue
        same = sorted(((dot(v, w), j) for k, (j, m, w) in enumerate(held) if k != at and m == lab), key=place)[:5]
        rest = sorted(((dot(v, w), j) for j, m, w in held if m != lab), key=place)
        for s, j in same:
            out += [(i, j, k + 1, y, s, x) for k, (x, y) in enumerate([t for t in rest if 30 * s <= 100 * t[0] <= 90 * s][:10])]
    return Counter(out)


@pytest.mark.parametrize("row_block,anchor_block,chunk", [(8192, 4096, 32), (40, 2, 1)])
def test_negatives_are_those_of_brute_force(spark, tmp_path, monkeypatch, row_block, anchor_block, chunk):
    for name, value in (("ROW_BLOCK", row_block), ("ANCHOR_BLOCK", anchor_block), ("CHUNK", chunk)):
        monkeypatch.setattr(va_file, name, value)
    spark.createDataFrame([(*x, "x", 1) for x in table()], ROWS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = va_file.op11_va_file_hard_negatives(spark, str(tmp_path)).collect()
    want = brute(table())
    assert len(want) > 100 and Counter((x.anchor_id, x.positive_id, x["rank"], x.negative_id, x.positive_score, x.negative_score) for x in got) == want


def test_scores_near_the_end_of_a_long(spark):
    rows = [(100, 1, True, [2**31, 0]), (101, 1, False, [2**31 - 1, 5]), (102, 2, False, [2**30, 7]), (103, 2, False, [1, 1]), (200, 3, True, [2**62, 2**62]), (201, 3, False, [2**62, 1])]
    df = spark.createDataFrame(rows, "vec_id long, label long, anchor boolean, q array<long>")
    got = [(x.anchor_id, x.positive_id, x.positive_score, x.negative_id, x.negative_score) for x in va_file.mine(df).collect()]
    assert got == [(100, 101, 2**62 - 2**31, 102, 2**61)]  # the scores of 200 are the greatest long, or far below it


def test_an_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert va_file.mine(va_file.whole(df).withColumn("anchor", F.lit(True))).count() == 0


def test_bounds_hold_and_leave_few_to_score():
    g = np.random.default_rng(1)
    x = np.floor(256 * g.normal(size=(4000, 64)) / 8).astype(np.int64)
    marks = [np.percentile(x[:, d], np.arange(1, 64) / 64 * 100).astype(int).tolist() for d in range(64)]
    cells = va_file.Cells(marks, [(int(x[:, d].min()), int(x[:, d].max())) for d in range(64)])
    low, high = cells.bounds(x[:20], cells.codes(x))
    exact = x[:20] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    few = sum(len(va_file.may_be_positive(low[a], high[a], 5)) for a in range(20))
    assert few < 20 * 4000 * 0.02
    window = (5_000, 15_000)
    able = [va_file.may_be_negative(low[a], high[a], window, 10) for a in range(20)]
    assert sum(map(len, able)) < 20 * 4000 * 0.2
    for a in range(20):
        best = sorted((s for s in exact[a] if window[0] <= s <= window[1]), reverse=True)[:10]
        assert sorted((s for s in exact[a][able[a]] if window[0] <= s <= window[1]), reverse=True)[:10] == best
