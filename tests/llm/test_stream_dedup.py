"""Exact deduplication by a stream: against brute force, in increments, with digests that collide."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import stream_dedup

DOCS = "doc_id long, text string, _metadata string, digest int"


def table():
    r = random.Random(4)
    texts = [" ".join(r.choice(["a", "b", "c"]) for _ in range(3)) for _ in range(60)]
    rows = [(i, t.replace(" ", r.choice([" ", "  ", "\n", " \t"]))) for i, t in enumerate(texts)]
    rows += [(100, None), (101, ""), (None, ""), (None, "only without id"), (None, "only without id"), (7, " "), (8, "\t\n"), (9, " ")]
    rows += [(200, "x y " * 30_000), (150, "x  y\n" * 30_000), (300, "twice"), (300, "twice"), (5, "Case"), (6, "case"), (400, "é"), (401, "é")]
    return rows


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), n in zip(rows, norm, strict=True):
        groups[n].append(i)
    least = {n: min((x for x in v if x is not None), default=None) for n, v in groups.items()}
    return Counter((i, least[n], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm, strict=True)), least


def write(spark, rows, path, parts=3):
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(parts).write.mode("append").parquet(path)


def check(got, rows):
    want, least = brute(rows)
    got = got.collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got) == want
    kept = [x for x in got if x.kept]
    assert len(kept) == len(least) == len({x.text_sha256 for x in kept}) and all(x.doc_id == x.keep_id for x in kept)


@pytest.mark.parametrize("digits", [64, 2])
def test_groups_are_those_of_brute_force(spark, tmp_path, digits):
    """Two digits: nearly all texts collide, and only their bytes tell them apart."""
    write(spark, table(), f"{tmp_path}/d.parquet")
    check(stream_dedup.deduplicate(spark, f"{tmp_path}/d.parquet", digits=digits), table())


def test_state_goes_on_over_new_files(spark, tmp_path):
    path, state, rows = f"{tmp_path}/d.parquet", f"{tmp_path}/state", table()
    later = [(-5, "a  b c"), (1000, "new"), (-6, None), (1001, "twice")]
    write(spark, rows, path)
    check(stream_dedup.deduplicate(spark, path, state, batch_bytes=1), rows)  # a file a batch
    before = {bytes(x.digest): x.n for x in stream_dedup.ledger(spark, state).collect()}
    write(spark, later, path, 1)
    check(stream_dedup.deduplicate(spark, path, state), rows + later)
    after = {bytes(x.digest): x.n for x in stream_dedup.ledger(spark, state).collect()}
    assert sum(after.values()) == len(rows) + 4 and all(after[k] >= n for k, n in before.items())
    check(stream_dedup.deduplicate(spark, path, state), rows + later)  # nothing new
    assert {bytes(x.digest): x.n for x in stream_dedup.ledger(spark, state).collect()} == after


def test_one_file_and_an_empty_table(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"doc_id": [3, 2], "text": ["a b", "a\nb"]}).to_parquet(f"{tmp_path}/one.parquet")
    check(stream_dedup.deduplicate(spark, f"{tmp_path}/one.parquet"), [(3, "a b"), (2, "a\nb")])
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none.parquet")
    assert stream_dedup.deduplicate(spark, f"{tmp_path}/none.parquet").count() == 0
