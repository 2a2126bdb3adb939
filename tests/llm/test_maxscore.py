"""Ranked search against brute force, and which lists are probed instead of added."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import maxscore

DOCS, ITEMS = "doc_id long, text string, n long, shard string", "item_id long, text string, score int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").encode().lower().decode())


def tables(seed=6, n=400):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "it's", "x1"]
    text = lambda k: " ".join(vocabulary[min(int(r.expovariate(1 / 40)), 302)] for _ in range(k))
    docs = [(i, text(r.choice([3, 20, 90])) + " The") for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "-- !!"), (None, docs[7][1]), (3, docs[7][1]), (n + 3, docs[7][1]), (n + 3, docs[7][1]), (n + 4, text(40_000)), (-1, "the THE tHe")]
    items = [(i, text(r.choice([1, 5, 30]))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "the"), (None, "w1 w2"), (0, "w250 w3"), (54, "Ünï ünï W1"), (55, docs[7][1])]
    return docs, items


def brute(docs, items, k=10):
    held = [(i, Counter(t), len(t)) for i, text in docs for t in [terms(text)]]
    n_docs, n_terms = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // n_terms if n_terms else 10
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, at + 1, i, -s) for at, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


@pytest.mark.parametrize("postings,block", [(2_000_000, 4 << 20), (700, 200)])
def test_ranks_are_those_of_brute_force(spark, monkeypatch, postings, block):
    monkeypatch.setattr(maxscore, "SHARD_POSTINGS", postings)
    docs, items = tables()
    left, right = spark.createDataFrame([(*x, 1, "s") for x in docs], DOCS).repartition(3), spark.createDataFrame([(*x, 1) for x in items], ITEMS)
    got = maxscore.rank(left, right, block_bytes=block).collect()
    assert Counter((x.item_id, x["rank"], x.doc_id, x.score) for x in got) == brute(docs, items)


def test_nothing_to_find(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 1)], ITEMS)
    assert maxscore.rank(docs, items).count() == 0
    assert maxscore.rank(spark.createDataFrame([(1, "a", 1, "s")], DOCS), items.limit(0)).count() == 0


def test_long_lists_of_low_bounds_are_only_probed():
    """A rare heavy term in 20 documents; a light one in all of 10,000, of which only those 20 are looked at."""
    docs = np.concatenate([np.arange(10_000), np.arange(0, 10_000, 500)])
    terms_, impact = np.repeat([0, 1], [10_000, 20]), np.concatenate([np.arange(10_000) % 7 + 1, np.full(20, 100)]).astype(np.int64)
    shard = maxscore.Shard(terms_, docs, impact, 10_000)
    found, score = shard.best([(0, 1), (1, 50)], 10)
    assert len(found) <= 20 and set(found) <= set(range(0, 10_000, 500))
    want = sorted((5000 + x % 7 + 1 for x in range(0, 10_000, 500)), reverse=True)[:10]
    assert sorted(score, reverse=True)[:10] == want
