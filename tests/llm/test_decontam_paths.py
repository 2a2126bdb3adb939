"""Long texts by both ways of meeting windows: with windows broadcast, and with fingerprints shuffled."""

import random

import pytest

from tidemark.llm import decontam

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("fits", [True, False])
def test_long_text_takes_time_in_proportion(spark, monkeypatch, fits):
    monkeypatch.setattr(decontam, "small", lambda *a: fits)
    if not fits:
        monkeypatch.setattr(decontam, "maybe_broadcast", lambda df, n: df)
    r = random.Random(8)
    w = [f"w{r.randrange(10**9)}" for _ in range(20_000)]
    rows = [(1, " ".join(w)), (2, "short text of " + " ".join(w[500:511])), (3, None), (4, "")]
    items = [(7, " ".join(w[19_900:19_925])), (8, " ".join(w[495:520])), (9, "none of these words is in any of the documents at all")]
    got = decontam.hits(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"])
    assert sorted((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in got.collect()) == [(1, 20_000, 50, ["7", "8"]), (2, 14, 11, ["8"]), (3, 0, 0, []), (4, 0, 0, [])]
