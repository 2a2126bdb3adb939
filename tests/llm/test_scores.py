"""Toxicity scores against a plain-Python scorer of the same fitted model, budgets of windows, and texts past all pieces."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, mixing, neardup, quality, sharding, toxicity

from .test_operators import CONV, components, hit_words, sentence

M = (1 << 64) - 1


def plain_score(model, text):
    scores = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()):
        codes = [32, *map(ord, word), 32]
        worth = []
        for n in toxicity.ORDERS:
            for i in range(len(codes) - n + 1):
                h = (sum(codes[i + j] * int(toxicity._FACTORS[j]) for j in range(n)) + n) & M
                h = ((h ^ (h >> 15)) * 0x2545F4914F6CDD1D) & M
                worth.append(float(model["table"][(h >> 40) % toxicity.BUCKETS]))
        scores.append(sum(worth) / len(worth) if any(worth) else model["unknown"])
    runs = [scores[i : i + toxicity.PASSAGE] for i in range(max(1, len(scores) - toxicity.PASSAGE + 1))] if scores else [[model["unknown"]]]
    z = model["scale"] * max(sum(x) / len(x) for x in runs) + model["shift"]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def labelled(r, n=500):
    bad = ["grumblor", "snarkfist", "vexling"]
    rows, labels = [], []
    for i in range(n):
        w = sentence(r, r.choice([3, 20, 60])).split()
        if i % 4 == 0:
            w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "s", "É", "\U0001f600"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_toxicity_scores_are_those_of_plain_python(spark):
    r = random.Random(9)
    rows, labels = labelled(r)
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "a"), (1004, "snarkfist"), (1005, "x" * 500), (1006, "ok " * 10 + "\x0bvexling\x0c!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(*toxicity.sample(df, labels))
    got = {x.doc_id: x for x in toxicity.score_documents(df, labels).collect()}
    for i, text in rows:
        want = plain_score(model, text)
        assert abs(got[i].score - want) < 1e-5 and got[i].predicted == int(got[i].score >= 0.3)
    assert len({round(x.score, 3) for x in got.values()}) > 20


def test_windows_over_the_budget_are_marked(spark):
    rows = [(1, 0, "system", "s" * 400, 0), *((1, i, ("assistant", "user")[i % 2], f"{i} " + "w" * (9000 if i == 7 else 300), 0) for i in range(1, 30))]
    windows = chat.format_windows(spark.createDataFrame(rows, CONV)).first().windows
    cost = lambda role, text: 4 + math.ceil((len(role) + len(text)) / 4)
    for w in windows:
        turns = re.findall(r"<\|(?:new|loss|old)\|>(\w+)<\|body\|>(.*?)<\|end\|>", w.text)
        tokens = sum(cost(*t) for t in turns)
        assert w.tokens == tokens and w.over == (tokens > chat.BUDGET)
    assert [w.over for w in windows].count(True) == 1
    assert all(w.tokens <= chat.STRIDE + chat.HISTORY + 110 + 80 for w in windows if not w.over)


def test_texts_longer_than_all_pieces(spark):
    r = random.Random(21)
    item = sentence(r, 14)
    body = " ".join(f"{w}{r.randrange(999)}" for w in sentence(r, 150_000).split())
    long = f"{body} {item} grumblor {sentence(r, 5)}"
    copy = long.replace("grumblor", "grumblors")
    assert len(long) > 1_200_000
    rows, labels = labelled(r, 300)
    texts = [(5000, long), (5001, copy), (5002, long[: len(long) // 2]), *rows]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    judged = {x.doc_id: x for x in quality.judge(df, labels).collect()}
    words = long.split()
    assert judged[5000].n_words == len(words) and judged[5000].word_chars == sum(map(len, words))
    mixed = {x.doc_id: x for x in mixing.mix(df, ["doc_id"]).collect()}
    assert mixed[5000].size == len(words) and 0 <= mixed[5000].taken <= 3 * len(words)
    model = toxicity.train(*toxicity.sample(df, labels))
    scores = {x.doc_id: x.score for x in toxicity.score_documents(df, labels).collect()}
    assert abs(scores[5000] - plain_score(model, long)) < 1e-5
    shards = {x.doc_id: x for x in sharding.shard(df).collect()}
    assert shards[5000].size == len(long.encode()) + 1
    kept = {x.doc_id: x for x in neardup.near_duplicates(df).collect()}
    assert kept[5000].n_shingles == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert kept[5001].component_id == 5000 and kept[5002].component_id == 5002
    few = [(i, t) for i, t in texts if i in (5002, 1, 2)]
    assert components(few)[0][1] == kept[5002].n_shingles
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    hits = {x.doc_id: x for x in decontam.hits(df, bench, ["doc_id"]).collect()}
    tail = " ".join(words[-60:])
    assert hits[5000].n_hit == hit_words(tail, [(1, item)])[1] >= 14 and hits[5000].n_words == len(words)
    assert hits[5002].n_hit == 0
    talk = spark.createDataFrame([(1, 0, "user", "go", 0), (1, 1, "assistant", long, 0)], CONV)
    back = chat.read_back(chat.format_windows(talk)).first()
    assert back.loss_text == long and back.turns[1].text == long


def test_operators_leave_the_session_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    neardup.near_duplicates(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))).count()
    assert spark.conf.get(name) == before and np.isfinite(float(before))
