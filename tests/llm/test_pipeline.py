"""Mixing and the five stages against plain Python, over odd rows and columns whose names clash."""

import hashlib
import heapq
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, sharding

from .test_operators import components, corpus, hit_words, sentence, words
from .test_sharding import descend

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["rows", "times", "mix_key", "drop_key", "draw", "size", "shard", "uid", "held_key", "doc", "copy", "fp", "node", "k0", "__n"]


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def row_name(r):
    return f"{'null' if r[0] is None else r[0]}:{'null' if r[1] is None else md5(r[1])}"


def highest_quotients(votes, seats):
    won = Counter()
    heap = [(-v, p) for p, v in sorted(votes.items()) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, p = heapq.heappop(heap)
        won[p] += 1
        heapq.heappush(heap, (-votes[p] / (2 * won[p] + 1), p))
    return won


def mix_by_hand(rows):
    """(target, taken) of each row; the corpus is small, so that a block is a word."""
    size = [len(words(r[1])) for r in rows]
    key = [(r[3] is None, r[3] or "") for r in rows]
    sizes = Counter()
    for k, n in zip(key, size, strict=True):
        sizes[k] += n
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(sorted(sizes))}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        open_ = [k for k in sizes if k not in full]
        left = total - sum(3 * sizes[k] for k in full)
        over = []
        for k in open_:
            target[k] = left * weight[k] / sum(weight[x] for x in open_)
            over += [k] * (target[k] > 3 * sizes[k])
        if not over:
            break
        full |= set(over)
        target |= {k: 3.0 * sizes[k] for k in full}
    quota = highest_quotients(target, total)
    draw = [md5(f"{mixing.SEED}|{'null' if r[0] is None else r[0]}|{'null' if r[1] is None else md5(r[1])}") for r in rows]
    taken = [0] * len(rows)
    for k in sizes:
        mine = sorted((i for i in range(len(rows)) if key[i] == k), key=lambda i: (draw[i], size[i]))
        shards = Counter()
        for i in mine:
            shards[draw[i][:2]] += size[i]
        won = highest_quotients(shards, quota[k])
        if quota[k] == 0 or any(won[s] > 3 * shards[s] for s in shards):
            won = highest_quotients(shards, round(target[k]))
        for s in shards:
            n, at = min(won[s], 3 * shards[s]), 0
            for i in mine:
                if draw[i][:2] == s and shards[s]:
                    taken[i] = size[i] * (n // shards[s]) + max(0, min(at + size[i], n % shards[s]) - at)
                    at += size[i]
    return [target[k] for k in key], taken, size


def test_mixing_is_that_of_plain_python(spark):
    r = random.Random(7)
    rows = [x[:5] for x in corpus(8, 50)] + [(2000 + i, sentence(r, 3), "en", "tiny", 0) for i in range(4)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(3), ["doc_id", "source"]).collect()
    target, taken, size = mix_by_hand(rows)
    want = sorted((str(x[0]), str(x[3]), n, t) for x, n, t in zip(rows, size, taken, strict=True))
    assert sorted((str(x.doc_id), str(x.source), x.size, x.taken) for x in got) == want
    wanted = {str(x[3]): t for x, t in zip(rows, target, strict=True)}
    assert all(abs(x.target - wanted[str(x.source)]) < 1e-6 for x in got)


def plain_language(model, text):
    """The decoding by loops over one text."""
    if not text or not any(c.isalpha() and re.match(r"[^\W\d_]", c) for c in text):
        return "und", False
    out = []
    for c in text.lower().encode():
        if c >= 128 or 97 <= c <= 122:
            out.append(c)
        elif not out or out[-1] != 32:
            out.append(32)
    x = np.zeros(len(langid.ORDERS) * langid.BUCKETS)
    for k, n in enumerate(langid.ORDERS):
        for i in range(len(out) - n + 1):
            h = sum(out[i + j] * int(langid._FACTORS[j]) for j in range(n))
            x[k * langid.BUCKETS + ((h * 2654435761 >> 12) % langid.BUCKETS)] += 1
    x = np.sqrt(x / max(1.0, x.sum())).astype(np.float32)
    loss = []
    for code in model["code"]:
        loss.append(sum(
            w * np.logaddexp(0, -c * (float(x @ model["w"][:, j]) + float(model["b"][j]))) for j, (c, w) in enumerate(zip(code, model["weight"], strict=True))
        ) * len(code))
    p = np.exp(-(np.array(loss) - min(loss)))
    p /= p.sum()
    two = np.sort(p)[-2:]
    return model["names"][int(p.argmax())], bool(two[1] - two[0] < langid.AMBIGUOUS)


def spoken(r, v, n):
    kinds = {"aa": "tion ing the and of ent", "bb": "keit ung der die sch ich", "cc": "eau oux la le ais tre"}
    return " ".join("".join(r.choice(kinds[v].split()) for _ in range(r.choice([1, 2]))) for _ in range(n))


def test_languages_are_those_of_plain_python(spark):
    r = random.Random(3)
    rows = [(i, spoken(r, v, r.choice([1, 4, 30])), v) for i in range(240) for v in [r.choice(["aa", "bb", "cc"])]]
    rows += [(1000, None, "aa"), (1001, "12 ² ½ _", "aa"), (1002, "", None), (1003, spoken(r, "bb", 400_000), None), (1004, "É", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(*langid.sample(df, langid.in_fold(F.col("doc_id"), 5, 0)))
    got = {x.doc_id: (x.lang_pred, x.ambiguous) for x in langid.identify(df, [F.col("doc_id")]).collect()}
    assert got == {i: plain_language(model, t) if len(t or "") < 1 << 20 else ("bb", False) for i, t, _ in rows}
    assert len(rows[-2][1]) > 1 << 20


def test_grams_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("abc ..É1") for _ in range(r.randrange(60))) for _ in range(60)]
    want = [langid.grams(t) for t in texts]
    for piece in (1, 2, 3, 5):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert all((langid.grams(t) == w).all() for t, w in zip(texts, want, strict=True))


def by_hand(rows, items, model):
    rows = [x for x in rows if (lambda p: p[0] != "und" and not p[1])(plain_language(model, x[1]))]
    kept, seen = components([(i, t) for i, t in enumerate(y[1] for y in rows)]), {}
    for place, _, group in kept:
        seen.setdefault(group, []).append(place)
    keep = []
    for group in seen.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        keep += [i for i in group if not ids or rows[i][0] == min(ids)]
    rows = [rows[i] for i in sorted(keep)]
    rows = [x for x in rows if not hit_words(x[1], items)[1]]
    _, taken, size = mix_by_hand(rows)
    times, count = Counter(), Counter()
    for x, t, n in zip(rows, taken, size, strict=True):
        times[row_name(x)] += (2 * t + n) // (2 * max(n, 1))
        count[row_name(x)] += 1
    out = []
    for x in rows:
        n = count[row_name(x)]
        key = f"{sharding.SEED}|{'null' if x[0] is None else x[0]}"
        out += [(str(x[0]), len((x[1] or "").encode()) + 1, descend(key, sharding.tree(16)))] * ((2 * times[row_name(x)] + n) // (2 * n))
    return sorted(out)


def test_the_stages_are_those_of_plain_python(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, spoken(r, v, r.choice([6, 40, 90])), v, r.choice(["a", "b", None]), 0) for i in range(150) for v in [r.choice(["aa", "bb", "cc"])]]
    base = rows[3][1] + " " + spoken(r, "aa", 80)
    for k in range(12):  # near copies
        w = base.split()
        w[r.randrange(len(w))] = "ingent"
        rows.append((300 + k, " ".join(w), "aa", "hot", 0))
    item = spoken(r, "bb", 12)
    rows += [(400, f"{spoken(r, 'bb', 30)} {item} {spoken(r, 'bb', 30)}", "bb", "a", 0), (401, None, None, None, None)]
    rows += [(402, "", "aa", "a", 0), (403, "12 ½", None, "a", 0), rows[0], rows[0], (None, spoken(r, "cc", 50), None, "b", 0)]
    items = [(1, item), (2, None), (None, "")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = langid.train(*langid.sample(df, langid.in_fold(F.col("doc_id"), 5, 0)))
    want = by_hand(rows, items, model)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(x.doc_id), x.size, x.shard) for x in got) == want and len(want) > 100


def test_stages_take_columns_of_any_name(spark, tmp_path):
    rows = [x[:5] for x in corpus(6, 20)]
    df = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(7).alias(c) for c in ODD))
    item = rows[2][1] if len(rows[2][1].split()) > 9 else sentence(random.Random(2), 12)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = df
    for name, step in corpus_pipeline.STAGES[:-1]:
        at = step(spark, at, str(tmp_path))
        assert at.columns == df.columns, name
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    assert all(x.times == 7 and x.rows == 7 for x in at.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() == at.count()
