"""The bootstrap against plain Python, with words of any length and shape beside the seeds."""

import random
import re

import pytest

from pyspark.sql import functions as F

from tidemark.llm import pii

from .test_operators import spans_by_hand

SPACE = r"[\x20\x09-\x0D]+"


def trimmed(word):
    return re.sub(r"[^A-Za-z0-9\x80-\U0010ffff]+\Z", "", word)


def by_hand(texts):
    """All spans of each text, by sets and loops over every word."""
    base = [spans_by_hand(t) for t in texts]
    flat = []
    for t, spans in zip(texts, base, strict=True):
        t = list(t or "")
        for s, kind, e in spans:
            if kind in (2, 3):
                t[s:e] = [pii.JOINER if c in " ().-" else c for c in t[s:e]]
        flat.append("".join(t))
    rows = [[(m.start(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in flat]

    def contexts(row, p):
        if p >= 2:
            yield row[p - 2][1], row[p - 1][1], None
        if 1 <= p < len(row) - 1:
            yield row[p - 1][1], None, row[p + 1][1]

    plain = lambda w: trimmed(w.replace(pii.JOINER, ""))
    seeds = set()
    for spans, row in zip(base, rows, strict=True):
        for s, kind, _ in spans:
            p = max(i for i, (at, _) in enumerate(row) if at <= s)
            seeds |= {(kind, plain(row[p][1]), c) for c in contexts(row, p)}
    votes = {}
    for kind, inst, c in seeds:
        votes.setdefault((c, kind), set()).add(inst)
    candidates = {k for k, v in votes.items() if len(v) >= pii.SEEDS}
    named, shaped = {}, {}
    for row in rows:
        for p, (_, w) in enumerate(row):
            for c in contexts(row, p):
                named.setdefault(c, set()).add(plain(w))
                shaped[c, plain(w)] = shaped.get((c, plain(w)), False) or bool(re.search("[0-9@]", w))
    most = lambda c: sum(shaped[c, i] for i in named[c]) >= pii.CONFIDENT * (len(named[c]) + 1)
    candidates = {(c, k) for c, k in candidates if most(c)}
    known = {(kind, inst) for kind, inst, _ in seeds}
    worth = dict.fromkeys(known, 1.0)
    for _ in range(pii.ROUNDS):
        score = {(c, k): sum(worth.get((k, i), 0.0) for i in named[c]) / (len(named[c]) + 1) for c, k in candidates}
        doubt = {}
        for (c, k), x in score.items():
            for i in named[c]:
                if shaped[c, i]:
                    doubt[k, i] = doubt.get((k, i), 1.0) * (1 - min(x, 0.999))
        worth = {k: 1 - x for k, x in doubt.items()} | dict.fromkeys(known, 1.0)
    sure = {}
    for (c, k), x in score.items():
        if x >= pii.CONFIDENT:
            sure.setdefault(c, []).append((x, -k))
    out = []
    for spans, row in zip(base, rows, strict=True):
        fresh = []
        for p, (at, w) in enumerate(row):
            holds = any(at <= s < at + len(w) for s, _, _ in spans)
            claims = [max(sure[c]) for c in contexts(row, p) if c in sure]
            if re.search("[0-9@]", w) and claims and not holds and trimmed(w):
                fresh.append((at, -max(claims)[1], at + len(trimmed(w))))
        out.append(sorted([*spans, *fresh]))
    return out


@pytest.mark.parametrize("way", ["listed", "broadcast", "shuffled"])
def test_bootstrap_is_that_of_plain_python(spark, monkeypatch, way):
    monkeypatch.setattr(pii, "LISTED", pii.LISTED if way == "listed" else -1)
    monkeypatch.setattr(pii, "small", lambda *a: way != "shuffled")
    r = random.Random(4)
    digit = lambda n: next(d for d in "0123456789" if [m[1] for m in spans_by_hand(n + d)] == [2])
    words = [f"w{chr(97 + i)}" for i in range(12)] + ["call,", "Call", "x" * 100, "id7", "a@b", "--", "é1", "(see"]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    made = {
        "mail": lambda i: f"n{i}@mail{i}.example.org" + r.choice(["", ",", ".", ")"]),
        "dial": lambda i: f"+1 (555) 123-{4500 + i}",
        "host": lambda i: f"10.0.{i}.7",
        "card": lambda i: (lambda n: n + digit(n))(f"4111 1111 1111 {100 + i}"),
    }
    texts = []
    for i in range(120):
        kind = r.choice(list(made))
        before = r.choice([f"reach {kind}", f"call ID7 {kind}", f"{'y' * 120} {kind}"])
        what = made[kind](i) if r.random() < 0.7 else r.choice([f"user{i}(at)h!", f"{i}-{i}", f"#{i}", "wa", "wb,", "@"])
        texts.append(f"{some(r.choice([0, 1, 5, 30]))} {before} {what} {r.choice(['now', 'or', some(2)])}".strip())
    texts += [None, "", "42", "reach mail", "7 reach mail 9x now", texts[0], texts[0]]
    want = by_hand(texts)
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "uid long, text string, kind int, w int").repartition(3)
    got = pii.find(df, ["uid", "kind", "w"]).collect()
    assert sorted((x.uid, [tuple(s) for s in x.spans]) for x in got) == list(enumerate(want))
    assert sum(len(x.spans) - len(x.base) for x in got) > 10


def test_words_of_any_kind_beside_a_seed(spark):
    rows = [f"call ID7 number n{i}@mail{i}.example.org" for i in range(30)] + ["call ID7 number user200(at)host"]
    rows += [f"{'z' * 300} desk m{i}@mail{i}.example.org" for i in range(30)] + [f"{'z' * 300} desk user201(at)host"]
    got = pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), ["doc_id"]).collect()
    spans = {x.doc_id: [tuple(s) for s in x.spans] for x in got}
    assert spans[30] == [(16, 0, 31)] and spans[61] == [(306, 0, 321)]


def test_words_listed_already_are_not_met_again(spark):
    """A context that holds almost only identifiers gives rows for its other words alone."""
    docs = spark.createDataFrame([(i, f"reach mail n{i}@x{i}.org now") for i in range(200)] + [(200, "reach mail them now")], "doc_id long, text string")
    found = pii.stage(pii._matches(docs, ["doc_id"]), "matches")
    keys = found.where("kind = 4").select(F.explode("ctx").alias("ctx"), "anchor").distinct()
    met = pii._in_contexts(docs, pii.stage(keys, "keys")).select("word").distinct()
    assert [r.word for r in met.collect()] == ["them"]
