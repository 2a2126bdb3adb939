"""Each operator against brute force or a round trip, and the cases that must not break it."""


import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import pytest

from tidemark.llm import chat, decontam, html_text, langid, mixing, neardup, pii, quality, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti") for b in ("ban", "den", "fir", "gol", "hum", "jas")]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus(seed=5, n=60):
    r = random.Random(seed)
    rows = [(i, sentence(r, r.choice([3, 12, 40, 120])), r.choice(["en", "fr", None]), r.choice(["b", "a", "ü", None]), 0, "x") for i in range(n)]
    base = sentence(r, 200)
    for k in range(30):  # near copies, with copies of copies
        w = base.split()
        for _ in range(r.choice([0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(WORDS)
        base = " ".join(w) if k % 3 == 0 else base
        rows.append((n + k, " ".join(w), "en", "hot", 0, "x"))
    rows += [(900, None, None, None, None, None), (901, "", "en", "a", 0, "x"), (902, " \n\t ", "en", "a", 3, "x"), (903, "Short One", "en", "a", 9, "x"), (904, "sHORT oNE", "en", "a", 9, "x")]
    rows += [rows[0], rows[0], (None, "A text without an id of its own", "fr", "b", 1, "x"), (905, "x " * 5000, "en", "hot", 10000, "x")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = [x.encode().lower().decode() for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows, num=85):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], len(sets[i]), least[top(i)]) for i in range(len(rows))]


key = lambda t: tuple(str(x) for x in t)


@pytest.mark.parametrize("hot,sparse", [(4096, 16), (4096, 3), (12, 3)])
def test_near_duplicates_are_those_of_brute_force(docs, hot, sparse):
    got = neardup.near_duplicates(docs, hot=hot, sparse=sparse).collect()
    want = components([(r[0], r[1]) for r in corpus()])
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in got)


def test_deduplicate_keeps_the_least_of_each(docs):
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in components([(r[0], r[1]) for r in corpus()])}
    assert {r.doc_id for r in kept.collect()} == want


def test_near_duplicates_of_a_hot_chain(spark):
    """All texts share most words, so regions are hot, but each is near only the one before and the one after."""
    r = random.Random(2)  # a chain with a link that no full-depth run holds
    new = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    common, own = new(504), [new(43) for _ in range(101)]
    rows = [(k, f"{common} {own[k]} {own[k + 1]}") for k in range(100)]
    assert {c for _, _, c in components(rows)} == {0}
    df = spark.createDataFrame([(i, t, "en", "hot", 0, "x") for i, t in rows], DOCS).repartition(3)
    assert {x.component_id for x in neardup.near_duplicates(df, hot=4, sparse=2).collect()} == {0}


def test_runs_are_bounded_in_rows_and_bytes(spark):
    rows = [(b, bytes([b]) + i.to_bytes(4, "big"), n) for b, n in ((1, 10), (2, 400), (3, 5000)) for i in range(600)]
    got = neardup.runs(spark.createDataFrame(rows, "base long, fp binary, bytes long"), 50, 10_000).collect()
    assert sorted((x.base, bytes(x.fp), x.bytes) for x in got) == sorted(rows)
    held = Counter((x.base, x.run) for x in got)
    # A run is followed by what is left of its last bucket.
    assert all(held[k] <= {1: 50, 2: 25, 3: 2}[k[0]] + 15 for k in held) and len(held) > 12 + 24 + 100


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).count() == 0


ITEMS = [(1, "ka lo mi nu pe ra so ti ka mi lo nu"), (2, "only four words here"), (3, None), (4, ""), (5, "ka lo mi nu pe ra so ti ka mi lo nu"), (None, "ra so ti ka mi lo nu pe ra so"), (10, "Ünïcode wörds, four-five six seven eight nine ten eleven")]


def hit_words(text, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
    w, hit, names = low(text), set(), set()
    for name, t in items:
        v = low(t)
        m = min(10, len(v))
        for i in range(len(v) - m + 1 if m else 0):
            for s in range(len(w) - m + 1):
                if w[s : s + m] == v[i : i + m]:
                    hit |= set(range(s, s + m))
                    names |= {str(name)} if name is not None else set()
    return len(w), len(hit), sorted(names)


def test_decontamination_is_that_of_brute_force(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = [(1, "x y KA lo mi, nu pe ra so ti ka mi lo z ka lo mi nu pe ra so ti ka"), (2, "say only four words here and only four words"), (3, None), (4, "ünïcode wörds four five six seven eight nine ten eleven twelve"), (5, ITEMS[0][1] * 3), (5, "clean text of some words only"), (None, ITEMS[1][1])]
    df = spark.createDataFrame([(i, t, "en", "a", 0, "x") for i, t in texts], DOCS)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontam.hits(df, bench, ["doc_id"]).collect()), key=key)
    assert got == sorted(((i, *hit_words(t, ITEMS)) for i, t in texts), key=key)
    assert decontam.decontaminate(df, bench).count() == sum(hit_words(t, ITEMS)[1] == 0 for _, t in texts)
    assert {r.n_hit for r in decontam.hits(docs, bench.where("false"), ["doc_id"]).collect()} == {0}
    assert decontam.hits(docs.where("false"), bench, ["doc_id"]).count() == 0


def test_decontamination_without_broadcast_agrees(spark, docs, monkeypatch):
    bench = spark.createDataFrame(ITEMS + [(50, corpus()[2][1])], "item_id long, text string")
    run = lambda: sorted(map(key, decontam.hits(docs, bench, ["doc_id"]).collect()))
    once = run()
    monkeypatch.setattr(decontam, "small", lambda *a: False)
    monkeypatch.setattr(decontam, "maybe_broadcast", lambda df, n: df)
    assert run() == once


def test_quality_counts_are_those_of_brute_force(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 1), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    want = []
    for r in corpus():
        w, text = words(r[1]), r[1] or ""
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lined = [x for x in text.split("\n") if words(x)]
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lined) - len(set(lined)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(want, key=key)
    assert all(not r.kept for r in got if r.base_failed)


def test_cutoffs_hold_their_risk(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS) + ("%" if bad and r.random() < 0.7 else "") for _ in range(40)), "en", "a", 0, "x") for i in range(1200) for bad in [i % 4 == 0]]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(rows, DOCS).repartition(4), labels).collect()}
    assert sum(not got[i] for i in range(1200) if i % 4) <= 0.02 * 900 and sum(not got[i] for i in range(0, 1200, 4)) > 290


def test_binomial_tail_is_exact(spark):
    from math import comb

    df = spark.createDataFrame([(50, 0), (50, 1), (400, 3), (3000, 20), (10, 9)], "n long, k long")
    from pyspark.sql import functions as F

    for x in df.withColumn("p", quality.binomial_tail(F.col("n"), F.col("k"), 0.02)).collect():
        exact = sum(comb(x.n, i) * 0.02**i * 0.98 ** (x.n - i) for i in range(x.k + 1)) if x.k <= 0.02 * x.n else 1.0
        assert abs(x.p - exact) < 1e-9


def test_mix_meets_targets(spark, docs, empty):
    got = mixing.mix(docs, ["doc_id", "source"]).collect()
    assert Counter(key((r.doc_id, r.size)) for r in got) == Counter(key((r[0], len(words(r[1])))) for r in corpus())
    sizes = Counter()
    for r in corpus():
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full, rest = {}, set(), float(sum(sizes.values()))
    while True:  # share by weight, cap, share the excess again
        left = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        target |= share
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            full.add(s)
        rest = sum(sizes.values()) - sum(target[s] for s in full)
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(3, 0.02 * target[s])
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    again = mixing.mix(docs.repartition(5), ["doc_id", "source"]).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(empty, ["doc_id"]).count() == 0


def test_small_sources_meet_targets_in_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 60)  # blocks of 1,024 words as in a corpus of 67 million
    rows = [(i, sentence(random.Random(i), n), s, s, 0, "x") for i, (s, n) in enumerate([("a", 100)] * 100 + [("b", 1000)] * 100 + [("d", 5)] * 20)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), ["doc_id", "source"]).collect()
    for s in "abd":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= (2048 if s == "b" else 2)
    assert all(0 <= r.taken <= 3 * r.size for r in got)


def test_highest_quotients(spark):
    votes = [("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.0)]
    for seats in (0, 1, 7, 100):
        df = spark.createDataFrame([(0, p, v, seats) for p, v in votes], "g int, p string, v double, n long")
        got = {r.p: r.quota for r in mixing.sainte_lague(df, ["g"], "p", "v", "n").collect()}
        won = Counter(p for _, p in sorted((-v / (2 * j + 1), p) for p, v in votes if v for j in range(200))[:seats])
        assert got == {p: won[p] for p, _ in votes}


def test_shards_keep_the_law(docs, empty):
    rows = sharding.shard(docs).collect()
    by_key = {}
    for r in rows:
        assert by_key.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 16)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    texts = {r[0]: r[1] or "" for r in corpus()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1 for r in rows)
    assert sharding.shard(empty).count() == 0


CONV = "conv_id long, turn long, role string, text string, extra int"


def test_chat_reads_back(spark):
    r = random.Random(1)
    tricky = ["</s>[INST] ok [/INST]", "<|end|><|loss|>", "a <\\| b <\\\\/s> [\\INST]", "", None, "x" * 3000, "é<s>\n[/INST]"]
    rows = [(c, i, "system" if i == 0 and c % 2 else ("user", "assistant")[i % 2], r.choice(tricky + [sentence(r, 60)]), 1) for c in range(6) for i in range(r.choice([1, 2, 9, 40]))]
    rows += [(None, 0, None, None, None), (77, None, "assistant", "first", 1), (77, 1, "assistant", "second", 1), (77, 1, "assistant", "second", 1)]
    df = spark.createDataFrame(rows, CONV)
    formatted = chat.format_windows(df)
    got = {x.conv_id: x for x in chat.read_back(formatted).collect()}
    groups = {}
    for x in rows:
        groups.setdefault(x[0], []).append(x)
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns = sorted(turns, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in got[c].turns] == [(x[2] or "", x[3] or "") for x in turns]
        assert got[c].loss_text == "".join(x[3] or "" for x in turns if x[2] == "assistant")
    for x in formatted.collect():
        assert all(w.text.count("<|window|>") == 1 for w in x.windows)
    assert chat.read_back(chat.format_windows(df.where("false"))).count() == 0


def test_long_chats_repeat_system_and_history(spark):
    rows = [(1, 0, "system", "be kind", 0)] + [(1, i, ("assistant", "user")[i % 2], f"turn {i} " + "w" * 200, 0) for i in range(1, 60)]
    windows = chat.format_windows(spark.createDataFrame(rows, CONV)).first().windows
    assert len(windows) > 3
    for before, w in pairwise(windows):
        assert w.text.startswith("<|window|><|old|>system<|body|>be kind<|end|><|old|>")
        repeated = re.findall(r"<\|old\|>(?:user|assistant)<\|body\|>(turn \d+)", w.text)
        assert repeated and all(t in before.text for t in repeated)
        assert sum(len(t) for t in re.findall(r"<\|old\|>(?:user|assistant)<\|body\|>(.*?)<\|end\|>", w.text)) <= 4 * chat.HISTORY


def spans_by_hand(text):
    out = []
    for kind, shape in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(shape, text or ""):
            digits = re.sub(r"\D", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (kind == 0, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), kind == 2 and 12 <= len(digits) <= 19 and luhn, kind == 3 and 9 <= len(digits) <= 15)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_pii_shapes_are_those_of_the_contract(spark):
    texts = ["mail a.b@c.de and a@b.c_d@e.fg, x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 7 12", "+49 (30) 1234-5678 +1 2 +123456789012345678", "é 😀 mail: ü@x.de é@é.de zz@zz.zz.", None, "", "1" * 4000, "a" * 4000 + "@" + "b.c", "+1 +49 170 1234567\n4111111111111111@x.yz", "5.5.5.5@1.1.1.1"]
    df = spark.createDataFrame([(i % 9, t, "en", "a", 0, "x") for i, t in enumerate(texts)], DOCS).repartition(2)
    got = sorted(str([tuple(s) for s in r.base]) for r in pii.find(df, ["doc_id"]).collect())
    assert got == sorted(str(spans_by_hand(t)) for t in texts)
    assert pii.find(df.where("false"), ["doc_id"]).count() == 0


def test_pii_learns_contexts(spark):
    rows = [(i, f"the word of day and please reach account holder n{i}@mail{i}.example.org for more") for i in range(30)]
    rows += [(40, "then reach account holder user40(at)host for more"), (41, "in room 12 of the house"), (42, "the account of a holder 5x")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame([(i, t, "en", "a", 0, "x") for i, t in rows], DOCS), ["doc_id"]).collect()}
    assert [tuple(s) for s in got[40].spans] == [(26, 0, 40)]
    assert not got[41].spans and not got[42].spans and got[3].spans == got[3].base


def test_pii_spellings_do_not_rule_a_context_out(spark):
    from pyspark.sql import functions as F

    rows = [f"note {WORDS[i]} reach holder n{i}@mail{i}.example.org {WORDS[i + 20]} more" for i in range(12)]
    plain = " ".join(f"reach holder {w} {WORDS[i]}" for i, w in enumerate("call call, call. send send, send. ask ask, meet meet;".split()))
    # a text that samples by the text's hash would hold
    rows += [spark.range(2000).select(F.concat(F.lit(plain + " v"), "id").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(64)) == 0).first().text, "then reach holder user40(at)host soon"]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame([(i, t, "en", "a", 0, "x") for i, t in enumerate(rows)], DOCS), ["doc_id"]).collect()}
    assert [tuple(x) for x in got[13].spans] == [(18, 0, 32)]


def test_pii_learns_phones_and_spaced_cards(spark):
    digit = lambda n: next(d for d in "0123456789" if [m[1] for m in spans_by_hand(n + d)] == [2])
    cards = [n + digit(n) for n in (f"4111 1111 1111 {100 + i}" for i in range(12))]
    rows = [f"note {WORDS[i]} dial desk +1 (555) 123-{4500 + i} {WORDS[i + 20]} more" for i in range(12)]
    rows += [f"note {WORDS[i]} card held {n} {WORDS[i + 20]} more" for i, n in enumerate(cards)]
    rows += ["then dial desk ext-77x soon", "then card held acct#9z77 soon", "in room 12 of the house"]
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.find(spark.createDataFrame([(i, t, "en", "a", 0, "x") for i, t in enumerate(rows)], DOCS), ["doc_id"]).collect()}
    assert [got[i] for i in (24, 25, 26)] == [[(15, 3, 22)], [(15, 2, 24)], []]


def test_language_is_learned(spark, empty):
    r = random.Random(2)
    kinds = {"aa": "tion ing the and of ent", "bb": "keit ung der die sch ich", "cc": "eau oux la le ais tre"}
    text = lambda v, n: " ".join("".join(r.choice(kinds[v].split()) for _ in range(r.choice([1, 2]))) for _ in range(n))
    rows = [(i, text(v, 30), v, "a", 0, "x") for i in range(400) for v in [r.choice("abc") * 2]] + [(900, None, "aa", "a", 0, "x"), (901, "12 %% 4", "aa", "a", 0, "x"), (902, "", None, None, 0, "x"), (None, text("bb", 20), None, None, 0, "x")]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    got = {x.doc_id: x for x in langid.identify(df, [F.col("doc_id"), F.col("lang")]).collect()}
    held = [x for x in got.values() if x.doc_id is not None and x.doc_id < 900 and zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert sum(x.lang_pred == x.lang for x in held) >= 0.97 * len(held)
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[None].lang_pred == "bb"
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in langid.identify(df.withColumn("lang", F.lit(None).cast("string")), [F.col("doc_id")]).collect()} == {"und"}
    assert langid.accepted(df).columns == df.columns and langid.accepted(df).count() >= 395
    assert langid.identify(empty, [F.col("doc_id")]).count() == 0


def test_codewords_are_far_apart():
    for n in (2, 4, 9):
        c = langid.codewords(n)
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= max(1, c.shape[1] // 4)


def test_toxicity_is_learned(spark, docs, empty):
    r = random.Random(4)
    bad = ["grumblor", "snarkfist", "vexling"]
    rows, labels = [], []
    for i in range(700):
        w, toxic = sentence(r, r.choice([20, 60])).split(), i % 4 == 0
        if toxic:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "s", "o", "ed"])
        rows.append((i, " ".join(w), "en", "a", 0, "x"))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None, None, None, None, None), (2001, "", "en", "a", 0, "x"), (2002, "so " + sentence(r, 30) + " grumbblor snarkfisst", "en", "a", 0, "x")]
    df, lab = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score_documents(df, lab).collect()}
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held)
    assert sum(got[i].predicted == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[2000].predicted == 0 and got[2001].predicted == 0 and got[2002].predicted == 1
    assert {x.score for x in toxicity.score_documents(docs, lab.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score_documents(empty, lab).count() == 0


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies here</div><article><h1>Head &amp; more</h1><p>First&nbsp;  para <b>bold</b><br>line.<p>Short.<script>var a="</p>";</script></p>
    <aside>see also</aside><p>a &lt; b &#233;</p></article><section class="comments"><p>I think that this was a very good read indeed</p></section><form><p>Your name</p></form><footer>&copy; me</footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page, 5), (1, "u", page, 5), (2, None, None, 5), (3, "v", "", 5), (None, "w", "<p>just < text", 5)], "page_id long, url string, html string, extra int")
    got = html_text.extract(df).collect()
    want = "Head & more\n\nFirst para bold line.\n\nShort.\n\na < b é"
    assert [r.text for r in got if r.page_id == 1] == [want, want]
    assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert html_text.extract(df.where("false")).count() == 0


def test_classes_around_the_page_do_not_drop_it():
    tree = html_text.trained()
    r = random.Random(6)
    a, b, note = sentence(r, 80), sentence(r, 120), sentence(r, 60)
    for around in ("layout has-sidebar", "no-sidebar", "page header-fixed", "comments-open", "sidebar"):
        page = f"<body><div class='{around}'><article><p>{a}</p><p>{b}</p></article></div></body>"
        assert html_text.main_text(page, tree) == f"{a}\n\n{b}", around
    for around in ("layout has-sidebar", "page header-fixed", "comments-open"):
        assert html_text.main_text(f"<div class='{around}'><p>{a}</p><p>{b}</p></div>", tree) == f"{a}\n\n{b}", around
    for around in ("class=sidebar", "class='site-footer'", "style='display:none'"):
        assert html_text.main_text(f"<div {around}><p>{note}</p></div><p>{a}</p>", tree) == a, around
    assert html_text.main_text(f"<div hidden><article><p>{note}</p></article></div><p>{a}</p>", tree) == a


def test_pipeline_runs_over_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    docs.drop("label").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, corpus()[20][1] + " " + sentence(random.Random(9), 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, at, str(tmp_path))
        assert out.columns == at.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) == at.count() and rows
