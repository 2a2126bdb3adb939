"""What operators promise to bound: windows by their budget, the driver's memory by the sample."""

import random
import tracemalloc

from tidemark.llm import chat, langid, quality

CONV = "conv_id long, turn long, role string, text string"


def test_windows_keep_to_their_budget(spark):
    r = random.Random(3)
    talk = lambda c, system, sizes: [(c, 0, "system", "s" * (4 * system))] * bool(system) + [(c, i, ("user", "assistant")[i % 2], f"{c}-{i} " + "w" * max(0, 4 * n - 9)) for i, n in enumerate(sizes, 1)]
    rows = talk(1, 700, [100] * 40) + talk(2, 0, [r.choice([5, 60, 300, 440, 460, 800, 1000]) for _ in range(80)]) + talk(3, 20, [r.choice([3, 900, 1010, 1500]) for _ in range(30)]) + talk(4, 1200, [50] * 5)
    got = {x.conv_id: x.windows for x in chat.format_windows(spark.createDataFrame(rows, CONV)).collect()}
    assert all(w.tokens <= chat.BUDGET for c in (1, 2) for w in got[c]) and not any(w.over for c in (1, 2) for w in got[c])
    for c in (3, 4):  # over only with one turn of its own that does not fit beside the system turn
        for w in got[c]:
            assert w.over == (w.tokens > chat.BUDGET)
            if w.over and c == 3:
                assert w.text.count("<|new|>") + w.text.count("<|loss|>") <= 1 + (w.span == 1) and "<|old|>user" not in w.text and "<|old|>assistant" not in w.text
    assert all(w.over for w in got[4]) and any("<|old|>user" in w.text or "<|old|>assistant" in w.text for w in got[2])
    assert all("ssss" in w.text for w in got[1]) and len(got[1]) >= 40 * 100 / (chat.BUDGET - 700)


def test_many_languages_take_bounded_memory(monkeypatch):
    """200 invented languages, as many rows each as the sample lets in."""
    monkeypatch.setattr(langid, "STEPS", 40)
    each, texts, langs = langid.SAMPLE_ROWS // 200, [], []
    for k in range(200):
        r = random.Random(k)
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(r.randint(2, 7))) for _ in range(40)]
        texts += [" ".join(r.choice(words) for _ in range(60)) for _ in range(each + 2)]
        langs += [f"l{k}"] * (each + 2)
    rows = [i for i in range(len(texts)) if i % (each + 2) < each]
    tracemalloc.start()
    model = langid.train([texts[i] for i in rows], [langs[i] for i in rows])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == langid.SAMPLE_ROWS and peak < 700e6
    held = [i for i in range(len(texts)) if i % (each + 2) >= each]
    found = langid.predict(model, [texts[i] for i in held])
    assert sum(p[0] == langs[i] for p, i in zip(found, held, strict=True)) > 0.95 * len(held)


def test_rules_together_keep_their_risk(spark):
    """Five rules, each failing other good documents: none may drop its share of them beside the others."""
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("ban", "den", "fir", "gol", "hum")]
    rows, labels = [], []
    for i in range(6000):
        w = [r.choice(words) + str(r.randrange(1000)) for _ in range(40)]
        text, bad = " ".join(w), i % 5 == 4
        if i % 100 < 4 or (bad and i % 2):  # of the good ones, 1 in 100 fails each of four rules
            kind = i % 100 if not bad else i // 2 % 4
            text = (text + " #" * 60, "\n".join([" ".join(w[:20])] * 9 + w), text + " !" * 60, " ".join(x * 8 for x in w))[kind]
        rows.append((i, text, "en"))
        labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.judge(docs, told).collect()}
    good = [i for i in got if i % 5 < 4]
    base = sum(got[i].base_failed for i in good)
    assert sum(not got[i].kept and not got[i].base_failed for i in good) <= quality.RISK * (len(good) - base)
    assert sum(not got[i].kept and not got[i].base_failed for i in got if i % 5 == 4) > 100  # and yet some rules are chosen
