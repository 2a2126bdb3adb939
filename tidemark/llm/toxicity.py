"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its hashed n-grams (3 to 6 characters with its boundaries), a passage the
mean of its words, and a softmax over that mean gives the class; embeddings and softmax are trained together by
AdaGrad in numpy. A text scores as its most toxic passage of `PASSAGE` words: first rounds train on whole texts,
later ones on each text's highest passage, as it will be scored. A misspelt word shares n-grams, and so vectors,
with what was seen. The best passage's margin is turned into a probability by a logistic fit on training rows left out.

The model is fitted on a bounded sample of the labelled rows outside the held-out fold: about `POSITIVE` toxic and
`NEGATIVE` other texts, up to `SAMPLE_CHARS` characters, chosen by a hash of the id. Scoring reads whole texts.

Nulls and edges: a word without a known n-gram scores as the mean word of clean texts, and a null or empty text as
one such word; a document with several labels is toxic if
one says so; without labels of both classes every score is 0; each document row gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stage
from .langid import in_fold

POSITIVE, NEGATIVE, SAMPLE_CHARS = 700, 900, 2_500
BUCKETS, WIDTH, LEAST_SEEN = 1 << 19, 6, 5
PASSAGE = 3
WHOLE_ROUNDS, PASSAGE_ROUNDS, BATCH, RATE, DECAY = 6, 14, 64, 0.3, 0.002
FLOOR = 1e-4  # where AdaGrad's sums start: larger slows what is seen seldom
CUT = 0.3
PIECE = 1 << 19
ORDERS = (3, 4, 5, 6)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x9E3779B9], dtype=np.uint64)


def subwords(text: str):
    """Hashed n-grams of a text's words and the word each belongs to, piece by piece: (grams, words, word count)."""
    text, done = text.lower(), 0
    while done < len(text):
        to = min(len(text), done + PIECE)
        while to < len(text) and text[to] not in " \t\n\x0b\x0c\r":
            to += 1
        raw = np.frombuffer(f" {text[done:to]} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        raw = np.where((raw >= 9) & (raw <= 13), np.uint64(32), raw)
        done = to
        gap = raw == 32
        word = np.cumsum(gap[:-1] & ~gap[1:])  # of the character after each gap, counted from 1
        n_words = int(word[-1]) if len(word) else 0
        if not n_words:
            continue
        spaces = np.concatenate([[0], np.cumsum(gap)])
        found = []
        for n in ORDERS:
            m = len(raw) - n + 1
            if m < 1:
                continue
            inside = spaces[n - 1 : n - 1 + m] - spaces[1 : 1 + m] == 0  # no space but at the ends
            at = np.flatnonzero(inside)
            h = sum(raw[at + j] * _FACTORS[j] for j in range(n)) + np.uint64(n)
            h = (h ^ (h >> np.uint64(15))) * np.uint64(0x2545F4914F6CDD1D)
            # the word of the n-gram's second character: the first may be the space before it
            found.append(((h >> np.uint64(40)).astype(np.int64) % BUCKETS, word[at]))
        yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]) - 1, n_words


def word_scores(text: str, table: np.ndarray, unknown: float = 0.0) -> np.ndarray:
    """The score of each word; a word of which no n-gram has a vector scores ``unknown``."""
    out = []
    for grams, of, n in subwords(text):
        ok = of < n
        worth = table[grams[ok]]
        count, known = np.bincount(of[ok], minlength=n), np.bincount(of[ok], weights=worth != 0, minlength=n)
        out.append(np.where(known > 0, np.bincount(of[ok], weights=worth, minlength=n) / np.maximum(count, 1), unknown))
    return np.concatenate(out) if out else np.zeros(0)


def passages(scores: np.ndarray) -> np.ndarray:
    """Means of all runs of PASSAGE words, or of all words if fewer."""
    if len(scores) <= PASSAGE:
        return np.array([scores.mean() if len(scores) else 0.0])
    c = np.concatenate([[0.0], np.cumsum(scores)])
    return (c[PASSAGE:] - c[:-PASSAGE]) / PASSAGE


def train(texts: list[str], toxic: list[int]) -> dict | None:
    if len(set(toxic)) < 2:
        return None
    grams, weight, word_of, first = [], [], [], [0]
    for t in texts:
        base = first[-1]
        for g, of, n in subwords(t):
            count = np.maximum(np.bincount(of, minlength=n + 1), 1)
            grams.append(g.astype(np.int32))
            weight.append((1.0 / count[of]).astype(np.float32))
            word_of.append((of + base).astype(np.int32))
            base += n
        first.append(base)
    first = np.array(first)
    grams, weight, word_of = (np.concatenate(x) if x else np.zeros(0) for x in (grams, weight, word_of))
    order = np.argsort(word_of, kind="stable")
    grams, weight, word_of = grams[order].astype(np.int64), weight[order], word_of[order]
    # Only n-grams seen often enough get a vector; all others score nothing, here and later.
    seen, grams = np.unique(grams, return_inverse=True)
    text_of = np.searchsorted(first, word_of, side="right")
    often = np.bincount(np.unique(grams * len(texts) + text_of - 1) // len(texts), minlength=len(seen)) >= LEAST_SEEN
    place = np.where(often, np.cumsum(often) - 1, -1)[grams]
    grams, weight, word_of = place[place >= 0], weight[place >= 0], word_of[place >= 0]
    seen, n_grams = seen[often], int(often.sum())
    cut = np.searchsorted(word_of, np.arange(first[-1] + 1))
    y = np.array(toxic)
    left = np.arange(len(y)) % 5 == 0
    r = np.random.default_rng(11)
    e, v, b = r.normal(0, 0.1, (n_grams, WIDTH)), r.normal(0, 0.5, (WIDTH, 2)), np.zeros(2)
    past_e, past_v, past_b = np.full((n_grams, WIDTH), FLOOR), np.full((WIDTH, 2), 1e-2), np.full(2, 1e-2)
    even = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    rows = np.flatnonzero(~left & (np.diff(first) > 0))
    for turn in range(WHOLE_ROUNDS + PASSAGE_ROUNDS):
        r.shuffle(rows)
        for i in range(0, len(rows), BATCH):
            batch = rows[i : i + BATCH]
            lo, hi = first[batch].copy(), first[batch + 1].copy()
            if turn >= WHOLE_ROUNDS:
                table = e @ (v[:, 1] - v[:, 0])
                for k, d in enumerate(batch):
                    if hi[k] - lo[k] > PASSAGE:
                        s = slice(cut[lo[k]], cut[hi[k]])
                        at = passages(np.bincount(word_of[s] - lo[k], weights=table[grams[s]] * weight[s], minlength=hi[k] - lo[k])).argmax()
                        lo[k], hi[k] = lo[k] + at, lo[k] + at + PASSAGE
            take = np.concatenate([np.arange(cut[a], cut[z]) for a, z in zip(lo, hi, strict=True)])
            of = np.repeat(np.arange(len(batch)), cut[hi] - cut[lo])
            g, w = grams[take], weight[take] / (hi - lo)[of]
            h = np.stack([np.bincount(of, weights=w * e[g, k], minlength=len(batch)) for k in range(WIDTH)], axis=1)
            z = h @ v + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= (even[batch] / len(batch))[:, None]
            back = p @ v.T
            grad = np.stack([np.bincount(g, weights=w * back[of, k], minlength=n_grams) for k in range(WIDTH)], axis=1)
            for x, past, d in ((e, past_e, grad), (v, past_v, h.T @ p), (b, past_b, p.sum(axis=0))):
                past += d * d
                x -= RATE * d / np.sqrt(past)
            e *= 1 - DECAY
    table, base = np.zeros(BUCKETS, dtype=np.float32), float(b[1] - b[0])
    table[seen] = e @ (v[:, 1] - v[:, 0])
    # A word never seen counts as the mean word of clean texts, not as one between the classes.
    clean = np.concatenate([word_scores(t, table, np.nan) for t, toxic_text in zip(texts, y, strict=True) if not toxic_text])
    clean = clean[~np.isnan(clean)]
    unknown = min(0.0, float(clean.mean())) if len(clean) else 0.0
    margin = np.array([passages(word_scores(t, table, unknown)).max() + base for t in texts])
    fit = left if len(set(y[left])) == 2 else np.ones(len(y), dtype=bool)
    mid, wide = margin[fit].mean(), margin[fit].std() + 1e-9
    x, a, c = (margin[fit] - mid) / wide, 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        d = (p - y[fit]) * even[fit] / fit.sum()
        a, c = a - (d @ x + 1e-3 * a), c - d.sum()
    return {"table": table, "unknown": unknown, "scale": a / wide, "shift": c - a * mid / wide + base * a / wide}


def score(model: dict | None, text: str | None) -> float:
    if model is None:
        return 0.0
    scores = word_scores(text or "", model["table"], model["unknown"])
    z = model["scale"] * (passages(scores).max() if len(scores) else model["unknown"]) + model["shift"]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and classes of a bounded sample of the labelled rows outside the held-out fold; equal texts count once."""
    told = F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~in_fold(F.col("doc_id"), 4, 2)
    told = labels.where(told).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in told.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return [], []
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("toxic") == 1, POSITIVE / sizes[1]).otherwise(NEGATIVE / sizes[0])
    picked = told.where(draw < share).withColumnRenamed("doc_id", "labelled")
    picked = maybe_broadcast(stage(picked, "picked"), 16)
    got = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("labelled"))
    got = got.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text", "toxic").distinct()
    got = got.orderBy(F.xxhash64("doc_id", "text")).limit(2 * (POSITIVE + NEGATIVE)).toPandas()
    got = got.sort_values(["doc_id", "text"])
    return got["text"].tolist(), got["toxic"].tolist()


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document row."""
    model = train(*sample(docs, labels))
    names = ["doc_id", "held_out", "score", "predicted"]

    def run(batches):
        for batch in batches:
            s = [score(model, t) for t in batch.column(2).to_pylist()]
            made = [pa.array(s, pa.float64()), pa.array([int(x >= CUT) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    doc_id, held_out = F.col("doc_id").cast("long").alias("doc_id"), in_fold(F.col("doc_id"), 4, 2).alias("held_out")
    schema = "doc_id long, held_out boolean, score double, predicted int"
    return docs.select(doc_id, held_out, "text").mapInArrow(run, schema)


def op3_subword_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, labels)
