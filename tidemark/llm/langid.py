"""Language identification by error-correcting output codes.

Each learned language has a codeword; a logistic classifier for each bit is trained in numpy on square roots of
hashed byte n-gram shares (2 to 4 bytes of the lower-cased letters, with one space for all else), so that all bits
are one matrix product. A text goes to the codeword of least loss: each bit's logistic loss, weighted by how well
that bit did on training rows left out of its fit. The score is the softmax of the losses; a text whose two best
codewords are closer than `AMBIGUOUS` is flagged.

The model is fitted on a bounded sample: of the `LANGUAGES` most frequent lang values, about `PER_LANGUAGE` rows each,
`SAMPLE_ROWS` at most in all, of texts up to `SAMPLE_CHARS` characters, chosen by a hash of the row. So the driver
holds `SAMPLE_ROWS` rows of features and their products at most, whatever the number of languages. Predictions read whole texts and nothing else.

Nulls and edges: a null text or one without a letter (Unicode category L) is ``und`` with score 0; null lang teaches
nothing; without any learned language every text is ``und``, with one each text with a letter is of it; equal rows
are one in the sample; each row gives one row; a kept column may have any name but those of the results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, without

LANGUAGES, PER_LANGUAGE = 200, 250
SAMPLE_ROWS = 5000
SAMPLE_CHARS = 20_000
ORDERS, BUCKETS = (2, 3, 4), 4096
STEPS, RATE, DECAY = 250, 8.0, 1e-5
AMBIGUOUS = 0.05
PIECE = 1 << 20
ROWS = 64  # scored in one matrix product
_LETTER = regex.compile(r"\p{L}")
_FACTORS = np.array([1, 31, 1009, 30011], dtype=np.int64)


def in_fold(doc_id: Column, parts: int, at: int) -> Column:
    """Whether crc32 of the id as text leaves `at`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == at


def grams(text: str) -> np.ndarray:
    """Counts of hashed n-grams of a whole text, piece by piece; a piece starts with the end of what came before."""
    data = text.lower().encode("utf-8", "replace")
    counts = np.zeros(len(ORDERS) * BUCKETS)
    tail = np.zeros(0, dtype=np.int64)
    for i in range(0, len(data), PIECE):
        raw = np.frombuffer(data[i : i + PIECE], dtype=np.uint8)
        letter = (raw >= 0x80) | ((raw >= 97) & (raw <= 122))
        b = np.where(letter, raw, 32).astype(np.int64)
        after_gap = np.concatenate([[bool(len(tail)) and tail[-1] == 32], ~letter[:-1]])
        b = np.concatenate([tail, b[letter | ~after_gap]])
        for k, n in enumerate(ORDERS):
            lo = max(0, len(tail) - n + 1)  # n-grams that end in this piece
            if len(b) - lo >= n:
                h = sum(b[lo + j : len(b) - n + 1 + j] * _FACTORS[j] for j in range(n))
                found = np.bincount((h * 2654435761 >> 12) % BUCKETS, minlength=BUCKETS)
                counts[k * BUCKETS : (k + 1) * BUCKETS] += found
        tail = b[-(max(ORDERS) - 1) :]
    return counts


def features(text: str) -> np.ndarray:
    c = grams(text)
    return np.sqrt(c / max(1.0, c.sum())).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +-1: all splits of up to 6 languages, else the random code of largest least distance."""
    if n <= 6:
        splits = range(2 ** (n - 1) - 1)
        rows = [[1 if i == 0 or (bits >> (i - 1)) & 1 else -1 for bits in splits] for i in range(n)]
        return np.array(rows, dtype=np.float64)
    r, best = np.random.default_rng(seed), None
    for _ in range(200):
        c = r.choice([-1.0, 1.0], (n, max(15, int(np.ceil(10 * np.log2(n))))))
        far = ((c[:, None] != c[None]).sum(axis=2) + 10**6 * np.eye(n, dtype=int)).min()
        if best is None or far > best[0]:
            best = far, c
    return best[1]


def train(texts: list[str], langs: list[str]) -> dict:
    names = sorted(set(langs))
    if len(names) < 2:
        return {"names": names}
    x, code = np.empty((len(texts), len(ORDERS) * BUCKETS), dtype=np.float32), codewords(len(names))
    for row, text in zip(x, texts, strict=True):
        row[:] = features(text)
    y = code[[names.index(v) for v in langs]]
    share = np.array([1.0 / langs.count(v) for v in langs])
    share = (share / share.sum())[:, None]

    # The weights are sums of rows, w = x.T @ a, so the descent runs on a and the rows' products alone.
    products = x @ x.T

    def fit(rows):
        own = products if rows.all() else products[np.ix_(rows, rows)]
        a, b = np.zeros((rows.sum(), y.shape[1]), dtype=np.float32), np.zeros(y.shape[1], dtype=np.float32)
        part = share[rows] / share[rows].sum()
        for _ in range(STEPS):
            pull = part * y[rows] / (1 + np.exp(np.clip(y[rows] * (own @ a + b), -30, 30)))
            a += (RATE * (pull - DECAY * a)).astype(np.float32)
            b += (RATE * 0.1 * pull.sum(axis=0)).astype(np.float32)
        whole = np.zeros((len(x), a.shape[1]), dtype=np.float32)
        whole[rows] = a
        return x.T @ whole, b

    left = np.arange(len(texts)) % 5 == 0
    w, b = fit(~left)
    right = ((x[left] @ w + b) * y[left] > 0).mean(axis=0)
    weight = np.log((right * left.sum() + 1) / ((1 - right) * left.sum() + 1))
    w, b = fit(np.ones(len(texts), dtype=bool))
    weight = np.maximum(weight, 0.05)
    return {"names": names, "w": w, "b": b, "code": code, "weight": weight / weight.sum()}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best codeword, its share of the softmax over losses, and the gap to the next."""
    margin = (x @ model["w"] + model["b"])[:, None, :] * model["code"][None]
    loss = (np.logaddexp(0, -margin) * model["weight"]).sum(axis=2) * len(model["weight"])
    p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    two = np.sort(p, axis=1)[:, -2:]
    return p.argmax(axis=1), two[:, 1], two[:, 1] - two[:, 0]


def sample(docs: DataFrame, held_out: Column) -> tuple[list[str], list[str]]:
    """Texts and languages of a bounded sample of the rows to learn from."""
    told = F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out & (F.length("text") <= SAMPLE_CHARS)
    rows = docs.select("doc_id", "text", "lang").where(told)
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    sizes = {r[0]: r[1] for r in counts.collect()}  # LANGUAGES small rows at most
    if not sizes:
        return [], []
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1e6
    each = min(PER_LANGUAGE, SAMPLE_ROWS // len(sizes))
    shares = F.create_map(*(x for v, n in sizes.items() for x in (F.lit(v), F.lit(each / n))))
    got = rows.where(draw < F.element_at(shares, F.col("lang"))).select("lang", "text").distinct()
    got = got.orderBy(F.xxhash64("text", "lang")).limit(min(2 * each * len(sizes), SAMPLE_ROWS)).toPandas()
    got = got.sort_values(["text", "lang"])
    return got["text"].tolist(), got["lang"].tolist()


def predict(model: dict, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """The language, its score and whether it is in doubt, of each text."""
    out = [("und", 0.0, False)] * len(texts)
    read = [i for i, t in enumerate(texts) if t and model["names"] and _LETTER.search(t)]
    if len(model["names"]) == 1:
        for i in read:
            out[i] = (model["names"][0], 1.0, False)
        return out
    for k in range(0, len(read), ROWS):
        part = read[k : k + ROWS]
        for i, at, p, gap in zip(part, *decode(model, np.stack([features(texts[i]) for i in part])), strict=True):
            out[i] = (model["names"][at], float(p), bool(gap < AMBIGUOUS))
    return out


def identify(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The kept columns with lang_pred, score and ambiguous, for each document row."""
    model = train(*sample(docs, in_fold(F.col("doc_id"), 5, 0)))
    schema = docs.select(*keep).schema
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            found = predict(model, batch.column(batch.num_columns - 1).to_pylist())
            lang, score, unsure = zip(*found, strict=True) if found else ((), (), ())
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *made], names=[*names, "lang_pred", "score", "ambiguous"]
            )

    for extra in ("lang_pred string", "score double", "ambiguous boolean"):
        schema = schema.add(*extra.split())
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is found beyond doubt, with all their columns."""
    found = identify(docs, [row_key(F.col("doc_id"), F.col("text")).alias("drop_key")])
    gone = found.where((F.col("lang_pred") == "und") | F.col("ambiguous"))
    return without(docs, row_key(F.col("doc_id"), F.col("text")), gone)


def op7_output_code_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, [F.col("doc_id"), in_fold(F.col("doc_id"), 5, 0).alias("held_out")])
