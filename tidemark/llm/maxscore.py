"""Ranked lexical search with MaxScore in shards.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased. One pass over the
texts gives a forward index: for each document its number of terms and its counts of the items' terms. Corpus counts
(documents, terms, documents of a term) come from all of it. Documents are dealt into shards of about
`SHARD_POSTINGS` counts; a shard turns its part into posting lists sorted by document, and knows the greatest score
that each list can give.

An item's lists are taken from the greatest bound down. As long as the bounds of the lists still to come add up to
the least score of the best `k` so far, a document met for the first time could still qualify: those lists are
essential, all their postings are added. The others are non-essential: they are probed by binary search, only for
documents whose score and remaining bounds still reach that least score. Each shard gives `k` rows an item, and the
best of all shards are ranked. No list is cut and no candidate dropped that could enter, ties included.

Items are taken in blocks of about `BLOCK_BYTES` of text, whose terms go to all executors; each block reads the
documents once. Nulls and edges: a null text has no terms; a document without terms counts in nothing and is never
found; an item without terms, or none of them in a document, gives no row; each item row is ranked on its own, items
of equal id too; documents of equal id are different documents; null doc_ids come after all others among equal scores;
terms in every document may weigh nothing; only id and text columns are read, others may have any name.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

K = 10
#: Bytes of item texts whose terms are held by each task at once.
BLOCK_BYTES = 4 << 20
#: Counts (document, term) of a shard: its arrays take some 60 bytes for each.
SHARD_POSTINGS = 2_000_000

#: Bytes of UTF-8: separators become spaces, A-Z lower-case; bytes of other characters stay.
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(65, 91))
_TABLE = bytes.maketrans(_SEPARATORS + _UPPER, b" " * len(_SEPARATORS) + _UPPER.lower())


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms of the whole text), and the ids and counts of its terms that are in the vocabulary."""

    def count(batches):
        for batch in batches:
            n, ids, counts = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = terms_of(text.as_buffer().to_pybytes() if text.is_valid else b"")
                held = [(vocabulary[t], c) for t, c in Counter(found).items() if t in vocabulary]
                n.append(len(found))
                ids.append([i for i, _ in held])
                counts.append([c for _, c in held])
            made = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n", "ids", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage(rows.mapInArrow(count, "doc_id long, n long, ids array<int>, counts array<long>"), "forward")


def weights(n_docs: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequency], dtype=np.int64)


def impacts(counts: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a unit of weight gives for a count in a document of n terms."""
    wide = len(n) and 90 * int(n.max()) * n_docs >= 1 << 63
    m = 10 + (90 * (n.astype(object) if wide else n) * n_docs) // n_terms
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m.astype(np.int64))


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score; 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


class Shard:
    """Posting lists of some documents, sorted by term and document, with the greatest impact of each list."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.argsort(terms, kind="stable")
        self.docs, self.impact, self.n_docs = docs[order], impact[order], n_docs
        held, start = np.unique(terms[order], return_index=True)
        self.at = {int(t): (int(a), int(b)) for t, a, b in zip(held, start, [*start[1:], len(order)], strict=True)}
        self.most = dict(zip(map(int, held), np.maximum.reduceat(self.impact, start).tolist() if len(start) else [], strict=True))

    def best(self, weighed: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (and scores) among which are all that can be in the k best; weighed: (term, weight)."""
        lists = sorted(((w * self.most[t], w, *self.at[t]) for t, w in weighed if w > 0 and t in self.at), reverse=True)
        rest = np.append(np.cumsum([x[0] for x in reversed(lists)], dtype=np.int64)[::-1], 0)
        score, least, i = np.zeros(self.n_docs, dtype=np.int64), 0, 0
        while i < len(lists) and (least == 0 or rest[i] >= least):  # essential
            _, w, a, b = lists[i]
            score[self.docs[a:b]] += w * self.impact[a:b]
            least, i = kth(score, k), i + 1
        able = np.flatnonzero((score > 0) & (score + rest[i] >= least))
        for j in range(i, len(lists)):  # non-essential
            _, w, a, b = lists[j]
            own = self.docs[a:b]
            place = np.minimum(np.searchsorted(own, able), b - a - 1)
            met = own[place] == able
            score[able[met]] += w * self.impact[a + place[met]]
            least = max(least, kth(score[able], k))
            able = able[score[able] + rest[j + 1] >= least]
        return able, score[able]


def _ranked(index: DataFrame, items: list, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """place, item_id, doc_id, score: the k best of each shard for each item (place, item_id, its terms)."""
    shards = max(1, math.ceil((index.agg(F.sum(F.size("ids"))).first()[0] or 0) / SHARD_POSTINGS))

    def search(table: pa.Table) -> pa.Table:
        ids, counts = (table.column(c).combine_chunks() for c in ("ids", "counts"))
        held = np.repeat(np.arange(len(table)), np.diff(ids.offsets.to_numpy()))
        n = table.column("n").to_numpy()
        impact = impacts(counts.flatten().to_numpy(), n[held], n_docs, n_terms)
        shard = Shard(ids.flatten().to_numpy(), held, impact, len(table))
        doc_ids = table.column("doc_id").to_pylist()
        # Nulls after all others, as in the ranking of all shards.
        order = np.empty(len(doc_ids), dtype=np.int64)
        order[sorted(range(len(doc_ids)), key=lambda x: (doc_ids[x] is None, doc_ids[x] or 0))] = np.arange(len(doc_ids))
        out = []
        for place, item_id, own in items:
            found, score = shard.best([(t, int(weight[t])) for t in own], k)
            for x in np.lexsort((order[found], -score))[:k]:
                out.append((place, item_id, doc_ids[found[x]], int(score[x])))
        names = ["place", "item_id", "doc_id", "score"]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=names)

    def one(batches):
        if held := list(batches):
            yield from search(pa.Table.from_batches(held)).to_batches()

    # Rows of one staged table have places of their own; by them even equal rows are dealt to all shards alike. A shard
    # is a task, so that none holds two.
    dealt = index.where(F.size("ids") > 0).withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    return dealt.repartitionById(shards, F.col("shard")).mapInArrow(one, "place long, item_id long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item row."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = stage(asked.withColumn("place", F.monotonically_increasing_id()), "items")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    found = None
    for b in range(blocks):
        vocabulary, block = {}, []
        for x in asked.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == b).collect():  # block_bytes, about
            own = sorted(set(terms_of(x.text.encode())))
            block.append((x.place, x.item_id, [vocabulary.setdefault(t, len(vocabulary)) for t in own]))
        index = forward_index(docs, vocabulary)
        counts = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        frequency = np.zeros(len(vocabulary), dtype=np.int64)
        for x in index.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # the block's terms
            frequency[x["t"]] = x["count"]
        part = stage(_ranked(index, block, weights(counts[0], frequency), counts[0], counts[1] or 1, k), "best")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_maxscore_search(spark, sf_dir: str) -> DataFrame:
    return rank(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS uid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS place, list_distinct(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS w FROM benchmark),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
q AS (SELECT item_id, place, unnest(w) AS term FROM b),
f AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY uid, term),
g AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM f, c GROUP BY term, n_docs),
m AS (SELECT uid, doc_id, 100 - 90 + ((90 * len(w) * n_docs) // n_terms) AS m FROM d, c),
s AS (SELECT item_id, place, doc_id, uid, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN g USING (term) JOIN f USING (term) JOIN m USING (uid) GROUP BY item_id, place, doc_id, uid)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 10
"""
