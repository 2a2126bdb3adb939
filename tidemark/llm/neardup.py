"""Near-duplicate documents by an LSH forest.

Each text is its set of distinct 5-word shingles; equal sets are one node. A node has a signature of 128 minhash
values, 8 for each of 16 trees. A tree is an order: the nodes sorted by its 8 values. Nodes with a common prefix of
`BASE_DEPTH` values are a region of the tree; a pair of similarity 0.85 meets in some region but for a chance of 7e-6.
Within a region the depth follows its density. Rows come in the tree's order, and the common prefix length of each
with the row before it tells where the region splits:

* a region, or a part of one, of at most `LEAF` nodes is a leaf: its pairs are candidates at the depth it has. A
  denser one is split by its next value, down to the last, so that the longest common prefixes come first;
* then the search steps to shorter prefixes: what two parts of a node of the tree may still link is a candidate there,
  unless it is connected already, up to the region's own prefix. So depth orders the work and saves none of the pairs
  that the recall bound needs;
* a region of at most `SPARSE` nodes gives its pairs for confirmation elsewhere; a larger one is solved in its own task
  on the full sets of its nodes, and gives a spanning forest of true links instead of all pairs;
* one of more than `HOT` nodes or `RUN_BYTES` of text is dealt into runs within these bounds. Each run is solved in its
  own task, and each node is held against the region's leader, the node whose signature agrees best with the values
  most common there. Then the nodes outside the region's largest component meet all its nodes, run against run, so
  that each pair that agrees often enough is confirmed on the full sets or connected already; components are
  contracted between groups of trees, so that later trees have little left to do. A task holds two runs at most.

A candidate is a pair whose signatures agree in `LEAST_AGREE` values, 4.5 standard deviations below the threshold.
Links are only ever made on full sets. Components come from alternating star contractions on the links.

Nulls and edges: a text without words is linked with nothing; with fewer than 5 words its word sequence is its only
shingle; rows with null doc_id take part, their component has the least doc_id that there is, or null; a row whose
component is null is kept; equal rows get equal results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, row_key, stage, text_key, without
from .shingles import Shingler, mix

TREES, DEPTH, BASE_DEPTH = 16, 8, 4
SLOTS = TREES * DEPTH
SPARSE = 16
LEAF = 64
HOT = 4096
#: Text of a run, in bytes; one longer text is a run of its own.
RUN_BYTES = 16 << 20
#: Trees whose runs meet together, before components are contracted again.
ROUNDS = ((0,), (1, 2, 3), tuple(range(4, TREES)))
LEAST_AGREE = 90  # of 128 values
NUM, DEN = 85, 100  # a link: DEN * intersection >= NUM * union
SEED = 20240501
#: Texts that a task cuts into shingles at once, in bytes.
CHUNK = 4 << 20

_SIGNED = "doc_id long, n_shingles long, fp binary, tkey string, sig binary, bytes long"


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


class Signer:
    def __init__(self):
        r = np.random.default_rng(SEED)
        self.a = (r.integers(1, 1 << 63, (SLOTS, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = r.integers(0, 1 << 63, (SLOTS, 1), dtype=np.uint64)

    def signature(self, s: np.ndarray) -> bytes:
        least = None
        for i in range(0, len(s), 2048):
            m = (self.a * s[i : i + 2048] + self.b).min(axis=1)
            least = m if least is None else np.minimum(least, m)
        return ((least >> np.uint64(20)) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def _fingerprint(s: np.ndarray) -> bytes:
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], dtype=np.uint64).tobytes()


def _chunks(texts: list, limit: int = CHUNK):
    """Runs of indices whose texts are within the limit together, or one longer text."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(t)
    if run:
        yield run


def _sign(batches):
    shingler, signer = Shingler(), Signer()
    for batch in batches:
        ids, keys, texts = batch.column(0), batch.column(1), [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(2).cast(pa.binary())]
        n, fps, sigs = [], [], []
        for run in _chunks(texts):
            for s in shingler.sets([texts[i] for i in run]):
                n.append(len(s))
                fps.append(_fingerprint(s) if len(s) else None)
                sigs.append(signer.signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(fps, pa.binary()), keys, pa.array(sigs, pa.binary()), pa.array(map(len, texts), pa.int64())], names=["doc_id", "n_shingles", "fp", "tkey", "sig", "bytes"])


def _groups(batches, key: int = 0):
    """Rows of sorted batches by the value of one column, as lists of tuples; a group may cross batches."""
    held, at = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[key] != at:
                yield at, held
                held = []
            at = row[key]
            held.append(row)
    if held:
        yield at, held


def _emit(rows: list, names: list[str], types: list):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _sparse_pairs(batches):
    """Rows (region, fp, sig) -> pairs whose signatures agree often enough."""
    out = []
    for _, rows in _groups(batches):
        sig = np.frombuffer(b"".join(r[2] for r in rows), dtype=">u2").reshape(len(rows), SLOTS)
        for i in range(len(rows) - 1):
            for j in np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= LEAST_AGREE) + i + 1:
                out.append(tuple(sorted((rows[i][1], rows[j][1]))))
        if len(out) > 20_000:
            yield _emit(out, ["a", "b"], [pa.binary()] * 2)
            out = []
    if out:
        yield _emit(out, ["a", "b"], [pa.binary()] * 2)


class Forest:
    """Union-find over indices."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def common_prefixes(order: np.ndarray) -> np.ndarray:
    """How many leading values each row of a sorted order shares with the row before it; 0 for the first."""
    same = np.zeros(len(order), dtype=np.int64)
    same[1:] = np.cumprod(order[1:] == order[:-1], axis=1).sum(axis=1)
    return same


def parts(prefix: np.ndarray, lo: int, hi: int, depth: int) -> list[tuple[int, int]]:
    """Where rows lo to hi, alike in `depth` values, split by the next value."""
    cuts = [lo, *(np.flatnonzero(prefix[lo + 1 : hi] <= depth) + lo + 1).tolist(), hi]
    return list(zip(cuts, cuts[1:], strict=False))


def visits(prefix: np.ndarray, lo: int, hi: int, depth: int, leaf: int = LEAF):
    """(depth, lo, hi, parts) of a region's nodes in the tree, children before their parents; a leaf is one part."""
    inner = [] if hi - lo <= leaf or depth >= DEPTH else parts(prefix, lo, hi, depth)
    for a, b in inner:
        yield from visits(prefix, a, b, depth + 1, leaf)
    yield depth, lo, hi, inner


def solve(fps: list[bytes], sig: np.ndarray, sets: list[np.ndarray], tree: int):
    """A spanning forest of the true links among a region's nodes, which are in the tree's order."""
    n, forest = len(fps), Forest(len(fps))
    common = np.array([np.bincount(sig[:, k]).argmax() for k in range(SLOTS)])
    leader = int((sig == common).sum(axis=1).argmax())

    def confirm(i: int, j: int):
        if forest.top(i) != forest.top(j) and linked(sets[i], sets[j]):
            forest.join(i, j)
            return fps[i], fps[j]
        return None

    def among(i: int, lo: int, hi: int):
        agree = (sig[lo:hi] == sig[i]).sum(axis=1)
        near = np.flatnonzero(agree >= LEAST_AGREE)
        for j in (near[np.argsort(-agree[near], kind="stable")] + lo).tolist():
            if link := confirm(i, j):
                yield link

    for j in range(n):
        if j != leader and (link := confirm(leader, j)):
            yield link
    prefix = common_prefixes(sig[:, tree * DEPTH : (tree + 1) * DEPTH])
    for _, lo, hi, inner in visits(prefix, 0, n, BASE_DEPTH):
        if not inner:
            for i in range(lo, hi - 1):
                yield from among(i, i + 1, hi)
        for a, b in inner[:-1]:
            for i in range(a, b):
                yield from among(i, b, hi)


def _dense_links(batches):
    """Rows (region, sig, fp, text, tree), in each tree's order -> true links; a region is within a run's bounds."""
    shingler, out, tops = Shingler(), [], [pa.binary()] * 2
    for _, rows in _groups(batches):
        texts = [(r[3] or "").encode() for r in rows]
        sets = [s for part in _chunks(texts) for s in shingler.sets([texts[k] for k in part])]
        sig = np.frombuffer(b"".join(r[1] for r in rows), dtype=">u2").reshape(len(rows), SLOTS).astype(np.int64)
        out += solve([r[2] for r in rows], sig, sets, rows[0][4])
        if len(out) > 20_000:
            yield _emit(out, ["a", "b"], tops)
            out = []
    if out:
        yield _emit(out, ["a", "b"], tops)


def _cross_links(batches):
    """Rows (meeting, side, sig, fp, label, rest, text), side 0 first -> true links that join labels across the sides."""
    shingler, out, tops = Shingler(), [], [pa.binary()] * 2
    for _, rows in _groups(batches):
        texts = [(r[6] or "").encode() for r in rows]
        sets = [s for part in _chunks(texts) for s in shingler.sets([texts[k] for k in part])]
        sig = np.frombuffer(b"".join(r[2] for r in rows), dtype=">u2").reshape(len(rows), SLOTS).astype(np.uint16)
        number = {}
        mark = [number.setdefault(r[4], len(number)) for r in rows]
        forest, n = Forest(len(number)), sum(r[1] == 0 for r in rows)
        for i in range(n):
            agree = (sig[n:] == sig[i]).sum(axis=1)
            near = np.flatnonzero(agree >= LEAST_AGREE)
            for j in (near[np.argsort(-agree[near], kind="stable")] + n).tolist():
                # Two nodes outside the largest component meet twice.
                once = not rows[j][5] or rows[i][3] < rows[j][3]
                if once and forest.top(mark[i]) != forest.top(mark[j]) and linked(sets[i], sets[j]):
                    forest.join(mark[i], mark[j])
                    out.append((rows[i][3], rows[j][3]))
        if len(out) > 20_000:
            yield _emit(out, ["a", "b"], tops)
            out = []
    if out:
        yield _emit(out, ["a", "b"], tops)


def _confirm(batches):
    """Rows (key, kind, fp, other, text), texts of a key (kind 0) before its pairs (kind 1) -> true links."""
    shingler, out = Shingler(), []
    for _, rows in _groups(batches):
        texts = [(r[2], (r[4] or "").encode()) for r in rows if r[1] == 0]
        sets = dict(zip((f for f, _ in texts), (s for part in _chunks([t for _, t in texts]) for s in shingler.sets([texts[k][1] for k in part])), strict=True))
        out += [(r[2], r[3]) for r in rows if r[1] == 1 and linked(sets[r[2]], sets[r[3]])]
        if len(out) > 20_000:
            yield _emit(out, ["a", "b"], [pa.binary()] * 2)
            out = []
    if out:
        yield _emit(out, ["a", "b"], [pa.binary()] * 2)


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node that has a link."""
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = sign(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lower, "u")
        star = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        edges = stage(star.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = sign(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def _leaders(hot: DataFrame) -> DataFrame:
    """Pairs (key, a, b) of each node of a hot region with the region's leader; rows: base, fp, sig."""

    def common(pdf):
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=">u2").reshape(len(pdf), SLOTS)
        most = np.array([np.bincount(sig[:, k].astype(np.int64)).argmax() for k in range(SLOTS)]).astype(">u2").tobytes()
        return pdf.head(1).assign(common=most)[["base", "common"]]

    def agreement(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=">u2").reshape(-1, SLOTS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).sum(axis=1), pa.int32())], names=["base", "fp", "agree"])

    # The leader only orders the work, so a bounded sample of each region may choose it.
    picked = hot.where(F.xxhash64("fp", F.lit("pick")) % F.greatest(F.lit(1), F.floor(F.col("n") / 1024)) == 0).select("base", "sig")
    most = picked.groupBy("base").applyInPandas(common, "base long, common binary")
    held = hot.select("base", "fp", "sig").join(most, "base").mapInArrow(agreement, "base long, fp binary, agree int")
    held = stage(held, "agreement")
    top = held.groupBy("base").agg(F.max_by("fp", F.struct("agree", "fp")).alias("leader"))
    return held.join(top, "base").where("fp <> leader").select("fp", F.greatest("fp", "leader").alias("b"), F.least("fp", "leader").alias("a")).select(F.xxhash64("fp").alias("key"), "a", "b").distinct()


def runs(rows: DataFrame, most: int, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Adds run: the nodes of each base dealt into runs of about `most` rows and `run_bytes` at most.

    Nodes fall into small buckets by hash; the buckets' running sums of cost give the runs, so that no task reads more
    of a region than its buckets. Cost is in millionths of a run.
    """
    million = 1_000_000
    costed = rows.withColumn("cost", F.ceil(million * F.greatest(F.col("bytes") / run_bytes, F.lit(1 / most))))
    total = costed.groupBy("base").agg(F.ceil(F.sum("cost") / million).alias("least_runs"))
    costed = stage(costed.join(total, "base").withColumn("bucket", F.pmod(F.xxhash64("fp", F.lit("run")), 16 * F.col("least_runs"))), "costed")
    before = F.sum("cost").over(Window.partitionBy("base").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    start = costed.groupBy("base", "bucket").agg(F.sum("cost").alias("cost")).select("base", "bucket", F.floor(F.coalesce(before, F.lit(0)) / million).alias("run"))
    return costed.join(start, ["base", "bucket"]).drop("cost", "least_runs", "bucket")


def _meet(hot: DataFrame, held: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The labels after each candidate pair of the hot regions (base, tree, fp, sig, bytes, run) is linked or ruled out."""
    for trees in ROUNDS:
        at = hot.where(F.col("tree").isin(*trees)).join(labels, F.col("fp") == F.col("node"), "left").select("base", "run", "fp", "sig", "bytes", F.coalesce("label", "fp").alias("label"))
        at = stage(at, "contracted")
        top = at.groupBy("base", "label").agg(F.count("*").alias("c")).groupBy("base").agg(F.max_by("label", F.struct("c", "label")).alias("top"))
        at = stage(at.join(top, "base").withColumn("rest", F.col("label") != F.col("top")).drop("top"), "contracted")
        rest = at.where("rest").drop("run")
        if rest.isEmpty():
            continue
        rest = stage(runs(rest, most), "rest")
        x = rest.select("base", F.col("run").alias("x"), F.lit(0).alias("side"), "sig", "fp", "label", "rest").join(at.select("base", F.col("run").alias("y")).distinct(), "base")
        y = at.select("base", F.col("run").alias("y"), F.lit(1).alias("side"), "sig", "fp", "label", "rest").join(rest.select("base", F.col("run").alias("x")).distinct(), "base")
        both = x.unionByName(y).join(held, "fp").select(F.xxhash64("base", "x", "y").alias("meeting"), "side", "sig", "fp", "label", "rest", "text")
        links = stage(both.repartition("meeting").sortWithinPartitions("meeting", "side", "fp").mapInArrow(_cross_links, "a binary, b binary"), "links")
        if not links.isEmpty():
            labels = components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    return labels


def near_duplicates(docs: DataFrame, hot: int = HOT, sparse: int = SPARSE) -> DataFrame:
    """A row for each document row: doc_id, n_shingles, component_id, kept, and tkey, the key of its text."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, min(int(before), 1000) if int(before) > 0 else 1000)  # texts are long
    try:
        return _near_duplicates(docs, hot, sparse)
    finally:
        conf.set(name, before)


def _near_duplicates(docs: DataFrame, hot: int, sparse: int) -> DataFrame:
    """All that runs in Arrow batches is written before this returns."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))
    signed = stage(texts.mapInArrow(_sign, _SIGNED), "signed")
    nodes = stage(signed.where("fp is not null").groupBy("fp").agg(F.min(F.struct("tkey", "bytes")).alias("least"), F.first("sig").alias("sig")).select("fp", "least.tkey", "sig", "least.bytes"), "nodes")

    part = lambda d: F.substring("sig", F.col("tree") * (2 * DEPTH) + 1, 2 * d)
    entries = nodes.select("fp", "sig", "bytes", F.explode(F.array(*map(F.lit, range(TREES)))).alias("tree"))
    entries = entries.withColumn("base", F.xxhash64("tree", part(BASE_DEPTH)))
    shared = entries.groupBy("base").agg(F.count("*").alias("n"), F.sum("bytes").alias("all")).where("n > 1")
    shared = stage(shared.select("base", "n", ((F.col("n") > sparse) & ((F.col("n") > hot) | (F.col("all") > RUN_BYTES))).alias("hot")), "regions")
    met = stage(entries.join(maybe_broadcast(shared, 25), "base"), "met")

    by_region = lambda df, *order: df.repartition("region").sortWithinPartitions("region", *order)
    few = by_region(met.where(F.col("n") <= sparse).select(F.col("base").alias("region"), "fp", "sig"), "fp")
    pairs = few.mapInArrow(_sparse_pairs, "a binary, b binary").distinct().select(F.xxhash64("a").alias("key"), "a", "b")
    dense = met.where((F.col("n") > sparse) & ~F.col("hot")).select("fp", "sig", "tree", F.col("base").alias("region"))
    dealt = None
    if not shared.where("hot").isEmpty():
        dealt = stage(runs(met.where("hot"), hot), "runs")
        pairs = pairs.unionByName(_leaders(dealt)).distinct()
        dense = dense.unionByName(dealt.select("fp", "sig", "tree", F.xxhash64("base", "run", F.lit("run")).alias("region")))
    pairs = stage(pairs, "pairs")

    # The texts of all nodes that have a candidate, read once more by their keys.
    needed = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).unionByName(dense.select("fp")).distinct()
    wanted = maybe_broadcast(stage(nodes.select("fp", "tkey").join(needed, "fp"), "wanted"), 96)
    held = stage(texts.select("tkey", "text").join(wanted, "tkey").groupBy("fp").agg(F.first("text").alias("text")), "texts")

    in_order = [part(DEPTH), F.col("fp")]
    found = by_region(dense.join(held, "fp").select("region", "sig", "fp", "text", "tree"), *in_order).mapInArrow(_dense_links, "a binary, b binary")
    asked = pairs.select("key", F.col("a").alias("fp")).unionByName(pairs.select("key", F.col("b").alias("fp"))).distinct()
    asked = asked.join(held, "fp").select("key", F.lit(0).alias("kind"), "fp", F.lit(None).cast("binary").alias("other"), "text")
    asked = asked.unionByName(pairs.select("key", F.lit(1).alias("kind"), F.col("a").alias("fp"), F.col("b").alias("other"), F.lit(None).cast("string").alias("text")))
    sure = asked.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(_confirm, "a binary, b binary")
    labels = components(found.unionByName(sure))
    if dealt is not None:
        labels = _meet(dealt, held, labels, hot)

    rows = signed.select("doc_id", "n_shingles", "fp", "tkey").join(labels, F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("label", "fp"))
    rows = stage(rows.select("doc_id", "n_shingles", "label", "tkey"), "labelled")
    least = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("c")).where("c > 1")
    # Written before the join, so that the rows of one large group can be split between tasks or meet a small table.
    least = maybe_broadcast(stage(least, "least"), 48)
    joined = rows.join(least, "label", "left").withColumn("component_id", F.when(F.col("c") > 1, F.col("least_id")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "tkey")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of least doc_id, with all its columns."""
    gone = near_duplicates(docs).where("not kept")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("tkey"))
    return without(docs, row_key(F.col("doc_id"), F.col("text")), gone.select(key.alias("drop_key")))


def op5_lsh_forest_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tkey")
