"""Hard negatives by a vector-approximation file.

Each dimension is cut into at most `CELLS` cells of about equally many rows; a vector's approximation is one byte a
dimension. For an anchor, each cell of a dimension has a least and a greatest product with the anchor's component, so
two table lookups a dimension give a lower and an upper bound of a score. Only rows whose bounds say that they may
enter are scored exactly:

* positives: rows of the anchor's label whose upper bound reaches the k-th largest lower bound;
* negatives of a positive: rows of other labels whose bounds meet the positive's score window and whose upper bound
  reaches the k-th largest lower bound among the rows that are surely inside it.

The anchors are a stated query set against all rows. Both are dealt into blocks; a task holds one block of rows and
one of anchors, gives the best of its block, and the best of all blocks are ranked. All rows are in the file; nothing
is sampled but the marks between cells, which change the work and not the result.

Nulls and edges: rows with a null label or vector, or a null or non-finite component, take no part; a shorter vector
counts as ended by zeros; a null vec_id is no anchor and comes after all others among equal scores; rows of equal
vec_id are different rows; a component or score beyond a long counts as the greatest there is; an empty table gives
no rows; only vec_id, label and embedding are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

CELLS = 64
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's, both ends included.
LOW, HIGH = 30, 90
ROW_BLOCK, ANCHOR_BLOCK = 8192, 4096
#: Anchors whose tables of bounds are held at once.
CHUNK = 32
LONG = (1 << 63) - 1


class Cells:
    """The marks between the cells of each dimension; ends[d] is the least and greatest value of dimension d."""

    def __init__(self, marks: list[list[int]], ends: list[tuple[int, int]]):
        self.marks = [np.unique(np.array(m, dtype=np.int64)) for m in marks]
        self.low, self.high = [], []
        for m, (least, most) in zip(self.marks, ends, strict=True):
            self.low.append(np.array([min(least, 0), *m.tolist()], dtype=object))  # zeros end shorter vectors
            self.high.append(np.array([*(m - 1).tolist(), max(most, 0)], dtype=object))
        # The end cells reach the ends; a mark at an end makes an empty cell beside it, which holds no row.
        reach = max((max(-min(e[0], 0), e[1], 0) for e in ends), default=0)
        self.kind = np.int64 if reach * reach * max(1, len(ends)) < 1 << 62 else object

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(m, vectors[:, d], side="right") for d, m in enumerate(self.marks)], axis=1).astype(np.uint8) if len(vectors) else np.zeros((0, len(self.marks)), np.uint8)

    def bounds(self, anchors: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (anchor, row) of the scores, by table lookup."""
        low = np.zeros((len(anchors), len(codes)), dtype=self.kind)
        high = low.copy()
        for d in range(len(self.marks)):
            own = anchors[:, d : d + 1].astype(self.kind)
            x, y = own * self.low[d].astype(self.kind), own * self.high[d].astype(self.kind)
            low += np.minimum(x, y)[:, codes[:, d]]
            high += np.maximum(x, y)[:, codes[:, d]]
        return low, high


def kth(x: np.ndarray, k: int):
    """The k-th largest, or None if there are fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else None


def may_be_positive(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    least = kth(low, k)
    return np.arange(len(high)) if least is None else np.flatnonzero(high >= least)


def may_be_negative(low: np.ndarray, high: np.ndarray, window: tuple[int, int], k: int) -> np.ndarray:
    sure = (low >= window[0]) & (high <= window[1])
    least = kth(low[sure], k)
    return np.flatnonzero((high >= (window[0] if least is None else max(window[0], least))) & (low <= window[1]))


def windows_of(score: int) -> tuple[int, int]:
    """The whole scores n with LOW * score <= 100 * n <= HIGH * score."""
    return -(-LOW * score // 100), HIGH * score // 100


def _matrix(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _cells(rows: DataFrame) -> tuple[Cells, int]:
    """Cells from all rows' values (one group a dimension), and the number of dimensions."""
    each = rows.select(F.posexplode("q").alias("d", "x")).groupBy("d")
    share = F.array(*(F.lit(i / CELLS) for i in range(1, CELLS)))
    held = {x["d"]: x for x in each.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.percentile_approx("x", share, 1000).alias("m")).collect()}
    width = max(held, default=-1) + 1
    return Cells([held[d]["m"] for d in range(width)], [(held[d]["a"], held[d]["b"]) for d in range(width)]), width


def approximate(rows: DataFrame, cells: Cells, width: int) -> DataFrame:
    """The file: vec_id, label, anchor, codes and vector (both as bytes) of rows (vec_id, label, anchor, q)."""

    def quantise(batches):
        for batch in batches:
            q = batch.column(3)
            size = np.diff(q.offsets.to_numpy())
            x = np.zeros((len(batch), width), dtype=np.int64)
            x[np.arange(width) < size[:, None]] = q.flatten().to_numpy()
            codes = cells.codes(x)
            made = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (codes, x)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["vec_id", "label", "anchor", "codes", "vector"])

    return stage(rows.select("vec_id", "label", "anchor", "q").mapInArrow(quantise, "vec_id long, label long, anchor boolean, codes binary, vector binary"), "va_file")


class Block:
    """One block of rows and one of anchors, as arrays."""

    def __init__(self, table: pa.Table, cells: Cells, width: int):
        self.cells, self.is_anchor = cells, np.array(table.column("side").to_pylist(), dtype=np.int64) == 0
        self.uid, self.label = table.column("uid").to_numpy(), table.column("label").to_numpy()
        self.vec_id = table.column("vec_id").to_pylist()
        self.codes, self.vector = _matrix(table.column("codes"), "u1", width), _matrix(table.column("vector"), "<i8", width)
        self.told = table.column("told").to_pylist()

    def meetings(self, same: bool):
        """(anchor, rows, low, high) of the anchors and the rows of the same label, or of others."""
        for label in np.unique(self.label[self.is_anchor]):
            of, rows = np.flatnonzero(self.is_anchor & (self.label == label)), np.flatnonzero(~self.is_anchor & ((self.label == label) == same))
            for i in range(0, len(of), CHUNK):
                low, high = self.cells.bounds(self.vector[of[i : i + CHUNK]], self.codes[rows])
                for j, a in enumerate(of[i : i + CHUNK].tolist()):
                    yield a, rows, low[j], high[j]

    def scores(self, anchor: int, rows: np.ndarray) -> np.ndarray:
        found = self.vector[rows].astype(self.cells.kind) @ self.vector[anchor].astype(self.cells.kind)
        return found if self.cells.kind is np.int64 else np.clip(found, -LONG, LONG)

    def first(self, rows: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (row, score): highest first, ties by vec_id, nulls last."""
        if len(rows) > k:
            keep = score >= kth(score, k)
            rows, score = rows[keep], score[keep]
        order = sorted(zip(rows.tolist(), score.tolist(), strict=True), key=lambda x: (-x[1], self.vec_id[x[0]] is None, self.vec_id[x[0]] or 0))
        return order[:k]


def _table(out: list, names: list[str]) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names=names)


def _positives(cells: Cells, width: int):
    names = ["anchor_uid", "anchor_id", "positive_id", "score"]

    def search(table: pa.Table) -> pa.Table:
        block, out = Block(table, cells, width), []
        for a, rows, low, high in block.meetings(same=True):
            other = block.uid[rows] != block.uid[a]
            rows = rows[other]
            rows = rows[may_be_positive(low[other], high[other], POSITIVES)]
            out += [(block.uid[a], block.vec_id[a], block.vec_id[r], int(s)) for r, s in block.first(rows, block.scores(a, rows), POSITIVES)]
        return _table(out, names)

    return search, ", ".join(f"{n} long" for n in names)


def _negatives(cells: Cells, width: int):
    names = ["anchor_uid", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]

    def search(table: pa.Table) -> pa.Table:
        block, out = Block(table, cells, width), []
        for a, rows, low, high in block.meetings(same=False):
            asked = [(x, *windows_of(x["score"])) for x in block.told[a] or []]
            able = [may_be_negative(low, high, (x[1], x[2]), NEGATIVES) for x in asked]
            if not able:
                continue
            once = np.unique(np.concatenate(able))
            score = block.scores(a, rows[once])
            for x, least, most in asked:
                inside = (score >= least) & (score <= most)
                for r, s in block.first(rows[once[inside]], score[inside], NEGATIVES):
                    out.append((block.uid[a], block.vec_id[a], x["place"], x["positive_id"], x["score"], block.vec_id[r], int(s)))
        return _table(out, names)

    return search, ", ".join(f"{n} long" for n in names)


def _met(file: DataFrame, anchors: DataFrame, blocks: tuple[int, int], search) -> DataFrame:
    """Each block of rows with each block of anchors, by the search."""
    row_blocks, anchor_blocks = blocks
    dealt = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keep = ["uid", "vec_id", "label", "codes", "vector", "told"]
    left = anchors.select(*keep, F.lit(0).alias("side"), dealt(anchor_blocks).alias("y"), every(row_blocks).alias("x"))
    right = file.withColumn("told", F.lit(None).cast(anchors.schema["told"].dataType))
    right = right.select(*keep, F.lit(1).alias("side"), dealt(row_blocks).alias("x"), every(anchor_blocks).alias("y"))
    return left.unionByName(right).groupBy("x", "y").applyInArrow(*search)


def mine(rows: DataFrame) -> DataFrame:
    """Hard negatives of rows (vec_id, label, anchor, q): a row for each anchor, positive and rank."""
    rows = stage(rows, "vectors")
    cells, width = _cells(rows)
    file = approximate(rows, cells, width).withColumn("uid", F.monotonically_increasing_id())
    n = file.agg(F.count("*"), F.count_if("anchor")).first()
    blocks = (max(1, math.ceil(n[0] / ROW_BLOCK)), max(1, math.ceil(n[1] / ANCHOR_BLOCK)))
    asked = file.where("anchor").drop("anchor")

    untold = F.lit(None).cast("array<struct<place:int,positive_id:bigint,score:bigint>>")
    found = _met(file, asked.withColumn("told", untold), blocks, _positives(cells, width))
    best = Window.partitionBy("anchor_uid").orderBy(F.col("score").desc(), F.col("positive_id").asc_nulls_last())
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= POSITIVES)
    told = stage(found.groupBy("anchor_uid").agg(F.collect_list(F.struct("place", "positive_id", "score")).alias("told")), "positives")

    asked = stage(asked.join(told, asked["uid"] == told["anchor_uid"]).drop("anchor_uid"), "windows")
    found = _met(file, asked, blocks, _negatives(cells, width))
    best = Window.partitionBy("anchor_uid", "place").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEGATIVES)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label (long) and q, the components as whole numbers, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long"))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))


def op11_va_file_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)).alias("anchor"), "q"))


ORACLE = """
WITH r AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid AS auid, a.vec_id AS anchor_id, a.label AS alabel, r.vec_id, r.label, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score FROM r AS a, r WHERE a.vec_id % 100 = 0 AND a.uid <> r.uid),
p AS (SELECT auid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY auid ORDER BY score DESC, vec_id) AS k FROM s WHERE label = alabel QUALIFY k <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.auid, k ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (auid) WHERE label <> alabel AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
