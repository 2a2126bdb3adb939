"""Sharding by a hierarchical weighted hash tree (law: key).

A document goes down a tree of regions, racks and shards. At each level every child of the node it has reached draws
for it: exponential with the child's weight as its rate, from a hash of the document's id and the child's name; the
least draw wins. A node's weight is the sum of its shards' weights, so shards get documents by weight. Draws of
different nodes are independent, and only those on the path are made: regions, then the racks of one region, then the
shards of one rack.

A changed weight changes the draws of its shard, rack and region only: documents move between that region and others,
between that rack and others of the region, and between that shard and others of the rack, nowhere else. One more
shard comes as a region of its own (`grown`), so it takes documents only into itself.

Nulls and edges: null text has no bytes (size 1, checksum of nothing); null ids are one key and so one shard, spread
over its slots by their texts; equal rows get neighbouring slots; a child of weight 0 gets nothing; other columns are
not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_number, maybe_broadcast, stage, text_key

SEED = "tree-1"
#: Rows of one numbering group, beyond which groups are 16 times as many.
GROUP_ROWS = 4_000_000


def tree(n_shards: int, racks: int = 2, regions: int = 4, weights: dict[int, float] | None = None) -> list:
    """Regions of racks of (shard, weight): `racks` shards a rack, `regions` shards a region."""
    leaves = [(i, float((weights or {}).get(i, 1.0))) for i in range(n_shards)]
    split = lambda xs, k: [xs[i : i + k] for i in range(0, len(xs), k)]
    return [split(region, racks) for region in split(leaves, regions)]


def grown(t: list, weight: float = 1.0) -> list:
    """The tree with one more shard, in a region of its own."""
    return [*t, [[(1 + max((s for region in t for rack in region for s, _ in rack), default=-1), weight)]]]


def _uniform(digest: Column) -> Column:
    return (hex_number(digest, 13) + 0.5) / float(1 << 52)


def _winner(key: Column, children: Column) -> Column:
    """The place of the child of least draw; children is an array of (at, name, weight)."""

    def draw(child: Column) -> Column:
        u = _uniform(F.md5(F.concat(key, F.lit("|"), child["name"])))
        return F.when(child["weight"] > 0, F.struct((-F.ln(u) / child["weight"]).alias("draw"), child["at"].alias("at")))

    return F.array_min(F.array_compact(F.transform(children, draw)))["at"]


def _children(nodes: list[tuple[str, float]]) -> Column:
    """Literals (at, name, weight) of a node's children."""
    one = lambda i, name, w: F.struct(F.lit(i).alias("at"), F.lit(name).alias("name"), F.lit(w).alias("weight"))
    return F.array(*(one(i, name, w) for i, (name, w) in enumerate(nodes)))


def with_shards(df: DataFrame, key: Column, outs: dict[str, list]) -> DataFrame:
    """Adds for each name the shard that its tree gives the key."""
    weight = lambda node: sum(map(weight, node)) if isinstance(node, list) else node[1]
    for name, t in outs.items():
        at = lambda *path: "/".join(map(str, path))
        regions = _children([(at("region", i), weight(region)) for i, region in enumerate(t)])
        racks = F.array(*(
            _children([(at("rack", i, j), weight(rack)) for j, rack in enumerate(region)]) for i, region in enumerate(t)
        ))
        shards = F.array(*(
            F.array(*(_children([(at("shard", s), w) for s, w in rack]) for rack in region)) for region in t
        ))
        names = F.array(*(F.array(*(F.array(*(F.lit(s) for s, _ in rack)) for rack in region)) for region in t))
        region, rack = F.col("__region"), F.col("__rack")
        df = df.withColumn("__region", _winner(key, regions))
        df = df.withColumn("__rack", _winner(key, F.get(racks, region)))
        df = df.withColumn("__shard", _winner(key, F.get(F.get(shards, region), rack)))
        df = df.withColumn(name, F.get(F.get(F.get(names, region), rack), F.col("__shard")))
    return df.drop("__region", "__rack", "__shard")


def numbered(df: DataFrame, part: str, order: Column, ties: list[str]) -> DataFrame:
    """Adds slot, gapless from 0 in each part: groups of a part by the order's first digits, then within a group."""
    base = stage(df.withColumn("__order", order), "numbering")
    digits = 2 + max(0, math.ceil(math.log(max(1.0, base.count() / 256 / GROUP_ROWS), 16)))
    base = base.withColumn("__group", F.substring("__order", 1, digits))
    counts = base.groupBy(part, "__group").agg(F.count("*").alias("__rows"))
    along = Window.partitionBy(part).orderBy("__group").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("__rows").over(along) - F.col("__rows")
    starts = counts.select(F.col(part).alias("__part"), F.col("__group").alias("__at"), before.alias("__start"))
    starts = stage(starts, "starts")
    within = F.row_number().over(Window.partitionBy(part, "__group").orderBy("__order", *ties)) - 1
    same = (F.col(part) == F.col("__part")) & (F.col("__group") == F.col("__at"))
    held = base.withColumn("__within", within).join(maybe_broadcast(starts, 48), same)
    held = held.withColumn("slot", (F.col("__start") + F.col("__within")).cast("long"))
    return held.drop("__order", "__group", "__rows", "__part", "__at", "__start", "__within")


def shard(docs: DataFrame, n_shards: int = 16, weights: dict[int, float] | None = None) -> DataFrame:
    """A row for each document row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    t = tree(n_shards, weights=weights)
    text = F.coalesce("text", F.lit(""))
    df = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("__key"),
        text_key(F.col("text")).alias("__text"),
    )
    df = with_shards(df, F.col("__key"), {"shard": t, "grown_shard": grown(t)})
    order = F.md5(F.concat_ws("|", "__key", F.lit("slot"), "__text"))
    df = numbered(df, "shard", order, ["doc_id", "size"]).withColumn("law", F.lit("key"))
    return df.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_hash_tree_shards(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle_tree(t: list, name: str) -> str:
    """CTEs that give each key its shard in the tree: the nodes as a table, then one draw a level."""
    weight = lambda node: sum(map(weight, node)) if isinstance(node, list) else node[1]
    regions = [f"('region/{i}', {i}, {weight(r)})" for i, r in enumerate(t)]
    racks = [f"('rack/{i}/{j}', {i}, {j}, {weight(k)})" for i, r in enumerate(t) for j, k in enumerate(r)]
    shards = [f"('shard/{s}', {i}, {j}, {s}, {w})" for i, r in enumerate(t) for j, k in enumerate(r) for s, w in k]
    draw = f"-ln((CAST('0x' || substr(md5(key || '|' || name), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)}) / weight"
    return f"""
{name}1 AS (SELECT key, arg_min(nth, {draw}) AS region FROM k, (VALUES {", ".join(regions)}) AS x(name, nth, weight) GROUP BY key),
{name}2 AS (SELECT key, region, arg_min(nth, {draw}) AS rack FROM {name}1 JOIN (VALUES {", ".join(racks)}) AS x(name, region, nth, weight) USING (region) GROUP BY key, region),
{name} AS (SELECT key, CAST(arg_min(nth, {draw}) AS INTEGER) AS {name} FROM {name}2 JOIN (VALUES {", ".join(shards)}) AS x(name, region, rack, nth, weight) USING (region, rack) GROUP BY key)"""


#: The checksum is that of the reflected polynomial EDB88320, a table look-up for each byte of the text.
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, '{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, coalesce(md5(text), 'null') AS tk FROM documents),
k AS (SELECT DISTINCT key FROM d),
{_oracle_tree(tree(16), "shard")},
{_oracle_tree(grown(tree(16)), "grown_shard")},
b AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, _: {_STEP.format("c")}) AS v FROM range(0, 256) AS r(i))),
c AS (SELECT DISTINCT text, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(text)), '..')]), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM (SELECT DISTINCT text FROM d), b)
SELECT doc_id, CAST(strlen(d.text) + 1 AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(key || '|slot|' || tk), doc_id, strlen(d.text)) - 1 AS BIGINT) AS slot, grown_shard
FROM d JOIN shard USING (key) JOIN grown_shard USING (key) JOIN c USING (text)
"""
