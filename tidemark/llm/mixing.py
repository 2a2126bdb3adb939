"""Mixing sources to target weights by Sainte-Lague apportionment.

Weights share all words among the sources; a target stops at `MOST` times its source's words and the excess goes to
the others by weight. The mix is a number of equal blocks of words: highest quotients target / (2 j + 1) give each
source its integer quota, and again each shard of a source (documents dealt by a seeded hash) its part of that
quota by the shard's words. In a shard the documents lie in seeded order, end to end; its blocks are taken from the
start of that line, going round again where the quota is more than the shard holds, never past `MOST` rounds. A
source whose blocks are too coarse for it, so that a shard's quota is past that or the source gets none, is
apportioned among its shards word by word instead.

Nulls and edges: null text is of size 0; null source is a source, the last; equal rows are taken alike in sum; an
empty table gives an empty result; other columns are not read and may have any name. Sources are a dimension table: after the first
grouping there is one small row for each, ranked in one task. Shards keep rows of one source apart, so that a
source with a third of all rows is as many tasks as its size needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, packed, stage, text_key, words

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: A block is 1/65536 of all words, 1 at least and BLOCK at most.
BLOCK, BLOCKS = 1024, 65536
#: A source has 16 ** SHARD_DIGITS shards. Its rows lie in order within a shard, one task each: 2 digits are for
#: sources of up to some billion rows, 3 for more. Another number takes other documents, so no input size changes it.
SHARD_DIGITS = 2


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns as k0.., src (a source's key; null has one of its own), size and the seeded draw."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.select(
        *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("none")).alias("src"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(SEED), doc_id, text_key(F.col("text")))).alias("draw"),
    )


def targets(totals: DataFrame, weights=WEIGHTS) -> DataFrame:
    """src, source_size -> with weight, the words of all sources and the target."""
    # '=' sorts before 'n': named sources by code point, null last.
    byname = Window.orderBy("src")
    w = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(byname) - 1) % len(weights) + 1)))
    w = w.withColumn("cap", MOST * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "src").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(everything))
    # With the sources of least ratio at their caps, the rest is shared by weight; the first level that no rest exceeds.
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(everything)["level"])
    share = F.when(F.col("ratio") < F.col("level"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return w.select("src", "source_size", "weight", "total", F.coalesce(share, F.lit(0.0)).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """Adds quota: the group's seats by highest quotients votes / (2 j + 1); ties go to the lower party.

    Only quotients near a party's proportional share can be the last to win a seat, so each party lists those:
    the divisor's error is half a seat for each party of the group, a party's part of that is its share of votes.
    """
    whole = Window.partitionBy(*group)
    df = parties.withColumn("n_parties", F.count("*").over(whole)).withColumn("all_votes", F.sum(F.col(votes).cast("double")).over(whole))
    part = F.when(F.col("all_votes") > 0, F.col(votes) / F.col("all_votes")).otherwise(0.0)
    slack = part * F.col("n_parties") / 2 + 2
    df = df.withColumn("low", F.greatest(F.lit(0).cast("long"), F.floor(part * F.col(seats) - slack))).withColumn("high", F.when(part > 0, F.ceil(part * F.col(seats) + slack)).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("open", F.col(seats) - F.sum("low").over(whole))
    lines = df.select(*group, party, votes, "open", F.explode(F.sequence("low", F.col("high"))).alias("j")).where(F.col(votes) > 0)
    ranked = lines.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.col(votes) / (2 * F.col("j") + 1)), party, "j")))
    won = ranked.where(F.col("rank") <= F.col("open")).groupBy(*group, party).agg(F.count("*").alias("won"))
    return df.join(won, [*group, party], "left").withColumn("quota", F.col("low") + F.coalesce("won", F.lit(0))).drop("n_parties", "all_votes", "low", "high", "open", "won")


def mix(docs: DataFrame, keep: list[str], weights=WEIGHTS, shard_digits: int = SHARD_DIGITS) -> DataFrame:
    """The kept columns with draw, size, source_size, target and taken, for each document row."""
    held = [f"k{i}" for i in range(len(keep))]
    base = stage(sized(docs, keep).withColumn("shard", F.substring("draw", 1, shard_digits)), "sizes")
    shards = stage(base.groupBy("src", "shard").agg(F.sum("size").alias("shard_size")), "shards")
    goal = targets(shards.groupBy("src").agg(F.sum("shard_size").alias("source_size")), weights)
    block = F.greatest(F.lit(1).cast("long"), F.least(F.lit(BLOCK).cast("long"), F.floor(F.col("total") / BLOCKS)))
    goal = goal.withColumn("block", block)
    goal = goal.withColumn("seats", F.floor((2 * F.col("total") + F.col("block")) / (2 * F.col("block"))))
    goal = sainte_lague(goal.withColumn("all", F.lit(0)), ["all"], "src", "target", "seats")
    goal = stage(goal.withColumnRenamed("quota", "source_quota").drop("all", "seats"), "targets")
    per = shards.join(maybe_broadcast(goal, F.octet_length("src") + 96), "src")
    quotas = stage(sainte_lague(per, ["src"], "shard", "shard_size", "source_quota"), "shard_quotas")
    past = F.col("quota") * F.col("block") > MOST * F.col("shard_size")
    coarse = quotas.groupBy("src").agg(F.bool_or(past | (F.col("source_quota") == 0)).alias("coarse"))
    coarse = maybe_broadcast(stage(coarse, "coarse"), F.octet_length("src") + 8)
    fine = stage(quotas.drop("quota").join(coarse, "src").where("coarse").drop("coarse"), "fine")
    fine = fine.withColumn("block", F.lit(1).cast("long")).withColumn("source_quota", F.round("target").cast("long"))
    fine = sainte_lague(fine, ["src"], "shard", "shard_size", "source_quota")
    quotas = quotas.join(coarse, "src").where("not coarse").drop("coarse").unionByName(fine)
    got = F.least(F.col("quota") * F.col("block"), MOST * F.col("shard_size")).alias("words")
    at = (F.col("src").alias("q_src"), F.col("shard").alias("q_shard"))
    quotas = stage(quotas.select(*at, "shard_size", "source_size", "target", got), "quotas")
    quotas = maybe_broadcast(quotas, F.octet_length("q_src") + 96)
    line = Window.partitionBy("src", "shard").orderBy("draw", "size", *held)
    upto = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = base.withColumn("start", upto - F.col("size"))
    rows = rows.join(quotas, (F.col("src") == F.col("q_src")) & (F.col("shard") == F.col("q_shard")))
    zero = F.lit(0).cast("long")
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(zero)
    rest = F.col("words") - rounds * F.col("shard_size")
    again = F.greatest(zero, F.least(F.col("start") + F.col("size"), rest) - F.col("start"))
    taken = (F.col("size") * rounds + again).cast("long").alias("taken")
    kept = (F.col(h).alias(c) for h, c in zip(held, keep, strict=True))
    return rows.select(*kept, "draw", "size", "source_size", "target", taken)


def repeated(docs: DataFrame, key: Column) -> DataFrame:
    """The documents as the mix takes them: whole, as often as the taken words come nearest to."""
    own = docs.select("doc_id", "source", "text", key.alias("mix_key"))
    nearest = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.greatest("size", F.lit(1)))).alias("times")
    times = mix(own, ["mix_key"]).select("mix_key", nearest)
    times = times.groupBy("mix_key").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    times = maybe_broadcast(stage(times, "times"), F.octet_length("mix_key") + 48)
    held = packed(docs, held_key=key).join(times, F.col("held_key") == F.col("mix_key"))
    # Equal rows share what was taken of them.
    each = F.floor((2 * F.col("times") + F.col("rows")) / (2 * F.col("rows")))
    copies = F.when(each > 0, F.sequence(F.lit(1).cast("long"), each)).otherwise(F.array().cast("array<bigint>"))
    return held.select("doc", F.explode(copies).alias("copy")).select("doc.*")


def op2_sainte_lague_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, ["doc_id"]).drop("draw")


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, 'none') AS src, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
  md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(md5(text), 'null')) AS draw FROM documents),
s AS (SELECT src, substr(draw, 1, 2) AS shard, CAST(sum(size) AS BIGINT) AS shard_size FROM d GROUP BY ALL),
a AS (SELECT src, CAST(sum(shard_size) AS BIGINT) AS source_size, (list_value(5, 2, 1))[(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS weight FROM s GROUP BY src),
b AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS ratio, sum(source_size) OVER () AS total FROM a),
c AS (SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / sum(weight) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
v AS (SELECT arg_min(level, (ratio, src)) AS lv FROM c WHERE level <= ratio),
e AS (SELECT c.*, lv FROM c LEFT JOIN v ON true),
t AS (SELECT src, source_size, CAST(total AS BIGINT) AS total, coalesce(CASE WHEN ratio < lv THEN CAST(cap AS DOUBLE) ELSE weight * lv END, 0) AS target, greatest(1, least({BLOCK}, CAST(total AS BIGINT) // {BLOCKS})) AS block FROM e),
n AS (SELECT *, (2 * total + block) // (2 * block) AS seats FROM t),
q1 AS (SELECT src, target / (2 * j + 1) AS quot, j, seats FROM (SELECT src, target, seats, unnest(range(0, CAST(ceil(target / block + 20) AS BIGINT))) AS j FROM n WHERE target > 0)),
w1 AS (SELECT src, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY quot DESC, src, j) AS r FROM q1) WHERE r <= seats GROUP BY src),
p AS (SELECT s.src, shard, shard_size, source_size, target, block, coalesce(quota, 0) AS source_quota FROM s JOIN n USING (src) LEFT JOIN w1 USING (src)),
q2 AS (SELECT src, shard, CAST(shard_size AS DOUBLE) / (2 * j + 1) AS quot, j, source_quota FROM (SELECT src, shard, shard_size, source_quota, unnest(range(0, CAST(ceil(CAST(shard_size AS DOUBLE) / source_size * source_quota * 2 + 200) AS BIGINT))) AS j FROM p WHERE shard_size > 0)),
w2 AS (SELECT src, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY quot DESC, shard, j) AS r FROM q2) WHERE r <= source_quota GROUP BY src, shard),
z AS (SELECT p.*, least(coalesce(quota, 0) * block, 3 * shard_size) AS words FROM p LEFT JOIN w2 USING (src, shard)),
l AS (SELECT doc_id, d.src, size, z.shard_size, z.source_size, z.target, z.words, CAST(sum(size) OVER (PARTITION BY d.src, z.shard ORDER BY draw, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start FROM d JOIN z ON d.src = z.src AND substr(d.draw, 1, 2) = z.shard)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN shard_size > 0 THEN size * (words // shard_size) + greatest(0, least(start + size, words % shard_size) - start) ELSE 0 END AS BIGINT) AS taken FROM l
"""
