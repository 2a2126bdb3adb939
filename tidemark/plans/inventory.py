"""Queries over inventories (V02, J16, A17): parts as shipped files and patterns, orders as project folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import inventory as V

from .tables import query


@query("V02_classify", """WITH d AS (SELECT p_partkey, p_type NOT LIKE 'PROMO%' AS managed, sha256(p_type) AS recorded, p_size < 50 AS there, CASE WHEN p_retailprice > 1090 THEN 'unreadable' END AS state,
  sha256(CASE WHEN p_size < 10 THEN p_type WHEN p_size < 30 THEN p_brand ELSE p_name END) AS now, p_brand <> 'Brand#11' AS in_kit, length(p_type) % 2 = 0 AND p_brand <> 'Brand#11' AS unmoved, p_size % 3 = 0 AS beside FROM part)
SELECT p_partkey, CASE WHEN NOT managed THEN 'seeded' WHEN NOT there THEN 'missing' WHEN state IS NOT NULL THEN state WHEN NOT in_kit THEN 'not_in_kit' WHEN now = (SELECT sha256(p_name) FROM part q WHERE q.p_partkey = d.p_partkey) THEN 'current'
  WHEN now = recorded THEN 'refresh' WHEN unmoved THEN 'kept' WHEN beside THEN 'blocked' ELSE 'offer' END AS class FROM d""")
def classify(t):
    """Installed files against what was recorded and what is shipped now, at their stamps."""
    p = t("part")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    size, path = F.col("p_size"), F.col("p_partkey").cast("string")
    entries = p.select(path.alias("path"), (~F.startswith("p_type", F.lit("PROMO"))).alias("managed"), sha("p_type").alias("recorded"))
    now = F.when(size < 10, sha("p_type")).when(size < 30, sha("p_brand")).otherwise(sha("p_name"))
    files = p.where(size < 50).select(path.alias("path"), F.when(F.col("p_retailprice") > 1090, "unreadable").alias("state"), now.alias("hash"), F.col("p_brand").alias("stamp"))
    beside = p.where(size % 3 == 0).select(F.concat(path, F.lit(".new")).alias("path"), F.lit(None).cast("string").alias("state"), F.lit("").alias("hash"), F.lit(None).cast("string").alias("stamp"))
    kit = p.where("p_brand <> 'Brand#11'")
    bare = kit.where(F.length("p_type") % 2 == 0).select(path.alias("path"), F.lit(None).cast("string").alias("stamp"), sha("p_type").alias("hash"))
    shipped = kit.select(path.alias("path"), F.col("p_brand").alias("stamp"), sha("p_name").alias("hash")).unionByName(bare)
    return V.classify_files(entries, files.unionByName(beside), shipped).select(F.col("path").cast("long").alias("p_partkey"), "class")


@query("J16_pattern_sources", """WITH s AS (SELECT CASE WHEN p_size < 15 THEN 'working' WHEN p_size < 30 THEN 'tip' WHEN p_size < 45 THEN 'carried' WHEN p_size < 49 THEN 'default' ELSE 'other' END AS kind, lpad(CAST(p_size AS VARCHAR), 2, '0') AS source,
  p_brand || ' ' || split_part(p_type, ' ', 1) AS pattern, CASE WHEN p_retailprice > 1095 THEN 'unreadable' END AS reason FROM part),
o AS (SELECT *, CASE kind WHEN 'working' THEN 1 WHEN 'tip' THEN 2 WHEN 'carried' THEN 3 WHEN 'default' THEN 4 ELSE 0 END AS place FROM s)
SELECT 'pattern' AS part, pattern AS name, arg_min(kind, {'p': place, 's': source}) AS kind, arg_min(source, {'p': place, 's': source}) AS source FROM o WHERE reason IS NULL AND place > 0 GROUP BY pattern
UNION ALL SELECT DISTINCT 'refusal', coalesce(reason, 'unknown kind'), kind, source FROM o WHERE reason IS NOT NULL OR place = 0""")
def pattern_sources(t):
    """Patterns of four kinds of sources, each under its first, and the sources that refuse the whole."""
    size = F.col("p_size")
    kind = F.when(size < 15, "working").when(size < 30, "tip").when(size < 45, "carried").when(size < 49, "default").otherwise("other")
    sources = t("part").select(
        kind.alias("kind"), F.lpad(size.cast("string"), 2, "0").alias("source"), F.concat("p_brand", F.lit(" "), F.split_part("p_type", F.lit(" "), F.lit(1))).alias("pattern"),
        F.when(F.col("p_retailprice") > 1095, "unreadable").alias("reason"),
    )
    patterns, refused = V.union_patterns(sources)
    told = patterns.select(F.lit("pattern").alias("part"), F.col("pattern").alias("name"), "kind", "source")
    return told.unionByName(refused.select(F.lit("refusal").alias("part"), F.col("reason").alias("name"), "kind", "source"))


@query("A17_projects", """WITH p AS (SELECT DISTINCT o_custkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'directory' WHEN 'P' THEN 'unreachable' ELSE 'gone' END AS entry, o_orderpriority = '1-URGENT' AS own, o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0 AS waitable,
  c_mktsegment = 'BUILDING' AS whole FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT *, entry = 'gone' AS missing, entry = 'gone' AND waitable AND NOT whole AS waits FROM p),
g AS (SELECT o_custkey, count(*) FILTER (WHERE entry = 'unreachable') AS unread, count(*) FILTER (WHERE waits) AS waiting, count(*) FILTER (WHERE missing AND NOT waits AND own) AS own_lost, count(*) FILTER (WHERE missing AND NOT waits AND NOT own) AS lost,
  count(*) FILTER (WHERE NOT missing) AS found, bool_or(whole) AS whole FROM m GROUP BY o_custkey),
v AS (SELECT *, CASE WHEN unread > 0 THEN 'unreadable' WHEN lost > 0 AND found = 0 THEN 'all_missing' WHEN lost > 0 THEN 'some_missing' WHEN own_lost > 0 THEN 'own_missing' WHEN waiting > 0 AND found = 0 THEN 'no_sessions_yet'
  WHEN waiting > 0 THEN 'some_waiting' WHEN whole THEN 'all' ELSE 'ok' END AS verdict FROM g)
SELECT o_custkey, CASE WHEN verdict IN ('unreadable', 'all_missing') OR (verdict = 'own_missing' AND found = 0) THEN 'fail' WHEN verdict IN ('some_missing', 'own_missing') THEN 'warn' ELSE 'ok' END AS status, verdict, found FROM v""")
def projects(t):
    """The folders of each customer's orders: unreadable, lost, waiting or found, one verdict each."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    entry = F.when(status == "F", "directory").when(status == "P", "unreachable")
    rows = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    own = priority == "1-URGENT"
    rows = rows.select("o_custkey", priority.alias("project"), entry.alias("entry"), own.alias("own"), (own & (F.col("o_custkey") % 2 == 0)).alias("waitable"), (F.col("c_mktsegment") == "BUILDING").alias("whole"))
    return V.project_verdicts(rows, "o_custkey")
