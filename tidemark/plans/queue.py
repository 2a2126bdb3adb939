"""Queue queries (T16, T17, A08, O05, S13, S14, S18): benchmark items and documents as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import queue as Q

from .tables import query

TODAY = "2024-06-30"
_N = r"trim(regexp_replace(regexp_replace(lower(text), '[\p{P}\p{S}]+', ' ', 'g'), '\s+', ' ', 'g'))"
_today = lambda: F.lit(TODAY).cast("date")


def questions(t):
    """Benchmark items as a queue: dates and states follow from their ids."""
    i = F.col("item_id")
    normal = T.normal_question(F.col("text"))
    asked = F.transform(F.sequence(F.lit(0), (i % 4).cast("int")), lambda k: F.date_add(F.lit("2024-05-01").cast("date"), k))
    return t("benchmark").select(
        F.concat(F.lit("q-"), F.lpad(i.cast("string"), 8, "0")).alias("id"), "text", normal.alias("normalized"), F.date_add(F.lit("2024-01-01").cast("date"), i.cast("int")).alias("created_on"),
        F.when(i % 4 == 0, F.array().cast("array<date>")).otherwise(asked).alias("asked_on"), F.when(i % 3 == 0, "answered").otherwise("open").alias("status"),
        F.when(i % 3 == 0, F.date_add(F.lit("2024-06-01").cast("date"), (i % 30).cast("int"))).alias("answered_on"), F.lit(None).cast("date").alias("archived_on"), F.lit(None).cast("string").alias("archived_reason"),
    )


@query("T16_add", f"""WITH q AS (SELECT item_id, {_N} AS n, item_id % 3 = 0 AS answered, DATE '2024-06-01' + CAST(item_id % 30 AS INT) AS answered_on FROM benchmark),
known AS (SELECT DISTINCT n FROM q WHERE NOT answered OR DATE '{TODAY}' - answered_on <= 10),
x AS (SELECT DISTINCT {_N} AS n FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents)) SELECT 'q-' || substr(sha256(n), 1, 8) AS id, n AS normalized FROM x WHERE n <> '' AND n NOT IN (SELECT n FROM known)""")
def add(t):
    """New texts that are neither open nor answered of late, one a key: the rows of the queue that are not as they were."""
    texts = t("documents").select("text", F.col("doc_id").alias("seq")).unionByName(t("benchmark").select("text", F.col("item_id").alias("seq")))
    queue = questions(t)
    out = Q.add(queue.withColumn("text", F.lit(None).cast("string")), texts, _today(), 10)
    return out.where("text is not null").select("id", "normalized")


@query("T17_sweep", f"SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'answered' WHEN DATE '{TODAY}' - (DATE '2024-01-01' + CAST(item_id AS INT)) > 160 THEN 'archived' ELSE 'open' END AS status, item_id % 3 <> 0 AND item_id % 4 >= 2 AS escalated FROM benchmark")
def sweep(t):
    q = questions(t).withColumn("escalated", Q.is_escalated(3))
    return Q.sweep(q, _today(), 160).select(F.substring("id", 3, 8).cast("long").alias("item_id"), "status", "escalated")


@query("A08_question_view", f"SELECT item_id, CAST(DATE '{TODAY}' - (DATE '2024-01-01' + CAST(item_id AS INT)) AS BIGINT) AS age_days, CAST(CASE WHEN item_id % 4 = 0 THEN 0 ELSE item_id % 4 + 1 END AS BIGINT) AS asked_count, CASE WHEN item_id % 4 > 0 THEN CAST(DATE '2024-05-01' + CAST(item_id % 4 AS INT) AS VARCHAR) END AS last_asked FROM benchmark")
def question_view(t):
    v = Q.view(questions(t), _today())
    return v.select(F.substring("id", 3, 8).cast("long").alias("item_id"), F.col("age_days").cast("long").alias("age_days"), F.col("asked_count").cast("long").alias("asked_count"), F.col("last_asked").cast("string").alias("last_asked"))


@query("O05_shown_questions", "SELECT item_id, esc AS escalated, greatest(total - 5, 0) AS not_shown FROM (SELECT item_id, item_id % 4 >= 2 AS esc, row_number() OVER (ORDER BY item_id % 4 >= 2 DESC, item_id) AS r, count(*) OVER () AS total FROM benchmark WHERE item_id % 3 <> 0) WHERE r <= 5")
def shown_questions(t):
    """The five of a briefing, escalated ones first: the cap is the feature."""
    return Q.select(questions(t), 5, 3).select(F.substring("id", 3, 8).cast("long").alias("item_id"), "escalated", F.col("not_shown").cast("long").alias("not_shown"))


@query("S13_queue_lines", "SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'id' WHEN 2 THEN 'createdOn' WHEN 3 THEN 'status' END AS bad FROM benchmark")
def queue_lines(t):
    """JSON lines of a queue with the first field that is wrong."""
    k = F.col("item_id") % 5
    made = F.to_json(F.struct(F.when(k == 1, "x").otherwise("q-0a1b2c3d").alias("id"), F.col("text"), F.when(k == 2, "2024-1-1").otherwise("2024-01-01").alias("createdOn"), F.when(k == 3, "lost").otherwise("open").alias("status"), "item_id"))
    lines = t("benchmark").select(F.when(k == 0, F.concat(F.lit("{bad "), F.col("item_id").cast("string"))).otherwise(made).alias("value"))
    read = Q.read_lines(lines)
    item = F.coalesce(F.get_json_object("value", "$.item_id"), F.regexp_extract("value", r"\A\{bad (\d+)", 1)).cast("long")
    return read.select(item.alias("item_id"), "bad")


@query("S14_prune", "SELECT event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def prune(t):
    from tidemark.sources import readers

    return readers.pruned(t.events().where("event_type = 'error'"), "ts", F.lit("2024-01-20").cast("timestamp"), 7).select("event_id")


@query("X32_sections", "SELECT conv_id, turn AS section, CAST(greatest(length(text) - length(replace(text, chr(10), '')), 0) + 1 AS BIGINT) AS lines FROM conversations WHERE role = 'user'")
def sections(t):
    """Change-log sections: a heading starts one, the lines until the next are its body."""
    from pyspark.sql import Window

    line = F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    log = t("conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    lines = log.select("conv_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    head = F.regexp_extract("raw", r"\A## (\d+)\z", 1)
    along = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    body = lines.withColumn("section", F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(along)).where(head == "")
    return body.groupBy("conv_id", F.col("section").cast("long").alias("section")).agg(F.count("*").alias("lines"))
