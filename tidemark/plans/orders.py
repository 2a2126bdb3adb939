"""Queries of orders, unions and findings over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import increments as I
from tidemark.operators import scan as S
from tidemark.operators.staging import numbered, shared_folder
from tidemark.streaming import jobs

from .scan import _FINDINGS, _FOUND, _LINES, CONFIGURED, KEYWORDS, PATTERNS, document_lines, findings, suspect_lines
from .tables import query


@query(
    "O01_finding_order",
    f'WITH {_FINDINGS} SELECT file, line, id, "check", row_number() OVER (ORDER BY file, coalesce(line, -1), id, "check") AS place FROM f',
)
def finding_order(t):
    """All findings with their places in the report: by file, line, rule and check."""
    line = F.coalesce("line", F.lit(-1))
    return numbered(findings(t), "place", "file", line, "id", "check").select("file", "line", "id", "check", "place")


@query("O02_session_order", "SELECT user_id, event_type, row_number() OVER (ORDER BY last DESC, user_id, event_type) AS place FROM (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY ALL)")
def session_order(t):
    """Sessions with the latest first, by name where they end together."""
    last = t.events().groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    placed = numbered(last, "place", F.desc("last"), "user_id", "event_type")
    return placed.select("user_id", "event_type", "place")


@query(
    "U02_union_days",
    "SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT l_suppkey) AS sources, max(rest) AS remaining FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, count(*) OVER (PARTITION BY l_suppkey) % 7 AS rest FROM lineitem) GROUP BY 1",
)
def union_days(t):
    """The days that any source asks for, once each, with how many ask and the most that remains for one of them."""
    per = t("lineitem").groupBy("l_suppkey").agg(F.collect_set(F.to_date("l_shipdate")).alias("days"), (F.count("*") % 7).alias("rest"))
    days = per.select("rest", F.explode("days").alias("day"))
    return days.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("sources"), F.max("rest").alias("remaining"))


@query(
    "W02_first_occurrence",
    f"WITH l AS ({_LINES}) SELECT doc_id, line, first FROM (SELECT doc_id, line, min(line) OVER (PARTITION BY doc_id, raw) AS first FROM l WHERE trim(raw) <> '') WHERE line > first",
)
def first_occurrence(t):
    """Lines of each document equal to an earlier one, which is named."""
    lines = document_lines(t).where(F.trim("raw") != "")
    first = F.min("line").over(Window.partitionBy("doc_id", F.xxhash64("raw"), "raw"))
    told = lines.withColumn("first", first).where("line > first")
    return told.select("doc_id", F.col("line").cast("long").alias("line"), F.col("first").cast("long").alias("first"))


@query(
    "R27_secrets",
    f"WITH l AS ({_LINES}), m AS ({_FOUND}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, pattern, match) AS place, count(*) OVER (PARTITION BY doc_id) AS total FROM m) "
    "SELECT doc_id, line, CASE WHEN origin = 'generic' THEN pattern ELSE '[' || origin || ']' END AS shown, CAST(NULL AS BIGINT) AS more FROM r WHERE place <= 5 "
    "UNION ALL SELECT doc_id, NULL, 'truncated', total - 5 FROM r WHERE place = 6",
)
def secrets(t):
    """The first five matches of each file under names that may be shown, and one more finding where there are more."""
    found = S.first_of_each(S.matches(suspect_lines(t), "doc_id", PATTERNS), "doc_id", ["line", "pattern", "match"], 6)
    line, none = F.col("line").cast("long"), F.lit(None).cast("long")
    shown = S.shown_pattern(F.col("pattern"), F.col("origin"))
    last = F.col("place") == 6
    told = (F.when(~last, line).alias("line"), F.when(last, "truncated").otherwise(shown).alias("shown"))
    return found.select("doc_id", *told, F.when(last, F.col("total") - 5).otherwise(none).alias("more"))


_KEYED = " UNION ALL ".join(
    f"SELECT doc_id, line, '{k}' AS keyword, length(regexp_extract(' ' || raw, '^(.*?)[^a-z0-9]{k}(?:[^a-z0-9]|$)', 1)) AS pos FROM a WHERE regexp_matches(' ' || raw, '[^a-z0-9]{k}(?:[^a-z0-9]|$)')"
    for k in KEYWORDS
)


@query(
    "R28_privacy_keywords",
    f"WITH a AS (SELECT doc_id, line, lower(raw) AS raw FROM ({_LINES}) WHERE line % 2 = 0), k AS ({_KEYED}) SELECT doc_id, line, arg_min(keyword, pos) AS keyword FROM k GROUP BY ALL",
)
def privacy_keywords(t):
    """The first keyword of each added line: every second line of a document is new against its base."""
    base = document_lines(t).select("doc_id", "line", (F.col("line") % 2 == 0).alias("added"))
    added = document_lines(t).join(base.where("added").select("doc_id", "line"), ["doc_id", "line"], "left_semi")
    held = added.withColumn("keyword", S.first_keyword(T.comparable(F.col("raw")), KEYWORDS)).where("keyword is not null")
    return held.select("doc_id", F.col("line").cast("long").alias("line"), "keyword")


@query(
    "X25_source_states",
    "WITH e AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY 1) SELECT user_id, 'a' AS source, CASE WHEN last % 3 = 0 THEN 'failed' ELSE 'ok' END AS state FROM e "
    "UNION ALL SELECT user_id, 'b', 'empty' FROM e WHERE last % 2 = 0",
)
def source_states(t):
    """States of the last line that holds any: a later token of a source overrides only an ok."""
    k = F.col("event_id")
    tokens = F.concat(F.lit("sources: a=ok"), F.when(k % 3 == 0, " a=failed a=ok").otherwise(""), F.when(k % 2 == 0, " b=empty").otherwise(""))
    lines = t("events").select("user_id", k.alias("at"), F.explode(F.array(tokens, F.lit("no states here"))).alias("line"))
    last = lines.where(F.startswith("line", F.lit("sources: "))).groupBy("user_id").agg(F.max_by("line", "at").alias("line"))
    found = F.regexp_extract_all("line", F.lit(r"([a-z]+=[a-z]+)"), F.lit(1))
    each = last.select("user_id", F.posexplode(found).alias("seq", "token"))
    parts = each.select(F.struct("user_id", F.substring_index("token", "=", 1).alias("source")).alias("source_id"), "seq", F.substring_index("token", "=", -1).alias("state"))
    return I.report_states(parts).select("source_id.user_id", "source_id.source", "state")


@query(
    "E03_placeholders",
    rf"WITH l AS ({_LINES}) SELECT doc_id, line, match FROM (SELECT doc_id, line, unnest(regexp_extract_all(raw, '(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+')) AS match FROM l) WHERE NOT regexp_matches(match, '(?i)@mail[0-4]\.')",
)
def placeholders(t):
    """Matches of a configured pattern but for those that the settings name as placeholders."""
    found = S.matches(suspect_lines(t), "doc_id", [p for p in PATTERNS if p[0] == CONFIGURED[1]])
    real = found.where(~F.rlike("match", F.lit(r"(?i)@mail[0-4]\.")))
    return real.select("doc_id", F.col("line").cast("long").alias("line"), "match")


@query(
    "T23_atomic_sink",
    "SELECT event_type AS source_id, CAST(CASE WHEN count(*) % 2 = 0 THEN DATE '2024-01-10' + CAST(count(*) % 9 AS INT) END AS VARCHAR) AS mark FROM events GROUP BY 1",
)
def atomic_sink(t):
    """Marks committed by a streaming round: each batch writes its own folder, and the last one holds the state."""
    folder = f"{shared_folder(t.spark)}/round-{uuid.uuid4().hex[:12]}"
    day = F.date_add(F.lit("2024-01-10").cast("date"), (F.count("*") % 9).cast("int"))
    told = t("events").groupBy(F.col("event_type").alias("source_id")).agg(day.alias("day"), F.when(F.count("*") % 2 == 0, 0).otherwise(1).alias("exit_code"))
    told = told.select("*", F.lit(True).alias("evidence_ok"), F.lit("ok").alias("state"), F.lit(1).alias("listed"), F.lit(1).alias("read"))
    told.write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(told.schema).parquet(f"{folder}/in")
    jobs.commit_rounds(stream, f"{folder}/marks", "2024-02-01", f"{folder}/at").awaitTermination()
    last = max(jobs.written_batches(t.spark, f"{folder}/marks"))
    marks = t.spark.read.parquet(f"{folder}/marks/batch={last}")
    return marks.select("source_id", F.col("mark").cast("string").alias("mark"))
