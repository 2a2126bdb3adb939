"""A keyed queue of questions: added once, asked on days, answered, archived, swept by age.

The table has one row a question: id, text, normalized, created_on, asked_on (days), status, answered_on, archived_on,
archived_reason. Each operation returns the new table; on a cluster it is written beside the old one and swapped in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

OPEN, ANSWERED, ARCHIVED = "open", "answered", "archived"
SCHEMA = "id string, text string, normalized string, created_on date, asked_on array<date>, status string, answered_on date, archived_on date, archived_reason string"


def read_lines(lines: DataFrame) -> DataFrame:
    """From JSON lines (value): the parsed question and what is wrong: null, json, or the first bad field. Blank lines go."""
    v = F.try_parse_json("value")
    get = lambda path, kind="string": F.try_variant_get(v, f"$.{path}", kind)
    day = lambda path: F.rlike(F.coalesce(get(path), F.lit("")), F.lit(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"))
    bad = (
        F.when(v.isNull() | (F.substring(F.trim("value"), 1, 1) != "{"), "json").when(~F.rlike(F.coalesce(get("id"), F.lit("")), F.lit(r"\Aq-[0-9a-f]{8}\z")), "id")
        .when(F.coalesce(F.trim(get("text")), F.lit("")) == "", "text").when(~day("createdOn"), "createdOn").when(~F.coalesce(get("status").isin(OPEN, ANSWERED, ARCHIVED), F.lit(False)), "status")
    )
    return lines.where(F.trim("value") != "").select("value", bad.alias("bad"), get("id").alias("id"), get("text").alias("text"), F.try_to_date(get("createdOn"), "yyyy-MM-dd").alias("created_on"), get("status").alias("status"))


def new_questions(queue: DataFrame, new: DataFrame, today: Column, within_days: int) -> DataFrame:
    """The rows that the new texts (text, seq) give: one a key, none that is open or was answered within so many days."""
    fresh = new.withColumn("normalized", T.normal_question(T.nfc("text"))).where("normalized <> ''")
    fresh = fresh.withColumn("r", F.row_number().over(Window.partitionBy("normalized").orderBy("seq"))).where("r = 1")
    known = queue.where((F.col("status") == OPEN) | ((F.col("status") == ANSWERED) & (F.datediff(today, "answered_on") <= within_days))).select("normalized").distinct()
    fresh = fresh.join(known, "normalized", "left_anti")
    return fresh.select(
        T.question_id(F.col("normalized")).alias("id"), "text", "normalized", today.alias("created_on"), F.array().cast("array<date>").alias("asked_on"), F.lit(OPEN).alias("status"),
        F.lit(None).cast("date").alias("answered_on"), F.lit(None).cast("date").alias("archived_on"), F.lit(None).cast("string").alias("archived_reason"),
    )


def add(queue: DataFrame, new: DataFrame, today: Column, within_days: int) -> DataFrame:
    """The queue with the rows of `new_questions`."""
    made = new_questions(queue, new, today, within_days)
    # An answered question asked anew later takes its old row's place; another's id may be the same by chance.
    return queue.join(made.select("id", "normalized"), ["id", "normalized"], "left_anti").select(*queue.columns).unionByName(made)


def mark_asked(queue: DataFrame, ids: DataFrame, today: Column) -> DataFrame:
    """Asked today, once a day however often it is said."""
    hit = ids.select("id").distinct().withColumn("hit", F.lit(True))
    asked = F.when(F.col("hit") & (F.col("status") == OPEN), F.array_union("asked_on", F.array(today))).otherwise(F.col("asked_on"))
    return queue.join(hit, "id", "left").withColumn("asked_on", asked).drop("hit").select(*queue.columns)


def answer(queue: DataFrame, ids: DataFrame, today: Column) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("hit", F.lit(True))
    now = F.coalesce(F.col("hit"), F.lit(False)) & (F.col("status") == OPEN)
    return queue.join(hit, "id", "left").withColumn("answered_on", F.when(now, today).otherwise(F.col("answered_on"))).withColumn("status", F.when(now, ANSWERED).otherwise(F.col("status"))).select(*queue.columns)


def age_days(today: Column) -> Column:
    return F.datediff(today, "created_on")


def is_escalated(times: int) -> Column:
    return (F.col("status") == OPEN) & (F.size("asked_on") >= times)


def sweep(queue: DataFrame, today: Column, max_days: int) -> DataFrame:
    """Open questions past the age are archived."""
    due = (F.col("status") == OPEN) & (age_days(today) > max_days)
    return queue.withColumns({"archived_on": F.when(due, today).otherwise(F.col("archived_on")), "archived_reason": F.when(due, "expired").otherwise(F.col("archived_reason")), "status": F.when(due, ARCHIVED).otherwise(F.col("status"))}).select(*queue.columns)


def view(queue: DataFrame, today: Column) -> DataFrame:
    return queue.select("id", "text", "status", age_days(today).alias("age_days"), F.size("asked_on").alias("asked_count"), F.array_max("asked_on").alias("last_asked"))


def select(queue: DataFrame, most: int, times: int) -> DataFrame:
    """The questions of a briefing: escalated ones first, then the oldest; with how many are not shown."""
    opened = queue.where(F.col("status") == OPEN)
    total = opened.agg(F.count("*").alias("total"))
    shown = opened.withColumn("escalated", is_escalated(times)).orderBy(F.desc("escalated"), "created_on", "id").limit(most)
    return shown.join(F.broadcast(total), F.lit(True)).select("id", "text", "escalated", F.greatest(F.col("total") - most, F.lit(0)).alias("not_shown"))
