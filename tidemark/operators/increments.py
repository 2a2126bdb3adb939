"""Day-grained increments: windows of whole local days, sessions under caps, digests under byte budgets, evidence, commits.

A source's mark is the last local day that was read whole. It lives in a keyed table and moves only on proof of
reading; it is not an event-time watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DAYS = 7


def window_days(mark: Column, today: Column, most: int = MAX_DAYS) -> Column:
    """From the day after the mark to yesterday, the oldest `most`; without a mark yesterday alone."""
    yesterday = F.date_add(today, -1)
    whole = F.when(mark.isNull(), F.array(yesterday)).when(mark < yesterday, F.sequence(F.date_add(mark, 1), yesterday)).otherwise(F.array().cast("array<date>"))
    return F.struct(F.slice(whole, F.lit(1), F.lit(most)).alias("days"), F.greatest(F.size(whole) - most, F.lit(0)).alias("remaining"), F.coalesce(mark > yesterday, F.lit(False)).alias("future"))


def sessions(events: DataFrame, session: str, day: str, at: str) -> DataFrame:
    """First and last instant of each session and local day."""
    return events.groupBy(session, day).agg(F.min(at).alias("first"), F.max(at).alias("last"))


def admitted_days(days: DataFrame, source: str, day: str, session: str, cap: int) -> DataFrame:
    """Whole days, oldest first, while the distinct sessions so far are within the cap; all later days wait."""
    seen = days.groupBy(source, session).agg(F.min(day).alias(day))
    fresh = seen.groupBy(source, day).agg(F.count("*").alias("fresh"))
    every = days.select(source, day).distinct().join(fresh, [source, day], "left").fillna({"fresh": 0})
    along = Window.partitionBy(source).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    # The running sum never falls, so days past the first overflow stay out, those without new sessions too.
    return every.withColumn("so_far", F.sum("fresh").over(along)).withColumn("taken", F.col("so_far") <= cap)


def newest_within(rows: DataFrame, key: str, order: str, cost: Column, budget: int) -> DataFrame:
    """The newest rows of each key while the running cost stays strictly under the budget."""
    back = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(back)).withColumn("kept", F.col("running") < budget)


def held_days(days: DataFrame, key: str, day: str, bytes_: str, budget: int) -> DataFrame:
    """The oldest days of each key while their bytes stay strictly under the budget, one at least."""
    along = Window.partitionBy(key).orderBy(day)
    run = days.withColumn("running", F.sum(bytes_).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("held", (F.col("running") < budget) | (F.row_number().over(along) == 1))


def read_prefix(days: DataFrame, source: str, day: str, read: str) -> DataFrame:
    """The last day of each source up to which every day was read; null if the first was not."""
    gap = F.min(F.when(~F.col(read), F.col(day)))
    return days.groupBy(source).agg(gap.alias("gap"), F.max(day).alias("end"), F.min(day).alias("begin")).select(source, F.when(F.col("gap").isNull(), F.col("end")).when(F.col("gap") > F.col("begin"), F.date_add("gap", -1)).alias("upto"))


def fold_results(results: DataFrame, use: str = "tool_use_id") -> DataFrame:
    """Results of a use: any failure fails, any next page means more, a repeated use makes the item count unknown."""
    return results.groupBy(use).agg(F.bool_or("failed").alias("failed"), F.bool_or("has_next").alias("more"), F.when(F.count("*") > 1, None).otherwise(F.max("items")).alias("items"))


def commit_reason(day: Column, today: Column, mark: Column, exit_code: Column, evidence_ok: Column, state: Column, listed: Column, read: Column) -> Column:
    """Why a mark may not move to the day; null if it may. The first reason that applies."""
    return (
        F.when(day.isNull(), "no_day").when(day >= today, "day_not_over").when(exit_code != 0, "run_failed").when(~F.coalesce(evidence_ok, F.lit(False)), "no_evidence")
        .when(state.isNull(), "not_reported").when(~state.isin("ok", "empty"), "not_read").when((state == "empty") & (F.coalesce(listed, F.lit(0)) > 0), "empty_with_listing")
        .when((state == "empty") & (F.coalesce(read, F.lit(0)) > 0), "empty_with_reads").when(F.coalesce(day <= mark, F.lit(False)), "not_later")
    )


def commit(marks: DataFrame, outcomes: DataFrame, today: Column) -> DataFrame:
    """Marks after a round: moved where nothing speaks against it, with the reason where something does."""
    joined = marks.join(outcomes, "source_id", "full")
    why = commit_reason(F.col("day"), today, F.col("mark"), F.col("exit_code"), F.col("evidence_ok"), F.col("state"), F.col("listed"), F.col("read"))
    return joined.withColumn("reason", why).select("source_id", F.when(F.col("reason").isNull(), F.col("day")).otherwise(F.col("mark")).alias("mark"), "reason")


def report_states(tokens: DataFrame, source: str = "source_id") -> DataFrame:
    """States of `id=state` tokens in order: a later token overrides only an ok."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "state")))
    step = F.aggregate(ordered, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (a == "ok"), x["state"]).otherwise(a))
    return tokens.groupBy(source).agg(step.alias("state"))


def open_incidents(log: DataFrame, key: str) -> DataFrame:
    """Failures since each key's last closing entry."""
    last = F.max(F.when(F.col("closes"), F.col("seq"))).over(Window.partitionBy(key))
    return log.withColumn("closed_at", last).where((F.col("exit_code") != 0) & (F.col("closed_at").isNull() | (F.col("seq") > F.col("closed_at")))).drop("closed_at")


def change_of_state(history: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Rows whose state differs from the key's row before."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(order))
    return history.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(state)))
