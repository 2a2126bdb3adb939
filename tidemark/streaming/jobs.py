"""Structured Streaming forms of the stateful operators: reminders asked once, increments committed on evidence, the queue."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.operators import increments as I
from tidemark.sources.state import read_state, versions, write_state


def remind_once(stream: DataFrame, session: str, path: str, at: str, late: str = "1 day") -> DataFrame:
    """The first row of each session and path; state older than the watermark is let go."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([session, path])


def day_sessions(stream: DataFrame, session: str, at: str, zone: str, late: str = "2 days") -> DataFrame:
    """First and last instant of each session and local day."""
    day = F.to_date(F.from_utc_timestamp(F.col(at), zone)).alias("day")
    return stream.withWatermark(at, late).groupBy(session, day, F.window(at, "7 days")).agg(F.min(at).alias("first"), F.max(at).alias("last"))


def commit_rounds(stream: DataFrame, marks_dir: str, today: str, checkpoint: str):
    """Starts a query that moves the marks after each batch of outcomes.

    A batch writes marks under its own number from those of the last batch before it that was written whole, so a batch
    that is run again after a failure writes the same rows to the same place.
    """
    marked = "source_id string, mark date"

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = read_state(spark, marks_dir, marked, below=number)
        marks = spark.createDataFrame([], marked) if marks is None else marks
        told = F.struct("day", "exit_code", "evidence_ok", "state", "listed", "read")
        last = batch.groupBy("source_id").agg(F.max_by(told, "day").alias("x")).select("source_id", "x.*")
        moved = I.commit(marks, last, F.lit(today).cast("date")).select("source_id", "mark")
        write_state(moved, marks_dir, number, name="batch")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written_batches(spark: SparkSession, marks_dir: str) -> list[int]:
    """The numbers of the last batches whose marks are whole, a few at most."""
    return [version for version, _, whole in versions(spark, marks_dir) if whole]


def question_queue(stream: DataFrame) -> DataFrame:
    """One state a normalized question over commands (normalized, text, day, action): added once, asked once a day, answered.

    Nothing is let go; `expiring_queue` is the form for a stream without an end."""

    def step(key, frames, state: GroupState):
        text, asked, status, last = state.get if state.exists else (None, 0, None, "")
        for frame in frames:
            for r in frame.sort_values("day").itertuples():
                if r.action == "add" and status != "open":
                    text, asked, status, last = r.text, 0, "open", ""
                elif r.action == "asked" and status == "open" and r.day != last:
                    asked, last = asked + 1, r.day
                elif r.action == "answer" and status == "open":
                    status = "answered"
        if status is not None:
            state.update((text, asked, status, last))
            yield pd.DataFrame({"normalized": [key[0]], "text": [text], "asked": [asked], "status": [status]})

    told, kept = "text string, asked int, status string", "text string, asked int, status string, last string"
    return stream.groupBy("normalized").applyInPandasWithState(
        step, f"normalized string, {told}", kept, "update", GroupStateTimeout.NoTimeout
    )


def keyed_session(spark: SparkSession) -> SparkSession:
    """A session whose streams keep their state on disk (RocksDB), as `expiring_queue` needs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


class QuestionProcessor(StatefulProcessor):
    """One normalized question: added once, asked once a day, answered, archived, and let go.

    Three variables of state: the open question, the days it was asked on, and how it was closed. A timer at the
    end of an open question's age archives it; one at the end of the days in which an answered question counts as a
    duplicate forgets it. Archived ones are forgotten at once, so the state holds only what can still matter.
    """

    def __init__(self, max_age_days: int, dedup_days: int, escalate_after: int):
        self.max_age_days, self.dedup_days, self.escalate_after = max_age_days, dedup_days, escalate_after

    def init(self, handle) -> None:
        self.handle = handle
        self.question = handle.getValueState("question", "text string, created date")
        self.asked = handle.getMapState("asked", "day date", "times int")
        self.closed = handle.getValueState("closed", "status string, day date")

    def _timer(self, day: date) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp() * 1000))

    def _forget(self) -> None:
        self.question.clear()
        self.asked.clear()
        self.closed.clear()

    def _held(self) -> tuple:
        """The question (text, created), the days it was asked on, and how it was closed; None where there is none."""
        question = self.question.get()
        return question, {x[0] for x in self.asked.keys()} if question else set(), self.closed.get() if question else None

    def _told(self, key, question, days: set, status: str, said: str, closed: date | None = None) -> Row:
        text, created = question
        escalated = status == "open" and len(days) >= self.escalate_after
        return Row(normalized=key[0], text=text, created=created, asked=len(days), status=status, escalated=escalated, said=said, closed=closed)

    def handleInputRows(self, key, rows, timerValues):
        """Each call of the state is a message to the JVM: it is read once and written once for all rows of a key."""
        question, days, closed = self._held()
        before, until = (question, frozenset(days), closed), None
        for r in sorted(rows, key=lambda x: x["at"]):
            day = r["at"].date()
            is_open = question is not None and closed is None
            if r["action"] == "add":
                if is_open:
                    yield self._told(key, question, days, "open", "duplicate_open")
                elif closed and (day - closed[1]).days <= self.dedup_days:
                    yield self._told(key, question, days, "answered", "duplicate_answered", closed[1])
                else:
                    question, days, closed = (r["text"].strip(), day), set(), None
                    until = day + timedelta(days=self.max_age_days + 1)
                    yield self._told(key, question, days, "open", "added")
            elif not is_open:
                if question is not None:
                    yield self._told(key, question, days, closed[0], "not_open", closed[1])
                else:
                    yield Row(normalized=key[0], text=None, created=None, asked=0, status=None, escalated=False, said="unknown", closed=None)
            elif r["action"] == "asked":
                again = day in days
                days.add(day)
                yield self._told(key, question, days, "open", "already" if again else "marked")
            elif r["action"] == "answer":
                closed = ("answered", day)
                until = day + timedelta(days=self.dedup_days + 1)
                yield self._told(key, question, days, "answered", "answered", day)
            elif r["action"] == "archive":
                yield self._told(key, question, days, "archived", "archived", day)
                question, days, closed = None, set(), None
        self._keep(before, question, days, closed)
        if until is not None:
            self._timer(until)

    def _keep(self, before: tuple, question, days: set, closed) -> None:
        """Write what differs from before."""
        if question is None:
            if before[0] is not None:
                self._forget()
            return
        if before[1] - days:
            self.asked.clear()
            before = (before[0], frozenset(), before[2])
        for day in sorted(days - before[1]):
            self.asked.updateValue((day,), (1,))
        if question != before[0]:
            self.question.update(question)
        if closed is None and before[2] is not None:
            self.closed.clear()
        elif closed != before[2]:
            self.closed.update(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        question, days, closed = self._held()
        if question is not None and closed is None:
            day = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, tz=UTC).date()
            yield self._told(key, question, days, "archived", "expired", day)
        if question is not None:
            self._forget()

    def close(self) -> None:
        """Nothing is held outside the state."""


def expiring_queue(stream: DataFrame, max_age_days: int, dedup_days: int, escalate_after: int, late: str = "1 day") -> DataFrame:
    """A row for each command and each expiry of the queue, from commands (normalized, text, at, action)."""
    told = "normalized string, text string, created date, asked int, status string, escalated boolean, said string, closed date"
    keyed = stream.withWatermark("at", late).groupBy("normalized")
    return keyed.transformWithState(QuestionProcessor(max_age_days, dedup_days, escalate_after), told, "Append", "EventTime")
