"""Readers, the push record source and the streaming queue, on small inputs of their own."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers
from tidemark.streaming import jobs


def test_walk_takes_markdown_and_decodes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_bytes("﻿one\r\ntwo é".encode())
    (tmp_path / "y.md").write_bytes(b"caf\xe9")
    (tmp_path / "z.txt").write_bytes(b"not this")
    got = {r.path: r.text for r in readers.notes(readers.walk(spark, str(tmp_path))).collect()}
    assert got == {"a/x.md": "one\ntwo é", "y.md": "café"}


def test_scan_bytes_tells_large_files_apart(spark, tmp_path):
    (tmp_path / "small.md").write_bytes(b"x")
    (tmp_path / "large.md").write_bytes(b"x" * 100)
    got = {r.path: (r.too_large, r.content is None) for r in readers.scan_bytes(readers.walk(spark, str(tmp_path)), most=50).collect()}
    assert got == {"small.md": (False, False), "large.md": (True, True)}


def test_transcript_keeps_what_people_said(spark, tmp_path):
    at = "2026-09-23T10:00:00Z"
    lines = [
        {"type": "user", "timestamp": at, "message": {"content": "hello"}},
        {"type": "assistant", "timestamp": at, "message": {"content": [{"type": "text", "text": "hi"}, {"type": "thinking", "text": "no"}]}},
        {"type": "user", "timestamp": at, "isMeta": True, "message": {"content": "meta"}},
        {"type": "user", "timestamp": at, "origin": {"kind": "hook"}, "message": {"content": "hook"}},
        {"type": "user", "message": {"content": "no time"}},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    read = readers.json_lines(spark, str(tmp_path))
    assert read.where("v is null").count() == 1
    assert sorted((r.role, r.text) for r in readers.transcript(read).collect()) == [("assistant", "hi"), ("user", "hello")]


def test_push_records(spark, tmp_path):
    path = tmp_path / "records"
    path.write_bytes(b"commit\0abc\0blob\0abc\x00100644\0a.md\0what\0x\0")
    got = readers.push_records(spark.read.format("binaryFile").load(str(path))).orderBy("seq").collect()
    assert [(r.kind, list(r.fields), r.problem) for r in got] == [("commit", ["abc"], None), ("blob", ["abc", "100644", "a.md"], None), ("what", [], "unknown kind")]


def test_question_queue_asks_once_a_day(spark, tmp_path):
    schema = "normalized string, text string, day string, action string"
    rows = [("q", "Q?", "2026-01-01", "add"), ("q", "Q?", "2026-01-02", "asked"), ("q", "Q?", "2026-01-02", "asked"), ("q", "Q?", "2026-01-03", "asked"), ("r", "R?", "2026-01-01", "add"), ("r", "R?", "2026-01-04", "answer")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    query = jobs.question_queue(stream).writeStream.outputMode("update").format("memory").queryName("queue_test").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("queue_test").collect()) == [("q", "Q?", 2, "open"), ("r", "R?", 0, "answered")]


def test_state_and_reports_are_written(spark, tmp_path):
    df = spark.range(3).select("id", F.lit("warn").alias("level"))
    out = readers.write_state(df, f"{tmp_path}/state", 1)
    assert spark.read.parquet(out).count() == 3
    readers.write_report(df, f"{tmp_path}/report", "1")
    assert spark.read.json(f"{tmp_path}/report/summary").first().n == 3


def test_sources_are_checked():
    assert readers.problems_of({"id": "a", "kind": "local", "collect": len, "read_evidence": len}) == []
    assert len(readers.problems_of({"kind": "other", "collect": 3})) == 4


def test_the_highest_whole_state_is_read(spark, tmp_path):
    for version in (1, 2, 10):
        readers.write_state(spark.range(version).select("id"), f"{tmp_path}/state", version)
    (tmp_path / "state" / "version=11").mkdir()
    assert readers.read_state(spark, f"{tmp_path}/state").count() == 10


def test_marks_move_batch_by_batch(spark, tmp_path):
    schema = "source_id string, day date, exit_code int, evidence_ok boolean, state string, listed int, read int"
    told = [("a", "2026-01-01", 0, True), ("b", "2026-01-01", 1, True)], [("a", "2026-01-02", 0, False), ("b", "2026-01-02", 0, True)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    for i, rows in enumerate(told):
        made = [(s, d, e, ok, "ok", 1, 1) for s, d, e, ok in rows]
        made = spark.createDataFrame(made, schema.replace("day date", "day string")).coalesce(1)
        made.write.mode("append").json(f"{tmp_path}/in")
        jobs.commit_rounds(stream, f"{tmp_path}/marks", "2026-02-01", f"{tmp_path}/at").awaitTermination(120)
        assert i in jobs.written_batches(spark, f"{tmp_path}/marks")
    last = max(jobs.written_batches(spark, f"{tmp_path}/marks"))
    got = {r.source_id: str(r.mark) for r in spark.read.parquet(f"{tmp_path}/marks/batch={last}").collect()}
    assert got == {"a": "2026-01-01", "b": "2026-01-02"}


def test_reminders_and_sessions_stream(spark, tmp_path):
    rows = [("s", "p", "2026-01-01 10:00:00"), ("s", "p", "2026-01-01 11:00:00"), ("s", "q", "2026-01-01 12:00:00"), ("t", "p", "2026-01-01 23:30:00")]
    spark.createDataFrame(rows, "session string, path string, at string").coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("session string, path string, at timestamp").json(f"{tmp_path}/in")

    def run(df, name, mode):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted((r.session, r.path) for r in run(jobs.remind_once(stream, "session", "path", "at"), "reminded", "append")) == [("s", "p"), ("s", "q"), ("t", "p")]
    got = {(r.session, str(r.day)): (str(r.first)[11:16], str(r.last)[11:16]) for r in run(jobs.day_sessions(stream, "session", "at", "Europe/Paris"), "days", "update")}
    assert got == {("s", "2026-01-01"): ("10:00", "12:00"), ("t", "2026-01-02"): ("23:30", "23:30")}


def test_the_expiring_queue(spark, tmp_path):
    """Escalation, duplicates, expiry by event time, and a state that holds only what can still matter."""
    schema = "normalized string, text string, at timestamp, action string"
    own = jobs.keyed_session(spark)
    (tmp_path / "in").mkdir()

    def run(rows):
        own.createDataFrame(rows, "normalized string, text string, at string, action string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = own.readStream.schema(schema).json(f"{tmp_path}/in")
        out = jobs.expiring_queue(stream, max_age_days=30, dedup_days=10, escalate_after=2)
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        got = own.read.parquet(f"{tmp_path}/out").collect()
        keys = {r["key"]["normalized"] for r in own.read.format("statestore").option("stateVarName", "question").load(f"{tmp_path}/at").collect()}
        return [(r.normalized, r.said, r.asked, r.status, r.escalated) for r in got], keys

    first = [
        ("q", " Q? ", "2026-01-01 08:00:00", "add"), ("q", "Q", "2026-01-01 09:00:00", "add"), ("q", None, "2026-01-02 08:00:00", "asked"), ("q", None, "2026-01-02 09:00:00", "asked"),
        ("q", None, "2026-01-03 08:00:00", "asked"), ("r", "R?", "2026-01-01 08:00:00", "add"), ("r", None, "2026-01-04 08:00:00", "answer"), ("r", "R!", "2026-01-04 09:00:00", "add"),
        ("s", None, "2026-01-04 08:00:00", "answer"), ("z", "Z?", "2026-01-03 08:00:00", "add"), ("z", None, "2026-01-04 08:00:00", "archive"),
    ]
    want = [
        ("q", "added", 0, "open", False), ("q", "already", 1, "open", False), ("q", "duplicate_open", 0, "open", False), ("q", "marked", 1, "open", False), ("q", "marked", 2, "open", True),
        ("r", "added", 0, "open", False), ("r", "answered", 0, "answered", False), ("r", "duplicate_answered", 0, "answered", False), ("s", "unknown", 0, None, False), ("z", "added", 0, "open", False), ("z", "archived", 0, "archived", False),
    ]
    got, keys = run(first)
    assert sorted(got, key=str) == sorted(want, key=str) and keys == {"q", "r"}
    # Time passes: r is forgotten after ten days and may be added anew, q is archived after thirty.
    got, keys = run([("t", "T?", "2026-01-20 08:00:00", "add")])
    assert keys == {"q", "t"}
    got, keys = run([("t", None, "2026-02-10 08:00:00", "asked"), ("r", "R?", "2026-02-10 08:00:00", "add")])
    assert ("q", "expired", 2, "archived", False) in got and keys == {"r", "t"}
    assert ("r", "added", 0, "open", False) in got and sum(x[:2] == ("r", "added") for x in got) == 2


def test_files_of_any_name_are_written_once(spark, tmp_path):
    """One file a name, in a bounded number of folders, whatever the name; lines in order, nothing half written left."""
    names = ["a/b", ".x", "_y", "é %41+ 1", "file=z", "", None, "..", *map(str, range(2000))]
    rows = [(n, i, None if i == 2 else f"{n} {i}") for i in (3, 0, 2, 1) for n in names]
    lines = spark.createDataFrame(rows, "file string, at int, value string")
    path = f"{tmp_path}/out"
    readers.write_files(lines, path, "at", "value")
    found = [x for x in (tmp_path / "out").rglob("*") if x.is_file()]
    assert len(found) == len(names) - 1 and not any(x.name.startswith(".") for x in found)
    assert len({x.parent for x in found}) <= readers.FOLDERS
    read = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    got = {r.name: r.value for r in read.select(readers.file_name().alias("name"), "value").collect()}
    want = {n: "".join(f"{n} {i}\n" for i in (0, 1, 3)) for n in names if n}
    assert got == {**want, "": " 0\nNone 0\n 1\nNone 1\n 3\nNone 3\n"}
    with pytest.raises(ValueError, match="exists"):
        readers.write_files(lines, path)


def test_configuration_is_read_from_one_file_a_name(spark, tmp_path):
    made = spark.range(300).selectExpr("id as file", "if(id % 3 = 0, 'not json', concat('{', chr(10), '\"id\": ', id % 2, '}')) as value")
    readers.write_files(made, f"{tmp_path}/config")
    read = readers.read_config(spark, f"{tmp_path}/config", {"type": "object", "properties": {"id": {"minimum": 1}}})
    got = {int(r.name): r.problems for r in read.select(readers.file_name("file").alias("name"), "problems").collect()}
    assert got == {i: ["$: not JSON"] if i % 3 == 0 else [] if i % 2 else ["$.id: must be >= 1"] for i in range(300)}


def test_logs_below_folders_are_read(spark, tmp_path):
    lines = spark.range(40).selectExpr("id % 20 as file", "id as turn", """concat('{"k": ', id, '}') as value""")
    readers.write_files(lines, f"{tmp_path}/sessions", "turn")
    read = readers.json_lines(spark, f"{tmp_path}/sessions").select(readers.file_name("file").cast("int").alias("name"), "value")
    assert sorted(tuple(r) for r in read.collect()) == sorted((i % 20, f'{{"k": {i}}}') for i in range(40))


def test_digests_are_one_file_a_session(spark, tmp_path):
    """Folders do not grow with the sessions; a message without text is no line."""
    said = spark.range(6000).selectExpr("id % 1500 as session", "-id as at", "'user' as role", "if(id % 1500 = 7, null, cast(id as string)) as text")
    readers.write_digests(said, f"{tmp_path}/out")
    found = [x for x in (tmp_path / "out").rglob("*") if x.is_file()]
    assert len(found) == 1500 and len({x.parent for x in found}) <= readers.FOLDERS
    texts = {x.name: x.read_text() for x in found}
    assert texts["file=3"] == "user: 4503\nuser: 3003\nuser: 1503\nuser: 3\n" and texts["file=7"] == ""


class _Counted:
    """One key's state and timers, counting calls: each is a message between the worker and the JVM."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, []

    def variable(self, name):
        outer, own = self, self.values

        class Variable:
            def __getattr__(self, call):
                def one(*args):
                    outer.calls += 1
                    if call in ("update", "updateValue"):
                        own[name] = args[0] if call == "update" else {*own.get(name, ()), args[0]}
                    elif call == "clear":
                        own.pop(name, None)
                    return {"get": own.get(name), "keys": iter(own.get(name, ())), "exists": name in own, "containsKey": bool(args) and args[0] in own.get(name, ())}.get(call)

                return one

        return Variable()

    def getValueState(self, name, *schema):
        return self.variable(name)

    getMapState = getValueState

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_keys_state_is_read_and_written_once_a_batch():
    handle, made = _Counted(), jobs.QuestionProcessor(7, 1, 3)
    made.init(handle)
    at = datetime(2026, 1, 1)
    rows = [{"at": at, "text": " Q? ", "action": "add"}] + [{"at": at + timedelta(hours=i), "text": None, "action": "asked"} for i in range(1, 100)]
    said = [(r.said, r.asked) for r in made.handleInputRows(("q",), iter(rows), None)]
    assert said.count(("marked", 5)) == 1 and len([x for x in said if x[0] == "already"]) == 94 and handle.calls < 20
    more = [{"at": at + timedelta(days=d), "text": None, "action": a} for d, a in ((4, "asked"), (5, "asked"), (6, "answer"))]
    assert [(r.said, r.asked) for r in made.handleInputRows(("q",), iter(more), None)] == [("already", 5), ("marked", 6), ("answered", 6)]
    assert handle.values["closed"] == ("answered", at.date() + timedelta(days=6)) and len(handle.timers) == 1
    again = [{"at": at + timedelta(days=9), "text": "Q", "action": "add"}, {"at": at + timedelta(days=9), "text": None, "action": "asked"}, {"at": at + timedelta(days=9), "text": None, "action": "archive"}]
    assert [(r.said, r.asked) for r in made.handleInputRows(("q",), iter(again), None)] == [("added", 0), ("marked", 1), ("archived", 1)]
    assert handle.values == {}
