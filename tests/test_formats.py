"""Line files by byte ranges and as a stream, sources as formats, and state that is whole or not there."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import formats, state

LIMIT = 50


def write(path, lines, end=b"\n"):
    path.write_bytes(b"\n".join(x.encode() for x in lines) + end)


def sample(seed=1, n=300):
    r = random.Random(seed)
    return ["".join(r.choice("aé x {}") for _ in range(r.choice([0, 3, 40, 50, 51, 400]))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 10**9])
def test_ranges_cut_no_line_and_repeat_none(tmp_path, size):
    lines = sample()
    write(tmp_path / "x", lines, b"" if size == 7 else b"\n")
    path, total = str(tmp_path / "x"), (tmp_path / "x").stat().st_size
    got = [y for a in range(0, total, size) for y in formats.lines_of(path, a, a + size, LIMIT, chunk=16)]
    assert [text for _, text in got] == [x for x in lines if len(x) <= LIMIT]
    raw = (tmp_path / "x").read_bytes()
    assert all(raw[at:].startswith(text.encode()) and (at == 0 or raw[at - 1 : at] == b"\n") for at, text in got)


def test_a_long_line_is_never_held(tmp_path, monkeypatch):
    (tmp_path / "x").write_bytes(b"short\n" + b"y" * 5_000_000 + b"\nlast")
    seen = []
    monkeypatch.setattr(formats, "_text", lambda parts, limit: seen.append(sum(map(len, parts))) or b"".join(parts).decode())
    assert [t for _, t in formats.lines_of(str(tmp_path / "x"), 0, 10**9, 1000)] == ["short", "last"] and max(seen) <= 5


def test_batch_takes_all_lines_in_ranges(spark, tmp_path):
    formats.register(spark)
    for i in range(3):
        write(tmp_path / f"{i}.jsonl", sample(i))
    (tmp_path / "_SUCCESS").write_text("")
    df = spark.read.format("json_lines").option("limit", LIMIT).option("rangeBytes", 500).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 10
    assert sorted(r.value for r in df.collect()) == sorted(x for i in range(3) for x in sample(i) if len(x) <= LIMIT)


def test_stream_goes_on_without_loss_or_repeats(spark, tmp_path):
    formats.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("json_lines").option("rangeBytes", 100).load(str(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at"))
        query.trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.file.rsplit("/", 1)[-1], r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "a").write_bytes(b"one\ntwo\nunfin")
    assert run() == [("a", "one"), ("a", "two")]
    assert run() == [("a", "one"), ("a", "two")]
    with (folder / "a").open("ab") as f:
        f.write(b"ished\nthree\n")
    (folder / "b").write_bytes(b"four\n" * 100)
    assert run() == [("a", "one"), ("a", "three"), ("a", "two"), ("a", "unfinished")] + [("b", "four")] * 100


def source(**more):
    given = {"id": "cal", "kind": "connector", "required": False, "schema": "calendar string, day string"}
    given |= {"collect": lambda window, config: [[(c, d) for d in window] for c in config["calendars"]], "read_evidence": lambda record, plan: {}, "server_spec": lambda c: {}, "tool_rules": lambda c: {}}
    return formats.Source(**(given | more))


def test_a_source_is_a_format(spark):
    formats.register(spark, source())
    df = spark.read.format("cal").option("from", "2024-01-01").option("to", "2024-01-08").option("config", '{"calendars": ["x", "y"]}').load()
    assert df.rdd.getNumPartitions() == 2
    assert sorted(tuple(r) for r in df.collect()) == [("x", "2024-01-01"), ("x", "2024-01-08"), ("y", "2024-01-01"), ("y", "2024-01-08")]
    assert spark.read.format("cal").option("from", "a").option("to", "b").option("config", '{"calendars": []}').load().count() == 0


@pytest.mark.parametrize(
    "more,said",
    [
        ({"id": "Cal"}, "source.id: must be a lower case identifier"), ({"kind": "remote"}, "source.kind: must be one of local, connector"), ({"required": None}, "source.required: must be a boolean"),
        ({"collect": 3}, "source.collect: must be a function"), ({"server_spec": None}, "source.server_spec: must be a function in a connector source"),
        ({"kind": "local", "tool_rules": 1}, "source.tool_rules: must be a function when present"), ({"empty_means_nothing_listed": 1}, "source.empty_means_nothing_listed: must be a boolean when present"),
    ],
)
def test_what_a_source_lacks_is_told(spark, more, said):
    assert formats.validate_source(source(**more)) == [said]
    with pytest.raises(ValueError, match="source"):
        formats.register(spark, source(**more))


def test_a_whole_source_lacks_nothing():
    assert formats.validate_source(source()) == [] and formats.validate_source(source(kind="local", server_spec=None, tool_rules=None)) == []
    assert formats.validate_source([1]) == ["source: must be an object"]


def held(spark, path, **more):
    found = state.read_state(spark, path, **more)
    return None if found is None else sorted(r.n for r in found.collect())


def test_the_highest_whole_version_is_read(spark, tmp_path):
    path, rows = str(tmp_path / "s"), lambda *n: spark.createDataFrame([(x,) for x in n], "n long").repartition(2)
    assert state.read_state(spark, path) is None
    for v in range(12):
        state.write_state(rows(v, v + 1), path, v)
    assert held(spark, path) == [11, 12] and held(spark, path, below=11) == [10, 11] and len(state.versions(spark, path)) == state.SLOTS
    # Data without its manifest, as when the driver is lost between the two: what was there before is read.
    rows(99).write.parquet(f"{path}/version=12")
    assert held(spark, path) == [11, 12]
    # A version written again that lost its driver halfway: its manifest is of other files.
    rows(99).write.mode("overwrite").parquet(f"{path}/version=11")
    assert held(spark, path) == [10, 11] and state.versions(spark, path)[0][::2] == (11, False)
    # Files that are fewer than the manifest says, as while they are moved.
    next((tmp_path / "s" / "version=10").glob("*.parquet")).unlink()
    assert held(spark, path) == [9, 10]
    # The batch runs again.
    state.write_state(rows(5), path, 11)
    assert held(spark, path) == [5]


def test_no_whole_version_is_an_error_and_an_empty_state_is_none(spark, tmp_path):
    path = str(tmp_path / "s")
    state.write_state(spark.createDataFrame([(1,)], "n long"), path, 3)
    next((tmp_path / "s" / "version=3").glob("*.parquet")).unlink()
    with pytest.raises(state.StateError):
        state.read_state(spark, path)
    state.write_state(spark.createDataFrame([], "n long"), path, 4)
    assert held(spark, path, schema="n long") == []
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_ranges_grow_with_what_is_read():
    reader = formats.LineReader({"path": "x", "rangeBytes".lower(): "10"})
    assert len(reader.spans([("a", 0, 1000)])) == 100
    spans = reader.spans([("a", 0, 1_000_000), ("b", 500, 1_000_000)])
    assert len(spans) <= formats.RANGES + 2
    assert [(s.start, s.end) for s in spans if s.path == "b"][0][0] == 500 and spans[-1].end == 1_000_000
    assert all(x.end == y.start for x, y in zip(spans, spans[1:], strict=False) if x.path == y.path)
    assert len(reader.spans([("a", 0, 1 << 40)])) == (1 << 40) // formats.RANGE_BYTES
