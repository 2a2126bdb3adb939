"""Sources as Spark formats: `spark.read.format(id)` and `spark.readStream.format(id)`.

* A source is an object of a known shape (`validate_source`); `register` makes it a format under its id. Connector
  sources and plans are read one partition a window.
* `json_lines` reads line files by byte ranges, in parallel within a file. A line belongs to the range in which it
  starts. A line over the limit is passed over without being held: at most 4 bytes a character of the limit are. As a
  stream, its offset is the end of the last whole line of each file, so what is appended later is read once, and a
  stopped query goes on from its checkpoint without loss or repeats.

Option `separator` is `nul` for files whose lines end with NUL bytes.

Paths are opened on the executors through Arrow's file systems (local paths and the schemes it knows).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

CHUNK = 256 << 10
#: Characters of the longest line that is taken.
MAX_LINE = 32 << 20
RANGE_BYTES = 64 << 20
#: Ranges grow with what is read, so that there are about so many at first, and none above `RANGE_BYTES` for it.
RANGES = 200
_LF = b"\n"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> dict[str, int]:
    """Files (path: bytes) at or below a path; hidden and marker files are left out."""
    where, at = opened(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.File:
        return {path: info.size}
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = where.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return {prefix + x.path: x.size for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))}


def last_line_end(path: str, start: int, size: int, sep: bytes = _LF) -> int:
    """Where the last whole line that ends after `start` ends; `start` if none does. Reads back from the end."""
    where, at = opened(path)
    with where.open_input_file(at) as f:
        while size > start:
            begin = max(start, size - CHUNK)
            found = f.read_at(size - begin, begin).rfind(sep)
            if found >= 0:
                return begin + found + 1
            size = begin
    return start


def lines_of(path: str, start: int, end: int, limit: int = MAX_LINE, chunk: int = CHUNK, sep: bytes = _LF) -> Iterator[tuple[int, str]]:
    """(place, text) of the lines that start in [start, end): place is the byte where a line starts.

    The last line may lack its end. A line of more than `limit` characters is passed over."""
    where, path = opened(path)
    with where.open_input_file(path) as f:
        size = f.size()
        end = min(end, size)
        at = start
        if start > 0:  # the line that runs into the range belongs to another
            at, found = start - 1, -1
            while found < 0:
                if at >= end:
                    return
                data = f.read_at(min(chunk, end - at), at)
                found = data.find(sep)
                at += len(data) if found < 0 else found + 1
        first, held, kept = at, [], 0
        while at < size and first < end:
            data, begin = f.read_at(min(chunk, size - at), at), 0
            while (found := data.find(sep, begin)) >= 0:
                if kept <= 4 * limit and (text := _text([*held, data[begin:found]], limit)) is not None:
                    yield first, text
                held, kept, begin = [], 0, found + 1
                first = at + begin
                if first >= end:
                    return
            at += len(data)
            kept += len(data) - begin
            held = [*held, data[begin:]] if kept <= 4 * limit else []
            if kept > 4 * limit and at >= end:  # nothing else starts in the range
                return
        if first < end and held and (text := _text(held, limit)) is not None:
            yield first, text


def _text(parts: list[bytes], limit: int) -> str | None:
    text = b"".join(parts).decode("utf-8", "replace")
    return text if len(text) <= limit else None


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int


_LINES = pa.schema([("file", pa.string()), ("place", pa.int64()), ("value", pa.string())])


class _Lines:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options.get("limit", MAX_LINE))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.sep = b"\0" if options.get("separator") == "nul" else _LF

    def spans(self, parts: list[tuple[str, int, int]]) -> list[Span]:
        """Ranges of files' parts (path, start, end), a task each."""
        size = max(self.range_bytes, min(RANGE_BYTES, sum(end - start for _, start, end in parts) // RANGES))
        return [Span(path, a, min(end, a + size)) for path, start, end in parts for a in range(start, end, size)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for place, text in lines_of(part.path, part.start, part.end, self.limit, sep=self.sep):
            rows.append((part.path, place, text))
            size += len(text)
            if len(rows) >= 4096 or size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LINES.types, strict=True)], schema=_LINES)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LINES.types, strict=True)], schema=_LINES)


class LineReader(_Lines, DataSourceReader):
    def partitions(self) -> list[Span]:
        return self.spans([(path, 0, size) for path, size in sorted(listed(self.path).items())]) or [Span("", 0, 0)]

    def read(self, part: Span):
        return super().read(part) if part.path else iter(())


class LineStream(_Lines, DataSourceStreamReader):
    """Offsets are the ends of whole lines by file."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"ends": {}}

    def latestOffset(self) -> dict:
        # A file's unfinished line waits; what was found before is where the search stops.
        ends = dict(self.known)
        for path, size in listed(self.path).items():
            ends[path] = last_line_end(path, ends.get(path, 0), size, self.sep)
        self.known = {p: e for p, e in ends.items() if e > 0}
        return {"ends": self.known}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        # After a restart this reader knows no ends; those of the checkpoint are the least.
        self.known = {**start["ends"], **end["ends"], **{p: max(e, self.known.get(p, 0)) for p, e in end["ends"].items()}}
        return self.spans([(path, start["ends"].get(path, 0), stop) for path, stop in sorted(end["ends"].items())])

    def commit(self, end: dict) -> None:
        """Nothing is held for what is behind an offset."""


class JsonLines(DataSource):
    """file, place, value: lines of files, for `readers.json_lines` and the transcript source."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        return "file string, place long, value string"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LineStream(self.options)


# --- sources -------------------------------------------------------------------------------------------------------

KINDS = ("local", "connector")


@dataclass(frozen=True)
class Source:
    """What a round reads. `collect(window, config)` gives its plan: rows of `schema`, in parts that tasks read."""

    id: str
    kind: str
    required: bool
    collect: Callable
    read_evidence: Callable
    schema: str
    empty_means_nothing_listed: bool = True
    is_configured: Callable | None = None
    server_spec: Callable | None = None
    tool_rules: Callable | None = None


def validate_source(source) -> list[str]:
    """What an object lacks to be a source; empty if nothing."""
    get = lambda name: getattr(source, name, None)
    if source is None or isinstance(source, (str, int, float, list, dict)):
        return ["source: must be an object"]
    out = []
    if not isinstance(get("id"), str) or not re.fullmatch(r"[a-z][a-z0-9_]*", get("id")):
        out.append("source.id: must be a lower case identifier")
    if get("kind") not in KINDS:
        out.append(f"source.kind: must be one of {', '.join(KINDS)}")
    if not isinstance(get("required"), bool):
        out.append("source.required: must be a boolean")
    out += [f"source.{name}: must be a function" for name in ("collect", "read_evidence") if not callable(get(name))]
    if not isinstance(get("empty_means_nothing_listed"), (bool, type(None))):
        out.append("source.empty_means_nothing_listed: must be a boolean when present")
    for name in ("is_configured", "server_spec", "tool_rules"):
        needed = get("kind") == "connector" and name != "is_configured"
        if not callable(get(name)) and (needed or get(name) is not None):
            out.append(f"source.{name}: must be a function{' in a connector source' if needed else ' when present'}")
    return out


@dataclass
class Part(InputPartition):
    index: int
    rows: list


def format_of(source: Source) -> type[DataSource]:
    """A format under the source's id; options from, to (days) and config (JSON) are its window and settings."""

    class PlanReader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            window = (self.options["from"], self.options["to"])
            config = json.loads(self.options.get("config", "{}"))
            return [Part(i, rows) for i, rows in enumerate(source.collect(window, config))] or [Part(0, [])]

        def read(self, part):
            yield from part.rows

    class SourceFormat(DataSource):
        @classmethod
        def name(cls):
            return source.id

        def schema(self):
            return source.schema

        def reader(self, schema):
            return PlanReader(self.options)

    return SourceFormat


def register(spark: SparkSession, source: Source | None = None) -> None:
    """Make a source a format of this session, or the line format if none is given."""
    if source is None:
        spark.dataSource.register(JsonLines)
        return
    if found := validate_source(source):
        raise ValueError("; ".join(found))
    spark.dataSource.register(format_of(source))
