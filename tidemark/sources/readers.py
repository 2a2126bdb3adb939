"""Readers and sinks: note folders, published sets, JSON lines, event streams, push records, state tables, reports."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable
from urllib.parse import quote
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.operators.gates import schema_problems
from tidemark.operators.staging import spread
from tidemark.sources import formats
from tidemark.sources.state import read_state, write_state  # noqa: F401  written and read here until now

MAX_BYTES = 100 << 20
MAX_LINE = 32 << 20
#: Folders over which `write_files` deals files.
FOLDERS = 1024


def walk(spark: SparkSession, root: str, all_files: bool = False, dot_entries: bool = False, ignore: tuple[str, ...] = ()) -> DataFrame:
    """path, bytes, mtime, content of the files below a folder: Markdown only unless all, no node_modules, no .git."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if not all_files:
        reader = reader.option("pathGlobFilter", "*.[mM][dD]")
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.substring_index("path", base, -1), r"\A/+", "")
    df = reader.load(root).select(path.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), "content")
    keep = ~F.rlike("path", F.lit(r"(?:\A|/)(?:node_modules|\.git)/"))
    if not dot_entries:
        keep = keep & ~F.rlike("path", F.lit(r"(?:\A|/)\."))
    for x in ignore:
        keep = keep & ~((F.col("path") == x) | F.startswith("path", F.lit(x + "/")))
    return df.where(keep)


def decoded(content: Column) -> Column:
    """UTF-8 if it is valid, else Latin-1; without a byte order mark, line ends as LF."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(F.regexp_replace(text, "\\A\ufeff", ""), r"\r\n?", "\n")


@F.pandas_udf(StringType())
def repaired(contents):
    """Latin-1 text whose embedded UTF-8 runs are read as such."""
    import re

    run = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")

    def one(data):
        data, out, at = bytes(data), [], 0
        for m in run.finditer(data):
            try:
                good = m.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [data[at : m.start()].decode("latin-1"), good]
            at = m.end()
        return "".join([*out, data[at:].decode("latin-1")])

    return contents.map(one, na_action="ignore")


def notes(files: DataFrame) -> DataFrame:
    return files.select("path", decoded(F.col("content")).alias("text"))


def scan_bytes(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Files to scan; those past the limit are told apart instead of read."""
    return files.select("path", (F.col("bytes") > most).alias("too_large"), F.when(F.col("bytes") <= most, F.col("content")).alias("content"))


def published(spark: SparkSession, root: str) -> DataFrame:
    """Tracked and untracked paths that are not ignored, listed by git on the driver: name lists only."""
    said = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True).stdout
    names = [(os.fsdecode(x), b"\xff" not in x) for x in said.split(b"\0") if x]
    return spark.createDataFrame(sorted(set(names)), "path string, decodable boolean")


def note_set(walked: DataFrame, listing: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Walked files that are published, and those that are not; without a listing all count as published."""
    if listing is None:
        return walked, walked.where("false")
    return walked.join(listing, "path", "left_semi"), walked.join(listing, "path", "left_anti")


def json_lines(spark: SparkSession, path: str, longest: int = MAX_LINE, modified_after: str | None = None) -> DataFrame:
    """file, value, v: lines as variants, null where a line is not JSON; longer lines are left out whole."""
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("modifiedAfter", modified_after) if modified_after else reader
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.where(F.length("value") <= longest).withColumn("v", F.try_parse_json("value"))


def transcript(lines: DataFrame) -> DataFrame:
    """file, at, role, text of the human and assistant messages of JSON lines; what the harness wrote is left out."""
    get = lambda p, t="string": F.try_variant_get("v", f"$.{p}", t)
    flag = lambda p: F.coalesce(get(p, "boolean"), F.lit(False))
    content = F.try_variant_get("v", "$.message.content", "string")
    blocks = F.from_json(F.get_json_object("value", "$.message.content"), "array<struct<type:string,text:string>>")
    told = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    is_list = F.startswith(F.get_json_object("value", "$.message.content"), F.lit("["))
    df = lines.select("file", F.try_to_timestamp(get("timestamp")).alias("at"), get("type").alias("role"), F.when(is_list, told).otherwise(content).alias("text"), (flag("isMeta") | flag("isSidechain") | flag("isCompactSummary") | flag("isVisibleInTranscriptOnly")).alias("marked"), get("origin.kind").alias("origin"))
    human = (F.col("role") != "user") | F.coalesce(F.col("origin") == "human", F.lit(True))
    return df.where(F.col("role").isin("user", "assistant") & ~F.col("marked") & human & F.col("at").isNotNull() & (F.coalesce(F.col("text"), F.lit("")) != "")).drop("marked", "origin")


def run_record(lines: DataFrame) -> dict[str, DataFrame]:
    """Tool uses, tool results and the outcome of a recorded run (file, value, v); bad lines are counted, not lost."""
    get = lambda p, t="string": F.try_variant_get("v", f"$.{p}", t)
    block = "array<struct<type:string,id:string,name:string,tool_use_id:string,is_error:boolean,content:string,input:string>>"
    parts = lines.select("file", get("type").alias("kind"), F.explode(F.from_json(F.get_json_object("value", "$.message.content"), block)).alias("b"))
    uses = parts.where("kind = 'assistant' and b.type = 'tool_use'").select("file", "b.id", "b.name", F.try_parse_json("b.input").alias("input"))
    results = parts.where("kind = 'user' and b.type = 'tool_result'").select("file", F.col("b.tool_use_id").alias("tool_use_id"), F.coalesce("b.is_error", F.lit(False)).alias("failed"), page("b.content").alias("page"))
    outcome = lines.where(get("type") == "result").select("file", get("subtype").alias("subtype"), get("is_error", "boolean").alias("is_error"), get("num_turns", "int").alias("turns"), get("total_cost_usd", "double").alias("cost"))
    return {"tool_uses": uses, "tool_results": results.select("file", "tool_use_id", "failed", "page.*"), "result": outcome, "invalid": lines.where("v is null").groupBy("file").agg(F.count("*").alias("n"))}


def page(content: str | Column) -> Column:
    """Whether a result is one whole JSON page, names a next one, and how many items it holds."""
    c = F.col(content) if isinstance(content, str) else content
    v = F.try_parse_json(c)
    items = F.coalesce(F.json_array_length(F.get_json_object(c, "$.events")), F.json_array_length(F.get_json_object(c, "$.files")))
    return F.struct(v.isNotNull().alias("complete"), (F.coalesce(F.try_variant_get(v, "$.nextPageToken", "string"), F.lit("")) != "").alias("has_next"), items.alias("items"))


ARITY = {"blob": 3, "commit": 1, "tip": 1, "ref": 2}


def push_records(files: DataFrame) -> DataFrame:
    """file, seq, kind, fields, problem of NUL-framed push records in binary files (path, content).

    A record is a kind and its fields; an unknown kind or a short record is an error row.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                parts = [x.decode("utf-8", "replace") for x in bytes(content).split(b"\0")]
                rows += parse_records(path, parts[:-1] if parts[-1:] == [""] else parts)
            yield pd.DataFrame(rows, columns=["file", "seq", "kind", "fields", "problem"])

    schema = "file string, seq int, kind string, fields array<string>, problem string"
    return files.select("path", "content").mapInPandas(run, schema)


def parse_records(file: str, parts: list[str]):
    at = seq = 0
    while at < len(parts):
        kind = parts[at]
        if kind not in ARITY:
            yield file, seq, kind, [], "unknown kind"
            return
        fields = parts[at + 1 : at + 1 + ARITY[kind]]
        yield file, seq, kind, fields, None if len(fields) == ARITY[kind] else "short record"
        at, seq = at + 1 + ARITY[kind], seq + 1


def framed(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """file, chunk, place, value of the NUL-ended tokens of files; a chunk is a range of bytes."""
    formats.register(spark)
    tokens = spark.read.format("json_lines").option("separator", "nul").option("rangeBytes", range_bytes).load(path)
    return tokens.select("file", F.floor(F.col("place") / range_bytes).alias("chunk"), "place", "value")


def parallel_records(tokens: DataFrame) -> DataFrame:
    """file, place, kind, fields, problem of the push records in tokens (file, chunk, place, value), as `push_records`.

    Where a record starts depends on all before it. So each chunk first tells, for each number of fields that may be
    open where it starts, how many are open where it ends and where its last record starts: a map of four states. The
    maps of a file, one small row a chunk, are composed in order, which gives every chunk its start; then each chunk
    names the record of each of its tokens on its own.
    """
    width = max(ARITY.values()) + 1

    def walk(values, places, state: int, record):
        """(record, token's number in it) for each token; state: fields still open, -1 after an unknown kind."""
        at = 0
        for value, place in zip(values, places, strict=True):
            if state < 0:
                yield None, 0, state, record
                continue
            if state == 0:
                record, at, state = place, 0, ARITY.get(value, -1)
            else:
                at, state = at + 1, state - 1
            yield record, at, state, record

    def maps(key, table):
        table = table.sort_by("place")
        values, places = table.column("value").to_pylist(), table.column("place").to_pylist()
        ends, last = [], []
        for s in range(width):
            *_, (_, _, state, record) = walk(values, places, s, None)
            ends.append(state)
            last.append(record)
        return pa.table({"file": [key[0].as_py()], "chunk": pa.array([key[1].as_py()], pa.int64()), "ends": pa.array([ends], pa.list_(pa.int32())), "last": pa.array([last], pa.list_(pa.int64()))})

    told = tokens.groupBy("file", "chunk").applyInArrow(maps, "file string, chunk long, ends array<int>, last array<long>")
    def compose(key, table):
        table = table.sort_by("chunk")
        states, records, state, record = [], [], 0, None
        for ends, last in zip(table.column("ends").to_pylist(), table.column("last").to_pylist(), strict=True):
            states.append(state)
            records.append(record)
            if state >= 0:
                record = record if last[state] is None else last[state]
                state = ends[state]
        return pa.table({"file": table.column("file"), "chunk": table.column("chunk"), "state": pa.array(states, pa.int32()), "record": pa.array(records, pa.int64())})

    starts = told.groupBy("file").applyInArrow(compose, "file string, chunk long, state int, record long")

    def named(key, table):
        table = table.sort_by("place")
        state, record = table.column("state")[0].as_py(), table.column("record")[0].as_py()
        found = [r for r, _, _, _ in walk(table.column("value").to_pylist(), table.column("place").to_pylist(), state, record)]
        return pa.table({"file": table.column("file"), "record": pa.array(found, pa.int64()), "place": table.column("place"), "value": table.column("value")})

    whole = tokens.join(starts, ["file", "chunk"]).groupBy("file", "chunk").applyInArrow(named, "file string, record long, place long, value string")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])
    out = whole.where("record is not null").groupBy("file", F.col("record").alias("place")).agg(parts.alias("parts"))
    kind, fields = F.get("parts", F.lit(0)), F.slice("parts", 2, width)
    arity = F.create_map(*(F.lit(x) for pair in ARITY.items() for x in pair))
    needed = F.try_element_at(arity, kind)
    problem = F.when(needed.isNull(), "unknown kind").when(F.size(fields) < needed, "short record")
    return out.select("file", "place", kind.alias("kind"), fields.alias("fields"), problem.alias("problem"))


#: sources by id: local ones have a plan, connector ones the evidence that they were read
SOURCES: dict[str, dict] = {}


def problems_of(source: dict) -> list[str]:
    """What a source lacks: its id, a known kind, its functions."""
    out = [f"{k} is missing" for k in ("id", "kind", "collect", "read_evidence") if k not in source]
    if source.get("kind") not in (None, "local", "connector"):
        out.append("kind must be local or connector")
    return out + [f"{k} must be a function" for k in ("collect", "read_evidence") if k in source and not isinstance(source[k], Callable)]


def register_source(source: dict) -> None:
    if found := problems_of(source):
        raise ValueError(f"source {source.get('id')}: {'; '.join(found)}")
    SOURCES[source["id"]] = source


def read_config(spark: SparkSession, path: str, schema: dict) -> DataFrame:
    """file, config (a variant, null if it is not JSON) and problems of configuration files under a schema."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    # A task reads some dozen small files, too few for what the schema's expression costs a task.
    held = spread(files.select(F.col("_metadata.file_path").alias("file"), "value"), "file")
    read = held.select("file", F.try_parse_json("value").alias("config"))
    wrong = F.when(F.col("config").isNull(), F.array(F.lit("$: not JSON")))
    return read.withColumn("problems", F.coalesce(wrong, schema_problems(F.col("config"), schema)))


def write_files(lines: DataFrame, path: str, *order: str | Column) -> None:
    """A text file for each name in lines (file, value), its lines in order; a null value is no line, a null name empty.

    A writer partitioned by name makes, renames and lists a folder for each, in as few tasks as the bytes need; here all
    tasks write, each file once. Files lie in folders by a hash of their names (`file_name` gives the name back). A file is
    written under a hidden name and moved when it is whole, so a task that is run again leaves the same files.
    """
    where, root = formats.opened(path)
    if where.get_file_info(root).type != fs.FileType.NotFound:
        raise ValueError(f"{path} exists")
    where.create_dir(root, recursive=True)

    def write(batches):
        where, root = formats.opened(path)
        attempt, made, name, out, at, hidden = TaskContext.get().taskAttemptId(), set(), None, None, "", ""
        for batch in batches:
            for file, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if out is None or file != name:
                    if out is not None:
                        out.close()
                        where.move(hidden, at)
                    name, told = file, f"file={quote(file, safe='')}"
                    folder = f"{root}/{crc32(told.encode()) % FOLDERS:03x}"
                    if folder not in made:
                        where.create_dir(folder, recursive=True)
                        made.add(folder)
                    at, hidden = f"{folder}/{told}", f"{folder}/.{attempt}-{told}"
                    out = where.open_output_stream(hidden)
                if value is not None:
                    out.write(f"{value}\n".encode())
        if out is not None:
            out.close()
            where.move(hidden, at)
        yield pa.record_batch({"done": pa.array([True])})

    dealt = spread(lines.withColumn("file", F.coalesce(F.col("file").cast("string"), F.lit(""))), "file").sortWithinPartitions("file", *order)
    dealt.select("file", "value").mapInArrow(write, "done boolean").agg(F.count("*")).collect()


def file_name(path: str | Column = "_metadata.file_path") -> Column:
    """The name under which `write_files` wrote a file, from its path."""
    # A path is a URI: what the file's own name has escaped is escaped in it once more.
    return F.url_decode(F.url_decode(F.regexp_extract(path, r"/file=([^/]*)\z", 1)))


def write_digests(messages: DataFrame, path: str) -> None:
    """One text file a session, its lines in time order."""
    line = F.concat("role", F.lit(": "), "text")
    write_files(messages.withColumns({"file": F.col("session"), "value": line}), path, "at", "role", "text")


def write_report(findings: DataFrame, path: str, version: str) -> None:
    """Findings as JSON lines with the report's version, beside a summary."""
    findings.withColumn("version", F.lit(version)).write.mode("overwrite").json(f"{path}/findings")
    findings.groupBy("level").agg(F.count("*").alias("n")).withColumn("version", F.lit(version)).write.mode("overwrite").json(f"{path}/summary")


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def pruned(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))


