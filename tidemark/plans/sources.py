"""Queries of readers and sinks (S01-S03, S05-S10, S12, S15, S16, S19, S21, E01, E05, E07, B01): tables written as files
to the folder that all executors share, then read back by the readers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import rules as R
from tidemark.operators.checks import run_checks
from tidemark.operators.staging import shared_folder
from tidemark.sources import formats, readers
from tidemark.streaming import jobs

from .gates import DOCUMENTS, SCHEMA
from .tables import query


def _folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _written(t, name: str) -> str:
    """The documents' ids as text files in a folder a source, beside folders that a walk leaves out."""
    path = _folder(t, name)
    rows = t("documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.col("doc_id").cast("string").alias("value"))
    rows.repartition("source").write.partitionBy("source").text(path)
    rows.where("source = 'src1'").select("value").write.text(f"{path}/node_modules/a")
    rows.where("source = 'src1'").select("value").write.text(f"{path}/drafts")
    return path


def _ids(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode(F.split(F.trim(readers.decoded(F.col("content"))), r"\n")).alias("id"))


_SOURCES = "SELECT coalesce(source, 'none') AS source, doc_id FROM documents"


@query("S01_walk", f"SELECT source, count(*) AS n FROM ({_SOURCES}) GROUP BY 1")
def walk(t):
    """A folder walked: modules and ignored folders left out, all the rest by relative path."""
    files = readers.walk(t.spark, _written(t, "walk"), all_files=True, ignore=("drafts",))
    source = F.regexp_extract("path", r"\Asource=([^/]*)/", 1)
    return _ids(files).where("id <> ''").groupBy(source.alias("source")).agg(F.count("*").alias("n"))


@query("S03_note_set", "SELECT o_orderstatus IN ('O', 'F') AS published, count(*) AS n FROM orders GROUP BY 1")
def note_set(t):
    """Walked files that are published, and how many are not."""
    walked = t("orders").select(F.col("o_orderkey").cast("string").alias("path"), "o_orderstatus")
    listing = walked.where(F.col("o_orderstatus").isin("O", "F")).select("path")
    inside, outside = readers.note_set(walked, listing)
    both = inside.select(F.lit(True).alias("published")).unionByName(outside.select(F.lit(False).alias("published")))
    return both.groupBy("published").agg(F.count("*").alias("n"))


@query("S05_byte_read", "SELECT doc_id, strlen(coalesce(text, '')) > 2000 AS too_large, CASE WHEN strlen(coalesce(text, '')) <= 2000 THEN md5(coalesce(text, '')) END AS sum FROM documents")
def byte_read(t):
    """Bytes to scan; what is past the limit is told apart instead of read."""
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    files = t("documents").select(F.col("doc_id").alias("path"), content.alias("content"), F.octet_length(content).alias("bytes"))
    read = readers.scan_bytes(files, 2000)
    return read.select(F.col("path").alias("doc_id"), "too_large", F.md5("content").alias("sum"))


@query("S06_lenient_decode", "SELECT c_custkey, 'caf' || chr(233) || ' ' || c_name AS text, CASE WHEN c_custkey % 3 = 0 THEN chr(233) || ' ' || chr(8364) ELSE chr(233) END AS repaired FROM customer")
def lenient_decode(t):
    """UTF-8 where it is valid, else Latin-1; embedded UTF-8 in Latin-1 is read as such by the repair."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("café "), "c_name")
    raw = F.when(k % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    mixed = F.when(k % 3 == 0, F.unhex(F.lit("E920E282AC"))).otherwise(F.unhex(F.lit("E9")))
    return t("customer").select("c_custkey", readers.decoded(raw).alias("text"), readers.repaired(mixed).alias("repaired"))


def _lines(t) -> str:
    """Events as JSON lines, one in seven of them broken and one in eleven too long."""
    path, k = _folder(t, "lines"), F.col("event_id")
    whole = F.to_json(F.struct("event_id", "user_id", F.col("event_type").alias("type")))
    value = F.when(k % 7 == 0, F.concat(F.lit("{broken "), k.cast("string"))).when(k % 11 == 0, F.rpad(whole, 400, " ")).otherwise(whole)
    t("events").select(value.alias("value")).write.text(path)
    return path


@query("S07_json_lines", "SELECT event_id % 7 <> 0 AS json, count(*) AS n FROM events WHERE event_id % 7 = 0 OR event_id % 11 <> 0 GROUP BY 1")
def json_lines(t):
    """Lines of a log as variants; longer ones are left out whole, what is not JSON is counted."""
    formats.register(t.spark)
    lines = t.spark.read.format("json_lines").option("limit", 300).option("rangeBytes", 100_000).load(_lines(t))
    read = lines.withColumn("v", F.try_parse_json("value"))
    return read.groupBy(F.col("v").isNotNull().alias("json")).agg(F.count("*").alias("n"))


@query("S08_transcripts", "SELECT conv_id, role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE role IN ('user', 'assistant') AND turn % 5 <> 4 AND coalesce(text, '') <> '' GROUP BY ALL")
def transcripts(t):
    """Messages of session logs: flagged lines and other kinds are left out, blocks are joined."""
    path = _folder(t, "sessions")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("thinking").alias("type"), F.lit("no").alias("text")))
    at = F.concat(F.lit("2026-01-01T00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00Z"))
    plain = F.to_json(F.struct(F.col("role").alias("type"), at.alias("timestamp"), (F.col("turn") % 5 == 4).alias("isMeta"), F.col("conv_id").alias("c"), F.struct(F.col("text").alias("content")).alias("message")))
    listed = F.to_json(F.struct(F.col("role").alias("type"), at.alias("timestamp"), (F.col("turn") % 5 == 4).alias("isMeta"), F.col("conv_id").alias("c"), F.struct(block.alias("content")).alias("message")))
    lines = t("conversations").where("text is not null").select(F.col("conv_id").alias("file"), "turn", F.when(F.col("role") == "assistant", listed).otherwise(plain).alias("value"))
    readers.write_files(lines, path, "turn")
    read = readers.transcript(readers.json_lines(t.spark, path))
    conv = readers.file_name("file").cast("long")
    return read.groupBy(conv.alias("conv_id"), "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("S12_state", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def state(t):
    """A state written in two versions: the higher one is read."""
    path = _folder(t, "state")
    readers.write_state(t("lineitem").where("l_linenumber = 1").groupBy("l_returnflag").agg(F.count("*").alias("n")), path, 1)
    readers.write_state(t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")), path, 2)
    return readers.read_state(t.spark, path)


@query("S15_stream_parser", "SELECT 'uses' AS part, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'failed', count(*) FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 UNION ALL SELECT 'more', count(*) FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 2 = 1 AND o_orderkey % 5 = 0 UNION ALL SELECT 'turns', CAST(sum(o_orderkey % 50) AS BIGINT) FROM orders WHERE o_orderkey % 4 = 2 UNION ALL SELECT 'invalid', count(*) FROM orders WHERE o_orderkey % 4 = 3")
def stream_parser(t):
    """A run's record: tool uses, their results and pages, the outcome, and the lines that are none."""
    path, k = _folder(t, "record"), F.col("o_orderkey")
    s = k.cast("string")
    token = F.when(k % 5 == 0, F.lit('\\"nextPageToken\\": \\"t\\", ')).otherwise("")
    line = (
        F.when(k % 4 == 0, F.concat(F.lit('{"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "u'), s, F.lit('", "name": "list", "input": {"a": 1}}]}}')))
        .when(k % 4 == 1, F.concat(F.lit('{"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "u'), s, F.lit('", "is_error": '), (k % 3 == 0).cast("string"), F.lit(', "content": "{'), token, F.lit('\\"events\\": [1, 2]}"}]}}')))
        .when(k % 4 == 2, F.concat(F.lit('{"type": "result", "subtype": "success", "is_error": false, "num_turns": '), (k % 50).cast("string"), F.lit("}")))
        .otherwise("not a line")
    )
    t("orders").select(line.alias("value")).write.text(path)
    read = readers.run_record(readers.json_lines(t.spark, path))
    told = lambda name, df: df.select(F.lit(name).alias("part"), "n")
    count = F.count("*").alias("n")
    results = read["tool_results"]
    out = told("uses", read["tool_uses"].agg(count))
    out = out.unionByName(told("failed", results.where("failed").agg(count))).unionByName(told("more", results.where("has_next").agg(count)))
    out = out.unionByName(told("turns", read["result"].agg(F.sum("turns").alias("n"))))
    return out.unionByName(told("invalid", read["invalid"].agg(F.sum("n").alias("n"))))


@query("S16_push_records", "SELECT c_custkey, kind, problem FROM customer, (VALUES (0, 'commit', NULL), (1, 'blob', NULL), (2, 'what', 'unknown kind'), (3, 'ref', 'short record')) AS v(i, kind, problem) WHERE i < 2 OR (i = 2 AND c_custkey % 3 = 1) OR (i = 3 AND c_custkey % 3 = 2)")
def push_records(t):
    """Records of a push, framed by NULs; what is unknown or short is an error row."""
    k = F.col("c_custkey")
    tail = F.when(k % 3 == 1, "what\0x\0").when(k % 3 == 2, "ref\0x\0").otherwise("")
    raw = F.concat(F.lit("commit\0"), k.cast("string"), F.lit("\0blob\0a\x00100644\0a.md\0"), tail)
    files = t("customer").select(k.cast("string").alias("path"), F.encode(raw, "UTF-8").alias("content"))
    return readers.push_records(files).select(F.col("file").cast("long").alias("c_custkey"), "kind", "problem")


@query("S16_parallel_records", """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'blob' WHEN '2-HIGH' THEN 'commit' WHEN '3-MEDIUM' THEN 'tip' ELSE 'ref' END AS kind, NULL AS problem, count(*) AS n,
  CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1""")
def parallel_records(t):
    """Records of pushes in files that are read by ranges: boundaries found by composing what each range does to them."""
    path, p, k = _folder(t, "pushes"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    parts = F.when(p == "1-URGENT", F.array(F.lit("blob"), k, F.lit("100644"), F.lit("ref"))).when(p == "2-HIGH", F.array(F.lit("commit"), k)).when(p == "3-MEDIUM", F.array(F.lit("tip"), k)).otherwise(F.array(F.lit("ref"), k, F.lit("blob")))
    t("orders").select(F.array_join(parts, "\0").alias("value")).write.option("lineSep", "\0").text(path)
    found = readers.parallel_records(readers.framed(t.spark, path, range_bytes=20_000))
    return found.groupBy("kind", "problem").agg(F.count("*").alias("n"), F.sum(F.get("fields", F.lit(0)).cast("long")).alias("total"))


@query("S19_config", "SELECT s_suppkey, problems FROM supplier JOIN (VALUES " + ", ".join(f"({i}, '{d[1]}')" for i, d in enumerate((*DOCUMENTS, ("not json", "$: not JSON")))) + f") AS v(r, problems) ON s_suppkey % {len(DOCUMENTS) + 1} = r")
def config(t):
    """Configuration files under a schema, each with what is wrong in it."""
    path, k = _folder(t, "config"), F.col("s_suppkey")
    texts = [*(d[0] for d in DOCUMENTS), "not json"]
    value = F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int"))
    readers.write_files(t("supplier").select(k.alias("file"), value.alias("value")), path)
    read = readers.read_config(t.spark, path, SCHEMA)
    told = F.array_join(F.array_sort("problems"), ";")
    return read.select(readers.file_name("file").cast("long").alias("s_suppkey"), told.alias("problems"))


@query("S21_digests", "SELECT conv_id, count(*) AS lines FROM (SELECT conv_id, unnest(string_split(role || ': ' || coalesce(replace(text, chr(13), ''), ''), chr(10))) FROM conversations WHERE text IS NOT NULL) GROUP BY 1")
def digests(t):
    """One text file a session, its messages in order."""
    path = _folder(t, "digests")
    text = F.translate("text", "\r", "")
    messages = t("conversations").where("text is not null").select(F.col("conv_id").alias("session"), F.col("turn").alias("at"), "role", text.alias("text"))
    readers.write_digests(messages, path)
    read = t.spark.read.option("recursiveFileLookup", True).text(path)
    return read.groupBy(readers.file_name().cast("long").alias("conv_id")).agg(F.count("*").alias("lines"))


@query("S09_calendar_plan", "SELECT s_suppkey, n_name AS calendar, CAST(DATE '2024-01-01' + CAST(s_suppkey % 20 AS INT) AS VARCHAR) || 'T00:00:00' AS starts, CAST(DATE '2024-01-08' + CAST(s_suppkey % 20 AS INT) AS VARCHAR) || 'T00:00:00' AS ends FROM supplier JOIN nation ON n_nationkey % 5 = s_suppkey % 5")
def calendar_plan(t):
    """The listings that a round must request: a window for each calendar of each account."""
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 20).cast("int"))
    accounts = t("supplier").select("s_suppkey", (F.col("s_suppkey") % 5).alias("group"), first.alias("first"))
    calendars = t("nation").select(F.col("n_name").alias("calendar"), (F.col("n_nationkey") % 5).alias("group"))
    j = accounts.join(calendars, "group")
    stamp = lambda d: F.date_format(d, "yyyy-MM-dd'T'00:00:00")
    return j.select("s_suppkey", "calendar", stamp("first").alias("starts"), stamp(F.date_add("first", 7)).alias("ends"))


@query("S10_search_predicates", "SELECT s_suppkey, 'title contains ''' || replace(replace(s_name, '\\', '\\\\'), '''', '\\''') || ''' and modifiedTime > ''2024-01-' || lpad(CAST(1 + s_suppkey % 28 AS VARCHAR), 2, '0') || 'T00:00:00Z''' || CASE WHEN s_suppkey % 2 = 0 THEN ' and parentId = ''f' || s_nationkey || '''' ELSE '' END AS predicate FROM supplier")
def search_predicates(t):
    """The searches that a round must make: quotes escaped, a folder only where one is configured."""
    quoted = F.regexp_replace("s_name", r"([\\'])", r"\\$1")
    day = F.lpad((1 + F.col("s_suppkey") % 28).cast("string"), 2, "0")
    folder = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" and parentId = 'f"), F.col("s_nationkey").cast("string"), F.lit("'"))).otherwise("")
    made = F.concat(F.lit("title contains '"), quoted, F.lit("' and modifiedTime > '2024-01-"), day, F.lit("T00:00:00Z'"), folder)
    return t("supplier").select("s_suppkey", made.alias("predicate"))


@query("E01_custom_rule", "SELECT p_partkey || '.md' AS file, 'too-short' AS \"check\", 'warn' AS level FROM part WHERE p_size < 5")
def custom_rule(t):
    """A rule of one's own, registered under a name and run with the built-in ones' machinery."""

    def short(c: R.Context) -> DataFrame:
        return R.found(c.notes, "short", F.when(F.length("text") < 5, "too-short"), "warn")

    path = F.concat(F.col("p_partkey").cast("string"), F.lit(".md"))
    files = t("part").select(path.alias("path"), F.repeat(F.lit("x"), F.col("p_size")).alias("text"))
    R.rule("short")(short)
    try:
        return R.run(R.Context(files), ["short"]).select("file", "check", "level")
    finally:
        del R.RULES["short"]


@query("E05_pending_tables", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS due, o_orderpriority AS what FROM orders WHERE o_orderstatus = 'O'")
def pending_tables(t):
    """Rows of the table under a configured heading, its date and text columns found by their names."""
    from tidemark.operators import notes as N

    row = F.concat(F.lit("| "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" | "), F.col("o_orderpriority"), F.lit(" |"))
    text = F.concat(F.lit("# Top\n\n## "), F.when(F.col("o_orderstatus") == "O", "Pending").otherwise("Done"), F.lit("\n\n| when | what |\n|---|---|\n"), row, F.lit("\n\n## Other\n| when | what |\n|---|---|\n| x | y |"))
    lines = t("orders").select("o_orderkey", F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    rows = N.table_rows(N.sections(lines, "o_orderkey", "## Pending"), "o_orderkey")
    heads = rows.where("kind = 'header'").select("o_orderkey", "table", F.col("cells").alias("names"))
    data = rows.where("kind = 'row'").join(heads, ["o_orderkey", "table"])
    cell = lambda name: F.get("cells", F.array_position("names", name).cast("int") - 1)
    return data.select("o_orderkey", cell("when").alias("due"), cell("what").alias("what"))


@query("B01_facts", "SELECT 'documents' AS fact, CAST(count(*) AS VARCHAR) AS value FROM documents UNION ALL SELECT 'sources', CAST(count(DISTINCT source) AS VARCHAR) FROM documents UNION ALL SELECT 'last_day', CAST(CAST(max(ts) AS DATE) AS VARCHAR) FROM events UNION ALL SELECT 'open_orders', CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS VARCHAR) FROM orders")
def facts(t):
    """A briefing's facts, each a small aggregate of its own table, as one relation."""
    text = lambda name, df, value: df.agg(value.cast("string").alias("value")).select(F.lit(name).alias("fact"), "value")
    out = text("documents", t("documents"), F.count("*"))
    out = out.unionByName(text("sources", t("documents"), F.countDistinct("source")))
    out = out.unionByName(text("last_day", t.events(), F.to_date(F.max("ts"))))
    return out.unionByName(text("open_orders", t("orders"), F.count_if(F.col("o_orderstatus") == "O")))


@query("E07_checks", """SELECT 'prices' AS id, 'ok' AS status, NULL AS code, CAST(count(*) AS VARCHAR) AS detail FROM orders WHERE o_totalprice >= 0
UNION ALL SELECT 'segments', CASE WHEN count(*) > 30 THEN 'warn' ELSE 'ok' END, NULL, c_mktsegment FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'plan', 'fail', 'crashed', NULL UNION ALL SELECT 'run', 'fail', 'crashed', NULL UNION ALL SELECT 'none', 'fail', 'empty', 'the check returned no result'
UNION ALL SELECT 'nations', CASE WHEN count(*) = 25 THEN 'ok' ELSE 'fail' END, NULL, CAST(count(*) AS VARCHAR) FROM nation""")
def checks(t):
    """Named checks, each a job: one that fails when planned or while it runs, or gives nothing, stops no other."""
    count = F.count("*").cast("string").alias("detail")
    told = {
        "prices": lambda s: t("orders").where("o_totalprice >= 0").agg(count).select(F.lit("ok").alias("status"), "detail"),
        "segments": lambda s: t("customer").groupBy(F.col("c_mktsegment").alias("detail")).agg(F.when(F.count("*") > 30, "warn").otherwise("ok").alias("status")),
        "plan": lambda s: t("orders").select("no_such_column"),
        "run": lambda s: t("orders").select(F.lit("ok").alias("status"), F.raise_error(F.col("o_orderpriority")).cast("string").alias("detail")),
        "none": lambda s: t("nation").where("n_nationkey < 0").select(F.lit("ok").alias("status"), F.lit("").alias("detail")),
        "nations": lambda s: t("nation").agg(count).select(F.when(F.col("detail") == "25", "ok").otherwise("fail").alias("status"), "detail"),
    }
    out = run_checks(t.spark, told)
    return out.select("id", "status", "code", F.when(~F.coalesce(F.col("code") == "crashed", F.lit(False)), F.col("detail")).alias("detail"))


@query("S11_source_formats", """SELECT 'lines' AS source, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders WHERE length(o_orderpriority) < 9
UNION ALL SELECT 'windows', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier, nation WHERE n_regionkey = s_suppkey % 5""")
def source_formats(t):
    """A line format read by byte ranges, long lines passed over, and a source of windows, both by name."""
    formats.register(t.spark)
    path = _folder(t, "lines")
    # Lines of more than 40 characters are over the limit.
    line = F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.when(F.length("o_orderpriority") >= 9, F.repeat(F.col("o_orderpriority"), F.lit(9))).otherwise(F.col("o_orderpriority")).alias("p")))
    t("orders").select(line.alias("value")).write.text(path)
    read = t.spark.read.format("json_lines").option("limit", 60).option("rangeBytes", 10_000).load(path)
    lines = read.agg(F.count("*").alias("n"), F.sum(F.get_json_object("value", "$.k").cast("long")).alias("total"))

    names = {str(r.n_regionkey): r.names for r in t("nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names")).collect()}  # a dimension: its five regions
    formats.register(t.spark, CALENDARS)
    plan = t.spark.read.format("tidemark_calendars").option("from", "2024-01-01").option("to", "2024-01-08").option("config", json.dumps(names)).load()
    asked = t("supplier").join(plan, (F.col("s_suppkey") % 5).cast("string") == F.col("account"))
    windows = asked.agg(F.count("*").alias("n"), F.sum("s_suppkey").cast("long").alias("total"))
    return lines.select(F.lit("lines").alias("source"), "n", "total").unionByName(windows.select(F.lit("windows").alias("source"), "n", "total"))


def _plan(window: tuple[str, str], config: dict) -> list[list[tuple]]:
    """A part for each account: its calendars in the window."""
    return [[(account, name, *window) for name in names] for account, names in sorted(config.items())]


CALENDARS = formats.Source(
    id="tidemark_calendars", kind="connector", required=False, collect=_plan, read_evidence=lambda record, plan: {}, schema="account string, calendar string, starts string, ends string",
    server_spec=lambda config: {}, tool_rules=lambda config: {"allow": [], "deny": []},
)


@query("E02_source_stream", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY event_type")
def source_stream(t):
    """The line format as a stream, stopped and started again while files are added: each line once."""
    formats.register(t.spark)
    path, out, at = (_folder(t, x) for x in ("grown", "taken", "offsets"))
    for half in (0, 1):
        rows = t("events").where(F.crc32(F.col("event_id").cast("string").cast("binary")) % 2 == half)
        rows.select(F.to_json(F.struct("event_id", "event_type")).alias("value")).write.mode("append").text(path)
        stream = t.spark.readStream.format("json_lines").load(path)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    read = t.spark.read.parquet(out).select(F.from_json("value", "event_id long, event_type string").alias("e")).select("e.*")
    return read.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("T17_expiring_queue", """WITH f AS (SELECT user_id, min(ts) AS first FROM events GROUP BY user_id),
a AS (SELECT e.user_id, count(DISTINCT CAST(ts AS DATE)) AS asked FROM events e JOIN f USING (user_id) WHERE ts > first AND CAST(ts AS DATE) - CAST(first AS DATE) <= 7 GROUP BY e.user_id)
SELECT f.user_id, 'archived' AS status, coalesce(asked, 0) AS asked, CAST(CAST(first AS DATE) + 8 AS VARCHAR) AS closed FROM f LEFT JOIN a USING (user_id)""")
def expiring_queue(t):
    """A question of each user, asked at each later event until its age archives it by a timer of event time."""
    path = _folder(t, "commands")
    own = jobs.keyed_session(t.spark)
    first = t.events().groupBy("user_id").agg(F.min("ts").alias("first"))
    rows = t.events().join(first, "user_id")
    key = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    age = F.datediff("ts", "first")
    commands = rows.where((F.col("ts") == F.col("first")) | (age <= 7)).groupBy("user_id", "ts").agg(F.first("first").alias("first"))
    commands = commands.select(key.alias("normalized"), F.lit("Still here?").alias("text"), F.col("ts").alias("at"), F.when(F.col("ts") == F.col("first"), "add").otherwise("asked").alias("action"))
    commands.write.parquet(f"{path}/in")
    # Later on a command of another key moves the time on for all.
    for folder, late in (("in", 0), ("in", 60)):
        if late:
            last = commands.agg((F.max("at") + F.expr(f"INTERVAL {late} DAYS")).alias("at"))
            last.select(F.lit("clock").alias("normalized"), F.lit("?").alias("text"), "at", F.lit("answer").alias("action")).write.mode("append").parquet(f"{path}/{folder}")
        stream = own.readStream.schema(commands.schema).parquet(f"{path}/{folder}")
        out = jobs.expiring_queue(stream, max_age_days=7, dedup_days=1, escalate_after=3)
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/at").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    expired = t.spark.read.parquet(f"{path}/out").where("said = 'expired'")
    return expired.select(F.substring_index("normalized", " ", -1).cast("long").alias("user_id"), "status", F.col("asked").cast("long").alias("asked"), F.col("closed").cast("string").alias("closed"))
