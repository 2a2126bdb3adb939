"""Queries of gates and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.operators import gates as G
from tidemark.operators import increments as I
from tidemark.operators import notes as N
from tidemark.operators import rules as R
from tidemark.operators.staging import stage

from .scan import CONFIGURED, PATTERNS
from .tables import query


def _pick(k: Column, choices) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (k % len(choices) + 1).cast("int"))


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int):
        return str(value)
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _cases(names: str, rows) -> str:
    """SQL rows (r, ...) for a join on a remainder."""
    return "(VALUES " + ", ".join(f"({i}, {', '.join(map(_sql, row))})" for i, row in enumerate(rows)) + f") AS c(r, {names})"


MESSAGES = (
    ("{}", "{}"),
    ("<system-reminder id='1'>not mine\nat all</system-reminder> {}", "{}"),
    ("<command-name>/go</command-name> <command-args>{}</command-args>", "/go {}"),
    ("Stop hook feedback: {}", ""),
    ("\n [SYSTEM NOTIFICATION - NOT USER INPUT] {}", ""),
    ("<system-reminder> {}", "<system-reminder> {}"),
    ("<bash-stdout>{}</bash-stdout>", ""),
    ("a <bash-stdout>x</bash-stderr> {} </bash-stdout>\t b", "a b"),
)


def _around(choices, name: str) -> str:
    parts = [x.partition("{}") for x in choices]
    return "CASE " + " ".join(
        f"WHEN o_orderkey % {len(choices)} = {i} THEN {_sql(a)} || {name if hit else _sql('')} || {_sql(b)}" for i, (a, hit, b) in enumerate(parts)
    ) + " END"


@query("X07_person_text", f"SELECT o_orderkey, {_around([m[1] for m in MESSAGES], 'o_orderpriority')} AS said FROM orders")
def person_text(t):
    """What a person wrote in a message: blocks of the harness removed, the person's own tags taken off."""
    text = F.replace(_pick(F.col("o_orderkey"), [m[0] for m in MESSAGES]), F.lit("{}"), F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", G.person_text(text).alias("said"))


SCHEMA = {
    "type": "object", "required": ["id", "tags"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1}, "kind": {"type": "string", "enum": ["a", "b"]},
        "tags": {"type": "array", "items": {"type": "string", "minLength": 2}},
        "at": {"type": ["string", "null"], "pattern": "^[0-9]{4}$"},
        "deep": {"type": "object", "properties": {"share": {"type": "number", "maximum": 1}}, "additionalProperties": {"type": "boolean"}},
    },
}
DOCUMENTS = (
    ('{"id": 1, "tags": ["ab"]}', ""),
    ('{"id": 0, "tags": ["a", "bc", 3]}', "$.id: must be >= 1;$.tags[0]: must have at least 2 characters;$.tags[2]: expected string, got number"),
    ('{"id": 1.5, "tags": "x"}', "$.id: expected integer, got number;$.tags: expected array, got string"),
    ('{"kind": "c", "more": 1}', "$.id: required;$.kind: must be one of the choices;$.more: unknown key;$.tags: required"),
    ('{"id": 2, "tags": [], "at": null, "deep": {"share": 2, "ok": true}}', "$.deep.share: must be <= 1"),
    ('{"id": 2, "tags": [], "at": "20x4"}', "$.at: does not match /^[0-9]{4}$/"),
    ("[1]", "$: expected object, got array"),
)


@query(
    "X23_schema_check",
    f"SELECT o_orderkey, problems FROM orders JOIN {_cases('problems', [(d[1],) for d in DOCUMENTS])} ON o_orderkey % {len(DOCUMENTS)} = r",
)
def schema_check(t):
    """Each document's departures from a schema, at any depth, as one generated expression."""
    v = F.parse_json(_pick(F.col("o_orderkey"), [d[0] for d in DOCUMENTS]))
    made = t("orders").select("o_orderkey", v.alias("v"))
    return made.select("o_orderkey", F.array_join(F.array_sort(G.schema_problems(F.col("v"), SCHEMA)), ";").alias("problems"))


SETTINGS = (
    ('{"a": 1}', []),
    ('{"a": {"token": "x"}}', ["$.a.token"]),
    ('{"list": [{"password": 1}, {"b": [{"token": 2}]}]}', ["$.list[0].password", "$.list[1].b[0].token"]),
    ('{"token": {"token": 1}}', ["$.token", "$.token.token"]),
)
_FORBIDDEN = [(i, p) for i, (_, ps) in enumerate(SETTINGS) for p in ps]


@query(
    "X34_forbidden_keys",
    "SELECT o_orderkey, path FROM orders JOIN (VALUES " + ", ".join(f"({i}, {_sql(p)})" for i, p in _FORBIDDEN) + f") AS v(r, path) ON o_orderkey % {len(SETTINGS)} = r",
)
def forbidden_keys(t):
    """Keys that a configuration may not hold, wherever they stand in it."""
    df = t("orders").select("o_orderkey", _pick(F.col("o_orderkey"), [s[0] for s in SETTINGS]).alias("json"))
    return G.forbidden_keys(df, "o_orderkey", "json", ["token", "password"], stage).select("o_orderkey", "path")


@query(
    "X26_identity",
    "SELECT c_custkey, 'A <a' || c_custkey || '@x.org>' AS author, 'B <b>' AS committer, 'note' || chr(10) || chr(10) || c_mktsegment AS message, "
    "'tree 1' || chr(10) || 'author  1 +0000' || chr(10) || 'committer  2 +0000' || chr(10) || 'encoding x' AS residue FROM customer",
)
def identity(t):
    """The identities of a commit up to their last bracket, its message, and what is left of its header."""
    return G.commit_parts(_commits(t), "c_custkey", "body")


def _commits(t) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    head = F.concat(F.lit("tree 1\nauthor A <a"), k, F.lit("@x.org> 1 +0000\ncommitter B <b> 2 +0000\nencoding x\n\n"))
    return t("customer").select("c_custkey", F.concat(head, F.lit("note\n\n"), F.col("c_mktsegment")).alias("body"))


@query(
    "X27_added_lines",
    "WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey % 3 AS m FROM orders), "
    "w AS (SELECT *, count(*) FILTER (WHERE m <> 2) OVER (PARTITION BY o_custkey, n > 2 ORDER BY n) AS so_far FROM l) "
    "SELECT o_custkey, 'f' || o_custkey || '.md' AS file, CAST(CASE WHEN n > 2 THEN 50 ELSE 10 END + so_far - 1 AS INTEGER) AS line, "
    "'++ ' || o_orderkey AS raw FROM w WHERE m = 0",
)
def added_lines(t):
    """Added lines of each customer's diff, in two hunks, with their numbers in the new file."""
    k = F.col("o_orderkey")
    mark = F.element_at(F.array(F.lit("+++ "), F.lit(" kept "), F.lit("--- ")), (k % 3 + 1).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct(k, F.concat(mark, k.cast("string")).alias("l"))))["l"]
    name = F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.lit(".md"))
    head = F.concat(F.lit("diff --git a/x b/x\nindex 1..2 100644\n--- a/"), name, F.lit("\n+++ b/"), name)
    first = F.concat(F.lit("\n@@ -8,2 +10,2 @@ part\n"), F.array_join(F.slice("x", 1, 2), "\n"))
    rest = F.when(F.size("x") > 2, F.concat(F.lit("\n@@ -40 +50,9 @@\n"), F.array_join(F.slice("x", F.lit(3), F.size("x")), "\n"))).otherwise("")
    diffs = t("orders").groupBy("o_custkey").agg(listed.alias("x")).select("o_custkey", F.concat(head, first, rest).alias("diff"))
    return G.added_lines(diffs, "o_custkey", "diff")


@query(
    "X33_section_checks",
    "WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), "
    "p AS (SELECT *, lag(v) OVER (PARTITION BY o_custkey ORDER BY n) AS b, count(*) OVER (PARTITION BY o_custkey, v) AS c FROM s) "
    "SELECT o_custkey, bool_and(c = 1) AS once, coalesce(bool_and(v < b), true) AS in_order, bool_and(o_orderkey % 5 <> 0) FILTER (WHERE n = 1) AS first_empty FROM p GROUP BY 1",
)
def section_checks(t):
    """A change log's versions once each, newest first, and nothing under the first heading."""
    k = F.col("o_orderkey")
    line = F.concat(F.lit("## 0.0."), (k % 4).cast("string"), F.when(k % 5 == 0, "\n\n- a line").otherwise("\n"))
    rows = F.array_sort(F.collect_list(F.struct(k, line.alias("l"))))["l"]
    logs = t("orders").groupBy("o_custkey").agg(F.array_join(rows, "\n").alias("text"))
    lines = logs.select("o_custkey", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    patch = F.regexp_extract("raw", r"\A## \d+\.\d+\.(\d+)\z", 1)
    along = Window.partitionBy("o_custkey").orderBy("at")
    lines = lines.withColumn("head", F.when(patch != "", patch.cast("int")))
    lines = lines.withColumn("section", F.count("head").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    heads = lines.where("head is not null")
    heads = heads.withColumn("newer", F.lag("head").over(along)).withColumn("c", F.count("*").over(Window.partitionBy("o_custkey", "head")))
    told = heads.groupBy("o_custkey").agg(F.bool_and(F.col("c") == 1).alias("once"), F.coalesce(F.bool_and(F.col("head") < F.col("newer")), F.lit(True)).alias("in_order"))
    body = lines.where("section = 1").groupBy("o_custkey").agg((F.count_if(F.col("head").isNull() & (F.trim("raw") != "")) == 0).alias("first_empty"))
    return told.join(body, "o_custkey")


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"


@query(
    "L09_push_channels",
    "WITH ch AS (SELECT 'ref' AS channel, 'refs/heads/' || n_name AS object, 'refs/heads/' || n_name AS text FROM nation "
    "UNION ALL SELECT 'author', CAST(c_custkey AS VARCHAR), 'A <a' || c_custkey || '@x.org>' FROM customer WHERE c_custkey % 7 <> 0 "
    "UNION ALL SELECT 'author', CAST(c_custkey AS VARCHAR), 'me <me@x.org>' FROM customer WHERE false "
    "UNION ALL SELECT 'message', CAST(c_custkey AS VARCHAR), 'from u' || c_custkey || '@y.org' FROM customer "
    "UNION ALL SELECT 'path', CAST(doc_id AS VARCHAR), doc_id || '@z.org.md' FROM documents "
    f"UNION ALL SELECT 'content', CAST(doc_id AS VARCHAR), text FROM documents) "
    f"SELECT channel, count(*) AS n, count(DISTINCT object) AS objects FROM (SELECT channel, object, unnest(regexp_extract_all(text, '(?i){_EMAIL}')) FROM ch) GROUP BY 1",
)
def push_channels(t):
    """All that a push makes public, one row a channel and object, scanned once; one's own identity is exempt."""
    k = F.col("c_custkey").cast("string")
    who = F.when(F.col("c_custkey") % 7 == 0, "me <me@x.org>").otherwise(F.concat(F.lit("A <a"), k, F.lit("@x.org>")))
    body = F.concat(F.lit("tree 1\nauthor "), who, F.lit(" 1 +0000\ncommitter me <me@x.org> 2 +0000\n\nfrom u"), k, F.lit("@y.org"))
    commits = t("customer").select(k.alias("object"), body.alias("body"))
    refs = t("nation").select(F.concat(F.lit("refs/heads/"), "n_name").alias("ref"))
    d = F.col("doc_id").cast("string")
    blobs = t("documents").select(d.alias("object"), F.concat(d, F.lit("@z.org.md")).alias("path"), F.col("text").alias("content"))
    found = G.channel_findings(G.push_channels(refs, commits, blobs, ["me <me@x.org>"]), [p for p in PATTERNS if p[0] == CONFIGURED[1]])
    return found.groupBy("channel").agg(F.count("*").alias("n"), F.countDistinct("object").alias("objects"))


@query(
    "L07_budgets",
    f"SELECT doc_id, pattern, problem, count(*) AS n FROM (SELECT doc_id, 'email' AS pattern, CAST(NULL AS VARCHAR) AS problem, unnest(regexp_extract_all(text, '(?i){_EMAIL}')) FROM documents "
    "UNION ALL SELECT doc_id, 'slow', 'timeout', '' FROM documents WHERE doc_id % 1000 = 7) GROUP BY ALL",
)
def budgets(t):
    """Matches under a time budget: a call that runs out is told as such, never as clean. One text in a thousand has a
    last line on which the second pattern takes exponential time."""
    slow = F.when(F.col("doc_id") % 1000 == 7, F.lit("\n~" + "a" * 60 + "!")).otherwise("")
    texts = t("documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), slow).alias("text"))
    patterns = [(CONFIGURED[1], "config"), ("~(a|aa)+$", "personal")]
    found = G.budgeted(texts, "doc_id", patterns, per_line=0.5)
    name = F.when(F.col("origin") == "config", "email").otherwise("slow")
    return found.groupBy("doc_id", name.alias("pattern"), "problem").agg(F.count("*").alias("n"))


#: calls of a listing (token, asked, ok, more, items), then how many pages and items it has
LISTINGS = (
    ([(None, "w", True, False, 3)], 1, 3),
    ([(None, "w", True, True, 3), ("t1", "w", True, False, 2)], 2, 5),
    ([(None, "w", True, True, 3)], None, None),
    ([(None, "w", True, True, 3), ("t1", "v", True, False, 2)], None, None),
    ([(None, "w", True, True, 3), ("t1", "w", False, False, None), ("t1", "w", True, False, 1)], 2, 4),
    ([(None, "w", True, True, 3), ("t1", "w", False, False, None), ("t2", "w", True, False, 1)], None, None),
    ([(None, "w", False, False, None), (None, "w", True, True, None), ("t1", "w", True, False, 1)], 2, None),
)


@query(
    "T10_listing_evidence",
    f"SELECT s_suppkey, CAST(pages AS BIGINT) AS pages, CAST(items AS BIGINT) AS items FROM supplier JOIN {_cases('pages, items', [x[1:] for x in LISTINGS])} ON s_suppkey % {len(LISTINGS)} = r",
)
def listing_evidence(t):
    """Listings read to their last page, retries by the very token that failed."""
    one = lambda i, c: F.struct(*(F.lit(x).cast(k).alias(n) for x, k, n in zip((i, *c), ("int", "string", "string", "boolean", "boolean", "int"), ("seq", "token", "asked", "ok", "more", "items"), strict=True)))
    calls = F.element_at(F.array(*(F.array(*(one(i, c) for i, c in enumerate(x[0]))) for x in LISTINGS)), (F.col("s_suppkey") % len(LISTINGS) + 1).cast("int"))
    return G.read_to_end(t("supplier").select("s_suppkey", F.inline(calls)), ["s_suppkey"])


SEARCHES = (
    ("name contains 'x' and modifiedTime > 'T'", True),
    ("modifiedTime > 'T' and name contains 'x'", True),
    ("not name contains 'x' and modifiedTime > 'T'", False),
    ("name contains 'x'", False),
    ("name contains 'x' or modifiedTime > 'T'", False),
    ("name contains 'x' and not (modifiedTime > 'T')", False),
)


@query("T11_search_evidence", f"SELECT s_suppkey, proved FROM supplier JOIN {_cases('proved', [(x[1],) for x in SEARCHES])} ON s_suppkey % {len(SEARCHES)} = r")
def search_evidence(t):
    """A search proves the reading if it holds every clause that was asked for, none of them negated or optional."""
    q = _pick(F.col("s_suppkey"), [x[0] for x in SEARCHES])
    parts = F.transform(F.split(q, r"(?i)\s+and\s+"), F.trim)
    wanted = F.array(F.lit("name contains 'x'"), F.lit("modifiedTime > 'T'"))
    proved = F.forall(wanted, lambda w: F.array_contains(parts, w)) & ~F.rlike(q, F.lit(r"(?i)\bor\b"))
    return t("supplier").select("s_suppkey", proved.alias("proved"))


_MARK = "DATE '2024-01-05' + CAST(c_custkey % 20 AS INT)"
_DAY = "DATE '2024-01-01' + CAST(c_custkey % 31 AS INT)"
_REFUSED = (
    f"CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 3 THEN 'unknown_action' WHEN {_DAY} >= DATE '2024-01-25' THEN 'day_not_over' "
    f"WHEN c_custkey % 4 = 1 AND {_DAY} <= {_MARK} THEN 'covered' WHEN c_custkey % 4 = 2 AND {_DAY} > {_MARK} THEN 'not_covered' END"
)


@query(
    "T14_manual_control",
    f"SELECT c_custkey, {_REFUSED} AS refusal, CAST(CASE WHEN c_custkey % 4 IN (0, 3) OR {_REFUSED} IS NOT NULL THEN {_MARK} WHEN c_custkey % 4 = 1 THEN {_DAY} ELSE {_DAY} - 1 END AS VARCHAR) AS mark FROM customer",
)
def manual_control(t):
    """Marks shown, moved on or taken back by hand; days that are not over are refused."""
    k = F.col("c_custkey")
    action = _pick(k, ("show", "assume", "reopen", "drop"))
    mark, day = (F.date_add(F.lit(x).cast("date"), (k % n).cast("int")) for x, n in (("2024-01-05", 20), ("2024-01-01", 31)))
    today = F.lit("2024-01-25").cast("date")
    refusal, moved = G.mark_refusal(action, day, mark, today), G.mark_change(action, day, mark, today)
    return t("customer").select("c_custkey", refusal.alias("refusal"), moved.cast("string").alias("mark"))


@query(
    "T18_incident_state",
    "WITH r AS (SELECT user_id, event_id, event_type = 'error' AS failed, event_type = 'purchase' AND value > 50 AS closes FROM events), "
    "c AS (SELECT user_id, max(event_id) FILTER (WHERE closes) AS closed FROM r GROUP BY 1) "
    "SELECT user_id, count(*) AS open, min(event_id) AS since FROM r JOIN c USING (user_id) WHERE failed AND (closed IS NULL OR event_id > closed) GROUP BY 1",
)
def incident_state(t):
    """Failed runs of each user since the last one with proof of work."""
    closes = F.coalesce((F.col("event_type") == "purchase") & (F.col("value") > 50), F.lit(False))
    log = t("events").select("user_id", F.col("event_id").alias("seq"), closes.alias("closes"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"))
    return I.open_incidents(log, "user_id").groupBy("user_id").agg(F.count("*").alias("open"), F.min("seq").alias("since"))


_DIRTY = "SELECT DISTINCT l_suppkey AS session, l_partkey AS path FROM lineitem WHERE l_returnflag IN ('A', 'N')"
_KNOWN = "SELECT DISTINCT l_suppkey AS session, l_partkey AS path FROM lineitem WHERE l_returnflag = 'R'"


@query(
    "T22_snapshot_diff",
    f"SELECT session, count(*) FILTER (WHERE k.path IS NOT NULL) AS before, count(*) FILTER (WHERE k.path IS NULL) AS since FROM ({_DIRTY}) d LEFT JOIN ({_KNOWN}) k USING (session, path) GROUP BY 1",
)
def snapshot_diff(t):
    """Changed paths of each session, split by whether its snapshot knew them."""
    d = _dirty(t).join(_known(t).withColumn("known", F.lit(True)), ["session", "path"], "left")
    return d.groupBy("session").agg(F.count("known").alias("before"), F.count_if(F.col("known").isNull()).alias("since"))


def _dirty(t) -> DataFrame:
    held = t("lineitem").where(F.col("l_returnflag").isin("A", "N"))
    return held.select(F.col("l_suppkey").alias("session"), F.col("l_partkey").alias("path")).distinct()


def _known(t) -> DataFrame:
    return t("lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("session"), F.col("l_partkey").alias("path")).distinct()


@query(
    "T26_stop_decision",
    f"WITH p AS (SELECT session, d.path % 9 <> 0 AS vault, k.path IS NOT NULL AS before, d.path % 3 = 0 AS proposed, session % 2 = 0 AS asked, d.path FROM ({_DIRTY}) d LEFT JOIN ({_KNOWN}) k USING (session, path)), "
    "s AS (SELECT session, count(*) FILTER (WHERE vault AND NOT before AND NOT proposed) AS o, count(*) FILTER (WHERE vault AND NOT before AND NOT proposed AND NOT (asked AND path % 5 <> 0)) AS f, count(*) FILTER (WHERE vault AND NOT before AND proposed) AS p FROM p GROUP BY 1) "
    "SELECT session, CASE WHEN f > 0 THEN 'block' WHEN o > 0 THEN 'reminded' WHEN p > 0 THEN 'proposed' ELSE 'clean' END AS action, CASE WHEN f > 0 THEN o ELSE 0 END AS n FROM s",
)
def stop_decision(t):
    """Whether a session may end: new changes that are neither proposed nor asked about hold it back once."""
    d = _dirty(t).join(_known(t).withColumn("known", F.lit(True)), ["session", "path"], "left")
    path = F.col("path")
    paths = d.select("session", (path % 9 != 0).alias("vault"), F.col("known").isNotNull().alias("before"), (path % 3 == 0).alias("proposed"), ((F.col("session") % 2 == 0) & (path % 5 != 0)).alias("asked"))
    return G.stop_decision(paths, "session").select("session", "action", F.col("n").cast("long").alias("n"))


@query("J03_exempt_folders", "SELECT doc_id FROM documents WHERE NOT (source = 'src1' OR starts_with(source || '/' || doc_id, 'src1/') OR starts_with(source || '/' || doc_id, 'src2/1'))")
def exempt_folders(t):
    """Files under none of the exempt folders, by an equi-join on their ancestors; src2/1 is here a name's beginning."""
    path = F.concat_ws("/", "source", F.regexp_replace(F.col("doc_id").cast("string"), r"\A1", "1/"))
    files = t("documents").where("source is not null").select("doc_id", path.alias("path"))
    folders = t.spark.range(2).select(F.when(F.col("id") == 0, "src1").otherwise("src2/1").alias("folder"))
    inside = files.select("doc_id", F.explode(P.ancestors(F.col("path"))).alias("folder")).join(F.broadcast(folders), "folder", "left_semi")
    return files.join(inside, "doc_id", "left_anti").select("doc_id")


@query(
    "J04_link_follow",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_type || '/' || p_partkey || '.md' WHEN p_partkey % 4 = 1 THEN p_type || '/index.md' END AS target FROM part",
)
def link_follow(t):
    """Where a link leads: a file as it is, a folder's index, nothing where neither is there."""
    k = F.col("p_partkey")
    raw = F.element_at(F.array(F.concat(k.cast("string"), F.lit(".md")), F.lit("."), F.lit("gone.md"), F.lit("https://x.org/a.md")), (k % 4 + 1).cast("int"))
    path = F.concat_ws("/", "p_type", F.concat(k.cast("string"), F.lit(".md")))
    notes = t("part").select(path.alias("path"), F.concat(F.lit("[a]("), raw, F.lit(")")).alias("text"))
    index = t("part").select(F.concat("p_type", F.lit("/index.md")).alias("path"), F.lit("").alias("text")).distinct()
    states = R.target_states(R.Context(notes.unionByName(index)))
    told = F.when(F.col("state") == "in-walk", F.col("dst")).when(F.col("state") == "directory", F.concat("dst", F.lit("/index.md")))
    got = states.select(F.regexp_extract("path", r"/(\d+)\.md\z", 1).cast("long").alias("p_partkey"), told.alias("target"))
    return t("part").select("p_partkey").join(got, "p_partkey", "left")


@query(
    "J05_results_of_uses",
    "SELECT o_orderkey, count(l_linenumber) > 0 AS answered, coalesce(bool_or(l_returnflag = 'R'), false) AS failed FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linestatus = 'F') l ON l_orderkey = o_orderkey GROUP BY 1",
)
def results_of_uses(t):
    """Each use with what came back for it; repeated results are folded before the join."""
    lines = t("lineitem").where("l_linestatus = 'F'")
    results = lines.select(F.col("l_orderkey").alias("tool_use_id"), (F.col("l_returnflag") == "R").alias("failed"), F.lit(False).alias("has_next"), F.lit(1).alias("items"))
    folded = I.fold_results(results)
    uses = t("orders").select("o_orderkey").join(folded, F.col("o_orderkey") == F.col("tool_use_id"), "left")
    return uses.select("o_orderkey", F.col("failed").isNotNull().alias("answered"), F.coalesce("failed", F.lit(False)).alias("failed"))


@query(
    "J14_path_selection",
    f"SELECT session, path, CASE WHEN path % 10 = 0 THEN 'outside' WHEN d.path IS NOT NULL THEN 'chosen' ELSE 'clean' END AS state FROM (SELECT DISTINCT l_suppkey AS session, l_partkey AS path FROM lineitem WHERE l_linestatus = 'O') g LEFT JOIN ({_DIRTY}) d USING (session, path)",
)
def path_selection(t):
    """Given paths: outside the vault, changed and so chosen, or clean."""
    given = t("lineitem").where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("session"), F.col("l_partkey").alias("path")).distinct()
    d = given.join(_dirty(t).withColumn("dirty", F.lit(True)), ["session", "path"], "left")
    state = F.when(F.col("path") % 10 == 0, "outside").when(F.col("dirty"), "chosen").otherwise("clean")
    return d.select("session", "path", state.alias("state"))


@query(
    "W03_newest_under_budget",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(1 + event_id % 9) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS running FROM events) WHERE running < 60",
)
def newest_under_budget(t):
    """The newest events of each user while their cost stays strictly below a budget: a prefix, newest first."""
    kept = I.newest_within(t("events"), "user_id", "event_id", 1 + F.col("event_id") % 9, 60).where("kept")
    return kept.select("user_id", "event_id")


@query(
    "W05_cumulative_distinct",
    "WITH f AS (SELECT l_returnflag AS source, l_suppkey AS s, min(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY ALL), n AS (SELECT source, d, count(*) AS fresh FROM f GROUP BY ALL), "
    "e AS (SELECT DISTINCT l_returnflag AS source, CAST(l_shipdate AS DATE) AS d FROM lineitem), r AS (SELECT source, d, sum(coalesce(fresh, 0)) OVER (PARTITION BY source ORDER BY d) AS so_far FROM e LEFT JOIN n USING (source, d)) "
    "SELECT source, count(*) AS days, CAST(max(so_far) AS BIGINT) AS sessions FROM r WHERE so_far <= 5 GROUP BY 1",
)
def cumulative_distinct(t):
    """Whole days of each source while the different sessions so far are within a cap."""
    days = t("lineitem").select(F.col("l_returnflag").alias("source"), F.to_date("l_shipdate").alias("d"), F.col("l_suppkey").alias("s")).distinct()
    taken = I.admitted_days(days, "source", "d", "s", 5).where("taken")
    return taken.groupBy("source").agg(F.count("*").alias("days"), F.max("so_far").cast("long").alias("sessions"))


HEADS = (
    ("---\ntype: a\n---\nbody", "---\ntype: a\nverified:\n  - by: me\n    at: 2026-01-01T00:00:00Z\n---\nbody"),
    ("---\nverified:\n  - by: x\n    at: y\nlast: 1\n---\n", "---\nverified:\n  - by: x\n    at: y\n  - by: me\n    at: 2026-01-01T00:00:00Z\nlast: 1\n---\n"),
    ("no header", None),
    ("---\nverified: {by: x, at: y}\n---\n", "---\nverified:\n  - by: x\n    at: y\n  - by: me\n    at: 2026-01-01T00:00:00Z\n---\n"),
    ("---\nverified: yes\n---\n", None),
    ("---\nverified: x\nverified: y\n---\n", None),
)


@query("V01_append_verified", f"SELECT s_suppkey, text FROM supplier JOIN {_cases('text', [(x[1],) for x in HEADS])} ON s_suppkey % {len(HEADS)} = r")
def append_verified(t):
    """Notes with one more verified event in their header; null where the header does not allow it."""
    notes = t("supplier").select("s_suppkey", _pick(F.col("s_suppkey"), [x[0] for x in HEADS]).alias("text"))
    return notes.select("s_suppkey", N.stamped(F.col("text"), F.lit("me"), F.lit("2026-01-01T00:00:00Z")).alias("text"))


USER_RULES = (
    ("Read(/home/x/**)", "apart", "deny"), ("Read(./notes/**)", "inside", None), ("Read", "none", "widened"), ("Edit", "none", "covers_vault"),
    ("Edit(~/other/**)", "apart", "deny"), ("Write(../../**)", "climbs", "unreadable"), ("Bash", "none", "covers_kit"), ("Bash(ls:*)", "none", "deny"),
    ("Bash(*)", "none", "covers_kit"), ("WebFetch(domain:x.org)", "none", "deny"), ("(broken", "none", "unreadable"), ("Edit(/vault/**)", "covers", "covers_vault"),
)


@query(
    "V03_user_rules",
    f"SELECT s_suppkey, CASE WHEN s_suppkey % 13 <> 0 THEN outcome END AS outcome FROM supplier JOIN {_cases('outcome', [(x[2],) for x in USER_RULES])} ON s_suppkey % {len(USER_RULES)} = r",
)
def user_rules(t):
    """What a round does about each rule that the user allows elsewhere: denied, widened, or a reason not to start."""
    k = F.col("s_suppkey")
    rule, reach = _pick(k, [x[0] for x in USER_RULES]), _pick(k, [x[1] for x in USER_RULES])
    return t("supplier").select("s_suppkey", G.mirrored(rule, reach, k % 13 == 0).alias("outcome"))


@query("B03_link_search", "SELECT p_partkey, 'Plan of ' || p_brand AS label FROM part WHERE p_partkey % 3 = 1")
def link_search(t):
    """Links of an index whose text holds a word, whatever its case."""
    k = F.col("p_partkey")
    label = F.concat(_pick(k, ("Notes on ", "Plan of ", "See ")), F.col("p_brand"))
    text = F.concat(F.lit("- ["), label, F.lit("](a.md)\n- `[plan](code.md)`"))
    found = N.links(t("part").select(k.cast("string").alias("path"), text.alias("text")))
    held = found.where(F.contains(F.lower("label"), F.lit("plan")))
    return held.select(F.col("path").cast("long").alias("p_partkey"), "label")


@query(
    "B04_problem_attachment",
    "SELECT l_orderkey, l_linenumber, CASE WHEN o_orderstatus = 'O' THEN 'shown' ELSE 'loose' END AS place FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'",
)
def problem_attachment(t):
    """Problems beside the shown item that they belong to, the others loose."""
    shown = t("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("shown").alias("place"))
    problems = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    return problems.join(shown, "l_orderkey", "left").fillna({"place": "loose"})


@query("F10_severity", f"SELECT s_suppkey, severity FROM supplier JOIN {_cases('severity', [('error',), ('off',), ('warn',), ('error',), ('warn',)])} ON s_suppkey % 5 = r")
def severity(t):
    """A rule's severity: the setting as a word or in an object; what is invalid falls to the rule's own, then to warn."""
    k = F.col("s_suppkey")
    setting = F.try_parse_json(_pick(k, ('"error"', '{"severity": "off"}', '"loud"', '{"other": 1}', "7")))
    own = F.when(k % 5 == 3, "error")
    return t("supplier").select("s_suppkey", G.severity(setting, own).alias("severity"))


@query(
    "O04_first_by_column",
    "WITH w AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS raw FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n') AS x FROM documents)), "
    "c AS (SELECT doc_id, line, unnest(range(1, length(raw) + 1)) AS col, unnest(string_split(raw, '')) AS ch FROM w WHERE contains(raw, '%')), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, col) AS place, count(*) OVER (PARTITION BY doc_id) AS total FROM c WHERE ch = '%') "
    "SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS \"column\", place, total, total > 5 AS truncated FROM r WHERE place <= 5",
)
def first_by_column(t):
    """The first five places of a mark in each document by line and column, with how many there are."""
    from tidemark.operators import scan as S

    lines = S.lines(t("documents").where(F.contains("text", F.lit("%"))), "doc_id")
    found = S.located(lines, "doc_id", [("%", "generic")])
    top = S.first_of_each(found, "doc_id", ["line", "column"], 5)
    return top.select("doc_id", "line", "column", F.col("place").cast("long").alias("place"), "total", "truncated")
