"""Briefing queries (E06, B01): blocks of facts over pending rows, notes, questions and runs made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.briefing import BLOCKS, Briefing, resolve_blocks

from . import dates, queue
from .tables import query

TODAY, NOW, ASKED = dates.TODAY, dates.NOW, queue.TODAY
#: A configuration that asks for all fact blocks, a judgement and a block of its own.
ASKS = '["due","upcoming","undated","sources","open_prs","stale","questions","strategy",{"id":"my-block","title":" Mine ","instruction":"Read it.","read":["notes/./a.md","notes/a.md"]}]'


def relations(t) -> dict:
    pending = dates.deadline_cells(t).select(
        F.concat(F.lit("pending/"), "o_custkey", F.lit(".md")).alias("file"), F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("what"), F.col("cell").alias("raw"),
        F.col("found.day").alias("deadline"), F.size("found.invalid").alias("invalid"), F.size("found.yearless").alias("yearless"),
    )
    code = F.when(F.col("invalid") > 0, "invalid_date").when(F.col("yearless") > 0, "date_without_year")
    last = t.events().groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    state = F.when(F.col("last") == "error", "needs_auth").when(F.col("last") == "signup", "absent").otherwise("ok")
    due = t("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    day = F.date_format("last", "yyyy-MM-dd")
    written = F.when(F.col("o_custkey") % 3 == 0, day).when(F.col("o_custkey") % 3 == 1, F.concat(day, F.lit("T23:30:00+00:00"))).otherwise(F.concat(day, F.lit("T10:00")))
    return {
        "pending": pending,
        "pending_problems": pending.select("file", "line", code.alias("code")).where("code is not null"),
        "runs": last.select(F.col("user_id").cast("string").alias("source"), state.alias("state"), (F.col("last") == "purchase").alias("advanced")),
        "pull_requests": t.events().where("event_type = 'signup'").select(F.col("event_id").alias("number"), "event_type", F.col("props").alias("url"), F.col("ts").alias("created")).withColumnRenamed("event_type", "title"),
        "notes": due.select(F.concat(F.lit("notes/"), "o_custkey", F.lit(".md")).alias("path"), written.alias("stale_after")),
        "questions": queue.questions(t),
    }


_PENDING = f"SELECT 'pending/' || o_custkey || '.md:' || o_orderkey AS key, o_orderpriority AS what, {dates._CELL} AS raw, CASE WHEN o_orderkey % 6 < 3 THEN CAST(o_orderdate AS DATE) END AS d, CASE o_orderkey % 6 WHEN 3 THEN 'invalid_date' WHEN 4 THEN 'date_without_year' END AS mark FROM orders"
_LAST = "SELECT user_id, arg_max(event_type, {'ts': ts, 'e': event_id}) AS last FROM events GROUP BY user_id"
_NOTES = """SELECT 'notes/' || o_custkey || '.md' AS path, max(CAST(o_orderdate AS DATE)) AS d, o_custkey % 3 AS form,
  strftime(max(o_orderdate), '%Y-%m-%d') || CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'T23:30:00+00:00' ELSE 'T10:00' END AS written FROM orders GROUP BY o_custkey"""
_STALE = f"SELECT path, d, written FROM n WHERE form < 2 AND d <= DATE '{TODAY}'"
_ASKED = f"""SELECT 'q-' || lpad(CAST(item_id AS VARCHAR), 8, '0') AS id, text, CASE WHEN item_id % 4 = 0 THEN 0 ELSE item_id % 4 + 1 END AS times, CASE WHEN item_id % 4 > 0 THEN DATE '2024-05-01' + CAST(item_id % 4 AS INT) END AS last,
  DATE '{ASKED}' - (DATE '2024-01-01' + CAST(item_id AS INT)) AS age FROM benchmark WHERE item_id % 3 <> 0"""


@query("E06_blocks", f"""WITH p AS ({_PENDING}), l AS ({_LAST}), n AS ({_NOTES}), q AS ({_ASKED}),
b AS (SELECT 1 AS position, 'due' AS id, CASE WHEN d < DATE '{TODAY}' THEN 'overdue' ELSE 'today' END AS part, key, d AS day, what AS text, mark FROM p WHERE d <= DATE '{TODAY}'
UNION ALL SELECT 2, 'upcoming', CASE WHEN d <= DATE '{TODAY}' + 7 THEN 'upcoming' ELSE 'later' END, key, d, what, mark FROM p WHERE d > DATE '{TODAY}'
UNION ALL SELECT 3, 'undated', 'undated', key, NULL, what || ' | ' || raw, mark FROM p WHERE d IS NULL
UNION ALL SELECT 4, 'sources', CASE last WHEN 'error' THEN 'needs_auth' WHEN 'signup' THEN 'absent' ELSE 'ok' END, CAST(user_id AS VARCHAR), NULL, CASE last WHEN 'error' THEN 'needs_auth' WHEN 'signup' THEN 'not_in_session' ELSE 'doctor' END, NULL FROM l WHERE last <> 'purchase'
UNION ALL SELECT 5, 'open_prs', 'open', CAST(event_id AS VARCHAR), CAST(ts AS DATE), event_type, props FROM events WHERE event_type = 'signup'
UNION ALL SELECT 6, 'stale', 'stale', path, d, written, NULL FROM ({_STALE})
UNION ALL SELECT 7, 'questions', CASE WHEN times >= 3 THEN 'escalated' ELSE 'open' END, id, last, text, CASE WHEN age > 100 THEN 'due_for_archive' END FROM q
UNION ALL SELECT 8, 'strategy', 'instruction', 'strategy', NULL, NULL, ''
UNION ALL SELECT 9, 'my-block', 'instruction', 'Mine', NULL, 'Read it.', 'notes/a.md')
SELECT position, id, part, key, CAST(day AS VARCHAR) AS day, text, mark FROM b""")
def blocks(t):
    """All fact blocks as table functions, each a relation of its own, with instructions and a custom block."""
    configs = t.spark.createDataFrame([("all", ASKS)], "config string, blocks string")
    files = t.spark.createDataFrame([("notes/a.md", True)], "path string, is_file boolean")
    asked, _ = resolve_blocks(configs, [], files)
    day = f"DATE '{TODAY}'"
    # The questions' days are of another year than the pending rows'.
    told = Briefing(t.spark, **relations(t))
    fixed = {"days": "7", "escalate_after": "3", "max_age": "100"}
    out = told.write(asked.where("id <> 'questions'"), today=day, **fixed).unionByName(told.write(asked.where("id = 'questions'"), today=f"DATE '{ASKED}'", **fixed))
    return out.select("position", "id", "part", "key", F.col("day").cast("string").alias("day"), "text", "mark")


_IDS = "[" + ", ".join(f"'{x}'" for x in BLOCKS) + "]"
#: A configuration for each part: catalog blocks, unknown ones, objects with and without what they need.
_CONFIG = """'["due","' || split_part(lower(p_type), ' ', 1) || '","' || %s[1 + p_size %% 10] || '",' || p_size || ',{"id":"' || lower(replace(p_brand, '#', CASE WHEN p_size %% 2 = 0 THEN '-' ELSE '#' END))
  || '","title":"' || CASE WHEN p_size %% 5 = 0 THEN ' ' ELSE p_name END || '","instruction":"' || p_type || '","read":["' || CASE WHEN p_size %% 7 = 0 THEN '../' ELSE '' END || 'docs/' || p_size || '.md","private/' || p_size || '.md"]},{"id":"'
  || CASE WHEN p_size > 25 THEN 'stale' ELSE 'brand-11' END || '","title":"t","instruction":"i"}]'""" % _IDS


@query("E06_block_problems", f"""WITH c AS (SELECT p_partkey AS config, CAST({_CONFIG} AS JSON) AS v FROM part),
e AS (SELECT config, i AS position, json_extract(v, '$[' || (i - 1) || ']') AS e FROM (SELECT config, v, unnest(range(1, CAST(json_array_length(v) AS BIGINT) + 1)) AS i FROM c)),
s AS (SELECT *, json_type(e) AS kind, CASE json_type(e) WHEN 'VARCHAR' THEN json_extract_string(e, '$') WHEN 'OBJECT' THEN json_extract_string(e, '$.id') END AS id FROM e),
k AS (SELECT *, CASE WHEN kind = 'VARCHAR' AND NOT list_contains({_IDS}, id) THEN 'unknown' WHEN kind NOT IN ('VARCHAR', 'OBJECT') THEN 'not_a_block'
  WHEN kind = 'OBJECT' AND NOT regexp_full_match(id, '[a-z][a-z0-9]*([-_][a-z0-9]+)*') THEN 'bad_id' WHEN kind = 'OBJECT' AND list_contains({_IDS}, id) THEN 'custom_id_taken' END AS code FROM s),
d AS (SELECT * REPLACE (CASE WHEN code IS NULL AND row_number() OVER (PARTITION BY config, id, code IS NULL ORDER BY position) > 1 THEN 'duplicate' ELSE code END AS code) FROM k),
o AS (SELECT *, json_extract_string(e, '$.title') AS title FROM d WHERE code IS NULL AND kind = 'OBJECT'),
r AS (SELECT config, position, id, json_extract_string(e, '$.read[' || j || ']') AS path FROM (SELECT *, unnest(range(0, CAST(coalesce(json_array_length(e, '$.read'), 0) AS BIGINT))) AS j FROM o))
SELECT config, CAST(position AS INT) AS position, code, id, NULL AS field, NULL AS path, NULL AS entry FROM d WHERE code IS NOT NULL
UNION ALL SELECT config, CAST(position AS INT), 'missing_field', id, 'title', NULL, NULL FROM o WHERE trim(title) = ''
UNION ALL SELECT config, CAST(position AS INT), CASE WHEN path LIKE '../%' THEN 'read_outside' WHEN path LIKE 'private/%' THEN 'read_never_read' ELSE 'read_missing' END, id, NULL, path, CASE WHEN path LIKE 'private/%' THEN 'private' END
  FROM r WHERE path LIKE '../%' OR path LIKE 'private/%' OR CAST(regexp_extract(path, '[0-9]+') AS INT) % 3 = 0""")
def block_problems(t):
    """What is wrong with the blocks of many configurations at once."""
    size = F.col("p_size")
    ids = F.array(*map(F.lit, BLOCKS))
    obj = F.concat(
        F.lit('{"id":"'), F.lower(F.when(size % 2 == 0, F.replace("p_brand", F.lit("#"), F.lit("-"))).otherwise(F.col("p_brand"))), F.lit('","title":"'), F.when(size % 5 == 0, " ").otherwise(F.col("p_name")),
        F.lit('","instruction":"'), "p_type", F.lit('","read":["'), F.when(size % 7 == 0, "../").otherwise(""), F.lit("docs/"), size.cast("string"), F.lit('.md","private/'), size.cast("string"), F.lit('.md"]}'),
    )
    listed = F.concat(
        F.lit('["due","'), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit('","'), F.get(ids, size % 10), F.lit('",'), size.cast("string"), F.lit(","), obj,
        F.lit(',{"id":"'), F.when(size > 25, "stale").otherwise("brand-11"), F.lit('","title":"t","instruction":"i"}]'),
    )
    files = t("part").select(F.concat(F.lit("docs/"), size.cast("string"), F.lit(".md")).alias("path")).where(size % 3 != 0).distinct().withColumn("is_file", F.lit(True))
    return resolve_blocks(t("part").select(F.col("p_partkey").alias("config"), listed.alias("blocks")), ["private"], files)[1]


@query("B01_briefing_facts", f"""WITH p AS ({_PENDING}), n AS ({_NOTES}), q AS ({_ASKED})
SELECT 'today' AS fact, NULL AS key, '{TODAY}' AS value UNION ALL SELECT 'today_human', NULL, '15/06/1996' UNION ALL SELECT 'weekday', NULL, 'saturday' UNION ALL SELECT 'tz', NULL, 'UTC'
UNION ALL SELECT 'last_run', arg_max(o_orderpriority, o_orderkey), strftime(max(o_orderdate), '%d/%m/%Y %H:%M') || ' 0' FROM orders
UNION ALL SELECT 'connector_states', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'open_pull_requests', CAST(event_id AS VARCHAR), strftime(ts, '%d/%m/%Y') FROM events WHERE event_type = 'signup'
UNION ALL SELECT 'stale', path, strftime(d, '%d/%m/%Y') FROM ({_STALE})
UNION ALL SELECT 'git', 'work', 'main origin/main ' || (SELECT count(*) FROM nation) || ' ' || (SELECT count(*) FROM region) || ' ' || (SELECT count(*) FROM supplier)
UNION ALL SELECT 'lock', min(s_name), 'true free' FROM supplier
UNION ALL SELECT 'incidents', o_orderpriority, count(*) || ' ' || strftime(max(o_orderdate), '%d/%m %H:%M') FROM orders WHERE o_orderstatus = 'P' GROUP BY 2
UNION ALL SELECT 'incidents', o_orderpriority, CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND o_orderdate <= TIMESTAMP '{NOW}'
UNION ALL SELECT 'marks', event_type, CAST(DATE '{TODAY}' - 1 - CAST(max(ts) AS DATE) AS VARCHAR) FROM events GROUP BY event_type
UNION ALL SELECT 'pending', CASE WHEN d IS NULL THEN 'undated' WHEN d < DATE '{TODAY}' THEN 'overdue' WHEN d = DATE '{TODAY}' THEN 'today' WHEN d <= DATE '{TODAY}' + 7 THEN 'upcoming' ELSE 'later' END, CAST(count(*) AS VARCHAR) FROM p GROUP BY 2
UNION ALL SELECT 'questions', CASE WHEN times >= 3 THEN 'escalated' ELSE 'open' END, CAST(count(*) AS VARCHAR) FROM q GROUP BY 2""")
def briefing_facts(t):
    """The fourteen facts of a day; lists stay an item a row."""
    o, at = t("orders"), F.col("o_orderdate").cast("timestamp")
    count = lambda name: t(name).agg(F.count("*").alias(f"n_{name}"))
    more = {
        "last_run": o.agg(F.max(at).alias("at"), F.max_by("o_orderpriority", "o_orderkey").alias("reason")).withColumn("exit", F.lit(0)),
        "connectors": t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("state")),
        "git": count("nation").join(count("region")).join(count("supplier")).select(F.lit("work").alias("branch"), F.lit("main").alias("default_branch"), F.lit("origin/main").alias("upstream"), F.col("n_nation").alias("ahead"), F.col("n_region").alias("behind"), F.col("n_supplier").alias("dirty")),
        "lock": t("supplier").agg((F.count("*") > 0).alias("held"), F.min("s_name").alias("command")).withColumn("legacy", F.lit("free")),
        "incidents": o.where("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("reason")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")),
        "repairs": o.where("o_orderstatus = 'F'").select(at.alias("at"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").cast("string").alias("detail")),
        "marks": t.events().groupBy(F.col("event_type").alias("source")).agg(F.to_date(F.max("ts")).alias("day")),
    }
    return Briefing(t.spark, **relations(t), **more).facts(F.lit(NOW).cast("timestamp"))
