"""Queries of increments, sessions, digests, evidence, joins and windows over events, conversations and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import text as T
from tidemark.operators import increments as I
from tidemark.operators.graph import reached
from tidemark.operators.staging import numbered, stage

from .tables import query

ZONE = "America/Sao_Paulo"
TODAY = "2024-01-25"
_LD = f"CAST(ts::TIMESTAMP AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}' AS DATE)"
_today = lambda: F.lit(TODAY).cast("date")


def local_events(t):
    return t.events().withColumn("day", D.local_day(F.col("ts"), ZONE))


def marks(t):
    """A mark for each source: the last day on which it had seen a tenth of its events."""
    return t("events").groupBy(F.col("event_type").alias("source_id")).agg(F.date_add(F.lit("2024-01-10").cast("date"), (F.count("*") % 20).cast("int")).alias("mark"))


_MARKS = "SELECT event_type AS source_id, CAST(DATE '2024-01-10' + CAST(count(*) % 20 AS INT) AS DATE) AS mark FROM events GROUP BY 1"


@query("T01_marks", f"SELECT source_id, CAST(mark AS VARCHAR) AS mark FROM ({_MARKS})")
def mark_table(t):
    return marks(t).select("source_id", F.col("mark").cast("string").alias("mark"))


@query("T02_window", f"""SELECT source_id, CAST(mark + 1 AS VARCHAR) AS first_day, least(greatest(CAST(DATE '{TODAY}' - mark - 1 AS BIGINT), 0), 7) AS days, greatest(CAST(DATE '{TODAY}' - mark - 1 AS BIGINT) - 7, 0) AS remaining, mark > DATE '{TODAY}' - 1 AS future FROM ({_MARKS})""")
def window(t):
    w = marks(t).withColumn("w", I.window_days(F.col("mark"), _today()))
    return w.select("source_id", F.date_add("mark", 1).cast("string").alias("first_day"), F.size("w.days").cast("long").alias("days"), F.col("w.remaining").cast("long").alias("remaining"), F.col("w.future").alias("future"))


@query("T03_tumbling_day", f"SELECT CAST({_LD} AS VARCHAR) AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def tumbling_day(t):
    """By local date: an exact day of 24 hours would be wrong across clock changes."""
    return local_events(t).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("T04_union_window", f"WITH m AS ({_MARKS}), d AS (SELECT source_id, unnest(generate_series(CAST(mark + 1 AS TIMESTAMP), CAST(least(mark + 7, DATE '{TODAY}' - 1) AS TIMESTAMP), INTERVAL 1 DAY)) AS day, greatest(CAST(DATE '{TODAY}' - mark - 1 AS BIGINT) - 7, 0) AS remaining FROM m WHERE mark < DATE '{TODAY}' - 1) SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, count(*) AS sources, max(remaining) AS remaining FROM d GROUP BY 1")
def union_window(t):
    """Days of all sources together (U02): distinct, with how many sources ask for each."""
    w = marks(t).withColumn("w", I.window_days(F.col("mark"), _today()))
    days = w.select(F.explode("w.days").alias("d"), F.col("w.remaining").cast("long").alias("r"))
    return days.groupBy(F.col("d").cast("string").alias("day")).agg(F.count("*").alias("sources"), F.max("r").alias("remaining"))


@query("T05_aligned_pair", f"WITH d AS (SELECT DISTINCT event_type, {_LD} AS day FROM events WHERE event_type IN ('purchase', 'signup')) SELECT CAST(a.day AS VARCHAR) AS day FROM d a JOIN d b ON a.day = b.day WHERE a.event_type = 'purchase' AND b.event_type = 'signup'")
def aligned_pair(t):
    """Days that the second source may close: those that the first has read too."""
    d = local_events(t).select("event_type", "day").distinct()
    one, two = d.where("event_type = 'purchase'").select("day"), d.where("event_type = 'signup'").select("day")
    return two.join(one, "day", "left_semi").select(F.col("day").cast("string").alias("day"))


CAP = 40


@query("T06_admission", f"""WITH e AS (SELECT event_type AS source, {_LD} AS day, user_id FROM events), s AS (SELECT source, user_id, min(day) AS day FROM e GROUP BY ALL), f AS (SELECT source, day, count(*) AS fresh FROM s GROUP BY ALL),
d AS (SELECT DISTINCT source, day FROM e), r AS (SELECT source, day, coalesce(fresh, 0) AS fresh, CAST(sum(coalesce(fresh, 0)) OVER (PARTITION BY source ORDER BY day) AS BIGINT) AS so_far FROM d LEFT JOIN f USING (source, day))
SELECT source, CAST(day AS VARCHAR) AS day, fresh, so_far, so_far <= {CAP} AS taken FROM r""")
def admission(t):
    """Whole days under a cap of sessions."""
    days = local_events(t).select(F.col("event_type").alias("source"), "day", "user_id").distinct()
    return I.admitted_days(days, "source", "day", "user_id", CAP).select("source", F.col("day").cast("string").alias("day"), "fresh", "so_far", "taken")


@query("A02_session_days", f"SELECT user_id, CAST({_LD} AS VARCHAR) AS day, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY ALL")
def session_days(t):
    s = I.sessions(local_events(t), "user_id", "day", "ts")
    return s.select("user_id", F.col("day").cast("string").alias("day"), F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("A03_session_rollup", f"WITH e AS (SELECT user_id, ts FROM events WHERE {_LD} BETWEEN DATE '2024-01-05' AND DATE '2024-01-11') SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS place FROM e GROUP BY 1")
def session_rollup(t):
    """Sessions over the covered days in the order of O02: last first, then by name."""
    s = I.sessions(local_events(t).where("day between '2024-01-05' and '2024-01-11'"), "user_id", "day", "ts").groupBy("user_id").agg(F.min("first").alias("a"), F.max("last").alias("b"))
    s = numbered(s, "place", F.desc("b"), "user_id")
    return s.select("user_id", F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("last"), "place")


@query("A04_drop_reasons", f"SELECT CASE WHEN user_id % 10 = 3 THEN 'excludedPath' WHEN {_LD} < DATE '2024-01-05' THEN 'modifiedBeforeWindow' WHEN {_LD} > DATE '2024-01-11' THEN 'outOfWindow' WHEN event_type = 'view' THEN 'selfTrace' WHEN value IS NULL THEN 'unreadable' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY 1")
def drop_reasons(t):
    """The first reason that applies, in the order of the tests."""
    r = F.when(F.col("user_id") % 10 == 3, "excludedPath").when(F.col("day") < "2024-01-05", "modifiedBeforeWindow").when(F.col("day") > "2024-01-11", "outOfWindow").when(F.col("event_type") == "view", "selfTrace").when(F.col("value").isNull(), "unreadable").otherwise("kept")
    return local_events(t).groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


@query("F06_in_window", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 03:00:00' AND ts < TIMESTAMP '2024-01-12 03:00:00'")
def in_window(t):
    """Half open, from the start of the first local day to the start of the day after the last."""
    a, b = (D.start_of_day(F.lit(x).cast("date"), ZONE) for x in ("2024-01-05", "2024-01-12"))
    return t.events().where((F.col("ts") >= a) & (F.col("ts") < b)).select("event_id")


@query("F07_human_messages", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND turn % 5 <> 4")
def human_messages(t):
    """User lines that no flag marks as written by the harness; an unknown origin is kept."""
    flagged = t("conversations").withColumn("is_meta", F.col("turn") % 5 == 4).withColumn("origin", F.lit(None).cast("string"))
    return flagged.where((F.col("role") == "user") & ~F.col("is_meta") & F.coalesce(F.col("origin") == "human", F.lit(True))).select("conv_id", "turn")


@query("F08_self_trace", "SELECT conv_id FROM (SELECT conv_id, arg_min(text, turn) AS first FROM conversations WHERE role = 'user' GROUP BY 1) WHERE starts_with(first, 'Th')")
def self_trace(t):
    """Sessions whose first user message starts with a known signature."""
    first = t("conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    return first.where(F.startswith("first", F.lit("Th"))).select("conv_id")


@query("F09_exclusion", "SELECT doc_id FROM documents WHERE NOT (contains(source, 'c1') OR contains(source, '7'))")
def exclusion(t):
    return t("documents").where(~F.exists(F.array(F.lit("c1"), F.lit("7")), lambda p: F.contains("source", p))).select("doc_id")


BUDGET = 1500


@query("T07_digest", f"WITH m AS (SELECT conv_id, turn, strlen(text) + 13 AS cost FROM conversations WHERE role <> 'system'), r AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS running FROM m) SELECT conv_id, turn, CAST(running AS BIGINT) AS running FROM r WHERE running < {BUDGET}")
def digest(t):
    """The newest messages of each session under a byte budget."""
    rows = t("conversations").where("role <> 'system'")
    return I.newest_within(rows, "conv_id", "turn", T.line_cost(F.col("text")), BUDGET).where("kept").select("conv_id", "turn", F.col("running").cast("long").alias("running"))


@query("A15_cut_totals", f"WITH m AS (SELECT conv_id, text, strlen(text) + 13 AS cost, turn FROM conversations WHERE role <> 'system'), r AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS running FROM m) SELECT conv_id, count(*) FILTER (WHERE running >= {BUDGET}) AS messages, CAST(coalesce(sum(length(text)) FILTER (WHERE running >= {BUDGET}), 0) AS BIGINT) AS chars FROM r GROUP BY 1")
def cut_totals(t):
    kept = I.newest_within(t("conversations").where("role <> 'system'"), "conv_id", "turn", T.line_cost(F.col("text")), BUDGET)
    return kept.groupBy("conv_id").agg(F.count_if(~F.col("kept")).alias("messages"), F.coalesce(F.sum(F.when(~F.col("kept"), F.length("text"))), F.lit(0)).cast("long").alias("chars"))


@query("W04_held_days", f"WITH d AS (SELECT event_type, {_LD} AS day, count(*) AS bytes FROM events GROUP BY ALL), r AS (SELECT *, sum(bytes) OVER (PARTITION BY event_type ORDER BY day) AS running, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d) SELECT event_type, CAST(day AS VARCHAR) AS day, CAST(running AS BIGINT) AS running FROM r WHERE running < 500 OR i = 1")
def held_days(t):
    days = local_events(t).groupBy("event_type", "day").agg(F.count("*").alias("bytes"))
    return I.held_days(days, "event_type", "day", "bytes", 500).where("held").select("event_type", F.col("day").cast("string").alias("day"), F.col("running").cast("long").alias("running"))


_READ = f"SELECT event_type, {_LD} AS day, count(*) FILTER (WHERE user_id % 7 = 0) > 0 AS ok FROM events GROUP BY ALL"


@query("W08_contiguous_prefix", f"WITH d AS ({_READ}), g AS (SELECT event_type, min(day) FILTER (WHERE NOT ok) AS gap, max(day) AS fin, min(day) AS beg FROM d GROUP BY 1) SELECT event_type, CAST(CASE WHEN gap IS NULL THEN fin WHEN gap > beg THEN CAST(gap - 1 AS DATE) END AS VARCHAR) AS upto FROM g")
def contiguous_prefix(t):
    days = local_events(t).groupBy("event_type", "day").agg((F.count_if(F.col("user_id") % 7 == 0) > 0).alias("ok"))
    return I.read_prefix(days, "event_type", "day", "ok").select("event_type", F.col("upto").cast("string").alias("upto"))


@query("W09_gap_free_range", f"WITH d AS (SELECT event_type, min({_LD}) AS a, max({_LD}) AS b FROM events GROUP BY 1) SELECT event_type, CAST(unnest(range(0, least(CAST(b - a AS BIGINT) + 1, 7))) AS BIGINT) AS i FROM d")
def gap_free_range(t):
    d = local_events(t).groupBy("event_type").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return d.select("event_type", F.posexplode(F.slice(F.sequence("a", "b"), F.lit(1), F.lit(7))).alias("i", "day")).select("event_type", F.col("i").cast("long").alias("i"))


@query("W07_last_wins", "WITH x AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'empty' ELSE 'ok' END AS s FROM events), f AS (SELECT user_id, arg_min(s, event_id) AS s FROM x WHERE s <> 'ok' GROUP BY 1) SELECT u.user_id, coalesce(f.s, 'ok') AS state FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN f USING (user_id)")
def last_wins(t):
    """Tokens in order: a token seen again overrides only an ok."""
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "empty").otherwise("ok")
    return I.report_states(t("events").select("user_id", F.col("event_id").alias("seq"), state.alias("state")), "user_id")


@query("T08_evidence", f"SELECT event_type AS source_id, count(*) FILTER (WHERE user_id % 3 <> 0) AS read, count(*) AS expected, count(*) FILTER (WHERE user_id % 3 <> 0) = count(*) AS ok FROM events WHERE {_LD} = DATE '2024-01-05' GROUP BY 1")
def evidence(t):
    day = local_events(t).where("day = '2024-01-05'").groupBy(F.col("event_type").alias("source_id")).agg(F.count_if(F.col("user_id") % 3 != 0).alias("read"), F.count("*").alias("expected"))
    return day.withColumn("ok", F.col("read") == F.col("expected"))


@query("T09_whole_reads", "SELECT o_orderkey, count(l_orderkey) AS results, count(l_orderkey) > 0 AND coalesce(bool_and(l_returnflag <> 'R'), false) AS whole FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def whole_reads(t):
    """A use counts only if it was answered and no answer failed."""
    j = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("results"), F.coalesce(F.bool_and(F.col("l_returnflag") != "R"), F.lit(False)).alias("whole"))


@query("A05_fold_results", "SELECT l_orderkey AS tool_use_id, bool_or(l_returnflag = 'R') AS failed, bool_or(l_linestatus = 'O') AS more, CASE WHEN count(*) > 1 THEN NULL ELSE max(l_linenumber) END AS items FROM lineitem GROUP BY 1")
def fold_results(t):
    r = t("lineitem").select(F.col("l_orderkey").alias("tool_use_id"), (F.col("l_returnflag") == "R").alias("failed"), (F.col("l_linestatus") == "O").alias("has_next"), F.col("l_linenumber").alias("items"))
    return I.fold_results(r)


@query("A14_listed_total", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'N') THEN NULL ELSE sum(l_linenumber) END AS listed FROM lineitem GROUP BY 1")
def listed_total(t):
    """A sum that one unknown count makes unknown."""
    items = F.when(F.col("l_returnflag") != "N", F.col("l_linenumber").cast("long"))
    return t("lineitem").groupBy("l_orderkey").agg(F.when(F.count_if(items.isNull()) > 0, None).otherwise(F.sum(items)).alias("listed"))


_OUT = f"""m AS ({_MARKS}), o AS (SELECT event_type AS source_id, max(CAST(ts AS DATE)) FILTER (WHERE user_id % 11 = 0) AS day, CAST(count(*) % 2 AS BIGINT) AS exit_code, count(*) % 3 <> 0 AS evidence_ok, CASE WHEN count(*) % 5 = 0 THEN 'empty' ELSE 'ok' END AS state FROM events GROUP BY 1)"""


@query("T12_commit", f"""WITH {_OUT}, w AS (SELECT m.source_id, mark, day, CASE WHEN day IS NULL THEN 'no_day' WHEN day >= DATE '2024-02-25' THEN 'day_not_over' WHEN exit_code <> 0 THEN 'run_failed' WHEN NOT evidence_ok THEN 'no_evidence' WHEN state = 'empty' THEN 'empty_with_listing' WHEN day <= mark THEN 'not_later' END AS reason FROM m JOIN o USING (source_id))
SELECT source_id, CAST(CASE WHEN reason IS NULL THEN day ELSE mark END AS VARCHAR) AS mark, reason FROM w""")
def commit(t):
    """Marks move only where nothing speaks against it; a closed day is never reopened."""
    n = F.count("*")
    out = t("events").groupBy(F.col("event_type").alias("source_id")).agg(F.max(F.when(F.col("user_id") % 11 == 0, F.to_date("ts"))).alias("day"), (n % 2).alias("exit_code"), (n % 3 != 0).alias("evidence_ok"), F.when(n % 5 == 0, "empty").otherwise("ok").alias("state"), n.alias("listed"), n.alias("read"))
    return I.commit(marks(t), out, F.lit("2024-02-25").cast("date")).select("source_id", F.col("mark").cast("string").alias("mark"), "reason")


@query("T13_vacuous", f"SELECT source_id, (SELECT count(*) FROM events e WHERE e.event_type = source_id AND CAST(e.ts AS DATE) > mark) = 0 AS vacuous FROM ({_MARKS})")
def vacuous(t):
    """Sources with nothing listed after their mark, which may advance without a run."""
    m = marks(t)
    later = t("events").join(m, F.col("event_type") == F.col("source_id")).where(F.to_date("ts") > F.col("mark")).select("source_id").distinct().withColumn("some", F.lit(True))
    return m.join(later, "source_id", "left").select("source_id", F.col("some").isNull().alias("vacuous"))


@query("T15_late_rows", f"SELECT source_id, count(*) FILTER (WHERE CAST(ts AS DATE) <= mark) AS late FROM events JOIN ({_MARKS}) ON event_type = source_id GROUP BY 1")
def late_rows(t):
    j = t("events").join(marks(t), F.col("event_type") == F.col("source_id"))
    return j.groupBy("source_id").agg(F.count_if(F.to_date("ts") <= F.col("mark")).alias("late"))


_LOG = "SELECT user_id, event_id AS seq, event_type, ts, props FROM events WHERE event_type IN ('error', 'purchase')"


def incident_log(t):
    return t("events").where("event_type in ('error', 'purchase')").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"), (F.col("event_type") == "purchase").alias("closes"), "ts", "props")


@query("W06_open_incidents", f"WITH l AS ({_LOG}), c AS (SELECT user_id, max(seq) FILTER (WHERE event_type = 'purchase') AS c FROM l GROUP BY 1) SELECT l.user_id, seq FROM l JOIN c USING (user_id) WHERE event_type = 'error' AND (c IS NULL OR seq > c)")
def open_incidents(t):
    """Failures since the last closing entry."""
    return I.open_incidents(incident_log(t), "user_id").select("user_id", "seq")


@query("A06_incident_groups", f"WITH l AS ({_LOG}), c AS (SELECT user_id, max(seq) FILTER (WHERE event_type = 'purchase') AS c FROM l GROUP BY 1), o AS (SELECT l.user_id, seq, ts, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS code FROM l JOIN c USING (user_id) WHERE event_type = 'error' AND (c IS NULL OR seq > c)) SELECT code, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, arg_max(seq, seq) AS last_seq FROM o GROUP BY 1")
def incident_groups(t):
    code = F.try_variant_get(F.try_parse_json("props"), "$.k", "long") % 10
    o = I.open_incidents(incident_log(t), "user_id").groupBy(code.alias("code"))
    return o.agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"), F.max_by("seq", "seq").alias("last_seq"))


@query("B06_recent_repairs", "SELECT event_id, 'k' AS kind FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-10 00:00:00'")
def recent_repairs(t):
    """Repairs named by the incidents of the last day."""
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    rows = t.events().where((F.col("event_type") == "error") & (F.col("ts") > now - F.make_dt_interval(hours=F.lit(24))) & (F.col("ts") <= now))
    return rows.select("event_id", F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("kind"))


@query("T19_state_changes", "WITH h AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, event_id, before, event_type FROM h WHERE before IS NULL OR before <> event_type")
def state_changes(t):
    return I.change_of_state(t("events"), "user_id", "event_id", "event_type").select("user_id", "event_id", "before", "event_type")


@query("T20_isolation", "SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) FILTER (WHERE event_type NOT IN ('click', 'view', 'login')) AS extra, list_contains(list(event_type), 'click') AND list_contains(list(event_type), 'view') AS has_both FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def isolation(t):
    """What was seen and not expected, and the reverse, as array differences."""
    expected = F.array(*map(F.lit, ("click", "view", "login")))
    seen = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    extra = F.array_join(F.array_sort(F.array_except("seen", expected)), ",")
    return seen.select("user_id", F.nullif(extra, F.lit("")).alias("extra"), (F.size(F.array_except(F.array(F.lit("click"), F.lit("view")), "seen")) == 0).alias("has_both"))


@query("T21_remind_once", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def remind_once(t):
    """The first question about a path in a session; see tidemark.streaming for the stream."""
    return t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("T25_dead_runs", "SELECT event_id FROM events WHERE event_type = 'view' AND value < 20 AND CAST(json_extract(props, '$.k') AS BIGINT) < 10")
def dead_runs(t):
    """Runs that ended well and soon without a turn though they should have worked."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return t("events").where((F.col("event_type") == "view") & (F.col("value") < 20) & (k < 10)).select("event_id")


@query("J01_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi(t):
    """Walk and published set."""
    return t("documents").join(t("labels"), "doc_id", "left_semi").select("doc_id")


@query("J02_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@query("J12_before_since", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'before' ELSE 'since' END AS side FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id)")
def before_since(t):
    """Dirty now against the snapshot."""
    old = t("labels").where("quality = 1").select("doc_id").distinct().withColumn("old", F.lit(True))
    return t("documents").select("doc_id").join(old, "doc_id", "left").select("doc_id", F.when(F.col("old"), "before").otherwise("since").alias("side"))


@query("U03_intersect_except", "SELECT 'both' AS side, user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup') UNION ALL SELECT 'only', user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup')")
def intersect_except(t):
    a, b = (t("events").where(F.col("event_type") == x).select("user_id") for x in ("error", "signup"))
    return a.intersect(b).select(F.lit("both").alias("side"), "user_id").unionByName(a.subtract(b).select(F.lit("only").alias("side"), "user_id"))


@query("J06_denials", "SELECT DISTINCT o_orderkey, l_partkey IS NOT NULL AS known FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'P') LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def denials(t):
    uses = t("lineitem").dropDuplicates(["l_orderkey"]).select("l_orderkey", F.lit(True).alias("use"))
    return t("orders").where("o_orderstatus = 'P'").select("o_orderkey").distinct().join(uses, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("use").isNotNull().alias("known"))


@query("J07_both_ways", "SELECT 'no order' AS side, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'no customer', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def both_ways(t):
    c, o = t("customer"), t("orders").select("o_custkey").distinct()
    one = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("no order").alias("side"), "c_custkey")
    two = o.join(c.where("c_mktsegment <> 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("no customer").alias("side"), F.col("o_custkey").alias("c_custkey"))
    return one.unionByName(two)


@query("J09_latest_match", "WITH p AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS latest FROM orders GROUP BY 1) SELECT c_custkey, latest, latest > c_acctbal * 20 AS same FROM customer JOIN p ON c_custkey = o_custkey")
def latest_match(t):
    """The last entry of each path wins, then it is compared."""
    p = t("orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("latest"))
    return t("customer").join(p, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "latest", (F.col("latest") > F.col("c_acctbal") * 20).alias("same"))


@query("J10_next_match", "SELECT a.event_id, min(b.event_id) AS follows FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.event_id > a.event_id WHERE a.event_type = 'signup' GROUP BY 1")
def next_match(t):
    """The next matching call after each one: one sorted pass a key instead of a join on an inequality."""
    back = Window.partitionBy("user_id").orderBy(F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    rows = t("events").where("event_type in ('signup', 'purchase')").withColumn("follows", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(back))
    return rows.where("event_type = 'signup'").select("event_id", "follows")


@query("J11_interval", f"SELECT event_id, CAST({_LD} AS VARCHAR) AS day FROM events WHERE {_LD} BETWEEN DATE '2024-01-05' AND DATE '2024-01-11'")
def interval(t):
    """Instants to the day interval that holds them: the starts are an array of at most a few days, searched in place."""
    days = F.sequence(F.lit("2024-01-05").cast("date"), F.lit("2024-01-12").cast("date"))
    starts = F.transform(days, lambda d: F.struct(D.start_of_day(d, ZONE).alias("at"), d.alias("day")))
    hit = F.filter(starts, lambda s: s["at"] <= F.col("ts"))
    rows = t.events().withColumn("n", F.size(hit)).where((F.col("n") > 0) & (F.col("n") < 8))
    return rows.select("event_id", F.element_at(days, F.col("n")).cast("string").alias("day"))


@query("J13_enum_lookup", "SELECT p_partkey, p_type IN ('ECONOMY', 'STANDARD') OR (p_type = 'PROMO' AND p_size > 25) AS allowed FROM part")
def enum_lookup(t):
    """Allowed values by field and note type, from a small table given with the query."""
    allow = F.create_map(F.lit(True), F.array(*map(F.lit, ("ECONOMY", "STANDARD", "PROMO"))), F.lit(False), F.array(*map(F.lit, ("ECONOMY", "STANDARD"))))
    return t("part").select("p_partkey", F.array_contains(allow[F.col("p_size") > 25], F.col("p_type")).alias("allowed"))


@query("J15_tree_compare", "SELECT coalesce(a.n_nationkey, b.s_nationkey) AS path, a.n_regionkey IS DISTINCT FROM b.m AS differs FROM nation a FULL JOIN (SELECT s_nationkey, CAST(min(s_suppkey) % 5 AS INT) AS m FROM supplier GROUP BY 1) b ON a.n_nationkey = b.s_nationkey")
def tree_compare(t):
    """Chosen paths whose ids differ between two trees; a missing one differs."""
    b = t("supplier").groupBy("s_nationkey").agg((F.min("s_suppkey") % 5).cast("int").alias("m"))
    j = t("nation").join(b, F.col("n_nationkey") == F.col("s_nationkey"), "full")
    return j.select(F.coalesce("n_nationkey", "s_nationkey").alias("path"), (~F.col("n_regionkey").eqNullSafe(F.col("m"))).alias("differs"))


@query("J16_pattern_union", "SELECT pattern, bool_or(failed) AS failed FROM (SELECT p_brand AS pattern, false AS failed FROM part UNION ALL SELECT p_brand, p_size > 48 FROM part UNION ALL SELECT p_type, false FROM part) GROUP BY 1")
def pattern_union(t):
    p = t("part")
    rows = p.select(F.col("p_brand").alias("pattern"), F.lit(False).alias("failed")).unionByName(p.select(F.col("p_brand").alias("pattern"), (F.col("p_size") > 48).alias("failed"))).unionByName(p.select(F.col("p_type").alias("pattern"), F.lit(False).alias("failed")))
    return rows.groupBy("pattern").agg(F.bool_or("failed").alias("failed"))


@query("A17_project_verdict", "SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'missing' WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'waiting' ELSE 'found' END AS verdict FROM orders GROUP BY 1")
def project_verdict(t):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t("orders").groupBy("o_custkey").agg(F.when(n("F") == 0, "missing").when(n("P") > 0, "waiting").otherwise("found").alias("verdict"))


@query("V02_three_way", """WITH d AS (SELECT doc_id, md5(text) AS shipped, CASE WHEN doc_id % 4 = 0 THEN md5(text) ELSE md5(text || 'x') END AS now, CASE WHEN doc_id % 4 = 1 THEN md5(text || 'x') WHEN doc_id % 4 = 2 THEN md5(text) ELSE md5(text || 'y') END AS seeded, doc_id % 9 = 0 AS gone FROM documents)
SELECT doc_id, CASE WHEN gone THEN 'missing' WHEN now = shipped THEN 'current' WHEN now = seeded THEN 'refresh' WHEN shipped = seeded THEN 'kept' ELSE 'offer' END AS class FROM d""")
def three_way(t):
    """By hashes of the shipped, the seeded and the present text."""
    k, x = F.col("doc_id") % 4, lambda s: F.md5(F.concat("text", F.lit(s)))
    d = t("documents").select("doc_id", F.md5("text").alias("shipped"), F.when(k == 0, F.md5("text")).otherwise(x("x")).alias("now"), F.when(k == 1, x("x")).when(k == 2, F.md5("text")).otherwise(x("y")).alias("seeded"))
    return d.select("doc_id", F.when(F.col("doc_id") % 9 == 0, "missing").when(F.col("now") == F.col("shipped"), "current").when(F.col("now") == F.col("seeded"), "refresh").when(F.col("shipped") == F.col("seeded"), "kept").otherwise("offer").alias("class"))


_EDGES = "SELECT DISTINCT user_id AS src, CAST(2 * (user_id + CAST(json_extract(props, '$.k') AS BIGINT) % 2) AS BIGINT) AS dst FROM events WHERE json_extract(props, '$.k') IS NOT NULL"


@query("R21_orphans", f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT e.dst FROM e JOIN r ON e.src = r.node) SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT node FROM r)")
def orphans(t):
    """Nodes that no path of links from the root reaches: each event links its user to the double of it or of the next."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    edges = stage(t("events").select(F.col("user_id").alias("src"), (2 * (F.col("user_id") + k % 2)).alias("dst")).distinct(), "links")
    root = t.spark.range(1, 2, numPartitions=1).select(F.col("id").alias("node"))
    return t("events").select("user_id").distinct().join(reached(edges, root, stage), F.col("user_id") == F.col("node"), "left_anti")
