"""Date and time queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D

from .tables import query

ZONE = "America/Sao_Paulo"
TODAY, NOW = "1996-06-15", "1996-06-15 12:00:00"
_day = lambda: F.to_date("o_orderdate")


@query("D01_leap_years", "SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap, CAST(day(last_day(make_date(year(o_orderdate), 2, 1))) AS BIGINT) AS feb_days FROM orders")
def leap_years(t):
    y = F.year("o_orderdate")
    return t("orders").select(y.cast("long").alias("y"), D.is_leap_year(y).alias("leap"), D.days_in_month(y, F.lit(2)).cast("long").alias("feb_days")).distinct()


@query("D02_valid_dates", """SELECT o_orderkey, s, regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(s AS DATE) IS NOT NULL AS valid
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-') || CAST(28 + o_orderkey % 5 AS VARCHAR) ELSE strftime(o_orderdate, '%Y') END AS s FROM orders)""")
def valid_dates(t):
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-M-dd")).when(k == 2, F.concat(F.date_format("o_orderdate", "yyyy-MM-"), (28 + F.col("o_orderkey") % 5).cast("string"))).otherwise(F.date_format("o_orderdate", "yyyy"))
    return t("orders").select("o_orderkey", s.alias("s")).withColumn("valid", D.iso_day(F.col("s")).isNotNull())


@query("D03_valid_instants", """SELECT event_id, s, regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-5][0-9])') AND (right(s, 1) = 'Z' OR coalesce((CASE WHEN substr(s, -6, 1) = '-' THEN -1 ELSE 1 END) * (try_cast(substr(s, -5, 2) AS INT) * 60 + try_cast(right(s, 2) AS INT)) BETWEEN -720 AND 840, false)) AS valid
FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') || CASE event_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'T' ELSE ' ' END || strftime(ts, '%H:%M:%S') || CASE event_id % 5 WHEN 0 THEN 'Z' WHEN 1 THEN '+14:00' WHEN 2 THEN '+14:30' WHEN 3 THEN '-12:00' ELSE '' END AS s FROM events)""".replace("\\\\", "\\"))
def valid_instants(t):
    i = F.col("event_id")
    tail = F.element_at(F.array(*map(F.lit, ("Z", "+14:00", "+14:30", "-12:00", ""))), (i % 5 + 1).cast("int"))
    s = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.when(i % 3 == 2, " ").otherwise("T"), F.date_format("ts", "HH:mm:ss"), tail)
    return t("events").select("event_id", s.alias("s")).withColumn("valid", D.is_instant(F.col("s")))


@query("D04_add_days", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 45 AS VARCHAR) AS plus, CAST(CAST(o_orderdate AS DATE) - 400 AS VARCHAR) AS minus FROM orders")
def add_days(t):
    return t("orders").select("o_orderkey", F.date_add(_day(), 45).cast("string").alias("plus"), F.date_add(_day(), -400).cast("string").alias("minus"))


@query("D05_days_between", f"SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) - DATE '{TODAY}' AS BIGINT) AS days FROM lineitem")
def days_between(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.datediff(F.to_date("l_shipdate"), F.lit(TODAY).cast("date")).cast("long").alias("days"))


@query("D06_local_day", f"SELECT event_id, strftime(ts::TIMESTAMP AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}', '%Y-%m-%d') AS local_day FROM events")
def local_day(t):
    return t.events().select("event_id", D.local_day(F.col("ts"), ZONE).cast("string").alias("local_day"))


@query("D07_start_of_day", f"SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AT TIME ZONE 'Asia/Tokyo' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS starts FROM orders")
def start_of_day(t):
    return t("orders").select(_day().alias("d")).distinct().select(F.col("d").cast("string").alias("day"), F.date_format(D.start_of_day(F.col("d"), "Asia/Tokyo"), "yyyy-MM-dd HH:mm:ss").alias("starts"))


@query("D08_zone_clock", "SELECT event_id, strftime(ts::TIMESTAMP AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Kolkata', '%Y-%m-%dT%H:%M:%S') || '+05:30' AS clock FROM events")
def zone_clock(t):
    return t.events().select("event_id", D.zone_clock(F.col("ts"), "Asia/Kolkata").alias("clock"))


@query("D09_human_display", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS at FROM orders")
def human_display(t):
    return t("orders").select("o_orderkey", D.human_day(_day()).alias("day"), D.human_instant(F.col("o_orderdate").cast("timestamp"), "UTC").alias("at"))


@query("D10_weekday", "SELECT o_orderkey, dayname(o_orderdate) AS weekday FROM orders")
def weekday(t):
    return t("orders").select("o_orderkey", F.date_format("o_orderdate", "EEEE").alias("weekday"))


_STALE = "CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T13:00:00Z' ELSE strftime(o_orderdate, '%Y/%m/%d') END"


def _stale_text():
    k = F.col("o_orderkey") % 3
    return F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T13:00:00Z"))).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))


@query("D11_stale_by_zone", f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) <= DATE '{TODAY}' WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 13 HOUR <= TIMESTAMP '{NOW}' END AS stale FROM orders")
def stale_by_zone(t):
    return t("orders").select("o_orderkey", D.stale_by_zone(_stale_text(), F.lit(TODAY).cast("date"), F.lit(NOW).cast("timestamp")).alias("stale"))


@query("D12_stale_by_utc", f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) <= TIMESTAMP '{NOW}' WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 13 HOUR <= TIMESTAMP '{NOW}' ELSE false END AS stale FROM orders")
def stale_by_utc(t):
    return t("orders").select("o_orderkey", D.stale_by_utc(_stale_text(), F.lit(NOW).cast("timestamp")).alias("stale"))


_CELL = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN 'by ' || strftime(o_orderdate, '%-d/%-m/%Y') || ' or so' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN '31/02/2026' WHEN 4 THEN 'before ' || strftime(o_orderdate, '%d/%m') ELSE '' END"


def deadline_cells(t):
    """Orders as rows of a pending table, the deadline written in the ways that notes write it."""
    k = F.col("o_orderkey") % 6
    cell = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.concat(F.lit("by "), F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" or so"))).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 3, "31/02/2026").when(k == 4, F.concat(F.lit("before "), F.date_format("o_orderdate", "dd/MM"))).otherwise("")
    return t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", cell.alias("cell")).withColumn("found", D.deadline(F.col("cell")))


@query("D13_deadline_from_text", f"SELECT o_orderkey, {_CELL} AS cell, CASE WHEN o_orderkey % 6 < 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS deadline, CAST(CASE o_orderkey % 6 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS n_invalid, CAST(CASE o_orderkey % 6 WHEN 4 THEN 1 ELSE 0 END AS BIGINT) AS n_yearless FROM orders")
def deadline_from_text(t):
    return deadline_cells(t).select("o_orderkey", "cell", F.col("found.day").cast("string").alias("deadline"), F.size("found.invalid").cast("long").alias("n_invalid"), F.size("found.yearless").cast("long").alias("n_yearless"))


_BUCKET = f"CASE WHEN d IS NULL THEN 'undated' WHEN d < DATE '{TODAY}' THEN 'overdue' WHEN d = DATE '{TODAY}' THEN 'today' WHEN d <= DATE '{TODAY}' + 7 THEN 'upcoming' ELSE 'later' END"


@query("D14_bucket", f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 6 < 3 THEN CAST(o_orderdate AS DATE) END AS d FROM orders) GROUP BY 1")
def bucket(t):
    return deadline_cells(t).groupBy(D.bucket(F.col("found.day"), F.lit(TODAY).cast("date"), 7).alias("bucket")).agg(F.count("*").alias("n"))


@query("B02_pending_buckets", f"""WITH r AS (SELECT o_orderkey, o_custkey, {_CELL} AS cell, CASE WHEN o_orderkey % 6 < 3 THEN CAST(o_orderdate AS DATE) END AS d, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, o_custkey, CAST(d AS VARCHAR) AS deadline, {_BUCKET} AS bucket, CASE k WHEN 3 THEN 'invalid_date' WHEN 4 THEN 'no_year' WHEN 5 THEN 'empty' END AS problem FROM r""")
def pending_buckets(t):
    """Rows to deadline to bucket, with the reason why a deadline could not be read."""
    problem = F.when(F.col("found.day").isNotNull(), None).when(F.size("found.invalid") > 0, "invalid_date").when(F.size("found.yearless") > 0, "no_year").when(F.trim("cell") == "", "empty").otherwise("no_date")
    return deadline_cells(t).select("o_orderkey", "o_custkey", F.col("found.day").cast("string").alias("deadline"), D.bucket(F.col("found.day"), F.lit(TODAY).cast("date"), 7).alias("bucket"), problem.alias("problem"))


@query("O03_dated_order", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS place FROM orders WHERE o_orderkey % 6 < 3")
def dated_order(t):
    """Dated rows of each table by deadline, then in input order."""
    w = Window.partitionBy("o_custkey").orderBy("found.day", "o_orderkey")
    return deadline_cells(t).where("found.day is not null").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("D15_month_offset", """WITH p AS (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT *, CAST((year(b) - year(a)) * 12 + month(b) - month(a) AS INT) AS m FROM p)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN m >= 1 AND CAST(a + to_months(m) AS DATE) = b THEN m END AS BIGINT) AS months FROM n""")
def month_offset(t):
    j = t("lineitem").join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", D.month_offset(_day(), F.to_date("l_shipdate")).cast("long").alias("months"))


@query("A12_infer_stale_months", """WITH p AS (SELECT o_orderpriority AS dir, CAST(o_orderdate AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + to_months(CASE WHEN o_orderpriority LIKE '1%' THEN 6 WHEN o_orderpriority LIKE '2%' THEN 3 ELSE CAST(1 + o_orderkey % 2 AS INT) END) AS DATE) AS b FROM orders),
n AS (SELECT *, CAST((year(b) - year(a)) * 12 + month(b) - month(a) AS BIGINT) AS m FROM p)
SELECT dir, CASE WHEN min(m) = max(m) AND bool_and(m >= 1) THEN min(m) END AS months FROM n GROUP BY dir""")
def infer_stale_months(t):
    """The offset on which all notes of a folder agree."""
    p = F.col("o_orderpriority")
    due = F.add_months(_day(), F.when(F.startswith(p, F.lit("1")), 6).when(F.startswith(p, F.lit("2")), 3).otherwise((1 + F.col("o_orderkey") % 2).cast("int")))
    rows = t("orders").select(p.alias("dir"), D.month_offset(_day(), due).alias("m"))
    return rows.groupBy("dir").agg(F.when((F.min("m") == F.max("m")) & F.bool_and(F.col("m").isNotNull()), F.min("m")).cast("long").alias("months"))


@query("D16_next_fire_times", "SELECT event_id, i, strftime(CAST(CAST(ts AS DATE) + CASE WHEN strftime(ts, '%H:%M:%S.%f') < '07:30:00.000000' THEN i ELSE i + 1 END AS TIMESTAMP) + INTERVAL '7 hours 30 minutes', '%Y-%m-%d %H:%M') AS fires FROM events, (SELECT CAST(unnest(range(0, 3)) AS INT) AS i) WHERE event_type = 'signup'")
def next_fire_times(t):
    rows = t.events().where("event_type = 'signup'").select("event_id", F.posexplode(D.next_fire_times(F.col("ts"), "07:30", 3)).alias("i", "at"))
    return rows.select("event_id", "i", F.date_format("at", "yyyy-MM-dd HH:mm").alias("fires"))


@query("D17_same_clock", "SELECT event_id, true AS same, false AS other FROM events")
def same_clock(t):
    at = F.col("ts")
    return t.events().select("event_id", D.same_clock(at, "Europe/Madrid", "Europe/Paris").alias("same"), D.same_clock(at, "Europe/Madrid", "Africa/Algiers").alias("other"))


@query("D18_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp FROM events")
def stamp(t):
    return t.events().select("event_id", D.stamp(F.col("ts")).alias("stamp"))


@query("D19_rfc3339_slack", "SELECT event_id, strftime(ts - INTERVAL 12 HOUR, '%Y-%m-%dT%H:%M:%S') || 'Z' AS since FROM events")
def rfc3339_slack(t):
    return t.events().select("event_id", D.rfc3339(F.col("ts"), 12).alias("since"))


@query("B05_marks_behind", "SELECT event_type AS source_id, CAST(DATE '2024-03-01' - CAST(max(ts) AS DATE) - 1 AS BIGINT) AS behind FROM events GROUP BY 1")
def marks_behind(t):
    """Days from each source's mark to yesterday."""
    return t("events").groupBy(F.col("event_type").alias("source_id")).agg((F.datediff(F.lit("2024-03-01").cast("date"), F.to_date(F.max("ts"))) - 1).cast("long").alias("behind"))


@query("T24_mark_health", "SELECT user_id, CASE WHEN max(CAST(ts AS DATE)) > DATE '2024-01-26' THEN 'future' WHEN DATE '2024-01-26' - max(CAST(ts AS DATE)) > 3 THEN 'behind' ELSE 'ok' END AS verdict FROM events GROUP BY 1")
def mark_health(t):
    """Future first, then more than three days behind, then unset."""
    behind = F.datediff(F.lit("2024-01-26").cast("date"), F.to_date(F.max("ts")))
    return t("events").groupBy("user_id").agg(F.when(behind < 0, "future").when(behind > 3, "behind").when(behind.isNull(), "unset").otherwise("ok").alias("verdict"))
