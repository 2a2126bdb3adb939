"""Rule queries (R01-R30, P01-P19, A09-A13): parts and orders written as notes, then read back and checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import notes as N
from tidemark.operators import rules as R
from tidemark.operators import user_fields as U
from tidemark.operators.staging import spread

from .tables import ORACLES, query

CONFIG = {
    "required": ["title", "owner"], "forbidden": ["secret"], "types": ["ECONOMY", "STANDARD", "PROMO"],
    "extensions": {"size": {"kind": "number"}, "due": {"kind": "date"}, "flag": {"kind": "boolean"}, "brand": {"kind": "enum", "options": ["Brand#1", "Brand#2", "Brand#3"]}},
    "version": "2", "confidential": ["PROMO"], "max_cell": 11,
}


def vault(t):
    """Each part as a note in its type's folder; what is wrong with it follows from its columns."""
    k, size = F.col("p_partkey"), F.col("p_size")
    line = lambda cond, x: F.when(cond, F.concat(x, F.lit("\n"))).otherwise("")
    lit = F.lit
    header = F.concat(
        line(k % 10 != 0, F.concat(lit("type: "), F.when(k % 10 == 1, lit('""')).otherwise(F.col("p_type")))),
        line(k % 7 != 0, F.concat(lit("title: "), F.col("p_name"))), line(k % 3 == 0, F.concat(lit("owner: "), F.when(k % 9 == 0, lit("")).otherwise(F.col("p_brand")))),
        line(k % 11 == 0, lit("title: again")), line(k % 13 == 0, lit("secret: x")),
        lit("status: "), F.element_at(F.array(*map(lit, ("draft", "stable", "final", "deprecated"))), (k % 4 + 1).cast("int")), lit("\n"),
        line(k % 5 == 0, F.concat(lit("generated: {by: "), F.when(k % 15 == 0, lit("")).otherwise("me"), lit(", at: "), F.when(k % 2 == 0, lit("2026-01-01T00:00:00Z")).otherwise("2026-01-01"), lit("}"))),
        line(k % 6 == 0, F.concat(lit("verified:\n  - by: a\n    at: 2026-01-01T00:00:00Z\n  - by: "), F.when(k % 12 == 0, lit("b")).otherwise(""), lit("\n    at: "), F.when(k % 18 == 0, lit("2026-02-30T00:00:00Z")).otherwise("2026-02-03T00:00:00+02:00"))),
        line(k % 8 == 0, F.concat(lit("stale_after: "), F.when(k % 16 == 0, lit("2026-05-05")).otherwise("2026-05-05T10:00:00Z"))),
        line(k % 4 == 1, F.concat(lit("sources:\n  - id: s1\n    resource: http://x\n  - id: s2\n    resource: "), F.when(k % 8 == 1, lit("http://y")).otherwise(""))),
        lit("size: "), F.when(k % 14 == 0, lit("big")).otherwise(size.cast("string")), lit("\ndue: "), F.when(k % 17 == 0, lit("2026-02-30")).otherwise("2026-02-03"), lit("\nflag: "), F.when(k % 19 == 0, lit("yes")).otherwise("true"), lit("\nbrand: "), F.regexp_replace("p_brand", "#", "\\#"), lit("\n"),
    )
    body = F.concat(lit("Text[^s1] about `[[code]]` "), F.when(k % 4 == 3, lit("[^s9] ")).otherwise(""), lit("[next](../"), F.col("p_type"), lit("/"), (k + 1).cast("string"), lit(".md) "), F.when(k % 21 == 0, lit("[[wiki]]")).otherwise(""), lit("\n"), F.when(k % 2 == 0, lit("\n")).otherwise(""), lit("| name | kind |\n|---|---|\n| "), F.col("p_name"), lit(" | "), F.col("p_type"), lit(" |\n| "), F.when(k % 3 == 0, F.concat(F.col("p_name"), lit(" | "), F.col("p_type"))).otherwise("x | y"), lit(" |\n"))
    return t("part").select(F.concat_ws("/", "p_type", F.concat(k.cast("string"), lit(".md"))).alias("path"), F.concat(lit("---\n"), header, lit("---\n"), body).alias("text"))


def context(t):
    return R.Context(vault(t), CONFIG)


_P = "p_type || '/' || CAST(p_partkey AS VARCHAR) || '.md'"


def _rule(name: str, rule_id: str, sql: str):
    """A query of one rule: file, check, level and count; lines are checked in the unit tests."""

    @query(name, f'SELECT file, "check", level, count(*) AS n FROM ({sql}) GROUP BY ALL')
    def one(t):
        return R.RULES[rule_id](context(t)).groupBy("file", "check", "level").agg(F.count("*").alias("n"))

    one.__doc__ = f"Findings of the rule {rule_id}."
    return one


def _when(*cases):
    return " UNION ALL ".join(f"SELECT {_P} AS file, '{check}' AS \"check\", '{level}' AS level FROM part WHERE {cond}" for check, level, cond in cases)


_rule("R01_type_required", "type-required", _when(("type-present", "must", "p_partkey % 10 = 0"), ("type-non-empty", "must", "p_partkey % 10 = 1")))
_rule("R04_generated_actor", "generated-actor", _when(("actor-present", "must", "p_partkey % 15 = 0"), ("timestamp-form", "should", "p_partkey % 5 = 0 AND p_partkey % 2 = 1")))
_rule("R05_verified_events", "verified-events", _when(("event-actor", "must", "p_partkey % 6 = 0 AND p_partkey % 12 <> 0"), ("event-timestamp-form", "should", "p_partkey % 18 = 0")))
_rule("R06_status_enum", "status-enum", _when(("status-enum", "must", "p_partkey % 4 = 2")))
_rule("R07_stale_after_format", "stale-after-format", _when(("timestamp-form", "should", "p_partkey % 16 = 0")))
_rule("R08_sources_resource", "sources-resource", _when(("entry-resource", "must", "p_partkey % 4 = 1 AND p_partkey % 8 <> 1")))
_rule("R09_unique_keys", "unique-keys", _when(("top-level-key-once", "must", "p_partkey % 11 = 0 AND p_partkey % 7 <> 0")))
_rule("R10_required_fields", "required-fields", _when(("field-present", "house", "p_partkey % 7 = 0 AND p_partkey % 11 <> 0"), ("field-present", "house", "p_partkey % 3 <> 0"), ("field-non-empty", "house", "p_partkey % 9 = 0")))
_rule("R11_forbidden_fields", "forbidden-fields", _when(("field-absent", "house", "p_partkey % 13 = 0")))
_rule("R12_type_enum", "type-enum", _when(("type-listed", "house", "p_partkey % 10 = 1"), ("type-listed", "house", "p_partkey % 10 > 1 AND p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO')")))
_rule("R13_extension_fields", "extension-fields", _when(("number-value", "house", "p_partkey % 14 = 0"), ("date-value", "house", "p_partkey % 17 = 0"), ("boolean-value", "house", "p_partkey % 19 = 0"), ("enum-value", "house", "p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')")))
_rule("R15_link_target_exists", "link-target-exists", f"SELECT {_P} AS file, 'target-exists' AS \"check\", 'house' AS level FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey = a.p_partkey + 1 AND b.p_type = a.p_type)")
_rule("R16_no_wikilinks", "no-wikilinks", _when(("no-wikilinks", "house", "p_partkey % 21 = 0")))
_rule("R20_index_completeness", "index-completeness", "SELECT DISTINCT p_type || '/index.md' AS file, 'folder-index' AS \"check\", 'warn' AS level FROM part UNION ALL SELECT 'index.md', 'root-links-folder', 'warn' FROM (SELECT DISTINCT p_type FROM part)")
_rule("R23_tables", "tables", _when(("blank-line-before", "warn", "p_partkey % 2 = 1"), ("duplicate-row", "warn", "p_partkey % 3 = 0"), ("long-cell", "warn", "length(p_name) > 11"), ("long-cell", "warn", "length(p_name) > 11 AND p_partkey % 3 = 0")))


@query("R29_confidential", f'SELECT {_P} AS file, count(*) AS n FROM part WHERE p_size < 10 AND p_type <> \'PROMO\' GROUP BY 1')
def confidential(t):
    """Links from outside into a confidential folder; links to its index pass."""
    note = F.concat(F.lit("See [a](../PROMO/"), F.when(F.col("p_size") < 10, "x").otherwise("index"), F.lit(".md)"))
    files = t("part").select(F.concat_ws("/", "p_type", F.concat(F.col("p_partkey").cast("string"), F.lit(".md"))).alias("path"), note.alias("text"))
    return R.RULES["confidential"](R.Context(files, CONFIG)).groupBy("file").agg(F.count("*").alias("n"))

_rule("R30_attribution", "attribution", _when(("source-referenced", "warn", "p_partkey % 4 = 1")))


@query("P01_headers", f"SELECT {_P} AS path, CAST(p_partkey % 10 <> 0 AS BIGINT) + CAST(p_partkey % 7 <> 0 OR p_partkey % 11 = 0 AS BIGINT) AS n FROM part")
def headers(t):
    """How many of the keys type and title each header has."""
    f = N.fields(vault(t)).where("key in ('type', 'title') and occurrence = 1")
    return vault(t).select("path").join(f.groupBy("path").agg(F.count("*").alias("n")), "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


@query("P07_repeated_keys", f"SELECT {_P} AS path, 'title' AS key, CAST(2 AS BIGINT) AS n FROM part WHERE p_partkey % 11 = 0 AND p_partkey % 7 <> 0")
def repeated_keys(t):
    return N.fields(vault(t)).groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")


@query("P05_entries", f"SELECT {_P} AS path, unnest(list_value('s1', 's2')) AS source FROM part WHERE p_partkey % 4 = 1")
def entries(t):
    f = N.fields(vault(t)).where("key = 'sources'")
    return f.select("path", F.explode("entries.v").alias("e")).select("path", F.col("e")["id"].alias("source"))


@query("P13_links", f"SELECT {_P} AS path, 'next' AS label, '../' || p_type || '/' || CAST(p_partkey + 1 AS VARCHAR) || '.md' AS raw FROM part")
def links(t):
    return N.links(vault(t)).select("path", "label", "raw")


@query("P16_wikilinks", f"SELECT {_P} AS path, unnest(list_value('wiki', 'wiki.md')) AS target FROM part WHERE p_partkey % 21 = 0")
def wikilinks(t):
    return spread(vault(t), "path").select("path", F.explode(N.wikilinks(N.code_stripped("text"))).alias("target"))


@query("P17_footnotes", f"SELECT {_P} AS path, unnest(CASE WHEN p_partkey % 4 = 3 THEN list_value('s1', 's9') ELSE list_value('s1') END) AS id FROM part")
def footnotes(t):
    return vault(t).select("path", F.explode(N.footnotes(F.col("text"))).alias("id"))


@query("P19_target_state", f"SELECT {_P} AS path, CASE WHEN EXISTS (SELECT 1 FROM part b WHERE b.p_partkey = part.p_partkey + 1 AND b.p_type = part.p_type) THEN 'in-walk' ELSE 'absent' END AS state FROM part")
def target_state(t):
    """Links joined to files and to the folders of files."""
    return R.target_states(context(t)).select("path", "state")


@query("R03_log_format", "SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE d > b GROUP BY 1")
def log_format(t):
    """Headings of each customer's log that are later than the one before."""
    line = F.concat(F.lit("## "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    logs = t("orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    ctx = R.Context(logs.select(F.concat(F.col("o_custkey").cast("string"), F.lit("/log.md")).alias("path"), "text"))
    out = R.RULES["log-format"](ctx).where("check = 'ordering'")
    return out.groupBy(F.substring_index("file", "/", 1).cast("long").alias("o_custkey")).agg(F.count("*").alias("n"))


@query("A07_distinct_paths", "SELECT DISTINCT source FROM documents")
def distinct_paths(t):
    return t("documents").select("source").distinct().orderBy("source")


@query("X28_privacy_policy", "SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'full' ELSE 'summary' END AS level, lower(trim(s_name)) AS topic FROM supplier")
def privacy_policy(t):
    return t("supplier").select("s_suppkey", F.coalesce(F.when(F.col("s_nationkey") % 3 == 0, "full"), F.lit("summary")).alias("level"), T.comparable(T.trim_space(F.col("s_name"))).alias("topic"))


_FIELDS = " UNION ALL ".join(f"SELECT '{i}' AS id, * FROM ({ORACLES[n]})" for n, i in (("R10_required_fields", "required-fields"), ("R11_forbidden_fields", "forbidden-fields"), ("R12_type_enum", "type-enum"), ("R13_extension_fields", "extension-fields")))


@query("E04_user_fields", _FIELDS)
def user_fields(t):
    """All user rules on fields at once, the settings as rows of a table."""
    rows = [("required", x, None, None) for x in CONFIG["required"]] + [("forbidden", x, None, None) for x in CONFIG["forbidden"]] + [("type", x, None, None) for x in CONFIG["types"]]
    rows += [("extension", k, s["kind"], s.get("options")) for k, s in CONFIG["extensions"].items()]
    found = U.user_fields(context(t).staged(), t.spark.createDataFrame(rows, U.SETTINGS))
    return found.groupBy("id", "file", "check", "level").agg(F.count("*").alias("n"))
