"""Briefings: a catalog of named blocks, the blocks that a configuration asks for, and the facts they are made of.

A block of facts is a SQL table function with typed arguments over registered relations, so that it can be called from
SQL, joined and filtered like a table. All give the same columns: part, key, day, text, mark. Judgement blocks and
custom ones are instructions; a custom block is a row of the configuration, checked before it is used.

Relations (`RELATIONS`) that a briefing does not have are empty. Nothing is gathered: a block has a row for each item.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import paths

# The ids of the catalog and their kinds, and the form of a custom id.
BLOCKS = {
    "sources": "fact", "due": "fact", "upcoming": "fact", "undated": "fact", "open_prs": "fact", "stale": "fact", "questions": "fact",
    "blind_spots": "judgement", "strategy": "judgement", "today_calendar": "judgement",
}
CUSTOM_ID = r"\A[a-z][a-z0-9]*([-_][a-z0-9]+)*\z"

RELATIONS = {
    "runs": "source string, state string, advanced boolean",
    "pending": "file string, line long, what string, raw string, deadline date",
    "pending_problems": "file string, line long, code string",
    "pull_requests": "number long, title string, url string, created timestamp",
    "notes": "path string, stale_after string",
    "questions": "id string, text string, created_on date, asked_on array<date>, status string",
    "incidents": "reason string, first timestamp, last timestamp, n long",
    "repairs": "at timestamp, kind string, detail string",
    "marks": "source string, day date",
    "connectors": "name string, state string",
    "last_run": "at timestamp, exit int, reason string",
    "git": "branch string, default_branch string, upstream string, ahead long, behind long, dirty long",
    "lock": "held boolean, command string, legacy string",
}

_COLUMNS = "part STRING, key STRING, day DATE, text STRING, mark STRING"

#: name: (arguments, the body over the relations).
_FACTS = {
    "sources": ("", """
        SELECT state AS part, source AS key, CAST(NULL AS DATE) AS day,
          CASE WHEN state = 'needs_auth' THEN 'needs_auth' WHEN state IN ('absent', 'tools_missing', 'blocked_by_user_rules') THEN 'not_in_session' ELSE 'doctor' END AS text,
          CAST(NULL AS STRING) AS mark
        FROM {runs} WHERE NOT coalesce(advanced, false)"""),
    "due": ("today DATE", """
        SELECT CASE WHEN deadline < today THEN 'overdue' ELSE 'today' END AS part, concat(p.file, ':', p.line) AS key, deadline AS day, what AS text, codes AS mark
        FROM {pending} p LEFT JOIN {codes} c ON p.file = c.file AND p.line = c.line WHERE deadline <= today"""),
    "upcoming": ("today DATE, days INT", """
        SELECT CASE WHEN deadline <= date_add(today, days) THEN 'upcoming' ELSE 'later' END AS part, concat(p.file, ':', p.line) AS key, deadline AS day, what AS text, codes AS mark
        FROM {pending} p LEFT JOIN {codes} c ON p.file = c.file AND p.line = c.line WHERE deadline > today"""),
    "undated": ("", """
        SELECT 'undated' AS part, concat(p.file, ':', p.line) AS key, CAST(NULL AS DATE) AS day, concat(what, ' | ', raw) AS text, codes AS mark
        FROM {pending} p LEFT JOIN {codes} c ON p.file = c.file AND p.line = c.line WHERE deadline IS NULL"""),
    "open_prs": ("", """
        SELECT 'open' AS part, CAST(number AS STRING) AS key, to_date(created) AS day, title AS text, url AS mark FROM {pull_requests}"""),
    "stale": ("today DATE", """
        SELECT 'stale' AS part, path AS key, at AS day, stale_after AS text, CAST(NULL AS STRING) AS mark
        FROM (SELECT path, stale_after, coalesce(CASE WHEN stale_after RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN try_cast(stale_after AS DATE) END,
            CASE WHEN stale_after RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?([Zz]|[+-][0-9]{{2}}:?[0-9]{{2}})$' THEN to_date(try_cast(stale_after AS TIMESTAMP)) END) AS at FROM {notes})
        WHERE at <= today"""),
    "questions": ("today DATE, escalate_after INT, max_age INT", """
        SELECT CASE WHEN size(asked_on) >= escalate_after THEN 'escalated' ELSE 'open' END AS part, id AS key, array_max(asked_on) AS day, text,
          CASE WHEN datediff(today, created_on) > max_age THEN 'due_for_archive' END AS mark
        FROM {questions} WHERE status = 'open'"""),
}


class Briefing:
    """The catalog over some relations. `function(id)` names a block's table function in this session."""

    def __init__(self, spark: SparkSession, **relations: DataFrame):
        if unknown := set(relations) - set(RELATIONS):
            raise ValueError(f"no such relation: {sorted(unknown)}")
        self.spark, self.tag = spark, uuid.uuid4().hex[:10]
        named = {}
        for name, schema in RELATIONS.items():
            made = relations.get(name)
            made = spark.createDataFrame([], schema) if made is None else made.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")))
            named[name] = f"briefing_{self.tag}_{name}"
            made.createOrReplaceTempView(named[name])
        named["codes"] = f"briefing_{self.tag}_codes"
        codes = spark.table(named["pending_problems"]).groupBy("file", "line")
        codes.agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes")).createOrReplaceTempView(named["codes"])
        self.relation = lambda name: spark.table(named[name])
        for name, (arguments, body) in _FACTS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {self.function(name)}({arguments}) RETURNS TABLE({_COLUMNS}) RETURN {body.format(**named)}")

    def function(self, name: str) -> str:
        return f"briefing_{name}_{self.tag}"

    def fact(self, name: str, **arguments: str) -> DataFrame:
        """A block of facts; arguments are SQL expressions by name."""
        order = [a.split()[0] for a in _FACTS[name][0].split(", ") if a]
        return self.spark.sql(f"SELECT * FROM {self.function(name)}({', '.join(arguments[a] for a in order)})")

    def write(self, blocks: DataFrame, **arguments: str) -> DataFrame:
        """The briefing of resolved blocks (config, position, id, kind, title, instruction, read): an item a row.

        Each fact block is one relation, joined to the configurations that ask for it; instructions are items."""
        of = lambda name: blocks.where((F.col("id") == name) & (F.col("kind") == "fact")).select("config", "position", "id", "kind")
        told = blocks.where("kind <> 'fact'").select(
            "config", "position", "id", "kind", F.lit("instruction").alias("part"), F.coalesce("title", "id").alias("key"), F.lit(None).cast("date").alias("day"),
            F.col("instruction").alias("text"), F.array_join("read", ",").alias("mark"),
        )
        for name in _FACTS:
            told = told.unionByName(F.broadcast(of(name)).join(self.fact(name, **arguments), F.lit(True)))
        return told

    def facts(self, now: Column) -> DataFrame:
        """The fourteen facts of a day as rows (fact, key, value): small ones whole, the others an item a row."""
        r, today = self.relation, F.to_date(now)
        one = self.spark.range(1)
        row = lambda df, name, key, value: df.select(F.lit(name).alias("fact"), key.cast("string").alias("key"), value.cast("string").alias("value"))
        none = F.lit(None).cast("string")
        out = row(one, "today", none, today)
        for df, name, key, value in (
            (one, "today_human", none, F.date_format(today, "dd/MM/yyyy")),
            (one, "weekday", none, F.lower(F.date_format(today, "EEEE"))),
            (one, "tz", none, F.current_timezone()),
            (r("last_run"), "last_run", F.col("reason"), F.concat_ws(" ", F.date_format("at", "dd/MM/yyyy HH:mm"), F.col("exit"))),
            (r("connectors"), "connector_states", F.col("name"), F.col("state")),
            (r("pull_requests"), "open_pull_requests", F.col("number"), F.date_format("created", "dd/MM/yyyy")),
            (self.fact("stale", today=self._literal(today)), "stale", F.col("key"), F.date_format("day", "dd/MM/yyyy")),
            (r("git"), "git", F.col("branch"), F.concat_ws(" ", "default_branch", "upstream", "ahead", "behind", "dirty")),
            (r("lock"), "lock", F.coalesce("command", F.lit("-")), F.concat_ws(" ", "held", "legacy")),
            (r("incidents"), "incidents", F.col("reason"), F.concat_ws(" ", "n", F.date_format("last", "dd/MM HH:mm"))),
            (r("marks"), "marks", F.col("source"), F.datediff(F.date_sub(today, 1), "day")),
        ):
            out = out.unionByName(row(df, name, key, value))
        bucket = F.when(F.col("deadline").isNull(), "undated").when(F.col("deadline") < today, "overdue").when(F.col("deadline") == today, "today")
        counted = r("pending").groupBy(bucket.when(F.col("deadline") <= F.date_add(today, 7), "upcoming").otherwise("later").alias("b")).agg(F.count("*").alias("n"))
        asked = self.fact("questions", today=self._literal(today), escalate_after="3", max_age="30").groupBy("part").agg(F.count("*").alias("n"))
        recent = r("repairs").where((F.col("at") <= now) & (F.col("at") > now - F.expr("INTERVAL 24 HOURS")))
        out = out.unionByName(row(counted, "pending", F.col("b"), F.col("n"))).unionByName(row(asked, "questions", F.col("part"), F.col("n")))
        return out.unionByName(row(recent, "incidents", F.col("kind"), F.col("detail")))

    def _literal(self, day: Column) -> str:
        return f"DATE '{self.spark.range(1).select(day.alias('d')).first()['d']}'"


def resolve_blocks(configs: DataFrame, never_read: list[str], files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and problems of configurations (config, blocks: the list as JSON text).

    files: path and is_file of what there is to read. Blocks: config, position, id, kind, title, instruction, read;
    problems: config, position, code, id, field, path, entry. A problem of a custom block keeps it out as a whole.
    """
    parsed = configs.select("config", F.try_parse_json("blocks").alias("v"))
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    nothing = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    whole = parsed.select("config", F.when(~F.coalesce(is_list, F.lit(False)), "not_a_list").when(F.to_json("v") == "[]", "empty").alias("code"))
    bad_list = whole.where("code is not null").select("config", F.lit(None).cast("int").alias("position"), "code", *nothing("id", "field", "path", "entry"))

    item = F.posexplode(F.from_json(F.to_json("v"), "array<variant>"))
    listed = parsed.where(is_list).select("config", item.alias("at", "e")).withColumn("position", F.col("at") + 1)
    kind = F.schema_of_variant("e")
    get = lambda path, as_: F.try_variant_get("e", path, as_)
    is_text, is_object = kind == "STRING", kind.startswith("OBJECT")
    typed = lambda path: F.when(F.schema_of_variant(F.try_variant_get("e", path, "variant")) == "STRING", get(path, "string"))
    listed = listed.withColumns({"id": F.when(is_text, get("$", "string")).when(is_object, typed("$.id")), "title": typed("$.title"), "instruction": typed("$.instruction"), "wanted": F.try_variant_get("e", "$.read", "array<variant>")})
    known = F.coalesce(F.col("id").isin(*BLOCKS), F.lit(False))
    code = (
        F.when(is_text & ~known, "unknown").when(~is_text & ~is_object, "not_a_block")
        .when(is_object & ~F.coalesce(F.rlike("id", F.lit(CUSTOM_ID)), F.lit(False)), "bad_id").when(is_object & known, "custom_id_taken")
    )
    listed = listed.withColumn("code", code).withColumn("custom", is_object)
    # Only what got this far counts as seen.
    seen = Window.partitionBy("config", "id", F.col("code").isNull()).orderBy("position")
    listed = listed.withColumn("code", F.coalesce("code", F.when(F.row_number().over(seen) > 1, "duplicate")))
    entry_problems = listed.where("code is not null").select("config", "position", "code", "id", *nothing("field", "path", "entry"))

    custom = listed.where("code is null and custom")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    fields = custom.select("config", "position", "id", F.explode(F.filter(F.array(F.when(blank("title"), "title"), F.when(blank("instruction"), "instruction")), lambda x: x.isNotNull())).alias("field"))
    fields = fields.select("config", "position", F.lit("missing_field").alias("code"), "id", "field", *nothing("path", "entry"))

    raw = F.try_variant_get("w", "$", "string")
    reads = custom.select("config", "position", "id", F.posexplode("wanted").alias("k", "w"))
    reads = reads.withColumn("path", F.when(F.schema_of_variant("w") == "STRING", F.trim(raw))).withColumn("clean", paths.resolve(F.lit(""), F.col("path")))
    outside = F.startswith("path", F.lit("/")) | F.startswith("path", F.lit("~")) | F.col("clean").isNull() | (F.col("clean") == "")
    entry = F.lit(None).cast("string")
    for folder in reversed(never_read):
        entry = F.when((F.col("clean") == folder) | F.startswith("clean", F.lit(folder + "/")), folder).otherwise(entry)
    there = files.select(F.col("path").alias("there"), "is_file")
    reads = reads.join(there, F.col("clean") == F.col("there"), "left").withColumn("entry", entry)
    wrong = (
        F.when(blank("path"), "read_empty").when(outside, "read_outside").when(F.col("entry").isNotNull(), "read_never_read")
        .when(F.col("there").isNull(), "read_missing").when(~F.col("is_file"), "read_not_file")
    )
    reads = reads.withColumn("code", wrong)
    read_problems = reads.where("code is not null").select("config", "position", "code", "id", *nothing("field"), F.coalesce("path", raw).alias("path"), F.when(F.col("code") == "read_never_read", F.col("entry")).alias("entry"))
    problems = bad_list.unionByName(entry_problems).unionByName(fields).unionByName(read_problems)

    flawed = fields.select("config", "position").unionByName(read_problems.select("config", "position")).distinct()
    first = reads.where("code is null").groupBy("config", "position", "clean").agg(F.min("k").alias("k")).groupBy("config", "position")
    read = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "clean"))), lambda x: x["clean"]).alias("read"))
    good = listed.where("code is null").join(flawed, ["config", "position"], "left_anti").join(read, ["config", "position"], "left")
    of = F.create_map(*(F.lit(x) for pair in BLOCKS.items() for x in pair))
    blocks = good.select(
        "config", "position", "id", F.when(F.col("custom"), "custom").otherwise(F.try_element_at(of, F.col("id"))).alias("kind"),
        F.trim("title").alias("title"), F.trim("instruction").alias("instruction"), F.coalesce("read", F.array().cast("array<string>")).alias("read"),
    )
    return blocks, problems
