"""Scan queries (L01-L10, O04, O07, A01, F10-F12, R26-R28, S04) over the documents' lines."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import scan as S

from .tables import Tables, query

#: A run of name characters is taken whole or not at all, so that a long one is read once.
CONFIGURED = (r'token = "[0-9a-f]{40}"', r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]+")
PATTERNS = S.pattern_table(CONFIGURED)
#: SQL's expressions have neither lookbehind nor possessive repeats; the matches are the same.
_SQL = [(p.replace("'", "''"), o, re.sub(r"\(\?<![^)]*\)|(?<=\+)\+", "", p).replace("'", "''")) for p, o in PATTERNS]
_LINES = r"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line, raw FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS raw FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS x FROM documents))"
_FOUND = " UNION ALL ".join(f"SELECT doc_id, line, '{p}' AS pattern, '{o}' AS origin, unnest(regexp_extract_all(raw, '(?i){q}')) AS match FROM l" for p, o, q in _SQL)


def document_lines(t: Tables):
    return S.lines(t("documents"), "doc_id")


def suspect_lines(t: Tables):
    """The lines of the documents that may hold a match at all: the others are not cut."""
    return S.lines(t("documents").where(S.may_match(F.col("text"), PATTERNS)), "doc_id")


_TABLE = ", ".join(f"(CAST({i} AS BIGINT), '{p}', '{o}')" for i, (p, o, _) in enumerate(_SQL))


@query("L01_pattern_table", f"WITH l AS ({_LINES}), m AS (SELECT pattern, origin, count(*) AS n FROM ({_FOUND}) GROUP BY ALL) SELECT place, v.pattern, v.origin, coalesce(n, 0) AS matches FROM (VALUES {_TABLE}) AS v(place, pattern, origin) LEFT JOIN m USING (pattern, origin)")
def pattern_table(t):
    """The patterns in their order, each with its origin and its matches in all documents."""
    listed = t.spark.createDataFrame([(i, p, o) for i, (p, o) in enumerate(PATTERNS)], "place long, pattern string, origin string")
    counts = S.matches(suspect_lines(t), "doc_id", PATTERNS).groupBy("pattern", "origin").agg(F.count("*").alias("n"))
    return listed.join(counts, ["pattern", "origin"], "left").select("place", "pattern", "origin", F.coalesce("n", F.lit(0)).alias("matches"))


@query("L02_lines", f"SELECT doc_id, count(*) AS lines, max(length(raw)) AS longest FROM ({_LINES}) GROUP BY doc_id")
def count_lines(t):
    return document_lines(t).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.length("raw")).cast("long").alias("longest"))


@query("L03_matches", f"WITH l AS ({_LINES}) SELECT doc_id, line, pattern, origin, match FROM ({_FOUND})")
def matches(t):
    found = S.matches(suspect_lines(t), "doc_id", PATTERNS)
    return found.select("doc_id", F.col("line").cast("long").alias("line"), "pattern", "origin", "match")


@query("L04_first_matches", f"WITH l AS ({_LINES}), f AS ({_FOUND}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, pattern, match) AS place, count(*) OVER (PARTITION BY doc_id) AS total FROM f) SELECT doc_id, line, pattern, match, place, total, total > 5 AS truncated FROM r WHERE place <= 5")
def first_matches(t):
    """The first five of each document, the true total beside them."""
    found = S.first_of_each(S.matches(suspect_lines(t), "doc_id", PATTERNS), "doc_id", ["line", "pattern", "match"], 5)
    return found.select("doc_id", F.col("line").cast("long").alias("line"), "pattern", "match", F.col("place").cast("long").alias("place"), "total", "truncated")


@query("L05_excerpts")
def excerpts(t):
    """Matches with their columns and masked excerpts."""
    return S.located(suspect_lines(t), "doc_id", PATTERNS)


@query("L05_redacted_lines", f"""WITH l AS ({_LINES}) SELECT doc_id, line, regexp_replace(regexp_replace(raw, '(?i){_SQL[-2][2]}', '[REDACTED]', 'g'), '(?i){_SQL[-1][2]}', '[REDACTED]', 'g') AS shown FROM l WHERE regexp_matches(raw, '(?i){_SQL[-2][2]}') OR regexp_matches(raw, '(?i){_SQL[-1][2]}')""")
def redacted_lines(t):
    held = suspect_lines(t).where(S.any_match(F.col("raw"), PATTERNS))
    return held.select("doc_id", F.col("line").cast("long").alias("line"), S.redacted(F.col("raw"), PATTERNS).alias("shown"))


@query("L06_prefilter", f"WITH l AS ({_LINES}) SELECT count(*) AS lines, count(*) FILTER (WHERE regexp_matches(raw, '(?i){_SQL[-2][2]}') OR regexp_matches(raw, '(?i){_SQL[-1][2]}')) AS passed FROM l")
def prefilter(t):
    parts = F.split(F.translate(F.coalesce("text", F.lit("")), "\0", ""), "\r\n|\r|\n")
    passed = F.filter(parts, lambda x: S.any_match(x, PATTERNS))
    some = F.when(S.may_match(F.col("text"), PATTERNS), F.size(passed)).otherwise(0)
    return t("documents").agg(
        F.coalesce(F.sum(F.size(parts)), F.lit(0)).alias("lines"), F.coalesce(F.sum(some), F.lit(0)).alias("passed")
    )


@query("L08_display", f"WITH l AS ({_LINES}) SELECT CASE WHEN origin = 'generic' THEN pattern ELSE '[' || origin || ']' END AS shown, count(*) AS n FROM ({_FOUND}) GROUP BY 1")
def display(t):
    found = S.matches(suspect_lines(t), "doc_id", PATTERNS)
    return found.groupBy(S.shown_pattern(F.col("pattern"), F.col("origin")).alias("shown")).agg(F.count("*").alias("n"))


KEYWORDS = ("idiot", "clown", "moron", "loser")
_KW = " UNION ALL ".join(f"SELECT doc_id, line, '{k}' AS keyword, length(regexp_extract(' ' || raw, '^(.*?)[^a-z0-9]{k}(?:[^a-z0-9]|$)', 1)) AS pos FROM l WHERE regexp_matches(' ' || raw, '[^a-z0-9]{k}(?:[^a-z0-9]|$)')" for k in KEYWORDS)


@query("L10_first_keyword", f"WITH l AS (SELECT doc_id, line, lower(raw) AS raw FROM ({_LINES})), k AS ({_KW}) SELECT doc_id, line, arg_min(keyword, pos) AS keyword FROM k GROUP BY doc_id, line")
def first_keyword(t):
    """The keyword that stands first on a line, whole words only."""
    held = document_lines(t).withColumn("folded", T.comparable(F.col("raw")))
    told = held.withColumn("keyword", S.first_keyword(F.col("folded"), KEYWORDS)).where("keyword is not null")
    return told.select("doc_id", F.col("line").cast("long").alias("line"), "keyword")


@query("R26_style", f"WITH l AS ({_LINES}), p AS (SELECT doc_id, line, instr(raw, '|') AS a, instr(raw, '\"') AS b FROM l) SELECT doc_id, line, CASE WHEN a > 0 AND (b = 0 OR a < b) THEN '|' ELSE '\"' END AS mark, CAST(CASE WHEN a > 0 AND (b = 0 OR a < b) THEN a ELSE b END AS BIGINT) AS col FROM p WHERE a > 0 OR b > 0")
def style(t):
    """The earliest forbidden character of each line."""
    marks = F.filter(F.array(*(F.struct(F.instr("raw", c).alias("col"), F.lit(c).alias("mark")) for c in '|"')), lambda x: x["col"] > 0)
    return document_lines(t).withColumn("first", F.array_min(marks)).where("first is not null").select("doc_id", F.col("line").cast("long").alias("line"), "first.mark", F.col("first.col").cast("long").alias("col"))


def findings(t: Tables):
    """The lines' matches and style marks as one set of findings with the severity that the settings give."""
    found = S.first_of_each(S.matches(suspect_lines(t), "doc_id", PATTERNS), "doc_id", ["line", "pattern", "match"], 5)
    secrets = found.select(F.lit("secrets").alias("id"), F.col("doc_id").alias("file"), F.col("line").cast("long").alias("line"), F.col("origin").alias("check"))
    marks = style(t).select(F.lit("style").alias("id"), F.col("doc_id").alias("file"), "line", F.col("mark").alias("check"))
    settings = F.create_map(F.lit("secrets"), F.lit("error"), F.lit("style"), F.lit("loud"))
    given = settings[F.col("id")]
    return secrets.unionByName(marks).withColumn("severity", F.when(given.isin("off", "warn", "error"), given).otherwise("warn"))


_FINDINGS = f"""l AS ({_LINES}), m AS ({_FOUND}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, pattern, match) AS place FROM m),
f AS (SELECT 'secrets' AS id, doc_id AS file, line, origin AS "check", 'error' AS severity FROM r WHERE place <= 5
UNION ALL SELECT 'style', doc_id, line, CASE WHEN a > 0 AND (b = 0 OR a < b) THEN '|' ELSE '"' END, 'warn' FROM (SELECT doc_id, line, instr(raw, '|') AS a, instr(raw, '"') AS b FROM l) WHERE a > 0 OR b > 0)"""


@query("U01_findings", f'WITH {_FINDINGS} SELECT id, file, line, "check", severity FROM f')
def union_of_findings(t):
    """Rules united, severities joined (F10, R27), in the order of O01."""
    return findings(t).orderBy("file", F.coalesce("line", F.lit(-1)), "id", "check")


@query("A01_counts", f"WITH {_FINDINGS} SELECT severity, count(*) AS n, count(DISTINCT file) AS files FROM f GROUP BY severity")
def counts(t):
    return findings(t).groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


@query("F11_restricted", f"WITH {_FINDINGS} SELECT id, count(*) AS n FROM f WHERE id = 'style' GROUP BY id")
def restricted(t):
    """One rule only: the filter reaches the union's branches before they run."""
    return findings(t).where("id = 'style'").groupBy("id").agg(F.count("*").alias("n"))


@query("F12_blocking", f"WITH {_FINDINGS} SELECT file, bool_or(severity = 'error') AS blocks FROM f GROUP BY file")
def blocking(t):
    return findings(t).groupBy("file").agg(F.bool_or(F.col("severity") == "error").alias("blocks"))


@query("F13_deviation", f"WITH {_FINDINGS} SELECT id, \"check\", severity = 'warn' AND \"check\" = '|' AS warning, count(*) AS n FROM f GROUP BY ALL")
def deviation(t):
    """Eligible findings are marked as warnings where the settings tolerate them."""
    marked = findings(t).withColumn("warning", (F.col("severity") == "warn") & (F.col("check") == "|"))
    return marked.groupBy("id", "check", "warning").agg(F.count("*").alias("n"))


@query("A16_degraded", f"WITH {_FINDINGS} SELECT id || ':' || \"check\" AS cause, count(*) AS n FROM f GROUP BY 1")
def degraded(t):
    return findings(t).groupBy(F.concat_ws(":", "id", "check").alias("cause")).agg(F.count("*").alias("n"))


@query("O07_list_cap", f"WITH {_FINDINGS}, d AS (SELECT DISTINCT file FROM f), rr AS (SELECT file, row_number() OVER (ORDER BY file) AS place, count(*) OVER () AS total FROM d) SELECT file, place, greatest(total - 10, 0) AS more FROM rr WHERE place <= 10")
def list_cap(t):
    """The first ten files and how many more there are: the cap is the feature."""
    files = findings(t).select("file").distinct()
    total = files.agg(F.count("*").alias("total"))
    shown = files.orderBy("file").limit(10).agg(F.array_sort(F.collect_list("file")).alias("files"))
    return shown.crossJoin(total).select(F.posexplode("files").alias("place", "file"), "total").select("file", (F.col("place") + 1).cast("long").alias("place"), F.greatest(F.col("total") - 10, F.lit(0)).cast("long").alias("more"))


@query("S20_report", f"WITH {_FINDINGS} SELECT 'findings/1' AS version, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warn') AS warnings FROM f")
def report(t):
    return findings(t).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings")).select(F.lit("findings/1").alias("version"), "errors", "warnings")


@query("S04_text_read", r"SELECT doc_id, md5(regexp_replace(ltrim(text, chr(65279)), '\r\n?', chr(10), 'g')) AS sum FROM documents")
def text_read(t):
    clean = F.regexp_replace(F.regexp_replace("text", "\\A\ufeff", ""), r"\r\n?", "\n")
    return t("documents").select("doc_id", F.md5(clean).alias("sum"))


def flagship(spark, sf_dir):
    return first_matches(Tables(spark, sf_dir))
