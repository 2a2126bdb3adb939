"""Pattern scan of texts: lines, matches with columns, excerpts with every matched span masked, the first few of each file."""

from __future__ import annotations

import bisect
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Built-in credential shapes that a scanner of this kind must know.
BUILT_IN = (
    "-----BEGIN (RSA |OPENSSH |EC |DSA |PGP )?PRIVATE KEY-----",
    "ghp_[A-Za-z0-9]{20,}",
    "github_pat_[A-Za-z0-9_]{20,}",
    "sk-ant-[A-Za-z0-9_-]{10,}",
    "AKIA[0-9A-Z]{16}",
    "xox[baprs]-[A-Za-z0-9-]{10,}",
)
#: Letters that match an ASCII letter when case is ignored.
ODD_CASE = "\u017f\u0130\u0131\u212a"
SIDE = 20  # characters kept on each side of a match
SPANS = 200  # more spans on a line than this mask the whole line


def pattern_table(configured: Sequence[str] = (), personal: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(pattern, origin), first origin wins; an empty pattern is refused."""
    found: dict[str, str] = {}
    for origin, patterns in (("generic", BUILT_IN), ("config", configured), ("personal", personal)):
        for p in patterns:
            if not p:
                raise ValueError(f"an empty {origin} pattern would match everything")
            found.setdefault(p, origin)
    return list(found.items())


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line (from 1), raw: split at CRLF, CR or LF, without NULs."""
    parts = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "\0", ""), "\r\n|\r|\n")
    return df.select(key, F.posexplode(parts).alias("at", "raw")).select(key, (F.col("at") + 1).alias("line"), "raw")


def literal_of(pattern: str) -> str | None:
    """The longest run of plain characters that every match must hold; None if none can be told."""
    runs, run, at, depth = [""], "", 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            run, at = "", at + 1
        elif c == "[":
            run, at = "", re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*").match(pattern, at).end()
        elif c == "|" and not depth:
            return None
        elif c in "()":
            run, depth = "", depth + (1 if c == "(" else -1)
        elif c in "*?{":
            runs[-1], run = (runs[-1][:-1] if run else runs[-1]), ""
            at = pattern.index("}", at) if c == "{" else at
        elif c in ".^$+|" or depth:
            run = ""
        elif run:
            run += c
            runs[-1] = run
        else:
            run = c
            runs.append(c)
        at += 1
    return max(runs, key=len) or None


def may_match(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Whether a whole text may hold a match: a cheap test of the literals in the patterns, never false for a match."""
    literals = [literal_of(p) for p, _ in patterns]
    if None in literals:
        return F.lit(True)
    folded = F.lower(F.replace(text, F.lit("\0"), F.lit("")))
    test = F.rlike(text, F.lit(f"[{ODD_CASE}]"))
    for x in dict.fromkeys(literals):
        test = F.contains(folded, F.lit(x.lower())) | test
    return test


def any_match(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """The prefilter of a line: exact, since it matches a pattern only if it matches their union, which is tested only
    on a line that has a literal of theirs."""
    union = F.rlike(text, F.lit("(?iu)" + "|".join(f"(?:{p})" for p, _ in patterns)))
    return may_match(text, patterns) & union


def matches(df: DataFrame, key: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """From lines: key, line, pattern, origin, match; every non-overlapping match of every pattern, in the JVM."""
    found = [
        F.transform(F.regexp_extract_all("raw", F.lit("(?iu)" + p), F.lit(0)), _as_match(p, origin))
        for p, origin in patterns
    ]
    held = df.where(any_match(F.col("raw"), patterns)).withColumn("found", F.concat(*found))
    # inline() would have the optimizer ask for the size of what was found, and find all of it twice.
    return held.select(key, "line", F.inline_outer("found")).where("match is not null")


def _as_match(pattern: str, origin: str):
    return lambda m: F.struct(F.lit(pattern).alias("pattern"), F.lit(origin).alias("origin"), m.alias("match"))


def masked(line: str, spans: list[tuple[int, int]], at: tuple[int, int]) -> str:
    """The excerpt around a match, with every span of the line that it shows masked."""
    if len(spans) > SPANS:
        return "[REDACTED]"
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    lo, hi = max(0, at[0] - SIDE), min(len(line), at[1] + SIDE)
    out, pos = [], lo
    for a, b in merged[max(0, bisect.bisect_right([m[0] for m in merged], lo) - 1) :]:
        if b <= lo or a >= hi:
            continue
        out += [line[pos : max(pos, a)], "[REDACTED]"]
        pos = min(hi, b)
    return "".join([*out, line[pos:hi]])


def located(df: DataFrame, key: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """From lines: key, line, column (from 1), pattern, origin, excerpt. Columns need each match's place: Arrow batches."""
    key_type = df.schema[key].dataType

    def run(batches):
        compiled = [(re.compile(p, re.I), p, origin) for p, origin in patterns]
        for batch in batches:
            out = []
            for k, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [(m.start(), m.end(), p, o) for c, p, o in compiled for m in c.finditer(raw) if m.end() > m.start()]
                spans = [(a, b) for a, b, _, _ in found]
                out += [(k, n, a + 1, p, o, masked(raw, spans, (a, b))) for a, b, p, o in sorted(found)]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), *(pa.array(c, pa.string()) for c in cols[3:])], names=[key, "line", "column", "pattern", "origin", "excerpt"])

    held = df.where(any_match(F.col("raw"), patterns)).select(key, F.col("line").cast("int").alias("line"), "raw")
    return held.mapInArrow(run, f"{key} {key_type.simpleString()}, line int, column int, pattern string, origin string, excerpt string")


def redacted(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    for p, _ in patterns:
        text = F.regexp_replace(text, "(?iu)" + p, "[REDACTED]")
    return text


def first_of_each(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each key with its total and whether some are left out."""
    each = Window.partitionBy(key)
    ranked = df.withColumn("place", F.row_number().over(each.orderBy(*order)))
    ranked = ranked.withColumn("total", F.count("*").over(each))
    return ranked.where(F.col("place") <= most).withColumn("truncated", F.col("total") > most)


def shown_pattern(pattern: Column, origin: Column) -> Column:
    """Personal patterns are never named, configured ones not in reports that leave the machine."""
    return F.when(origin == "generic", pattern).otherwise(F.concat(F.lit("["), origin, F.lit("]")))


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """The keyword that stands first as a whole word, in folded text; longer first on ties."""
    place = lambda k: F.regexp_instr(text, F.lit(rf"(?u)(?<![\p{{L}}\p{{N}}]){re.escape(k)}(?![\p{{L}}\p{{N}}])"))
    found = F.filter(F.array(*(F.struct(place(k).alias("at"), F.lit(-len(k)).alias("n"), F.lit(k).alias("keyword")) for k in keywords)), lambda x: x["at"] > 0)
    return F.array_min(found)["keyword"]
