"""What is there against what should be: shipped files, pattern sources, listed projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The order in which sources of patterns are taken, first wins: a fixed value.
PATTERN_SOURCES = ("working", "tip", "carried", "default")


def classify_files(entries: DataFrame, files: DataFrame, shipped: DataFrame) -> DataFrame:
    """path and class of each entry of a manifest, by hashes alone.

    entries: path, managed, recorded (the hash when it was installed). files: path, state (null, or why it was not
    read: not_regular, unreadable), hash and stamp of what is there now. shipped: path, stamp (null for the file
    without a stamp), hash of each version that can be made. In order: seeded (not managed), missing, not_regular,
    unreadable, not_in_kit, current (as shipped at its own stamp), refresh (untouched since, the shipped one moved),
    kept (the shipped one did not move), blocked (a new version lies beside it already), offer.
    """
    f = files.select(F.col("path").alias("f_path"), "state", "hash", "stamp")
    beside = files.select(F.col("path").alias("b_path"))
    s = shipped.select(F.col("path").alias("s_path"), F.col("stamp").alias("s_stamp"), F.col("hash").alias("s_hash"))
    here = F.col("path") == F.col("s_path")
    flag = lambda df, on, name: df.join(s.join(df.select("path", "stamp", "hash", "recorded"), here).where(on).select(F.col("path").alias(name)).distinct(), F.col("path") == F.col(name), "left")
    df = entries.join(f, F.col("path") == F.col("f_path"), "left")
    df = flag(df, F.lit(True), "in_kit")
    df = flag(df, F.col("s_stamp").eqNullSafe(F.col("stamp")) & (F.col("s_hash") == F.col("hash")), "as_shipped")
    df = flag(df, F.col("s_hash") == F.col("recorded"), "not_moved")
    df = df.join(beside, F.concat("path", F.lit(".new")) == F.col("b_path"), "left")
    has = lambda c: F.col(c).isNotNull()
    found = (
        F.when(~F.coalesce("managed", F.lit(False)), "seeded").when(~has("f_path"), "missing").when(has("state"), F.col("state")).when(~has("in_kit"), "not_in_kit")
        .when(has("as_shipped"), "current").when(F.col("hash") == F.col("recorded"), "refresh").when(has("not_moved"), "kept").when(has("b_path"), "blocked").otherwise("offer")
    )
    return df.select("path", found.alias("class"))


def union_patterns(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns of all sources (kind, source, pattern, reason), each once under its first source; and the refusals.

    reason tells why a source could not be read: any such row refuses the whole, so callers look at the second first.
    A source that could be read and has no pattern (null) adds none.
    """
    order = F.array_position(F.array(*map(F.lit, PATTERN_SOURCES)), F.col("kind"))
    refused = sources.where(F.col("reason").isNotNull() | (order == 0)).select("kind", "source", F.coalesce("reason", F.lit("unknown kind")).alias("reason")).distinct()
    first = F.min(F.struct(order.alias("place"), "kind", "source"))
    held = sources.where(F.col("reason").isNull() & F.col("pattern").isNotNull() & (order > 0)).groupBy("pattern").agg(first.alias("x"))
    return held.select("pattern", "x.kind", "x.source"), refused


def project_verdicts(projects: DataFrame, key: str) -> DataFrame:
    """key, status, verdict, found: one verdict a list of projects, the worst first.

    projects: key, project, entry (directory, unreachable, or what else stands there; null for nothing), own (the
    list's own project), waitable (may have no folder yet), whole (the list is all that there are).
    """
    p = projects.select(key, "project", F.coalesce("entry", F.lit("gone")).alias("entry"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("own", "waitable", "whole"))).distinct()
    missing = ~F.col("entry").isin("directory", "unreachable")
    waits = missing & F.col("waitable") & ~F.col("whole")
    n = lambda c: F.count_if(c)
    df = p.groupBy(key).agg(
        n(F.col("entry") == "unreachable").alias("unread"), n(waits).alias("waiting"), n(missing & ~waits & F.col("own")).alias("own_lost"), n(missing & ~waits & ~F.col("own")).alias("lost"),
        n(~missing).alias("found"), F.bool_or("whole").alias("whole"),
    )
    nothing = F.col("found") == 0
    verdict = (
        F.when(F.col("unread") > 0, "unreadable").when((F.col("lost") > 0) & nothing, "all_missing").when(F.col("lost") > 0, "some_missing").when(F.col("own_lost") > 0, "own_missing")
        .when((F.col("waiting") > 0) & nothing, "no_sessions_yet").when(F.col("waiting") > 0, "some_waiting").when(F.col("whole"), "all").otherwise("ok")
    )
    v = F.col("verdict")
    status = F.when(v.isin("unreadable", "all_missing") | ((v == "own_missing") & nothing), "fail").when(v.isin("some_missing", "own_missing"), "warn").otherwise("ok")
    return df.withColumn("verdict", verdict).select(key, status.alias("status"), "verdict", "found")
