"""Paths as columns: segment-aware tests, link targets and their resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, r"(?:\A|/)[^/]*\z", "")


def is_reserved(path: Column) -> Column:
    return base_name(path).isin("index.md", "log.md")


def is_under(path: Column, folder: Column) -> Column:
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def has_dot_segment(path: Column) -> Column:
    return F.rlike(path, F.lit(r"(?:\A|/)\."))


def is_markdown(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(".md"))


def ancestors(path: Column) -> Column:
    """The folders above a path, outermost first, for an equi-join instead of a prefix test."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def is_external(target: Column) -> Column:
    return F.rlike(target, F.lit(r"\A(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)"))


def path_part(target: Column) -> Column:
    """A target without fragment and query, percent-decoded where that is possible; a plus stays a plus."""
    cut = F.substring_index(F.substring_index(target, "#", 1), "?", 1)
    return F.coalesce(F.try_url_decode(F.replace(cut, F.lit("+"), F.lit("%2B"))), cut)


def resolve(source: Column, target: Column) -> Column:
    """A target against its source's folder, or the root if it starts with a slash; null above the root."""
    joined = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat_ws("/", dir_name(source), target))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    step = lambda a, p: F.when(p != "..", F.struct(F.concat(a["at"], F.array(p)).alias("at"), a["out"].alias("out"))).otherwise(F.struct(F.slice(a["at"], F.lit(1), F.greatest(F.size(a["at"]) - 1, F.lit(0))).alias("at"), (a["out"] | (F.size(a["at"]) == 0)).alias("out")))
    walked = F.aggregate(parts, F.struct(none.alias("at"), F.lit(False).alias("out")), step)
    return F.when(~walked["out"], F.array_join(walked["at"], "/"))
