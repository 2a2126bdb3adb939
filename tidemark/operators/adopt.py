"""What a folder of notes tells of its own settings: kinds of fields, collections, choices, confidential folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import paths as P

MOST_CHOICES = 12


def kinds(values: DataFrame, field: str, value: str) -> DataFrame:
    """field, kind: the strictest kind that all values have; few repeated tokens are an enum; no values, a string."""

    def every(ok: Column) -> Column:
        return F.coalesce(F.bool_and(ok), F.lit(False))

    v = F.col(value)
    told = values.where(v.isNotNull()).groupBy(field).agg(
        every(v.isin("true", "false")).alias("boolean"),
        every(D.iso_day(v).isNotNull()).alias("date"),
        every(F.rlike(v, F.lit(r"\A-?\d+(\.\d+)?\z"))).alias("number"),
        every(F.rlike(v, F.lit(r"\A[A-Za-z0-9_-]+\z"))).alias("token"),
        F.count("*").alias("rows"),
        F.countDistinct(v).alias("different"),
    )
    few = (F.col("different") <= MOST_CHOICES) & (F.col("rows") > F.col("different")) & F.col("token")
    kind = F.when(F.col("boolean"), "boolean").when(F.col("date"), "date").when(F.col("number"), "number")
    return told.select(field, kind.when(few, "enum").otherwise("string").alias("kind"))


def collections(notes: DataFrame, path: str, kind: str) -> DataFrame:
    """dir, role: a first-level folder whose notes all have one type is a collection, another a domain."""
    inside = notes.where(F.contains(path, F.lit("/"))).withColumn("dir", F.substring_index(path, "/", 1))
    one = (F.countDistinct(kind) == 1) & (F.count_if(F.col(kind).isNull()) == 0)
    return inside.groupBy("dir").agg(F.when(one, "collection").otherwise("domain").alias("role"))


def choices(values: DataFrame, field: str, kind: str, value: str) -> DataFrame:
    """field, type, options: the different values of each field for each type of note, sorted."""
    return values.groupBy(field, kind).agg(F.array_sort(F.collect_set(value)).alias("options"))


def confidential_folders(marked: DataFrame, path: str, known: list[str]) -> DataFrame:
    """The folders of marked notes outside the known ones; a folder inside another of them is dropped."""
    folders = marked.select(P.dir_name(F.col(path)).alias("dir")).where("dir <> ''").distinct()
    with_self = F.concat(P.ancestors(F.col("dir")), F.array("dir"))
    if known:
        folders = folders.where(~F.arrays_overlap(with_self, F.array(*map(F.lit, known))))
    above = folders.select("dir", F.explode(P.ancestors(F.col("dir"))).alias("up"))
    nested = above.join(folders.select(F.col("dir").alias("up")), "up").select("dir").distinct()
    return folders.join(nested, "dir", "left_anti")


def pushed_tips(lines: DataFrame, at: str, line: str) -> DataFrame:
    """at, tip: the object third from last in each line of a push, the first line of each; a null object is no tip."""
    words = F.split(F.trim(line), r"\s+")
    tip = F.when(F.size(words) >= 3, F.element_at(words, -3))
    held = lines.select(F.col(at).alias("at"), tip.alias("tip"))
    held = held.where(F.rlike("tip", F.lit(r"\A[0-9a-f]{40}\z")) & ~F.rlike("tip", F.lit(r"\A0+\z")))
    return held.groupBy("tip").agg(F.min("at").alias("at"))


def whole_listing(lines: DataFrame, key: str, value: str, schema: str, number: str, valid: Column) -> DataFrame:
    """key, items: a listing's JSON lines in the order of their numbers, all of them or, if one is wrong, null."""
    read = lines.select(key, F.from_json(value, schema).alias("x"))
    ok = F.coalesce(F.bool_and(F.coalesce(valid, F.lit(False))), F.lit(False))
    items = F.array_sort(F.collect_list(F.struct(F.col(f"x.{number}").alias("n"), "x")))["x"]
    return read.groupBy(key).agg(F.when(ok, items).alias("items"))
