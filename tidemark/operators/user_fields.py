"""User rules on header fields, with the settings as a table: one pass and a few joins for any number of settings.

settings: setting (required, forbidden, type, extension), name (the key; for type, an allowed type), kind (of an
extension: boolean, number, date, enum, string), options (of an enum). Findings are those that the rules of the same
names give with the same settings. Without a `type` row any type is allowed. Settings are a person's configuration:
the table is broadcast if it is as small as that, by a measured count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates as D

from . import notes as N
from .rules import Context, found, large

KINDS = ("boolean", "number", "date", "enum", "string")
SETTINGS = "setting string, name string, kind string, options array<string>"
FEW = 100_000


def problems(settings: DataFrame) -> DataFrame:
    """Settings that say nothing: an unknown setting, no name, an unknown kind, an enum without options."""
    s, k = F.col("setting"), F.col("kind")
    extension = s == "extension"
    problem = (
        F.when(~F.coalesce(s.isin("required", "forbidden", "type", "extension"), F.lit(False)), "unknown setting").when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name")
        .when(extension & ~F.coalesce(k.isin(*KINDS), F.lit(False)), "unknown kind").when(extension & (k == "enum") & (F.coalesce(F.size("options"), F.lit(0)) < 1), "no options")
    )
    return settings.select("setting", "name", problem.alias("problem")).where("problem is not null")


def user_fields(c: Context, settings: DataFrame) -> DataFrame:
    """Findings (id, check, level, file, line) of all settings on the notes of a context."""
    few = settings.count() <= FEW
    of = lambda kind, *more: (F.broadcast if few else lambda x: x)(settings.where(F.col("setting") == kind).select(F.col("name").alias("s_name"), *more).distinct())
    have = lambda n: F.coalesce(F.col(f"{n}.state") == N.VALUE, F.lit(False))
    value = F.when(F.col("scalar.state") == N.VALUE, F.col("scalar.v"))
    unreadable = F.coalesce(F.col("scalar.state") == N.UNREADABLE, F.lit(False))

    # Each required key of each note: the keys once, as one row.
    keys = of("required").agg(F.collect_set("s_name").alias("keys"))
    wanted = c.notes.select("path").join(F.broadcast(keys)).select("path", F.explode("keys").alias("key"))
    held = wanted.join(large(c.first.select("path", "key", "line", "scalar", "map", "list", "entries")), ["path", "key"], "left")
    filled = (have("scalar") & (F.trim("scalar.v") != "")) | (have("map") & (F.size("map.v") > 0)) | (have("list") & (F.size("list.v") > 0)) | (have("entries") & (F.size("entries.v") > 0))
    read = have("scalar") | have("map") | have("list") | have("entries")
    check = F.when(F.col("line").isNull(), "field-present").when(~read, "shape-readable").when(~filled, "field-non-empty")
    out = found(held, "required-fields", check, F.when(F.col("line").isNotNull() & ~read, "should").otherwise("house"), F.col("line"))

    forbidden = c.first.join(of("forbidden"), F.col("key") == F.col("s_name"), "left_semi")
    out = out.unionByName(found(forbidden, "forbidden-fields", "field-absent", "house", F.col("line")))

    types = of("type")
    told = c.of("type").withColumn("value", value).where("value is not null")
    any_type = types.agg((F.count("*") > 0).alias("any_type"))
    other = told.join(types, F.col("value") == F.col("s_name"), "left_anti").join(F.broadcast(any_type)).where("any_type")
    out = out.unionByName(found(other, "type-enum", "type-listed", "house", F.col("line")))

    own = c.first.join(of("extension", "kind", "options"), F.col("key") == F.col("s_name")).withColumn("value", value)
    k, v = F.col("kind"), F.col("value")
    good = (
        F.when(k == "boolean", v.isin("true", "false")).when(k == "number", F.rlike(v, F.lit(r"\A-?\d+(\.\d+)?\z"))).when(k == "date", D.iso_day(v).isNotNull())
        .when(k == "enum", F.array_contains("options", v)).otherwise(F.lit(True))
    )
    check = F.when(unreadable, "shape-readable").when(~good, F.concat(k, F.lit("-value")))
    return out.unionByName(found(own, "extension-fields", check, F.when(unreadable, "should").otherwise("house"), F.col("line")))
