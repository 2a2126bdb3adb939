"""State tables whose versions are whole or not there: data first, a manifest of one file last.

A version's rows are written to a folder of their own, then its manifest, one JSON file that a job commits by a single
rename: the version's number, its rows and the names and lengths of its files. A reader takes the highest version whose
manifest agrees with the files that are there, so a driver or an executor lost at any point, while files are being
moved too, leaves the version before it. A version written again, as a batch is after a failure, takes the same place.
Manifests lie in `SLOTS` slots, so that finding the last version never takes more than listing those; data older than
the versions in the slots is not read any more and may be removed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 8
_FILE = "struct<name:string,length:long>"
_MANIFEST = f"version long, folder string, rows long, files array<{_FILE}>"


class StateError(RuntimeError):
    """There are manifests, and none agrees with the files that are there."""


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """One row: files, the names and lengths of the Parquet files of a folder."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder)
    one = F.struct(F.substring_index("path", "/", -1).alias("name"), F.col("length"))
    return listed.agg(F.array_sort(F.collect_list(one)).alias("files"))


def write_state(df: DataFrame, path: str, version: int, name: str = "version") -> str:
    """Write a version and give its folder; it counts from the moment its manifest is there."""
    spark, folder = df.sparkSession, f"{name}={version}"
    df.write.mode("overwrite").parquet(f"{path}/{folder}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/{folder}").agg(F.count("*").alias("rows"))
    told = rows.join(_files(spark, f"{path}/{folder}")).select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), "rows", "files")
    told.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest/slot-{version % SLOTS}")
    return f"{path}/{folder}"


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _whole(spark: SparkSession, path: str, told) -> bool:
    try:
        there = _files(spark, f"{path}/{told.folder}").first().files
    except AnalysisException as e:
        if _absent(e):
            return False
        raise
    return sorted((f.name, f.length) for f in there) == sorted((f.name, f.length) for f in told.files)


def versions(spark: SparkSession, path: str, below: int | None = None) -> list[tuple[int, str, bool]]:
    """(version, folder, whole) of the manifests that there are, highest first: `SLOTS` at most."""
    try:
        told = spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).json(f"{path}/_manifest").where("version is not null")
        told = told if below is None else told.where(F.col("version") < below)
        held = sorted(told.collect(), key=lambda r: -r.version)
    except AnalysisException as e:
        if not _absent(e):
            raise
        held = []  # nothing has been written yet
    return [(r.version, f"{path}/{r.folder}", _whole(spark, path, r)) for r in held]


def read_state(spark: SparkSession, path: str, schema: str | None = None, below: int | None = None) -> DataFrame | None:
    """The rows of the highest whole version (below another); None if there is no version at all."""
    found = versions(spark, path, below)
    for _, folder, whole in found:
        if whole:
            return (spark.read.schema(schema) if schema else spark.read).parquet(folder)
    if found:
        raise StateError(f"{path}: no version of {[v for v, _, _ in found]} has all its files")
    return None
