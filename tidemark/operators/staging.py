"""Tables written to the folder that driver and executors share, to cut lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="tidemark-")
        shared_folder.own = found
    return f"{found.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows dealt by a key over a few tasks a core, before work whose time goes by rows.

    A scan deals by stored bytes, so a table of some MB is one task, however much each of its rows costs.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Adds name: the row's place, from 1, in the order of all rows, without a task that sees them all.

    Rows are dealt by ranges of the order and sorted within; a range's start is the number of rows in those before it.
    Rows that the order does not tell apart are numbered in any order.
    """
    local = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    local = stage(local.withColumns({"__range": F.shiftright(at, 33), "__in": at.bitwiseAND((1 << 33) - 1)}), "ranges")
    sizes = local.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__start"))  # a row a task
    held = local.join(F.broadcast(starts), "__range")
    return held.withColumn(name, (F.col("__start") + F.col("__in") + 1).cast("long")).drop("__range", "__in", "__start")
