"""What the operators share: words, staged tables, and joins whose small side has a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A table at most this large, by a measured sum, may be broadcast.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null is empty. Text that is ASCII throughout takes the shorter way."""
    upper = "".join(map(chr, range(65, 91)))
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def text_key(text: Column) -> Column:
    """A key of the exact text; null differs from empty."""
    return F.coalesce(F.md5(text), F.lit("null"))


def row_key(doc_id: Column, text: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text_key(text))


def hex_number(digest: Column, digits: int) -> Column:
    """The first hex digits of a digest as a long."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not getattr(shared_dir, "own", None):
            shared_dir.own = tempfile.mkdtemp(prefix="tidemark-")
        found = shared_dir.own
    return f"{found.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them again: cuts the lineage, survives lost executors."""
    spark = spark or df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows' measured bytes are within the limit."""
    cost = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    return (df.agg(F.sum(cost.cast("long"))).first()[0] or 0) <= limit


def maybe_broadcast(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """The table marked for broadcast if its measured size allows that; else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, row_bytes) else df


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """The rows of docs as one column ``doc``, so that no column of theirs can clash with those added here."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(whole.alias("doc"), *(made.alias(name) for name, made in extra.items()))


def without(docs: DataFrame, key: Column, drop: DataFrame) -> DataFrame:
    """Rows of docs whose key is not in the one column ``drop_key`` of drop."""
    gone = maybe_broadcast(stage(drop.select("drop_key").distinct(), "dropped"), 64)
    held = packed(docs, held_key=key)
    return held.join(gone, held["held_key"] == gone["drop_key"], "left_anti").select("doc.*")
