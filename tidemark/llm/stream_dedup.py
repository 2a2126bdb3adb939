"""Exact deduplication by a stream with keyed state.

A stream over the files of a table keeps one row of state for each digest of a normalised text, without expiry, on the
executors' disks (RocksDB) and with its checkpoint in the shared folder: the digest, the stable identifier (least
doc_id), the content locator (file and row of that document) and the number of rows. New files only add to it; a
stopped stream goes on from its checkpoint. Copies in one file are added up before they are shuffled, so a text in a
third of all rows is a few rows of a batch.

A digest with more than one row is a hit. `decide` reads the ledger from the state and compares the full bytes of all
hits: their texts are grouped by digest and whole text, copies added up in place again, and a text without the row
that the locator names is not the retained one, whatever its digest says. Rows of such digests are grouped by their
whole texts. Nothing is decided by digest alone.

Texts are equal when identical after each run of `[\\x20\\x09-\\x0D]` becomes one space. Nulls and edges: a null text
is an empty one; null ids come after all others, so that keep_id is null only where all ids of a group are; of rows
equal in id and text the one first by file and place is kept; an empty table gives no rows; only doc_id and text are
read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, new_path, stage

#: Bytes of files that one micro-batch takes.
BATCH_BYTES = 64 << 30
#: Hex digits of SHA-256 that are the key of the state. Fewer only make more hits that the bytes then tell apart.
DIGITS = 64
#: A run that is not one space already.
RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    # Small stores would each reserve 4 MB for a manifest.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUN, " ")


def _keyed(docs: DataFrame, digits: int, *more: Column) -> DataFrame:
    """digest (the key), first (what a group's least is taken of), and more columns, of rows read from files."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    docs = docs.select("doc_id", normalised(F.col("text")).alias("norm"), at.alias("at"))
    docs = docs.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at").alias("first")
    return docs.select(F.unhex(F.left("sha", F.lit(digits))).alias("digest"), first, *more)


def _session(spark: SparkSession) -> SparkSession:
    """A session of its own, so that no other query's settings change. A new state has as many partitions as a shuffle
    of the caller's session."""
    own, partitions = spark.newSession(), "spark.sql.shuffle.partitions"
    for name, value in (STATE | {partitions: spark.conf.get(partitions)}).items():
        own.conf.set(name, value)
    return own


def _schema(spark: SparkSession, path: str):
    return spark.read.parquet(path).select("doc_id", "text").schema


def advance(spark: SparkSession, path: str, state: str, digits: int = DIGITS, batch_bytes: int = BATCH_BYTES) -> None:
    """Take the files of `path` that are new since the last time into the state, in micro-batches."""
    # The last character as a class: a glob may be one file, where a plain path must be a folder.
    glob = f"{path[:-1]}[{path[-1]}]"
    rows = _session(spark).readStream.schema(_schema(spark, path)).option("maxBytesPerTrigger", str(batch_bytes)).parquet(glob)
    held = _keyed(rows, digits).groupBy("digest").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    sink = held.writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
    sink.trigger(availableNow=True).start().awaitTermination()


def ledger(spark: SparkSession, state: str) -> DataFrame:
    """digest, first (no_id, doc_id, at) and n of every key of the state."""
    rows = _session(spark).read.format("statestore").load(state)
    return stage(rows.select("key.digest", F.col("value.min").alias("first"), F.col("value.count").alias("n")), "ledger", spark)


def decide(spark: SparkSession, path: str, state: str, digits: int = DIGITS) -> DataFrame:
    """A row for each row of the files: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = spark.read.schema(_schema(spark, path)).parquet(path)
    hits = ledger(spark, state).where("n > 1").withColumnRenamed("first", "least")
    hits = stage(hits, "hits")
    listed = maybe_broadcast(hits, 160 + F.octet_length("least.at.file"))
    rows = _keyed(docs, digits, F.col("sha"))

    texts = _keyed(docs, digits, F.col("norm")).join(listed, "digest").groupBy("digest", "norm")
    texts = texts.agg(F.max(F.col("first.at") == F.col("least.at")).alias("retained"))
    unlike = stage(texts.where("not retained").select("digest").distinct(), "unlike")
    apart = None
    if not unlike.isEmpty():
        unlike = maybe_broadcast(unlike, 48)
        listed = listed.join(unlike, "digest", "left_anti")
        apart = _keyed(docs, digits, F.col("sha"), F.col("norm")).join(unlike, "digest")
        whole = apart.groupBy("digest", "norm").agg(F.min("first").alias("least"), F.count("*").alias("n"))
        apart = apart.join(stage(whole, "whole"), ["digest", "norm"]).select("first", "sha", "least", "n")
        rows = rows.join(unlike, "digest", "left_anti")
    found = rows.join(listed, "digest", "left").select("first", "sha", "least", "n")
    found = found.unionByName(apart) if apart is not None else found
    least = F.coalesce("least", "first")
    return found.select(
        F.col("first.doc_id").alias("doc_id"), least["doc_id"].alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (least["at"] == F.col("first.at")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def deduplicate(spark: SparkSession, path: str, state: str | None = None, digits: int = DIGITS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Advance the state (a new one, unless told which) by the files of path, then decide on all their rows."""
    state = state or new_path(spark, "stream_dedup")
    if spark.read.parquet(path).isEmpty():
        empty = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"
        return spark.createDataFrame([], empty)
    advance(spark, path, state, digits, batch_bytes)
    return decide(spark, path, state, digits)


def op12_streaming_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(spark, f"{sf_dir}/documents.parquet")


ORACLE = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS place, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, place) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""
