"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, to be written and read again as the next one's docs.
All but the last return the columns of documents. Language identification drops documents without a language or in
doubt; deduplication keeps one document of each component; decontamination drops documents in which a benchmark
window occurs; mixing repeats or leaves out whole documents as the sources' quotas say; sharding places what is left.

Rows are told apart by id and text together, so equal rows share one fate in every stage and null ids take part. Columns
of any name are handed on untouched, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, stage
from tidemark.llm.decontam import decontaminate
from tidemark.llm.langid import accepted
from tidemark.llm.mixing import repeated
from tidemark.llm.neardup import deduplicate
from tidemark.llm.sharding import shard


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language beyond doubt; null text, text without a letter and ambiguous text go."""
    return accepted(docs)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component; of null ids and of texts without words, all stay."""
    return deduplicate(docs)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs; null text has none and stays, null items are none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as their source's quota says; null source is a source, texts without words go."""
    return repeated(docs, row_key(F.col("doc_id"), F.col("text")))


def place_in_shards(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document with its shard and slot; null text has size 1, null ids are one key."""
    return shard(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: Language identification is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
