"""Queries that take whole texts and all rows, where their SQL still has a cut."""

from hashlib import sha256

from pyspark.sql import functions as F

from tidemark.operators import queue as Q
from tidemark.plans import registry


def test_questions_are_whole_texts(spark, tmp_path):
    same = "which of these many words are the same in both of the two questions "
    spark.createDataFrame([(1, same + "a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, same + "a"), (2, same + "b"), (3, same + "b"), (4, same + "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["T16_add"](spark, str(tmp_path)).collect()
    assert sorted(r.normalized for r in got) == [same + "b", same + "c"]


def test_questions_with_any_id_are_told(spark, tmp_path):
    """One id in 65,536 begins as those of the queue's own rows do."""
    text = next(x for x in (f"question {i}" for i in range(1_000_000)) if sha256(x.encode()).hexdigest().startswith("0000"))
    spark.createDataFrame([(181, "of the day")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, text), (2, "of the day"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.normalized for r in registry.QUERIES["T16_add"](spark, str(tmp_path)).collect()] == [text]


def test_another_questions_id_takes_no_row(spark):
    """Ids are 32 bits of a digest: a new question with an old one's id must not push it out."""
    new = spark.createDataFrame([("a new one", 1)], "text string, seq long")
    made = Q.new_questions(spark.createDataFrame([], Q.SCHEMA), new, F.lit("2026-01-02").cast("date"), 10)
    old = made.withColumns({"normalized": F.lit("an old one"), "text": F.lit("An old one")})
    got = Q.add(old, new, F.lit("2026-01-02").cast("date"), 10)
    assert sorted(r.normalized for r in got.collect()) == ["a new one", "an old one"]


def test_orphans_follow_all_links(spark, tmp_path):
    rows = [(2, 1, "error", '{"k": 3}'), (3, 4, "click", '{"k": 2}'), (4, 8, "view", "{}"), (5, 80, "view", None), (6, 80, "view", '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.user_id for r in registry.QUERIES["R21_orphans"](spark, str(tmp_path)).collect()} == {80}
