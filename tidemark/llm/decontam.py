"""Benchmark decontamination by winnowing.

Each run of `KEEP` consecutive k-grams keeps its least hash (leftmost among equals), in documents and in
benchmark items alike. Any 10 shared words hold `KEEP` whole k-grams, the same on both sides, so both keep the
same hash at the same place: a join on the kept hashes meets every shared window. Each meeting is extended to
the windows whose kept k-gram it is and confirmed word by word. An item of fewer than 10 words is one window of
its own length, met through k-grams of that length.

Nulls and edges: a null or empty text has no words, so a document has zero counts and an item no window; an
item without an id still marks words but adds nothing to the item list; equal item rows count once; each
document row gives one result row, repeated ids and null ids included; columns besides id and text are not read.

Windows go to all executors where their measured size allows that; else only fingerprints are shuffled, never the
words of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, maybe_broadcast, small, stage, text_key, without

WINDOW = 10  # words of a full window
GRAM = 5  # words of a k-gram
KEEP = WINDOW - GRAM + 1  # k-grams of a window, of which one is kept
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
POS_BITS = 27  # a row of Spark holds fewer than 2**27 words


def match_words(text: Column) -> Column:
    """The lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; none for null."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def _grams(hashes: Column, n: Column, k: int) -> Column:
    """A long for each k-gram: 36 bits of its hash, then its place."""


    def one(i: Column) -> Column:
        gram = F.xxhash64(*(F.get(hashes, i + j) for j in range(k)))
        return F.shiftleft(F.shiftrightunsigned(gram, 64 - 63 + POS_BITS), POS_BITS).bitwiseOR(i.cast("long"))

    return F.transform(F.sequence(F.lit(0), n - k), one)


def _least(grams: Column, i: Column) -> Column:
    return F.least(*(F.get(grams, i + j) for j in range(KEEP)))


def _hash(kept: Column) -> Column:
    return F.shiftright(kept, POS_BITS)


def _place(kept: Column) -> Column:
    return kept.bitwiseAND((1 << POS_BITS) - 1).cast("int")


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("words"))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, len, hash, off (place of the kept k-gram in the window) and the window's words joined by spaces."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), match_words(F.col(text_col)).alias("words"))
    items = _hashed(items).where("n > 0")
    full = items.where(F.col("n") >= WINDOW).withColumn("g", _grams(F.col("wh"), F.col("n"), GRAM))
    full = full.select("item_id", "words", "g", F.explode(F.sequence(F.lit(0), F.col("n") - WINDOW)).alias("i"))
    full = full.withColumn("kept", _least(F.col("g"), F.col("i")))
    full = full.select(
        "item_id",
        F.lit(WINDOW).alias("len"),
        _hash(F.col("kept")).alias("hash"),
        (_place(F.col("kept")) - F.col("i")).alias("off"),
        F.array_join(F.slice("words", F.col("i") + 1, WINDOW), " ").alias("window"),
    )
    for m in range(1, WINDOW):
        part = items.where(F.col("n") == m).select(
            "item_id",
            F.lit(m).alias("len"),
            _hash(F.get(_grams(F.col("wh"), F.col("n"), m), F.lit(0))).alias("hash"),
            F.lit(0).alias("off"),
            F.array_join("words", " ").alias("window"),
        )
        full = full.unionByName(part)
    return full.distinct()


def _tagged(m: int):
    return lambda v: F.struct(F.lit(m).alias("len"), v.alias("kept"))


def _fingerprints(lengths: list[int]) -> Column:
    """Kept k-grams of a document as (len, kept), for the window lengths that the benchmark has."""
    parts = []
    for m in lengths:
        if m == WINDOW:
            at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: _least(F.col("g"), i)))
        else:
            at = _grams(F.col("wh"), F.col("n"), m)
        made = F.transform(at, _tagged(m))
        parts.append(F.when(F.col("n") >= m, made).otherwise(F.array().cast("array<struct<len:int,kept:bigint>>")))
    return F.concat(*parts) if parts else F.array().cast("array<struct<len:int,kept:bigint>>")


def _met_in_place(base: DataFrame, held: list[str], windows: DataFrame) -> DataFrame:
    """uid, held columns, n, spans and found of each document; the windows fit a broadcast."""
    # One row without a fingerprint stands for the document itself, so that the texts are read and cut once.
    # The array is made before inline() so that the exploding join stays in one generated stage, which hands on
    # the document's words by reference instead of copying them for each fingerprint.
    alone = F.array(F.struct(F.lit(0).alias("len"), F.lit(-1).cast("long").alias("kept")))
    base = base.withColumn("kept_all", F.concat(alone, F.col("kept_all")))
    rows = base.select("uid", *held, "n", "words", F.inline_outer("kept_all"))
    rows = rows.withColumn("hash", F.when(F.col("kept") < 0, -1 - F.col("uid")).otherwise(_hash(F.col("kept"))))
    met = rows.join(F.broadcast(windows), ["len", "hash"], "left")
    met = met.withColumn("s", _place(F.col("kept")) - F.col("off"))
    met = met.where((F.col("kept") < 0) | _same(F.col("s"), F.col("len"), F.col("window")))
    span = F.when(F.col("kept") >= 0, F.struct("s", (F.col("s") + F.col("len")).alias("e")))
    found = F.collect_set(F.when(F.col("kept") >= 0, F.col("window")))
    return met.groupBy("uid", *held, "n").agg(F.sort_array(F.collect_set(span)).alias("spans"), found.alias("found"))


def _met_by_fingerprint(base: DataFrame, held: list[str], windows: DataFrame) -> DataFrame:
    """The same where the windows do not fit: fingerprints alone are shuffled, once for equal texts, and those that
    met a window come back to the words of their text as one list."""
    keys = maybe_broadcast(stage(windows.select("len", "hash").distinct(), "window_keys"), 20)
    # inline() would let the optimizer ask for the list's size below every projection, and make it anew inside lambdas.
    slim = base.select("tkey", F.inline_outer("kept_all")).where("kept is not null")
    slim = slim.select("tkey", "len", _hash(F.col("kept")).alias("hash"), _place(F.col("kept")).alias("place"))
    slim = slim.join(keys, ["len", "hash"]).distinct()
    met = slim.join(windows, ["len", "hash"]).select("tkey", (F.col("place") - F.col("off")).alias("s"), "len", "window")
    claims = met.where("s >= 0").groupBy(F.col("tkey").alias("c_tkey"))
    claims = stage(claims.agg(F.collect_list(F.struct("s", "len", "window")).alias("claims")), "claims")
    claims = maybe_broadcast(claims, F.size("claims") * (WINDOW * 16) + 48)
    df = base.join(claims, F.col("tkey") == F.col("c_tkey"), "left")
    sure = F.filter(F.coalesce("claims", F.array()), lambda c: _same(c["s"], c["len"], c["window"]))
    df = df.select("uid", *held, "n", sure.alias("sure"))
    span = lambda c: F.struct(c["s"].alias("s"), (c["s"] + c["len"]).alias("e"))
    spans = F.sort_array(F.array_distinct(F.transform("sure", span)))
    return df.select("uid", *held, "n", spans.alias("spans"), F.array_distinct("sure.window").alias("found"))


def _same(s: Column, m: Column, window: Column) -> Column:
    """Whether the document's words from s on are the window's."""
    here = F.array_join(F.slice("words", F.greatest(s, F.lit(0)) + 1, m), " ")
    return (s >= 0) & (s + m <= F.col("n")) & (here == window)


def hits(docs: DataFrame, benchmark: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """A row for each document row: the key columns, n_words, n_hit and items (item ids as strings, sorted)."""
    listed = stage(item_windows(benchmark), "windows")
    lengths = sorted(r[0] for r in listed.select("len").distinct().collect())  # 10 at most
    windows = stage(listed.select("len", "hash", "off", "window").distinct(), "places")
    fits = small(windows, F.octet_length("window") + 64, BROADCAST_BYTES)
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]
    held = [f"k{i}" for i in range(len(keys))]
    told = [] if fits else [text_key(F.col(text_col)).alias("tkey")]
    base = _hashed(docs.select(*own, *told, match_words(F.col(text_col)).alias("words")))
    base = base.withColumn("uid", F.monotonically_increasing_id())
    base = base.withColumn("g", F.when(F.col("n") >= WINDOW, _grams(F.col("wh"), F.col("n"), GRAM)))
    base = base.withColumn("kept_all", _fingerprints(lengths))
    per = (_met_in_place if fits else _met_by_fingerprint)(base, held, windows)

    def further(a: Column, x: Column) -> Column:
        fresh = F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]))
        return F.struct(F.greatest(a["to"], x["e"]).alias("to"), (a["hit"] + fresh).alias("hit"))

    nothing = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("hit"))
    covered = F.aggregate("spans", nothing, further, lambda a: a["hit"])
    each = F.explode_outer("found").alias("window")
    per = per.select("uid", *held, F.col("n").cast("long").alias("n_words"), covered.alias("n_hit"), each)
    owners = maybe_broadcast(listed.select("window", "item_id").distinct(), F.octet_length("window") + 48)
    items = F.array_sort(F.collect_set("item_id")).alias("items")
    out = per.join(owners, "window", "left").groupBy("uid", *held, "n_words", "n_hit").agg(items)
    return out.select(*(F.col(h).alias(c) for h, c in zip(held, keys, strict=True)), "n_words", "n_hit", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    keyed = docs.select(text_key(F.col("text")).alias("drop_key"), "text")
    return without(docs, text_key(F.col("text")), hits(keyed, benchmark, ["drop_key"]).where("n_hit > 0"))


def op10_winnowing_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return hits(docs, bench, ["doc_id"]).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS uid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT uid, i, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT uid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT uid, i, dw.m, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.m = bw.m),
p AS (SELECT uid, count(DISTINCT q) AS n_hit FROM (SELECT uid, unnest(range(i, i + m)) AS q FROM h) GROUP BY uid),
t AS (SELECT uid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (uid) LEFT JOIN t USING (uid)
"""
