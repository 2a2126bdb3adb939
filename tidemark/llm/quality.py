"""Quality rules whose cutoffs come with a guarantee.

Each rule is a rate of a text (symbols a word, repeated words, ...) and a fixed list of cutoffs, mildest first. A path
is a fixed set of rules that grow stricter together: all of them, all but one, or one alone; its level t takes the
t-th cutoff of each. On the labelled good documents of a stratum (the language), a level passes if the exact binomial
test rejects "its rules together drop more than `risk` of good documents": P(Bin(n, risk) <= drops) <=
delta / (paths x strata), the last by Bonferroni. Along a path the tests go on only while they pass (fixed sequence,
which needs no further correction), so with probability 1 - delta every level that passed, and so the one chosen,
whichever it is, drops no more than `risk` of a stratum's good documents by all its rules. Of the strictest levels of
the paths the one that drops most labelled bad documents is chosen, the first among equals. All labelled documents
count. Where labels are too few for any pass, a stratum has no cutoffs and its rules drop nothing.

Nulls and edges: a null text has no words and fails the base rule; null lang is a stratum of its own; a document
with several labels is good only if all say so, null labels and labels of unknown documents are ignored; each
document row gives one row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, stage, words

RISK = 0.02
DELTA = 0.05
GRAM = 5
#: rule: cutoffs, mildest first; a document fails above the cutoff
RULES = {
    "symbols": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "repeats": [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2],
    "bangs": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2],
    "word_length": [40.0, 30.0, 25.0, 20.0, 17.0, 15.0],
}
#: Sets of rules that are made stricter together, in the order in which equals are preferred.
PATHS = [list(RULES), *([r for r in RULES if r != out] for out in RULES), *([r] for r in RULES)]
LEVELS = max(map(len, RULES.values()))
NEVER = 99  # the level at which a document is dropped, for one that no level drops


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in 5-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes of their words' 64-bit hashes within one text.
    """
    n = F.col("n_words").cast("int")
    grams = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*(F.get("wh", i + j) for j in range(GRAM))))
    df = df.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w))).withColumn("g", F.when(n >= GRAM, grams))
    # Only a text with a repeated hash is sorted.
    ordered = F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("o", F.when(F.size(F.array_distinct("g")) < F.size("g"), ordered))
    twin = lambda j: F.coalesce(F.get("o", j)["h"] == F.get("o", j - 1)["h"], F.lit(False)) | F.coalesce(F.get("o", j)["h"] == F.get("o", j + 1)["h"], F.lit(False))
    at = F.transform(F.filter(F.sequence(F.lit(0), F.size("o") - 1), twin), lambda j: F.get("o", j)["i"])
    df = df.withColumn("at", F.when(F.col("o").isNotNull(), F.array_sort(at)))
    cover = F.aggregate("at", F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("hit")), lambda a, p: F.struct((p + GRAM).alias("to"), (a["hit"] + p + GRAM - F.greatest(a["to"], p)).alias("hit")), lambda a: a["hit"])
    return df.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long"))).drop("wh", "g", "o", "at")


def measures(docs: DataFrame, keys: list[Column], text_col: str = "text") -> DataFrame:
    """The key columns and the text's counts, the base verdict and the rules' rates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lined = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    df = docs.select(*keys, words(F.col(text_col)).alias("words"), lined.alias("lined"), count("#*$%&|<>").cast("long").alias("n_symbols"), count("!").cast("long").alias("n_bangs"))
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    df = df.withColumn("n_lines", F.size("lined").cast("long")).withColumn("n_dup_lines", (F.size("lined") - F.size(F.array_distinct("lined"))).cast("long"))
    df = _repeat_words(df).drop("words", "lined")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _rates() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "bangs": per("n_bangs", "n_words"), "word_length": per("word_chars", "n_words")}


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly in logarithms; 1 where k is above the mean."""
    import math

    odds = math.log(p) - math.log1p(-p)
    step = lambda a, i: F.struct((a["t"] + F.log((n - i) / (i + 1.0)) + odds).alias("t"), (F.greatest(a["s"], a["t"]) + F.log1p(F.exp(-F.abs(a["s"] - a["t"])))).alias("s"))
    first = n * math.log1p(-p)
    start = F.struct((first + F.log(n / 1.0) + odds).alias("t"), first.alias("s"))
    total = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: F.exp(a["s"]))
    return F.when(k > p * n, 1.0).otherwise(total)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff of the chosen level of each stratum; no row where none passes."""
    said = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg((F.min("quality") == 1).alias("good"))
    held = measured.join(said, F.col("doc_id") == F.col("label_id"))
    passed = lambda r, x: F.size(F.filter(F.array(*map(F.lit, RULES[r])), lambda c: x > c))
    # A rate above i cutoffs of a descending list is above its last i.
    first = {r: F.when(passed(r, x) > 0, len(RULES[r]) - passed(r, x)).otherwise(NEVER) for r, x in _rates().items()}
    held = held.select("stratum", "good", *(c.alias(f"first_{r}") for r, c in first.items()))
    dropped = F.array(*(F.struct(F.lit(i).alias("path"), F.array_min(F.array(*(F.col(f"first_{r}") for r in rules))).alias("first")) for i, rules in enumerate(PATHS)))
    counts = stage(held.select("stratum", "good", F.inline(dropped)).groupBy("stratum", "good", "path", "first").agg(F.count("*").alias("c")), "path-counts")
    size = counts.where("path = 0 and good").groupBy("stratum").agg(F.sum("c").alias("n"))
    strata = max(1, size.count())
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
    grid = size.select("stratum", "n", F.explode(F.sequence(F.lit(0), F.lit(len(PATHS) - 1))).alias("path")).select("*", level)
    so_far = lambda which: F.coalesce(F.sum(F.when((F.col("first") <= F.col("level")) & which, F.col("c"))), F.lit(0)).cast("long")
    drops = grid.join(counts, ["stratum", "path"], "left").groupBy("stratum", "path", "level", "n").agg(so_far(F.col("good")).alias("k"), so_far(~F.col("good")).alias("bad"))
    tested = drops.withColumn("passes", binomial_tail(F.col("n"), F.col("k"), risk) <= delta / (len(PATHS) * strata))
    along = Window.partitionBy("stratum", "path").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    passing = tested.withColumn("so_far", F.min("passes").over(along)).where("so_far")
    strictest = passing.groupBy("stratum", "path").agg(F.max_by(F.struct("level", "bad"), "level").alias("x")).select("stratum", "path", "x.*")
    best = strictest.groupBy("stratum").agg(F.max_by(F.struct("path", "level"), F.struct("bad", -F.col("path"))).alias("x")).select("stratum", "x.*")
    table = [(i, r, t, float(RULES[r][min(t, len(RULES[r]) - 1)])) for i, rules in enumerate(PATHS) for r in rules for t in range(LEVELS)]
    named = measured.sparkSession.createDataFrame(table, "path int, rule string, level int, cutoff double")
    return best.join(F.broadcast(named), ["path", "level"]).select("stratum", "rule", "cutoff")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document row: its id, counts, base verdict and the verdict of the chosen cutoffs."""
    stratum = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("none")).alias("stratum")
    measured = stage(measures(docs, [F.col("doc_id"), stratum]), "measures")
    chosen = cutoffs(measured, labels).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    chosen = stage(chosen, "cutoffs").withColumnRenamed("stratum", "chosen_for")
    judged = measured.join(maybe_broadcast(chosen, 128), F.col("stratum") == F.col("chosen_for"), "left")
    fails = F.lit(False)
    for rule, rate in _rates().items():
        fails = fails | F.coalesce(rate > F.col(rule), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~fails)


def op1_risk_controlled_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    lists = ", ".join(f"('{r}', {[float(c) for c in cs]})" for r, cs in RULES.items())
    paths = ", ".join(f"({i}, '{r}')" for i, rules in enumerate(PATHS) for r in rules)
    rate = {"symbols": "n_symbols / n_words", "dup_lines": "n_dup_lines / nullif(n_lines, 0)", "repeats": "n_repeat_words / n_words", "bangs": "n_bangs / n_words", "word_length": "word_chars / n_words"}
    rates = " UNION ALL ".join(f"SELECT uid, doc_id, stratum, '{r}' AS rule, CASE WHEN n_words > 0 THEN coalesce(CAST({x} AS DOUBLE), 0) ELSE 0 END AS rate FROM f" for r, x in rate.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce('=' || lang, 'none') AS stratum, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lined FROM documents),
g AS (SELECT uid, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT uid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, s) AS c FROM g) WHERE c > 1),
rw AS (SELECT uid, count(DISTINCT q) AS n FROM (SELECT uid, unnest(range(i, i + 5)) AS q FROM r) GROUP BY uid),
f AS (SELECT d.uid, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  length(text) - length(replace(text, '!', '')) AS n_bangs, len(lined) AS n_lines, CAST(len(lined) - len(list_distinct(lined)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rw USING (uid)),
x AS ({rates}),
rules AS (SELECT * FROM (VALUES {lists}) AS v(rule, cuts)), paths AS (SELECT * FROM (VALUES {paths}) AS v(path, rule)),
q AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
fr AS (SELECT uid, stratum, good, rule, CASE WHEN e > 0 THEN l - e ELSE {NEVER} END AS first FROM (SELECT uid, stratum, good, rule, len(cuts) AS l, len(list_filter(cuts, lambda c: rate > c)) AS e FROM x JOIN q USING (doc_id) JOIN rules USING (rule))),
h AS (SELECT uid, stratum, good, path, min(first) AS first FROM fr JOIN paths USING (rule) GROUP BY uid, stratum, good, path),
s AS (SELECT stratum, count(*) AS n FROM h WHERE path = 0 AND good GROUP BY stratum),
k AS (SELECT s.stratum, s.n, p.path, t.level, (SELECT count(*) FROM s) AS strata, (SELECT count(*) FROM h WHERE h.stratum = s.stratum AND h.path = p.path AND good AND first <= t.level) AS k,
  (SELECT count(*) FROM h WHERE h.stratum = s.stratum AND h.path = p.path AND NOT good AND first <= t.level) AS bad FROM s, (SELECT DISTINCT path FROM paths) AS p, range(0, {LEVELS}) AS t(level)),
p AS (SELECT stratum, path, level, bad, strata, CASE WHEN k > {RISK} * n THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))) FROM range(0, k + 1) AS t(i)) END AS tail FROM k),
z AS (SELECT *, max(CASE WHEN tail <= {DELTA} / ({len(PATHS)} * strata) THEN 0 ELSE 1 END) OVER (PARTITION BY stratum, path ORDER BY level) AS failed FROM p),
b AS (SELECT * FROM z WHERE failed = 0 QUALIFY row_number() OVER (PARTITION BY stratum, path ORDER BY level DESC) = 1),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY bad DESC, path) = 1),
c AS (SELECT stratum, rule, cuts[1 + least(level, len(cuts) - 1)] AS cutoff FROM o JOIN paths USING (path) JOIN rules USING (rule)),
bad AS (SELECT DISTINCT uid FROM x JOIN c ON x.stratum = c.stratum AND x.rule = c.rule WHERE rate > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND bad.uid IS NULL AS kept FROM f LEFT JOIN bad USING (uid)
"""


ORACLE = _oracle()
