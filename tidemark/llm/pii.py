"""Personal data: checked shapes, then contextual extraction bootstrapped from them.

The shapes (email, ip, card, phone) give spans and seed entities. A seed is the word that holds the match, without
closing punctuation; a phone or card is one word, and the same seed, whatever its separators. A context is the two
words before a word, or the word before and the word after it, taken from the words of the whole text. Contexts of at
least `SEEDS` different seeds of a kind, most of whose different words have identifier shape (a digit or @), become
patterns of that kind; all such words of the corpus that stand in a pattern are its instances. On the graph of
patterns and instances the scores are iterated: a pattern is worth the mean score of its different words (smoothed),
an instance that is a seed is worth 1, another what its patterns make likely, a word without the shape 0. Patterns
that end above `CONFIDENT` mark the identifiers in them that hold no shape, under the pattern's kind.

The expressions below are the contract's with possessive repeats and a guard that a match starts where a run of its
first character starts: the same matches, in time that grows with the text alone.

Two passes read all texts: one lists matches and words of identifier shape (few rows a document), one counts the
different words of contexts. Before the second, parts of the corpus rule out contexts that cannot pass, so that a
frequent one is not counted in full. Contexts up to a number are a list that each text's words are tested for; more
are met by a broadcast where their measured size allows that, else each different (context, word) is met in a shuffled
join, so that a hot context is as many rows as it has words. All three ways give the same rows.

Nulls and edges: null text has no spans; spans count code points; each document row gives one row, equal ids
included; no seeds means no patterns; a word that two kinds claim alike gets the first kind; other columns are not
read, and kept columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, small, stage, words

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
KINDS = ("email", "ip", "card", "phone")
SHAPES = (EMAIL, IP, CARD, PHONE, TOKEN)
#: what a text must hold for a shape to be looked for
HINTS = ("@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", r"\+[0-9]", "[0-9@]")
CARD_KIND, PHONE_KIND, TOKEN_KIND = 2, 3, 4
SEEDS = 3
ROUNDS = 3
CONFIDENT = 0.6
#: One in so many documents is read before all are, to rule contexts out.
PARTS = (256, 16)
#: Contexts that a text's words are tested for in place.
LISTED = 20_000
#: Stands for each separator inside a valid phone or card, so that the match is one word of the same length.
JOINER = "\ue000"
_ROW = "struct<kind:int,i:int,gap:int,match:string,ctx:array<bigint>,anchor:bigint>"


def _valid(kind: Column, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)

    def part(p: Column) -> Column:
        plain = F.regexp_replace(p, "^0+(?=.)", "")
        return (F.length(plain) <= 3) & (F.coalesce(F.substring(plain, 1, 3).try_cast("int"), F.lit(999)) <= 255)

    def worth(i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0
    return (
        F.when(kind == 0, True)
        .when(kind == 1, F.forall(F.split(text, r"\."), part))
        .when(kind == CARD_KIND, n.between(12, 19) & F.when(n.between(12, 19), luhn))
        .when(kind == PHONE_KIND, n.between(9, 15))
        .otherwise(True)
    )


def _has(k: int, name: str) -> Column:
    return F.contains(name, F.lit("@")) if HINTS[k] == "@" else F.rlike(name, F.lit(HINTS[k]))


def _then_match(kind: int):
    """A gap and the match after it, joined to one word if it is valid."""

    def put(gap: Column, i: Column) -> Column:
        m = F.get("__m", i)
        one = F.translate(m, " ().-", JOINER * 5)
        return F.concat(gap, F.coalesce(F.when(_valid(F.lit(kind), m), one), m, F.lit("")))

    return put


def _flat(df: DataFrame) -> DataFrame:
    """Adds flat: the text with JOINER for each separator inside a valid phone or card, all else in its place."""
    df = df.withColumn("flat", F.col("text"))
    for kind, hint in ((PHONE_KIND, r"\+[0-9]"), (CARD_KIND, r"[0-9][\x20-][0-9]")):
        has = F.rlike("flat", F.lit(hint))
        df = df.withColumns(
            {
                "__m": F.when(has, F.regexp_extract_all("flat", F.lit(SHAPES[kind]), F.lit(0))),
                "__g": F.when(has, F.split("flat", SHAPES[kind], -1)),
            }
        )
        made = F.array_join(F.transform("__g", _then_match(kind)), "")
        df = df.withColumn("flat", F.coalesce(made, "flat")).drop("__m", "__g")
    return df


def _trimmed(word: Column) -> Column:
    return F.regexp_replace(word, r"[^A-Za-z0-9\x80-\x{10FFFF}]++\z", "")


def _plain(word: Column) -> Column:
    """A lower-case word without joiners and closing punctuation."""
    return _trimmed(F.replace(word, F.lit(JOINER), F.lit("")))


def _before(w: Column, p: Column) -> Column:
    """The context of the two words before place p."""
    return F.when(p >= 2, F.xxhash64(F.lit("2"), F.get(w, p - 2), F.get(w, p - 1)))


def _around(w: Column, p: Column) -> Column:
    """The context of the words before and after place p."""
    return F.when((p >= 1) & (p + 1 < F.size(w)), F.xxhash64(F.lit("1"), F.get(w, p - 1), F.get(w, p + 1)))


def _entry(kind: int, i: Column, gap: Column, match: Column, ctx: Column, anchor: Column) -> Column:
    named = (F.lit(kind).alias("kind"), i.alias("i"), gap.alias("gap"), match.alias("match"))
    return F.struct(*named, ctx.cast("array<bigint>").alias("ctx"), anchor.cast("bigint").alias("anchor"))


def _listed(k: int):
    """A match of shape k with the length of the gap before it and, of a shaped word, its contexts and their anchor,
    the word before it."""

    def one(match: Column, i: Column) -> Column:
        ctx, anchor, p = F.lit(None), F.lit(None), F.get("at", i)
        if k == TOKEN_KIND:
            ctx = F.array_compact(F.array(_before(F.col("w"), p), _around(F.col("w"), p)))
            anchor = F.xxhash64(F.get("w", p - 1))
        return _entry(k, i, F.length(F.coalesce(F.get(f"g{k}", i), F.lit(""))), match, ctx, anchor)

    return one


def _matches(docs: DataFrame, keep: list[str]) -> DataFrame:
    """uid, kept columns as k0.., kind, start, end, match, word, ctx and free.

    Kind is -1 for the document itself and 4 for a word of identifier shape. word, long (its length in the text) and
    ctx are those of the shaped word at or around the match; free tells of a shaped word that it holds no valid shape.
    """
    held = [f"k{i}" for i in range(len(keep))]
    own = [F.col(c).alias(h) for c, h in zip(keep, held, strict=True)]
    df = docs.select(*own, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = _flat(df.withColumn("uid", F.monotonically_increasing_id()))
    listed = [F.array(_entry(-1, F.lit(0), F.lit(0), F.lit(""), F.lit(None), F.lit(None)))]
    for k, shape in enumerate(SHAPES):
        source = "flat" if k == TOKEN_KIND else "text"
        m, g = f"m{k}", f"g{k}"
        df = df.withColumn(m, F.when(_has(k, source), F.regexp_extract_all(source, F.lit(shape), F.lit(0))))
        some = F.size(F.coalesce(m, F.array().cast("array<string>"))) > 0
        df = df.withColumn(g, F.when(some, F.split(source, shape, -1)))
        if k == TOKEN_KIND:
            # The places of the shaped words among all words, in the order of the matches.
            shaped = lambda p: F.rlike(F.get("w", p), F.lit("[0-9@]"))
            df = df.withColumn("w", F.when(some, words(F.lower("flat"))))
            df = df.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("w") - 1), shaped))
        listed.append(F.when(some, F.transform(m, _listed(k))).otherwise(F.array().cast(f"array<{_ROW}>")))
    df = df.withColumn("all", F.concat(*listed)).select("uid", *held, F.inline_outer("all"))
    along = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(along).cast("long"))
    df = df.withColumn("start", F.col("end") - F.length("match")).where(_valid(F.col("kind"), F.col("match")))
    # A match lies in one shaped word, the last that starts at or before it.
    is_word = F.col("kind") == TOKEN_KIND
    upto = Window.partitionBy("uid").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    word = F.when(is_word, F.struct("start", "match", "ctx", "anchor"))
    df = df.withColumn("at", F.last(word, ignorenulls=True).over(upto))
    free = F.max(F.col("kind").between(0, 3)).over(Window.partitionBy("uid", "at.start"))
    long = F.length(_trimmed(F.col("at.match")))
    free = (is_word & ~free & (long > 0)).alias("free")
    word = _plain(F.lower("at.match")).alias("word")
    told = (word, long.alias("long"), "at.ctx", "at.anchor", free)
    return df.select("uid", *held, "kind", "start", "end", *told)


def _in_contexts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """ctx and word: the words without identifier shape of all texts that stand in one of the contexts of keys, a
    written table. Those with it are listed already.

    Up to `LISTED` contexts are tested within a text's words, so that only words in them become rows; more are joined.
    """
    texts = _flat(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    w = texts.select(words(F.lower("flat")).alias("w")).where("size(w) > 0")
    places = F.explode(F.array(_before(F.col("w"), F.col("p")), _around(F.col("w"), F.col("p")))).alias("ctx")
    listed = keys.select("ctx", "anchor").limit(LISTED + 1).collect()
    if len(listed) <= LISTED:
        among = f"IN ({', '.join(sorted({f'{r.ctx}L' for r in listed})) or 'NULL'})"
        anchors = f"IN ({', '.join(sorted({f'{r.anchor}L' for r in listed})) or 'NULL'})"
        # The word before is tested first: most places need no more.
        here = f"""filter(sequence(1, greatest(size(w) - 1, 1)), p -> xxhash64(get(w, p - 1)) {anchors} AND NOT get(w, p) RLIKE '[0-9@]' AND (
            (p >= 2 AND xxhash64('2', get(w, p - 2), get(w, p - 1)) {among})
            OR (p + 1 < size(w) AND xxhash64('1', get(w, p - 1), get(w, p + 1)) {among})))"""
        rows = w.select("w", F.explode(F.expr(here)).alias("p")).select(F.get("w", F.col("p")).alias("word"), places)
        return rows.where(f"ctx {among}")
    keys = keys.select("ctx")
    rows = w.select("w", F.posexplode("w").alias("p", "word")).where(~F.rlike("word", F.lit("[0-9@]")))
    rows = rows.select("word", places).where("ctx is not null")
    return rows.join(F.broadcast(keys), "ctx") if small(keys, 16) else rows.distinct().join(keys, "ctx")


def _hopeful(docs: DataFrame, shaped: DataFrame) -> DataFrame:
    """The contexts (ctx, anchor, n_shaped, n_bared) whose words of identifier shape may be numerous enough.

    A context has at least as many different words as in any part of the corpus, so one that fails on a part fails on
    all of it: small parts rule out the frequent contexts, larger ones see only the rarer, and no context that could
    pass the exact count is lost. The words set bits of one number, so that each task sends a row a context; there
    are at least as many words as bits.
    """
    left = stage(shaped, "hopeful")
    bit = F.pmod(F.xxhash64(_plain(F.col("word"))), F.lit(64)).cast("int")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")
    for part in PARTS:
        some = docs.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)
        met = _in_contexts(some, left).groupBy("ctx").agg(bits)
        # A word without the shape is none of the shaped ones but those that lost it with their closing punctuation.
        seen = F.greatest(F.coalesce(F.bit_count("bits"), F.lit(0)) - F.col("n_bared"), F.lit(0)) + F.col("n_shaped")
        left = left.join(met, "ctx", "left").where(_may_pass(seen)).select("ctx", "anchor", "n_shaped", "n_bared")
        left = stage(left, "hopeful")
    return left


def _may_pass(n: Column) -> Column:
    """Whether n_shaped words among n are enough for a confident pattern if all of them were identifiers."""
    return F.col("n_shaped") >= CONFIDENT * (F.greatest(n, F.col("n_shaped")) + 1)


def patterns(found: DataFrame, docs: DataFrame) -> DataFrame | None:
    """ctx, kind and score of the confident patterns; None where no context has seeds enough."""
    seeds = found.where("kind between 0 and 3").withColumnRenamed("word", "inst")
    seeds = stage(seeds.select("kind", "inst", F.explode("ctx").alias("ctx")).distinct(), "seeds")
    candidates = seeds.groupBy("ctx", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= SEEDS)
    candidates = stage(candidates.select("ctx", "kind"), "contexts")
    if candidates.isEmpty():
        return None
    # Words of identifier shape and their contexts are listed already.
    shaped = found.where(F.col("kind") == TOKEN_KIND)
    shaped = shaped.select(F.col("word").alias("inst"), "anchor", F.explode("ctx").alias("ctx")).distinct()
    shaped = shaped.join(maybe_broadcast(candidates.select("ctx").distinct(), 16), "ctx", "left_semi")
    shaped = stage(shaped, "shaped")
    bared = F.count_if(~F.rlike("inst", F.lit("[0-9@]"))).alias("n_bared")
    counted = shaped.groupBy("ctx", "anchor").agg(F.count("*").alias("n_shaped"), bared)
    hopeful = _hopeful(docs, counted)
    met = _in_contexts(docs, hopeful).select("ctx", _plain(F.col("word")).alias("inst"))
    met = met.unionByName(shaped.join(maybe_broadcast(hopeful.select("ctx"), 16), "ctx", "left_semi").select("ctx", "inst"))
    totals = met.distinct().groupBy("ctx").agg(F.count("*").alias("n")).join(hopeful, "ctx")
    totals = totals.where(_may_pass(F.col("n")))
    totals = stage(totals.join(candidates, "ctx").select("ctx", "kind", "n"), "totals")
    known = seeds.select("kind", "inst").distinct().withColumn("seed", F.lit(True))
    edges = shaped.join(totals.select("ctx", "kind"), "ctx").join(known, ["kind", "inst"], "left")
    edges = stage(edges.select("ctx", "kind", "inst", F.coalesce("seed", F.lit(False)).alias("seed")), "edges")
    score = edges.where("seed").select("kind", "inst", F.lit(1.0).alias("worth")).distinct()
    for _ in range(ROUNDS):
        worth = edges.join(score, ["kind", "inst"], "left").groupBy("ctx", "kind").agg(F.sum("worth").alias("worth"))
        pats = totals.join(worth, ["ctx", "kind"], "left")
        pats = pats.select("ctx", "kind", (F.coalesce("worth", F.lit(0.0)) / (F.col("n") + 1)).alias("score"))
        pats = stage(pats, "patterns")
        doubt = F.sum(F.log1p(-F.least("score", F.lit(0.999)))).alias("doubt")
        told = edges.join(pats, ["ctx", "kind"]).groupBy("kind", "inst").agg(F.max("seed").alias("seed"), doubt)
        told = told.select("kind", "inst", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("worth"))
        score = stage(told, "scores")
    return pats.where(F.col("score") >= CONFIDENT)


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each document row: the kept columns, base and spans as sorted arrays of (start, kind, end)."""
    found = stage(_matches(docs, keep), "matches")
    held = [f"k{i}" for i in range(len(keep))]
    span = F.struct("start", "kind", "end")
    base = found.where(F.col("kind") < TOKEN_KIND)
    base = base.select("uid", *held, F.when(F.col("kind") >= 0, span).alias("span"), F.lit(True).alias("base"))
    sure = patterns(found, docs)
    if sure is not None:
        named = F.max_by("kind", F.struct("score", -F.col("kind"))).alias("named")
        best = maybe_broadcast(stage(sure.groupBy("ctx").agg(named, F.max("score").alias("score")), "best"), 32)
        shaped = found.where("free").select("uid", *held, "start", "long", F.explode("ctx").alias("ctx"))
        fresh = shaped.join(best, "ctx").groupBy("uid", *held, "start", "long")
        fresh = fresh.agg(F.max_by("named", F.struct("score", -F.col("named"))).alias("kind"))
        fresh = fresh.withColumn("end", F.col("start") + F.col("long"))
        base = base.unionByName(fresh.select("uid", *held, span.alias("span"), F.lit(False).alias("base")))
    base = base.groupBy("uid", *held).agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), F.col("span")))).alias("base"),
        F.array_sort(F.collect_list("span")).alias("spans"),
    )
    return base.select(*(F.col(h).alias(c) for h, c in zip(held, keep, strict=True)), "base", "spans")


def _told(spans: Column) -> Column:
    def one(s: Column) -> Column:
        name = F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
        return F.concat_ws(":", name, s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(spans, one), ",")


def op9_bootstrapped_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    digest = F.sha2(_told(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, range(4)), digest, _told(F.col("spans")).alias("spans"))
