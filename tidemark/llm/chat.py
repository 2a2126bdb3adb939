"""Chat formatting in budgeted windows.

A turn costs its tokens (a quarter of its UTF-8 bytes, rounded up, and the markers). Prefix sums of the costs choose
turn-aligned spans. Of a conversation's budget, what its system turn and the history leave is the room for a span's
own turns; half of it, `STRIDE` at most, is the conversation's stride. A turn of up to a stride belongs to span
floor(cost before it / stride), so that such turns take no more than the room together; a longer one is a span of its
own. Each span becomes a window: the leading system turn again, then the turns of the span before that start within
`HISTORY` of this one (within what is left, where the span is a long turn), then the span's own turns. Only own
assistant turns are under the loss mask; repeated turns are marked as such and masked, so each assistant text is a
target once.

Turns are never cut, so the budget bounds every window but those of one turn that, with the system turn, is more than
`BUDGET` by itself: those are marked as over it, for the trainer to leave out or to give room.

Every marker starts with ``<|``. In roles and texts a backslash goes in after the first character of each control
string (the markers and the usual ones of other templates), after whatever backslashes stand there already, and
comes out again on reading; so the escape is reversible and no text can look like a marker.

Nulls and edges: null text or role is empty; turns of equal number are ordered by role and text and repeated rows
stay; null conv_id is one conversation; a system turn that is not first is an ordinary turn; other columns are not
read. The rows of a conversation meet in one task, since its digest covers all of them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRIDE = 512
HISTORY = 128
BUDGET = 1024  # tokens of a window
START, NEW, LOSS, OLD, BODY, END = "<|window|>", "<|new|>", "<|loss|>", "<|old|>", "<|body|>", "<|end|>"
_HIDE = r"(<|\[)(\\*)(\||/?s>|/?INST\])"
_SHOW = r"(<|\[)\\(\\*)(\||/?s>|/?INST\])"
_TURN = r"(?s)<\|(?:new|loss)\|>(.*?)<\|body\|>(.*?)<\|end\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _HIDE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _SHOW, "$1$2$3")


def format_windows(
    conversations: DataFrame, stride: int = STRIDE, history: int = HISTORY, budget: int = BUDGET
) -> DataFrame:
    """conv_id and windows: in order, each with its string, its loss spans (start, length in code points), its tokens
    and whether these are over the budget."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    conv = conversations.select("conv_id", "turn", role, text)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    t = conv.withColumn("ord", F.row_number().over(order) - 1)
    lead = (F.col("ord") == 0) & (F.col("role") == "system")
    tokens = 4 + F.ceil((F.octet_length("role") + F.octet_length("text")) / 4)
    t = t.withColumn("lead", lead).withColumn("tokens", tokens.cast("long"))
    t = t.withColumn("cost", F.when(F.col("lead"), 0).otherwise(F.col("tokens")))
    by_ord = Window.partitionBy("conv_id").orderBy("ord")
    so_far = by_ord.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("before", F.sum("cost").over(so_far) - F.col("cost"))
    whole = Window.partitionBy("conv_id")
    t = t.withColumn("kept", F.coalesce(F.max(F.when(F.col("lead"), F.col("tokens"))).over(whole), F.lit(0)))
    # Half the room of the conversation's windows, a token at least.
    step = F.least(F.lit(stride), F.floor(F.greatest(budget - F.col("kept") - history, F.lit(2)) / 2))
    t = t.withColumn("at_step", F.floor(F.col("before") / step)).withColumn("long", ~F.col("lead") & (F.col("cost") > step))
    other = (F.lag("at_step").over(by_ord) != F.col("at_step")) | F.lag("lead").over(by_ord) | F.lag("long").over(by_ord)
    t = t.withColumn("opens", ~F.col("lead") & (F.col("long") | F.coalesce(other, F.lit(True))))
    t = t.withColumn("span", F.greatest(F.lit(1), F.sum(F.col("opens").cast("long")).over(so_far)))
    left = F.greatest(F.lit(0), F.least(F.lit(history), budget - F.col("kept") - F.col("cost")))
    t = t.withColumn("reach", F.when(F.col("long"), left).otherwise(F.lit(history)))
    said = F.concat(escape(F.col("role")), F.lit(BODY), escape(F.col("text")), F.lit(END))
    t = t.withColumn("system", F.first(F.when(F.col("lead"), F.struct(said.alias("piece"), "tokens"))).over(so_far))
    backwards = Window.partitionBy("conv_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("next", F.last(F.when(F.col("opens"), F.struct("before", "span", "reach")), ignorenulls=True).over(backwards))
    # `next` is the nearest span that opens after the turn.
    near = F.col("next.before") - F.col("before") <= F.col("next.reach")
    again = ~F.col("lead") & (F.col("next.span") != F.col("span")) & near
    body = F.concat(escape(F.col("role")), F.lit(BODY))
    shown = escape(F.col("text"))
    is_target = F.col("role") == "assistant"
    own = F.struct(
        "span",
        F.lit(1).alias("own"),
        "ord",
        F.concat(F.when(is_target, LOSS).otherwise(NEW), body, shown, F.lit(END)).alias("piece"),
        F.when(is_target, F.length(F.lit(LOSS)) + F.length(body)).alias("at"),
        F.length(shown).alias("len"),
        "tokens",
    )
    old = F.struct(
        F.col("next.span").alias("span"),
        F.lit(0).alias("own"),
        "ord",
        F.concat(F.lit(OLD), body, shown, F.lit(END)).alias("piece"),
        F.lit(None).cast("int").alias("at"),
        F.lit(0).alias("len"),
        "tokens",
    )
    rows = t.select("conv_id", "system", F.explode(F.when(again, F.array(own, old)).otherwise(F.array(own))).alias("x"))
    rows = rows.select("conv_id", "system", "x.*")
    spans = rows.groupBy("conv_id", "span").agg(
        F.first("system", ignorenulls=True).alias("system"),
        F.min(F.when(F.col("own") == 1, F.col("ord"))).alias("first"),
        F.array_sort(F.collect_list(F.struct("own", "ord", "piece", "at", "len", "tokens"))).alias("pieces"),
    )
    repeats = (F.col("first") > 0) & F.col("system").isNotNull() & (F.col("span") > 1)
    head = F.concat(F.lit(START), F.when(repeats, F.concat(F.lit(OLD), F.col("system.piece"))).otherwise(""))
    cost = F.aggregate("pieces", F.when(repeats, F.col("system.tokens")).otherwise(F.lit(0).cast("long")), _plus_tokens)
    spans = spans.withColumn("head", head).withColumn("tokens", cost)
    none = F.array().cast("array<struct<start:int,len:int>>")
    opening = F.struct(F.length("head").alias("to"), none.alias("loss"))
    spans = spans.select(
        "conv_id",
        "span",
        F.concat("head", F.array_join(F.transform("pieces", lambda p: p["piece"]), "")).alias("text"),
        F.aggregate("pieces", opening, _place, lambda a: a["loss"]).alias("loss"),
        "tokens",
        (F.col("tokens") > budget).alias("over"),
    )
    listed = F.array_sort(F.collect_list(F.struct("span", "text", "loss", "tokens", "over")))
    return spans.groupBy("conv_id").agg(listed.alias("windows"))


def _plus_tokens(a: Column, p: Column) -> Column:
    return a + p["tokens"]


def _place(a: Column, p: Column) -> Column:
    """One more piece of a window: where the next starts, and the loss spans so far."""
    target = F.struct((a["to"] + p["at"]).alias("start"), p["len"].alias("len"))
    loss = F.when(p["at"].isNotNull(), F.concat(a["loss"], F.array(target))).otherwise(a["loss"])
    return F.struct((a["to"] + F.length(p["piece"])).alias("to"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns (role, text) of each conversation and the text under its loss mask, from its windows alone."""
    found = lambda x, g: F.regexp_extract_all(x["text"], F.lit(_TURN), F.lit(g))
    turns = F.flatten(F.transform("windows", lambda x: F.zip_with(found(x, 1), found(x, 2), lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))))
    loss = F.array_join(F.flatten(F.transform("windows", lambda x: F.transform(x["loss"], lambda s: unescape(F.substring(x["text"], s["start"] + 1, s["len"]))))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.aggregate("windows", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"])).alias("formatted_chars"))


def op8_budgeted_windows(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2, numPartitions=1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    back = read_back(format_windows(conversations.unionByName(extra)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, t, CASE WHEN t = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(0, 2) AS r(t)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS ord FROM c),
l AS (SELECT *, ord = 0 AND role = 'system' AS lead FROM o),
k AS (SELECT *, CASE WHEN lead THEN 0 ELSE 4 + CAST(ceil((strlen(role) + strlen(text)) / 4.0) AS BIGINT) END AS cost FROM l),
b AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY conv_id ORDER BY ord) AS BIGINT) - cost AS before, max(CASE WHEN lead THEN 4 + CAST(ceil((strlen(role) + strlen(text)) / 4.0) AS BIGINT) ELSE 0 END) OVER (PARTITION BY conv_id) AS kept FROM k),
p AS (SELECT *, least({STRIDE}, greatest({BUDGET} - kept - {HISTORY}, 2) // 2) AS step FROM b),
r AS (SELECT *, before // step AS at_step, NOT lead AND cost > step AS long FROM p),
w AS (SELECT *, NOT lead AND (long OR coalesce(lag(at_step) OVER v <> at_step OR lag(lead) OVER v OR lag(long) OVER v, true)) AS opens FROM r WINDOW v AS (PARTITION BY conv_id ORDER BY ord)),
e AS (SELECT *, greatest(1, sum(CAST(opens AS INT)) OVER (PARTITION BY conv_id ORDER BY ord)) AS span, CASE WHEN long THEN greatest(0, least({HISTORY}, {BUDGET} - kept - cost)) ELSE {HISTORY} END AS reach,
  regexp_replace(role, '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS erole, regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS etext FROM w),
s AS (SELECT conv_id, span, min(ord) AS first, arg_min(before, ord) FILTER (NOT lead) AS start, arg_min(reach, ord) FILTER (NOT lead) AS reach, sum(length(erole) + length(etext) + CASE WHEN role = 'assistant' THEN {len(LOSS)} ELSE {len(NEW)} END + {len(BODY) + len(END)}) + {len(START)} AS own FROM e GROUP BY conv_id, span),
h AS (SELECT s.conv_id, s.span, sum(length(erole) + length(etext) + {len(OLD) + len(BODY) + len(END)}) AS old FROM s JOIN e ON e.conv_id = s.conv_id AND e.span = s.span - 1 AND s.start - e.before <= s.reach AND NOT e.lead GROUP BY s.conv_id, s.span),
y AS (SELECT s.conv_id, sum(length(erole) + length(etext) + {len(OLD) + len(BODY) + len(END)}) AS sys FROM s JOIN e ON e.conv_id = s.conv_id AND e.lead AND s.span > 1 GROUP BY s.conv_id),
f AS (SELECT conv_id, CAST(sum(own) + coalesce(sum(old), 0) AS BIGINT) AS n FROM s LEFT JOIN h USING (conv_id, span) GROUP BY conv_id),
t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY ord) FILTER (WHERE role = 'assistant'), '') AS loss FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n + coalesce(sys, 0) AS BIGINT) AS formatted_chars FROM t JOIN f USING (conv_id) LEFT JOIN y USING (conv_id)
"""
