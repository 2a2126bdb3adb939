"""Gates: person text, schemas as columns, forbidden keys, diffs, objects and channels of a push, listings read to the end."""

from __future__ import annotations

import json
import math
import re
import time

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan as S
from .staging import spread

#: Tags of blocks that the harness writes into a message, tags around what a person typed, and beginnings
#: of messages that no person wrote.
HARNESS_TAGS = (
    "system-reminder", "task-notification", "command-message", "command-stdout", "command-stderr",
    "local-command-stdout", "local-command-stderr", "local-command-caveat", "bash-stdout", "bash-stderr", "bash-exit-code",
    "user-prompt-submit-hook", "agent-message", "fetched-web-content", "coordinator-relay", "function_results", "fork-boilerplate",
    "teammate-message", "cross-session-message", "slack-tag-message", "forked-skill-launch", "message-files-missing",
    "ide_opened_file", "ide_selection",
)
PERSON_TAGS = ("command-name", "command-args", "bash-input")
HARNESS_PREAMBLES = ("[SYSTEM NOTIFICATION - NOT USER INPUT]", "Stop hook feedback:")
_BLANK = r"[\s\p{Cc}\p{Cf}]"


def _block(tags: tuple[str, ...]) -> str:
    return rf"(?s)<({'|'.join(tags)})(?:\s[^>]*)?>(.*?)</\1(?:\s[^>]*)?>"


def person_text(text: Column) -> Column:
    """What a person wrote: blocks of the harness out, the person's own tags off, empty if the harness speaks."""
    rest = F.regexp_replace(F.regexp_replace(text, _block(HARNESS_TAGS), " "), _block(PERSON_TAGS), " $2 ")
    head = F.regexp_replace(rest, rf"\A{_BLANK}+", "")
    speaks = F.lit(False)
    for x in HARNESS_PREAMBLES:
        speaks = speaks | F.startswith(head, F.lit(x))
    return F.when((head == "") | speaks, "").otherwise(F.trim(F.regexp_replace(rest, r"[\s\p{Cc}]+", " ")))


_KINDS = {"object": "OBJECT<", "array": "ARRAY<", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}


def _is_kind(v: Column, kind: str) -> Column:
    told = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    if kind in ("number", "integer"):
        value = F.try_variant_get(v, "$", "double")
        return _is_number(v) & ((value % 1 == 0) if kind == "integer" else (F.abs(value) < math.inf))
    if kind in ("object", "array"):
        return F.startswith(told, F.lit(_KINDS[kind]))
    return told == _KINDS[kind]


def _is_number(v: Column) -> Column:
    """Also one too large to be finite, which is of no type of a schema."""
    told = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    return told.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(told, F.lit("DECIMAL"))


def _described(v: Column) -> Column:
    told = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    out = F.lit("number")
    for kind, start in _KINDS.items():
        out = F.when(F.startswith(told, F.lit(start)), kind).otherwise(out)
    return out


def _members(v: Column) -> Column:
    """An object's keys and values; null for all else. A path could not name a key with a dot."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is_value(v: Column, value) -> Column:
    """Whether a variant is this JSON value, kind and all; the order of an object's keys, which no variant keeps, is not
    compared."""
    if isinstance(value, dict):
        held = _members(v)
        same = F.size(held) == len(value)
        for key, x in value.items():
            same = same & F.array_contains(F.map_keys(held), key) & _is_value(F.try_element_at(held, F.lit(key)), x)
    elif isinstance(value, list):
        held = F.when(_is_kind(v, "array"), F.try_variant_get(v, "$", "array<variant>"))
        same = F.size(held) == len(value)
        for i, x in enumerate(value):
            same = same & _is_value(F.get(held, F.lit(i)), x)
    elif value is None:
        same = _is_kind(v, "null")
    elif isinstance(value, bool):
        same = _is_kind(v, "boolean") & (F.try_variant_get(v, "$", "boolean") == value)
    elif isinstance(value, str):
        same = _is_kind(v, "string") & (F.try_variant_get(v, "$", "string") == value)
    else:
        same = _is_number(v) & (F.try_variant_get(v, "$", "double") == float(value))
    return F.coalesce(same, F.lit(False))


_SPACE = r"\x09-\x0d\x20\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_NO_SPACE = r"\x00-\x08\x0e-\x1f\x21-\x9f\xa1-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\ufefe\uff00-\x{10ffff}"


def _for_java(pattern: str) -> str:
    r"""A schema's pattern, which is JavaScript's, for Java: `$` is the very end, `.`, `\s` and `\S` have JavaScript's
    characters, and brackets and ampersands in a class are plain."""
    within = {r"\s": _SPACE, r"\S": _NO_SPACE, "[": r"\[", "&": r"\&"}
    alone = {r"\s": f"[{_SPACE}]", r"\S": f"[{_NO_SPACE}]", ".": r"[^\n\r\u2028\u2029]", "$": r"\z", "[]": "(?!)", "[^]": r"[\s\S]"}

    def one(m: re.Match) -> str:
        t = m[0]
        if t in alone or len(t) < 3:
            return alone.get(t, t)
        head = t[: 1 + (t[1] == "^")]
        return head + re.sub(r"\\[\s\S]|[\[&]", lambda x: within.get(x[0], x[0]), t[len(head) :])

    return re.sub(r"\\[\s\S]|\[\^?(?:\\[\s\S]|[^\]\\])*\]|[\s\S]", one, pattern)


def _told(value) -> str:
    """A value of a schema as JavaScript writes it."""
    return json.dumps(int(value) if isinstance(value, float) and value.is_integer() else value, ensure_ascii=False, separators=(",", ":"))


def schema_problems(v: Column, schema: dict, path: Column | str = "$") -> Column:
    """What is wrong with a variant under a schema, as `path: message` strings; the schema becomes one expression.

    Known: type, enum and const of any values, minimum, exclusiveMinimum, maximum, minLength (in UTF-16 units), pattern
    (JavaScript's), items, required, properties, additionalProperties (false or a schema). An object's keys are gone
    through once: a named one goes to its own schema, any other to additionalProperties.
    """
    path = F.lit(path) if isinstance(path, str) else path
    none = F.array().cast("array<string>")
    found: list[Column] = []

    def add(bad: Column, message: str):
        found.append(F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(path, F.lit(f": {message}")))).otherwise(none))

    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    is_text = _is_kind(v, "string")
    if "enum" in schema:
        known = F.lit(False)
        for x in schema["enum"]:
            known = known | _is_value(v, x)
        add(~known, "must be one of the choices")
    if "const" in schema:
        add(~_is_value(v, schema["const"]), f"must equal {_told(schema['const'])}")
    for key, sign, bad in (
        ("minimum", ">=", lambda x: number < x), ("exclusiveMinimum", ">", lambda x: number <= x), ("maximum", "<=", lambda x: number > x),
    ):
        if key in schema:
            add(_is_number(v) & bad(F.lit(schema[key])), f"must be {sign} {_told(schema[key])}")
    if "minLength" in schema:
        units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
        add(is_text & (units < schema["minLength"]), f"must have at least {schema['minLength']} characters")
    if schema.get("pattern"):
        add(is_text & ~F.rlike(text, F.lit(_for_java(schema["pattern"]))), f"does not match /{schema['pattern']}/")
    if "items" in schema:
        items = F.when(_is_kind(v, "array"), F.try_variant_get(v, "$", "array<variant>"))

        def one(item: Column, i: Column) -> Column:
            at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            return schema_problems(item, schema["items"], at)

        found.append(F.coalesce(F.flatten(F.transform(items, one)), none))
    members = _members(v)
    if schema.get("required"):
        lacks = F.array_except(F.array(*map(F.lit, schema["required"])), F.map_keys(members))
        told = F.transform(lacks, lambda k: F.concat(path, F.lit("."), k, F.lit(": required")))
        found.append(F.coalesce(told, none))
    named, other = schema.get("properties", {}), schema.get("additionalProperties")
    if named or other is False or isinstance(other, dict):

        def of_key(e: Column) -> Column:
            at = F.concat(path, F.lit("."), e["key"])
            rest = none
            if other is False:
                rest = F.array(F.concat(at, F.lit(": unknown key")))
            elif isinstance(other, dict):
                rest = schema_problems(e["value"], other, at)
            cases = F.when(F.lit(False), none)
            for key, sub in named.items():
                cases = cases.when(e["key"] == key, schema_problems(e["value"], sub, at))
            return cases.otherwise(rest)

        found.append(F.coalesce(F.flatten(F.transform(F.map_entries(members), of_key)), none))
    within = F.concat(*found) if found else none
    if not kinds:
        return within
    right = F.lit(False)
    for kind in kinds:
        right = right | F.coalesce(_is_kind(v, kind), F.lit(False))
    wrong = F.concat(path, F.lit(f": expected {' or '.join(kinds)}, got "), _described(v))
    return F.when(right, within).otherwise(F.array(wrong))


def forbidden_keys(df: DataFrame, key: str, json: str, forbidden: list[str], stage) -> DataFrame:
    """key, path, name of each forbidden key at any depth of a JSON text: a level a round until none is left."""
    level = df.select(key, F.lit("$").alias("path"), F.col(json).alias("at"))
    out = None
    while True:
        is_object = F.startswith(F.ltrim("at"), F.lit("{"))
        members = F.when(is_object, F.map_entries(F.from_json("at", "map<string,string>")))
        items = F.when(F.startswith(F.ltrim("at"), F.lit("[")), F.from_json("at", "array<string>"))
        named = F.transform(members, lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("step"), e["key"].alias("name"), e["value"].alias("at")))
        placed = F.transform(items, lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("step"), F.lit(None).cast("string").alias("name"), x.alias("at")))
        below = level.select(key, "path", F.inline(F.coalesce(named, placed)))
        below = stage(below.select(key, F.concat("path", "step").alias("path"), "name", "at"), "level")
        found = below.where(F.col("name").isin(forbidden)).select(key, "path", "name")
        out = found if out is None else out.unionByName(found)
        level = below.where(F.rlike("at", F.lit(r"\A\s*[\[{]"))).select(key, "path", "at")
        if level.isEmpty():
            return out


def added_lines(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """key, file, line, raw of the added lines of unified diffs, numbered as in the new file."""
    lines = diffs.select(key, F.posexplode(F.split(diff, "\n")).alias("at", "raw"))
    along = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    start = F.regexp_extract("raw", r"\A@@ -\d+(?:,\d+)? \+(\d+)", 1)
    lines = lines.withColumn("hunk", F.last(F.when(start != "", F.struct("at", start.cast("int").alias("n"))), True).over(along))
    is_head = F.rlike("raw", F.lit(r"\A(?:diff --git |--- |\+\+\+ |index )"))
    opened = F.last(F.when(F.startswith("raw", F.lit("diff --git ")), F.col("at")), True).over(along)
    lines = lines.withColumn("inside", F.coalesce(F.col("hunk.at") > F.coalesce(opened, F.lit(-1)), F.lit(False)))
    name = F.when(~F.col("inside") & F.startswith("raw", F.lit("+++ b/")), F.substring("raw", F.lit(7), F.length("raw")))
    lines = lines.withColumn("file", F.last(name, True).over(along)).where("inside and at > hunk.at")
    new = F.substring("raw", 1, 1).isin("+", " ") & (F.col("inside") | ~is_head)
    within = Window.partitionBy(key, "hunk.at").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("line", F.col("hunk.n") + F.count_if(new).over(within).cast("int") - 1)
    told = F.substring("raw", F.lit(2), F.length("raw"))
    return lines.where(F.startswith("raw", F.lit("+"))).select(key, "file", "line", told.alias("raw"))


def commit_parts(objects: DataFrame, key: str, body: str) -> DataFrame:
    """key, author, committer, message and residue: the header without the identities that have channels of their own."""
    cut = F.instr(body, "\n\n")
    head = F.when(cut > 0, F.substring(body, F.lit(1), cut - 1)).otherwise(F.col(body))
    message = F.when(cut > 0, F.substring(body, cut + 2, F.length(body))).otherwise("")

    def identity(name: str) -> Column:
        return F.regexp_extract(head, rf"(?m)^{name} (.*>|.*)(?![\s\S]*^{name} )", 1)

    residue = F.regexp_replace(head, r"(?m)^(author|committer) .*>", "$1 ")
    return objects.select(
        key, identity("author").alias("author"), identity("committer").alias("committer"), message.alias("message"), residue.alias("residue")
    )


def push_channels(refs: DataFrame, commits: DataFrame, blobs: DataFrame, own: list[str]) -> DataFrame:
    """channel, object, text of all that a push makes public: names, identities but one's own, messages, headers, files."""
    parts = commit_parts(commits, "object", "body")
    rows = refs.select(F.lit("ref").alias("channel"), F.col("ref").alias("object"), F.col("ref").alias("text"))
    for name in ("author", "committer", "message", "residue"):
        one = parts.select(F.lit(name).alias("channel"), "object", F.col(name).alias("text")).where("text <> ''")
        rows = rows.unionByName(one.where(~F.col("text").isin(own)) if name in ("author", "committer") and own else one)
    rows = rows.unionByName(blobs.select(F.lit("path").alias("channel"), "object", F.col("path").alias("text")).distinct())
    return rows.unionByName(blobs.select(F.lit("content").alias("channel"), "object", F.col("content").alias("text")))


def channel_findings(channels: DataFrame, patterns) -> DataFrame:
    """channel, object, line, pattern, origin of every match in the channels, each text scanned once."""
    held = channels.where(S.may_match(F.col("text"), patterns)).withColumn("key", F.struct("channel", "object"))
    found = S.matches(S.lines(held, "key"), "key", patterns)
    return found.select("key.channel", "key.object", "line", "pattern", "origin")


#: Fixed values, in seconds: a call on one line, a text, and what a text's budget grows by for each line, each line and
#: pattern, and each character and pattern.
PER_LINE, PER_TEXT, EACH_LINE, EACH_LINE_PATTERN, EACH_CHAR_PATTERN = 2.0, 20.0, 1e-3, 4e-5, 1e-9


def severity(setting: Column, own: Column) -> Column:
    """A rule's severity from its setting (a variant): a word or an object's; what is no severity falls to the rule's
    own, then to warn."""
    word = F.when(F.schema_of_variant(setting) == "STRING", F.try_variant_get(setting, "$", "string"))
    valid = lambda c: F.when(c.isin("off", "warn", "error"), c)
    return F.coalesce(valid(F.coalesce(word, F.try_variant_get(setting, "$.severity", "string"))), valid(own), F.lit("warn"))


_TOKEN = re.compile(r"\\[\s\S]|\[\^?\]?(?:\\[\s\S]|[^\]\\])*\]|\{\d+(?:,\d*)?\}[?+]?|[*+?][?+]?|\((?:\?:)?|[\s\S]")
MOST_PATHS, MOST_REPEATS = 64, 1000


def is_linear(pattern: str) -> bool:
    """Whether a pattern provably takes time in proportion to a text, so that it needs no budget.

    Proved by its parts: repetition stands on single characters or classes only and is bounded, but for one that ends
    the pattern; a group is at most optional; no look-around, back reference or flag. Then from each start there are
    at most `MOST_PATHS` ways to go on, each of bounded length before the end that can no longer fail. False says only
    that this proof fails.
    """
    tokens, paths, depth, atom = _TOKEN.findall(pattern), 1, 0, None
    for i, t in enumerate(tokens):
        if t in ("(", "(?:"):
            if tokens[i + 1 : i + 2] == ["?"] and t == "(":
                return False
            depth, atom = depth + 1, None
        elif t == ")":
            depth, atom = depth - 1, "group"
        elif t == "|":
            paths, atom = paths + paths, None
        elif t[0] in "*+?" or (t[0] == "{" and len(t) > 1):
            low, high = (0, 1) if t[0] == "?" else (int(t[0] == "+"), None)
            if t[0] == "{":
                low, _, top = t[1 : t.index("}")].partition(",")
                high = int(top) if top else (None if "," in t else int(low))
            if atom is None or (atom == "group" and high != 1):
                return False
            if high is None:
                return i == len(tokens) - 1 and not depth and "|" not in tokens and paths <= MOST_PATHS
            if high > MOST_REPEATS:
                return False
            paths, atom = paths * (high - int(low) + 1), None
        else:
            if t[0] == "\\" and (t[1].isdigit() or t[1] in "gkGKX"):
                return False
            atom = "one"
    return depth == 0 and paths <= MOST_PATHS


def accrued(n_lines: int, n_chars: int, n_patterns: int) -> float:
    """Seconds that a text's size adds to its budget."""
    return n_lines * (EACH_LINE + EACH_LINE_PATTERN * n_patterns) + n_chars * n_patterns * EACH_CHAR_PATTERN


def budgeted(texts: DataFrame, key: str, patterns, per_line: float = PER_LINE, per_text: float = PER_TEXT) -> DataFrame:
    """key, line, pattern, origin, problem: matches under a time budget for each call and each text.

    A text's budget grows with its lines, characters and patterns; a line's patterns share the budget of one call. A
    pattern that runs out of either gives a row with problem `timeout`, as do the patterns and lines after it that have
    none left: what was not scanned is never told as clean. Patterns that are proved to be linear cannot run out: they
    are matched in the JVM, and only the others need a matcher that can be stopped.
    """
    kind = texts.schema[key].dataType
    linear = [p for p in patterns if is_linear(p[0])]
    patterns = [p for p in patterns if p not in linear]
    plain = S.matches(S.lines(texts, key), key, linear).where("match <> ''") if linear else None
    if plain is not None:
        plain = plain.select(key, F.col("line").cast("int").alias("line"), "pattern", "origin", F.lit(None).cast("string").alias("problem"))
    if not patterns and plain is not None:
        return plain

    def run(batches):
        compiled = [(regex.compile(p, regex.I), p, origin) for p, origin in patterns]
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = regex.split("\r\n|\r|\n", (text or "").replace("\0", ""))
                ends = time.monotonic() + per_text + accrued(len(lines), len(text or ""), len(compiled))
                for n, raw in enumerate(lines, 1):
                    stop = min(ends, time.monotonic() + per_line)
                    for c, p, origin in compiled:
                        try:
                            left = stop - time.monotonic()
                            if left <= 0:
                                raise TimeoutError
                            out += [(k, n, p, origin, None) for m in c.finditer(raw, timeout=left) if m.end() > m.start()]
                        except TimeoutError:
                            out.append((k, n, p, origin, "timeout"))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "line", "pattern", "origin", "problem"])

    schema = f"{key} {kind.simpleString()}, line int, pattern string, origin string, problem string"
    slow = texts.select(key, "text").mapInArrow(run, schema)
    return slow if plain is None else plain.unionByName(slow)


def read_to_end(calls: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pages, items: the first listing of each key read to its last page; pages is null where there is none.

    Calls (seq, token, asked, ok, more, items): a listing opens without a token; the next call with one continues it if
    it asks the same; one that failed is taken over only by a retry of its very token. Items are unknown if any page's are.
    """

    def first(rows: list[dict]):
        """Read from the end: from each page, how many pages there are to the last and their items."""
        rows = sorted(rows, key=lambda r: (r["seq"] is None, r["seq"]))
        n = len(rows)
        ends, taken, later, best = [None] * n, [None] * n, None, (None, None)
        for i in range(n - 1, -1, -1):
            r = rows[i]
            same = later is not None and rows[later]["asked"] == r["asked"]
            if r["ok"] and not r["more"]:
                ends[i] = (1, r["items"])
            elif r["ok"] and same and taken[later] is not None:
                pages, items = ends[taken[later]] or (None, None)
                ends[i] = pages and (pages + 1, None if items is None or r["items"] is None else items + r["items"])
            if not r["token"]:
                best = ends[i] if r["ok"] and ends[i] else best
                continue
            taken[i] = i if r["ok"] else taken[later] if same and rows[later]["token"] == r["token"] else None
            later = i
        return best

    def run(batches):
        for batch in batches:
            told = [first(rows) for rows in batch.column(len(keys)).to_pylist()]
            arrays = [*batch.columns[: len(keys)], pa.array([x[0] for x in told], pa.int64()), pa.array([x[1] for x in told], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "pages", "items"])

    kinds = [f"{k} {calls.schema[k].dataType.simpleString()}" for k in keys]
    listed = spread(calls, *keys).groupBy(*keys).agg(F.collect_list(F.struct("seq", "token", "asked", "ok", "more", "items")))
    return listed.mapInArrow(run, ", ".join([*kinds, "pages long", "items long"]))


def mark_change(action: Column, day: Column, mark: Column, today: Column) -> Column:
    """A mark after a manual action: cover a day that is over, or reopen one; refused actions leave it as it is."""
    over = day < today
    return (
        F.when((action == "assume") & over & (mark.isNull() | (day > mark)), day)
        .when((action == "reopen") & over & (day <= mark), F.date_add(day, -1))
        .otherwise(mark)
    )


def mark_refusal(action: Column, day: Column, mark: Column, today: Column) -> Column:
    return (
        F.when(action == "show", None)
        .when(~action.isin("assume", "reopen"), "unknown_action")
        .when(day.isNull(), "no_day")
        .when(day >= today, "day_not_over")
        .when((action == "assume") & F.coalesce(day <= mark, F.lit(False)), "covered")
        .when((action == "reopen") & (mark.isNull() | (day > mark)), "not_covered")
    )


def stop_decision(paths: DataFrame, session: str) -> DataFrame:
    """session, action, n of each session's changed paths (before, proposed, asked, vault): block once for a new change."""
    since = F.col("vault") & ~F.col("before")
    open_ = since & ~F.col("proposed")
    per = paths.groupBy(session).agg(
        F.count_if(open_).alias("open"), F.count_if(open_ & ~F.col("asked")).alias("fresh"), F.count_if(since & F.col("proposed")).alias("proposed")
    )
    action = F.when(F.col("fresh") > 0, "block").when(F.col("open") > 0, "reminded").when(F.col("proposed") > 0, "proposed").otherwise("clean")
    return per.select(session, action.alias("action"), F.when(F.col("fresh") > 0, F.col("open")).otherwise(0).alias("n"))


def mirrored(rule: Column, reach: Column, own: Column) -> Column:
    """What becomes of an allowed rule in a round: deny, widened read, or why it blocks; null where the round has it itself.

    Reach is how the rule's paths lie to the vault: none (no path), inside, covers, climbs, reads (meets what the round
    may read) or apart.
    """
    tool = F.regexp_extract(rule, r"\A([A-Za-z_]+)(?:\((?s:.*)\))?\z", 1)
    spec = F.regexp_extract(rule, r"\A[A-Za-z_]+\(((?s:.*))\)\z", 1)
    read, write = tool.isin("Read", "Grep", "Glob"), tool.isin("Edit", "Write", "NotebookEdit")
    return (
        F.when(own, None)
        .when(tool == "", "unreadable")
        .when(read & (reach == "inside"), None)
        .when(read & reach.isin("none", "climbs", "covers", "reads"), "widened")
        .when(write & (reach == "climbs"), "unreadable")
        .when(write & reach.isin("none", "covers"), "covers_vault")
        .when(write & (reach == "inside"), None)
        .when((tool == "Bash") & ((spec == "") | (spec == "*")), "covers_kit")
        .otherwise("deny")
    )
