"""Rules over notes: each takes a context of relations and returns findings (id, check, level, file, line).

Notes are parsed into fields, lines and links; a rule is projections and joins over these and never collects.
An unreadable field is always a `should`. Rules are registered by id, so that a restricted run builds only theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import paths as P

from . import notes as N
from .staging import spread, stage

RULES: dict[str, Callable[[Context], DataFrame]] = {}
STATUSES = ("draft", "stable", "deprecated")


@dataclass
class Context:
    """files (path, text) with the relations that rules read, and the settings."""

    files: DataFrame
    config: dict = field(default_factory=dict)

    def __post_init__(self):
        self.markdown = self.files.where(P.is_markdown(F.col("path")))
        self.notes = self.markdown.where(~P.is_reserved(F.col("path")))
        self.fields = N.fields(self.markdown)
        self.first = self.fields.where("occurrence = 1")

    def staged(self) -> Context:
        """The same with the parsed headers written once, for several rules that read them."""
        self.fields = stage(self.fields, "fields")
        self.first = self.fields.where("occurrence = 1")
        return self

    def lines(self) -> DataFrame:
        return self.markdown.select("path", F.posexplode(F.split("text", "\n")).alias("at", "raw")).select("path", (F.col("at") + 1).alias("line"), "raw")

    def piped_lines(self) -> DataFrame:
        """The lines with a pipe, each with the lines before and next to it."""
        piped = spread(self.markdown.where(F.contains("text", F.lit("|"))).select("path", "text"), "path").select("path", F.split("text", "\n").alias("all"))
        placed = F.transform("all", lambda raw, i: F.struct((i + 1).alias("line"), raw.alias("raw"), F.get("all", i - 1).alias("before"), F.get("all", i + 1).alias("next")))
        return piped.select("path", F.inline(F.filter(placed, lambda x: F.contains(x["raw"], F.lit("|")))))

    def of(self, key: str) -> DataFrame:
        """All notes with one field: its columns are null where the key is absent."""
        return self.notes.select("path").join(large(self.first.where(F.col("key") == key)), "path", "left")


def large(df: DataFrame) -> DataFrame:
    """A side of a join that may be as large as all notes: what their texts hold shows in no estimate from stored bytes,
    by which it would be broadcast."""
    return df.hint("merge")


def rule(name: str):
    def register(f):
        RULES[name] = f
        return f

    return register


def found(df: DataFrame, rule_id: str, check: Column | str, level: Column | str, line: Column | None = None) -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(F.lit(rule_id).alias("id"), as_col(check).alias("check"), as_col(level).alias("level"), F.col("path").alias("file"), (F.lit(None) if line is None else line).cast("int").alias("line")).where("check is not null")


def run(ctx: Context, only: list[str] | None = None) -> DataFrame:
    """The findings of the chosen rules, in order of file, line, id and check; headers are parsed once for all."""
    out = None
    if only is None or len(only) > 1:
        ctx = ctx.staged()
    for name, f in RULES.items():
        if only is None or name in only:
            out = f(ctx) if out is None else out.unionByName(f(ctx))
    return out.orderBy("file", F.coalesce("line", F.lit(-1)), "id", "check")


def _scalar(name: str = "scalar") -> Column:
    return F.when(F.col(f"{name}.state") == N.VALUE, F.col(f"{name}.v"))


def _unreadable(name: str) -> Column:
    return F.coalesce(F.col(f"{name}.state") == N.UNREADABLE, F.lit(False))


@rule("type-required")
def type_required(c: Context) -> DataFrame:
    check = F.when(F.col("key").isNull(), "type-present").when(_unreadable("scalar"), "shape-readable").when(F.trim("scalar.v") == "", "type-non-empty")
    return found(c.of("type"), "type-required", check, F.when(_unreadable("scalar"), "should").otherwise("must"), F.col("line"))


@rule("index-no-header")
def index_no_header(c: Context) -> DataFrame:
    index = c.fields.where(P.base_name(F.col("path")) == "index.md")
    deep = found(index.where(F.contains("path", F.lit("/"))).groupBy("path").agg(F.min("line").alias("line")), "index-no-header", "no-header-outside-root", "must", F.col("line"))
    root = index.where((F.col("path") == "index.md") & (F.col("key") != "okf_version")).groupBy("path").agg(F.min("line").alias("line"))
    return deep.unionByName(found(root, "index-no-header", "root-version-only", "should", F.col("line")))


@rule("log-format")
def log_format(c: Context) -> DataFrame:
    logs = c.lines().where((P.base_name(F.col("path")) == "log.md") & F.rlike("raw", F.lit(r"\A## ")))
    text = F.trim(F.substring("raw", F.lit(4), F.length("raw")))
    logs = logs.withColumn("text", text).withColumn("day", D.iso_day(F.col("text")))
    shape = F.rlike("text", F.lit(D.ISO_DAY))
    valid = logs.where("day is not null").withColumn("before", F.lag("day").over(Window.partitionBy("path").orderBy("line")))
    order = found(valid.where(F.col("day") > F.col("before")), "log-format", "ordering", "must", F.col("line"))
    bad = found(logs, "log-format", F.when(shape & F.col("day").isNull(), "heading-calendar").when(~shape & F.rlike("text", F.lit(r"\A[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}")), "heading-form").when(~shape, "heading-not-a-date"), F.when(shape | F.rlike("text", F.lit(r"\A[0-9]{1,4}[-/.]")), "must").otherwise("should"), F.col("line"))
    return order.unionByName(bad)


@rule("generated-actor")
def generated_actor(c: Context) -> DataFrame:
    g = c.of("generated").where("key is not null")
    by, at = F.col("map.v")["by"], F.col("map.v")["at"]
    actor = found(g, "generated-actor", F.when(_unreadable("map") | (F.coalesce(F.trim(by), F.lit("")) == ""), "actor-present"), F.when(_unreadable("map"), "should").otherwise("must"), F.col("line"))
    return actor.unionByName(found(g.where(at.isNotNull()), "generated-actor", F.when(~D.is_instant(at), "timestamp-form"), "should", F.col("line")))


@rule("verified-events")
def verified_events(c: Context) -> DataFrame:
    v = c.of("verified").where("key is not null")
    events = F.when(F.col("entries.state") == N.VALUE, F.col("entries.v")).when(F.col("map.state") == N.VALUE, F.array("map.v"))
    v = v.withColumn("events", events)
    none = found(v, "verified-events", F.when(F.coalesce(F.size("events"), F.lit(0)) < 1, "has-events"), "must", F.col("line"))
    e = v.select("path", "line", F.explode("events").alias("e"))
    at = F.col("e")["at"]
    actor = found(e, "verified-events", F.when(F.coalesce(F.trim(F.col("e")["by"]), F.lit("")) == "", "event-actor"), "must", F.col("line"))
    stamp = found(e, "verified-events", F.when(at.isNull(), "event-timestamp-present").when(~D.is_instant(at), "event-timestamp-form"), "should", F.col("line"))
    return none.unionByName(actor).unionByName(stamp)


@rule("status-enum")
def status_enum(c: Context) -> DataFrame:
    s = c.of("status").where("key is not null")
    return found(s, "status-enum", F.when(_unreadable("scalar") | ~F.coalesce(_scalar().isin(*STATUSES), F.lit(False)), "status-enum"), F.when(_unreadable("scalar"), "should").otherwise("must"), F.col("line"))


@rule("stale-after-format")
def stale_after_format(c: Context) -> DataFrame:
    s = c.of("stale_after").where("key is not null")
    return found(s, "stale-after-format", F.when(~F.coalesce(D.is_instant(_scalar()), F.lit(False)), "timestamp-form"), "should", F.col("line"))


@rule("sources-resource")
def sources_resource(c: Context) -> DataFrame:
    e = c.of("sources").where(F.col("entries.state") == N.VALUE).select("path", "line", F.explode("entries.v").alias("e"))
    missing = found(e, "sources-resource", F.when(F.coalesce(F.trim(F.col("e")["resource"]), F.lit("")) == "", "entry-resource"), "must", F.col("line"))
    at = F.col("e")["last_modified"]
    return missing.unionByName(found(e.where(at.isNotNull()), "sources-resource", F.when(~D.is_instant(at), "entry-timestamp-form"), "should", F.col("line")))


@rule("unique-keys")
def unique_keys(c: Context) -> DataFrame:
    twice = c.fields.groupBy("path", "key").agg(F.sort_array(F.collect_list("line")).alias("at")).where(F.size("at") > 1)
    return found(twice, "unique-keys", "top-level-key-once", "must", F.get("at", F.lit(1)))


@rule("required-fields")
def required_fields(c: Context) -> DataFrame:
    keys = c.config.get("required", [])
    wanted = c.notes.select("path", F.explode(F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")).alias("key"))
    j = wanted.join(large(c.first.select("path", "key", "line", "scalar", "map", "list", "entries").where(F.col("key").isin(keys))), ["path", "key"], "left")
    blank = lambda n: F.coalesce(F.col(f"{n}.state") == N.VALUE, F.lit(False))
    filled = (blank("scalar") & (F.trim("scalar.v") != "")) | (blank("map") & (F.size("map.v") > 0)) | (blank("list") & (F.size("list.v") > 0)) | (blank("entries") & (F.size("entries.v") > 0))
    any_read = blank("scalar") | blank("map") | blank("list") | blank("entries")
    return found(j, "required-fields", F.when(F.col("line").isNull(), "field-present").when(~any_read, "shape-readable").when(~filled, "field-non-empty"), F.when(F.col("line").isNotNull() & ~any_read, "should").otherwise("house"), F.col("line"))


@rule("forbidden-fields")
def forbidden_fields(c: Context) -> DataFrame:
    return found(c.first.where(F.col("key").isin(c.config.get("forbidden", []))), "forbidden-fields", "field-absent", "house", F.col("line"))


@rule("type-enum")
def type_enum(c: Context) -> DataFrame:
    allowed = c.config.get("types")
    t = c.of("type").where(_scalar().isNotNull())
    return found(t, "type-enum", F.when(F.lit(allowed is not None) & ~_scalar().isin(*(allowed or [""])), "type-listed"), "house", F.col("line"))


def kind_ok(value: Column, kind: str, options: list[str] | None = None) -> Column:
    if kind == "boolean":
        return value.isin("true", "false")
    if kind == "number":
        return F.rlike(value, F.lit(r"\A-?\d+(\.\d+)?\z"))
    if kind == "date":
        return D.iso_day(value).isNotNull()
    if kind == "enum":
        return value.isin(*(options or [""]))
    return F.lit(True)


@rule("extension-fields")
def extension_fields(c: Context) -> DataFrame:
    specs = c.config.get("extensions", {})
    if not specs:
        return found(c.first.where("false"), "extension-fields", "none", "house")
    check = F.when(_unreadable("scalar"), "shape-readable")
    for key, spec in specs.items():
        check = check.when((F.col("key") == key) & ~kind_ok(_scalar(), spec["kind"], spec.get("options")), F.lit(f"{spec['kind']}-value"))
    held = c.first.where(F.col("key").isin(list(specs)))
    return found(held, "extension-fields", check, F.when(_unreadable("scalar"), "should").otherwise("house"), F.col("line"))


def resolved_links(c: Context, only: Column | None = None) -> DataFrame:
    """path, line, raw, dst (null: outside) of internal links of all notes or those chosen, wikilinks left out."""
    ln = N.links(c.markdown if only is None else c.markdown.where(only)).where(~P.is_external(F.col("raw")) & ~F.startswith("raw", F.lit("#")))
    return ln.withColumn("dst", P.resolve(F.col("path"), P.path_part(F.col("raw"))))


@rule("link-style")
def link_style(c: Context) -> DataFrame:
    style = c.config.get("link_style", "any")
    rooted = F.startswith("raw", F.lit("/"))
    wrong = rooted if style == "file-relative" else ~rooted if style == "bundle-absolute" else F.lit(False)
    return found(resolved_links(c), "link-style", F.when(wrong, "link-style"), "house", F.col("line"))


def target_states(c: Context) -> DataFrame:
    """Links with the state of their target: in-walk, directory, absent or outside."""
    files = c.files.select(F.col("path").alias("dst"), F.lit(True).alias("is_file")).distinct()
    folders = c.files.select(F.explode(P.ancestors(F.col("path"))).alias("dst")).distinct().withColumn("is_dir", F.lit(True))
    j = resolved_links(c).join(large(files), "dst", "left").join(large(folders), "dst", "left")
    return j.withColumn("state", F.when(F.col("dst").isNull(), "outside").when(F.col("is_file") | (F.col("dst") == ""), "in-walk").when(F.col("is_dir"), "directory").otherwise("absent"))


@rule("link-target-exists")
def link_target_exists(c: Context) -> DataFrame:
    return found(target_states(c), "link-target-exists", F.when(F.col("state").isin("absent", "outside"), "target-exists"), "house", F.col("line"))


@rule("no-wikilinks")
def no_wikilinks(c: Context) -> DataFrame:
    bare = spread(c.markdown.select("path", "text"), "path").select("path", F.posexplode(F.split(N.code_stripped("text"), "\n")).alias("at", "raw"))
    return found(bare.where(F.size(N.wikilinks(F.col("raw"))) > 0), "no-wikilinks", "no-wikilinks", "house", F.col("at") + 1)


@rule("root-version")
def root_version(c: Context) -> DataFrame:
    root = c.markdown.where("path = 'index.md'").select("path").join(c.first.where("key = 'okf_version'"), "path", "left")
    return found(root, "root-version", F.when(F.col("key").isNull(), "version-present").when(~F.coalesce(_scalar() == c.config.get("version", "1"), F.lit(False)), "version-equal"), "house", F.col("line"))


@rule("index-completeness")
def index_completeness(c: Context) -> DataFrame:
    folders = c.notes.select(F.explode(P.ancestors(F.col("path"))).alias("folder")).distinct()
    missing = folders.withColumn("path", F.concat("folder", F.lit("/index.md"))).join(large(c.files.select("path")), "path", "left_anti")
    first = c.notes.select(F.explode(P.ancestors(F.col("path"))).alias("folder")).where(~F.contains("folder", F.lit("/"))).distinct()
    # The root's index alone is parsed for links; its path tells it before the text is read.
    linked = resolved_links(c, F.col("path") == "index.md").select(F.regexp_replace("dst", r"/index\.md\z", "").alias("folder")).distinct()
    unlinked = first.join(linked, "folder", "left_anti").withColumn("path", F.lit("index.md"))
    return found(missing, "index-completeness", "folder-index", "warn").unionByName(found(unlinked, "index-completeness", "root-links-folder", "warn"))


def tolerated(findings: DataFrame, c: Context, keys: list[str]) -> DataFrame:
    """Timestamp findings on fields whose value is a plain day, told as tolerated instead of at their level."""
    days = c.first.where(F.col("key").isin(keys) & D.iso_day(_scalar()).isNotNull())
    days = days.select(F.col("path").alias("file"), "line", F.lit(True).alias("day")).distinct()
    held = findings.join(days, ["file", "line"], "left")
    plain = F.coalesce("day", F.lit(False)) & F.col("check").isin("timestamp-form", "event-timestamp-form", "entry-timestamp-form")
    return held.withColumn("level", F.when(plain, "tolerated").otherwise(F.col("level"))).drop("day")


@rule("columns")
def columns(c: Context) -> DataFrame:
    """The first difference between a configured heading list and the first table's header."""
    wanted = c.config.get("columns", {})
    heads = N.table_rows(c.piped_lines(), "path").where("kind = 'header'")
    first = heads.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where("r = 1")
    out = None
    for path, names in wanted.items():
        expected = F.array(*map(F.lit, names))
        pairs = F.zip_with("cells", expected, lambda a, b: ~a.eqNullSafe(b))  # the shorter side is filled with nulls
        one = found(first.where((F.col("path") == path) & F.exists(pairs, lambda x: x)), "columns", F.concat(F.lit("column-"), F.array_position(pairs, True).cast("string")), "warn", F.col("line"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else found(first.where("false"), "columns", "none", "warn")


@rule("tables")
def tables(c: Context) -> DataFrame:
    """Tables without a blank line before them, rows told twice, cells past the limit, from one reading of the rows."""
    rows = N.table_rows(c.piped_lines(), "path")
    most = c.config.get("max_cell", 200)
    head = F.col("kind") == "header"
    rows = rows.withColumn("width", F.max(F.when(head, F.size("cells"))).over(Window.partitionBy("path", "table")))
    rows = rows.withColumn("first", F.min(F.when(~head, F.col("line"))).over(Window.partitionBy("path", "table", F.to_json("cells"))))
    blank = F.when(head & (F.trim(F.coalesce("before", F.lit(""))) != ""), "blank-line-before")
    again = F.when(~head & (F.col("line") > F.col("first")), "duplicate-row")
    long = F.when(~head & (F.size("cells") == F.col("width")) & F.exists("cells", lambda x: F.length(x) > most), "long-cell")
    told = rows.select("path", "line", F.explode(F.array_compact(F.array(blank, again, long))).alias("told"))
    return found(told, "tables", F.col("told"), "warn", F.col("line"))


@rule("confidential")
def confidential(c: Context) -> DataFrame:
    """Links from outside into a confidential folder; its own index is the door that stays open."""
    folders = c.config.get("confidential", [])
    if not folders:
        return found(c.notes.where("false"), "confidential", "none", "error")
    ln = resolved_links(c).where("dst is not null")
    inside = lambda x: F.exists(F.array(*map(F.lit, folders)), lambda d: P.is_under(x, d))
    door = F.col("dst").isin([f"{d}/index.md" for d in folders] + folders)
    return found(ln.where(inside(F.col("dst")) & ~inside(F.col("path")) & ~door), "confidential", "link-into-confidential", "error", F.col("line"))


@rule("attribution")
def attribution(c: Context) -> DataFrame:
    """Where a note has two sources or more: each has an id, each footnote names one, each is named."""
    s = c.of("sources").where((F.col("entries.state") == N.VALUE) & (F.size("entries.v") >= 2)).select("path", "line", F.posexplode("entries.v").alias("at", "e")).select("path", "line", F.col("e")["id"].alias("source"))
    s = stage(s, "sources")  # read four times below, parsed once
    noid = found(s, "attribution", F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "source-id"), "warn", F.col("line"))
    notes = c.notes.join(large(s.select("path").distinct()), "path").select("path", F.explode(N.footnotes(F.col("text"))).alias("source")).distinct()
    named = s.where("source is not null").select("path", "source", "line").distinct()
    unknown = found(notes.join(large(named), ["path", "source"], "left_anti"), "attribution", "footnote-known", "warn")
    unused = found(named.join(large(notes), ["path", "source"], "left_anti"), "attribution", "source-referenced", "warn", F.col("line"))
    return noid.unionByName(unknown).unionByName(unused)
