"""Queries of header shapes, table cells and rules that need a vault of their own.

The vaults are written from parts, orders and suppliers: what each note holds follows from its columns, in shapes that
headers have in the wild (quotes, comments, block scalars, flow and block lists, CRLF, a byte order mark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import adopt as A
from tidemark.operators import notes as N
from tidemark.operators import rules as R

from .tables import query


def _pick(k: Column, *choices: str) -> Column:
    """One of the choices by the remainder of k."""
    return F.element_at(F.array(*map(F.lit, choices)), (k % len(choices) + 1).cast("int"))


def _values(*rows: str) -> str:
    """SQL rows (remainder, value) for a join on the remainder."""
    return "(VALUES " + ", ".join(f"({i}, {v})" for i, v in enumerate(rows)) + ") AS v(r, value)"


def _quoted(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"


#: what stands after the key, and its reading: a state and a value
SCALARS = (
    ("status: plain", "value", "plain"),
    ("status: 'single # kept'", "value", "single # kept"),
    ('"status": "double: kept" # comment', "value", "double: kept"),
    ("status: bare # comment", "value", "bare"),
    ("status: |\n  block", "unreadable", None),
    ("status: >\n  folded", "unreadable", None),
    ("status:\n  - item", "unreadable", None),
    ("status: # only a comment", "value", ""),
    ("status: a#b", "value", "a#b"),
    ("statuses: other", None, None),
)
MAPPINGS = (
    ("generated: {by: me, at: now}", "value", "at=now,by=me"),
    ("generated:\n  by: me\n  at: 'then'", "value", "at=then,by=me"),
    ("generated: {by: {x: y}}", "unreadable", None),
    ("generated:\n  by: me\n    deep: x", "unreadable", None),
    ("generated:", "value", ""),
    ("generated: plain", "unreadable", None),
    ("generated: {by: \"a, b\"}", "value", "by=a, b"),
)
LISTS = (
    ("tags: [a, b]", "value", "a|b"),
    ("tags:\n  - a\n  - b", "value", "a|b"),
    ("tags:\n- a\n- 'b c'", "value", "a|b c"),
    ("tags:\n  - k: v", "unreadable", None),
    ("tags: []", "value", ""),
    ("tags: [a, [b]]", "unreadable", None),
    ("tags: plain", "unreadable", None),
    ("tags: ['x, y', z]", "value", "x, y|z"),
)


def _headers(t, shapes) -> DataFrame:
    text = _pick(F.col("o_orderkey"), *(f"---\ntitle: t\n{s}\nlast: 1\n---\nbody" for s, _, _ in shapes))
    return t("orders").select(F.col("o_orderkey").cast("string").alias("path"), text.alias("text"))


def _shape_sql(shapes) -> str:
    states = _values(*(f"{_quoted(s)}, {_quoted(v)}" for _, s, v in shapes)).replace("v(r, value)", "v(r, state, value)")
    return (
        f"SELECT CAST(o_orderkey AS VARCHAR) AS path, state, value FROM orders JOIN {states} "
        f"ON o_orderkey % {len(shapes)} = r WHERE state IS NOT NULL"
    )


def _read(t, shapes, key: str, shape: str, told) -> DataFrame:
    f = N.fields(_headers(t, shapes)).where(F.col("key") == key)
    return f.select("path", F.col(f"{shape}.state").alias("state"), told(F.col(f"{shape}.v")).alias("value"))


@query("P02_scalar", _shape_sql(SCALARS))
def scalar(t):
    """The first line of a key as one value: quotes and comments off, blocks unreadable."""
    return _read(t, SCALARS, "status", "scalar", lambda v: v)


@query("P03_mapping", _shape_sql(MAPPINGS))
def mapping(t):
    """One line in braces or an indented block of one depth."""

    def told(v: Column) -> Column:
        pairs = F.transform(F.map_entries(v), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        return F.array_join(F.array_sort(pairs), ",")

    return _read(t, MAPPINGS, "generated", "map", told)


@query("P04_list", _shape_sql(LISTS))
def listing(t):
    """One line in brackets or a block of dashes; items with keys are not plain ones."""
    return _read(t, LISTS, "tags", "list", lambda v: F.array_join(v, "|"))


@query(
    "P06_key_line",
    "SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(2 + 2 * (o_orderkey % 4) + o_orderkey % 3 AS BIGINT) AS line "
    "FROM orders",
)
def key_line(t):
    """The line of a key in its file, after lists and blank lines."""
    k = F.col("o_orderkey")
    many = F.concat(F.repeat(F.lit("k:\n  - x\n"), (k % 4).cast("int")), F.repeat(F.lit("\n"), (k % 3).cast("int")))
    text = F.concat(F.lit("---\n"), many, F.lit("status: x\n---\n"))
    f = N.fields(t("orders").select(k.cast("string").alias("path"), text.alias("text"))).where("key = 'status'")
    return f.select("path", F.col("line").cast("long").alias("line"))


DANGLING = (
    ("sources:\n  - id: a\n    url: x\ncount: 3\n  - id: b\n    url: y", 1, "sources"),
    ("sources:\n  - id: a\ncount: 3\nother: x", 0, None),
    ("tags:\n  - a\nname: b\n  - c\n  - d", 2, "tags"),
    ("sources:\n  - id: a\n    url: x\nevents:\n  - by: me\n    at: now\nname: n\n  - by: you\n    at: then", 1, "events"),
    ("name: n\n  - c", 1, None),
)


@query(
    "P08_dangling_items",
    "SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(n AS BIGINT) AS items, owner FROM orders JOIN (VALUES "
    + ", ".join(f"({i}, {n}, {_quoted(o)})" for i, (_, n, o) in enumerate(DANGLING))
    + f") AS v(r, n, owner) ON o_orderkey % {len(DANGLING)} = r WHERE n > 0",
)
def dangling(t):
    """List items under a key that holds a scalar, and the earlier list that they were cut off from."""
    text = _pick(F.col("o_orderkey"), *(f"---\n{x}\n---\n" for x, _, _ in DANGLING))
    found = N.dangling_items(t("orders").select(F.col("o_orderkey").cast("string").alias("path"), text.alias("text")))
    return found.groupBy("path", "owner").agg(F.count("*").alias("items"))


LIMITS = (
    ("---\na: &x 1\nb: *x\n---\n", "a=&x 1|b=*x"),
    ("---\na: 1\n", ""),
    ("no header\n---\na: 1\n---\n", ""),
    ("---\n  a: 1\nb: 2\n---\n", "b=2"),
    ("---\na: 1\na: 2\n---\n", "a=1|a=2"),
    ("---\r\na: 1\r\n---\r\n", "a=1"),
    ("\ufeff---\na: 1\n---\n", "a=1"),
    ("--- \na: 1\n---\t\n", "a=1"),
    ("---\n? a\n: 1\n---\n", ""),
)


@query(
    "P09_limits",
    "SELECT CAST(o_orderkey AS VARCHAR) AS path, value AS told FROM orders JOIN "
    + _values(*(_quoted(x) for _, x in LIMITS))
    + f" ON o_orderkey % {len(LIMITS)} = r",
)
def limits(t):
    """What the header parser does not do: anchors, explicit keys, indented roots; and what it tolerates."""
    raw = _pick(F.col("o_orderkey"), *(x for x, _ in LIMITS))
    clean = F.regexp_replace(F.regexp_replace(raw, "\\A\ufeff", ""), r"\r\n?", "\n")
    notes = t("orders").select(F.col("o_orderkey").cast("string").alias("path"), clean.alias("text"))
    one = F.struct("line", F.concat("key", F.lit("="), "scalar.v").alias("told"))
    told = N.fields(notes).groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("x"))
    told = told.select("path", F.array_join("x.told", "|").alias("told"))
    return notes.select("path").join(told, "path", "left").select("path", F.coalesce("told", F.lit("")).alias("told"))


CELLS = (
    ("| a | b |", "a,b"),
    ("a | b", "a,b"),
    ("| a \\| b | c |", "a | b,c"),
    ("|  | x |", ",x"),
    ("| one |", "one"),
    ("|:--|--:|", None),
    ("---|---", None),
    ("| - text | x |", "- text,x"),
)


@query(
    "P11_table_cells",
    "SELECT o_orderkey, value IS NULL AS delimiter, value AS cells FROM orders JOIN "
    + _values(*(_quoted(x) for _, x in CELLS))
    + f" ON o_orderkey % {len(CELLS)} = r",
)
def table_cells(t):
    """Cells between pipes that no backslash escapes; rows of dashes part the header from the data."""
    raw = _pick(F.col("o_orderkey"), *(x for x, _ in CELLS))
    rows = t("orders").select("o_orderkey", raw.alias("raw"))
    rule = N.is_delimiter_row(F.col("raw"))
    cells = F.when(~rule, F.array_join(N.table_cells(F.col("raw")), ","))
    return rows.select("o_orderkey", rule.alias("delimiter"), cells.alias("cells"))


def _indexes(t) -> DataFrame:
    """An index of each nation in its region's folder, and the root's."""
    k = F.col("n_nationkey")
    path = F.when(k == 0, "index.md").otherwise(F.concat_ws("/", F.col("n_regionkey").cast("string"), k.cast("string"), F.lit("index.md")))
    body = _pick(k, "okf_version: 2\n", "okf_version: 3\nname: x\n", "", "name: y\n")
    text = F.when(k % 5 == 4, "no header").otherwise(F.concat(F.lit("---\n"), body, F.lit("---\n")))
    return t("nation").select(path.alias("path"), text.alias("text"))


@query(
    "R02_index_header",
    "SELECT n_regionkey || '/' || n_nationkey || '/index.md' AS file, 'no-header-outside-root' AS \"check\", 'must' AS level "
    "FROM nation WHERE n_nationkey <> 0 AND n_nationkey % 5 <> 4 AND n_nationkey % 4 <> 2",
)
def index_header(t):
    """Only the root's index may have a header, and only its version in it."""
    return R.RULES["index-no-header"](R.Context(_indexes(t), {"version": "2"})).select("file", "check", "level")


@query(
    "R17_root_version",
    "SELECT * FROM (VALUES ('2', CAST(NULL AS VARCHAR)), ('3', 'version-equal')) AS v(wanted, \"check\") WHERE \"check\" IS NOT NULL "
    "AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 0)",
)
def root_version(t):
    """The root's version is there and is the configured one."""
    files, out = _indexes(t), None
    for wanted in ("2", "3"):
        one = R.RULES["root-version"](R.Context(files, {"version": wanted}))
        one = one.select(F.lit(wanted).alias("wanted"), "check")
        out = one if out is None else out.unionByName(one)
    return out


def _linked(t) -> DataFrame:
    k = F.col("s_suppkey")
    raw = _pick(k, "/a/b.md", "b.md", "../c.md", "https://x.org/d.md", "#part")
    path = F.concat(F.lit("s/"), k.cast("string"), F.lit(".md"))
    return t("supplier").select(path.alias("path"), F.concat(F.lit("see [x]("), raw, F.lit(")")).alias("text"))


@query(
    "R14_link_style",
    "SELECT 's/' || s_suppkey || '.md' AS file, style FROM supplier JOIN (VALUES (0, 'file-relative'), (1, 'bundle-absolute'), "
    "(2, 'bundle-absolute')) AS v(r, style) ON s_suppkey % 5 = r",
)
def link_style(t):
    """Internal links against the chosen style: external ones and fragments have none."""
    files, out = _linked(t), None
    for style in ("file-relative", "bundle-absolute", "any"):
        one = R.RULES["link-style"](R.Context(files, {"link_style": style})).select("file", F.lit(style).alias("style"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "R18_timestamp_deviation",
    "SELECT id, CASE WHEN id = 'stale-after-format' AND k % 2 = 0 THEN 'tolerated' ELSE level END AS level, count(*) AS n FROM ("
    "SELECT p_partkey AS k, 'stale-after-format' AS id, 'should' AS level FROM part WHERE p_partkey % 3 <> 1) GROUP BY ALL",
)
def timestamp_deviation(t):
    """A form of timestamp that the settings tolerate is told as such, everywhere alike; the rule finds nothing itself."""
    k = F.col("p_partkey")
    value = F.when(k % 3 == 1, "2026-05-05T10:00:00Z").when(k % 2 == 0, "2026-05-05").otherwise("May 5")
    path = F.concat(k.cast("string"), F.lit(".md"))
    text = F.concat(F.lit("---\nstale_after: "), value, F.lit("\n---\n"))
    ctx = R.Context(t("part").select(path.alias("path"), text.alias("text")))
    found = R.RULES["stale-after-format"](ctx)
    return R.tolerated(found, ctx, ["stale_after"]).groupBy("id", "level").agg(F.count("*").alias("n"))


HEADS = ("| name | kind |", "| name | sort |", "| kind | name |", "| name |", "| name | kind | more |")


@query(
    "R22_columns",
    "SELECT n_nationkey || '.md' AS file, CASE n_nationkey % 5 WHEN 1 THEN 'column-2' WHEN 2 THEN 'column-1' WHEN 3 THEN 'column-2' "
    "WHEN 4 THEN 'column-3' END AS \"check\" FROM nation WHERE n_nationkey % 5 <> 0",
)
def columns(t):
    """The first difference between a file's configured headings and its first table."""
    k = F.col("n_nationkey")
    text = F.concat(F.lit("intro\n\n"), _pick(k, *HEADS), F.lit("\n|---|---|\n| x | y |\n\n| other |\n|---|\n| z |\n"))
    files = t("nation").select(F.concat(k.cast("string"), F.lit(".md")).alias("path"), text.alias("text"))
    wanted = {f"{i}.md": ["name", "kind"] for i in range(25)}
    return R.RULES["columns"](R.Context(files, {"columns": wanted})).select("file", "check")


def _tabled(t) -> DataFrame:
    """A note of each order: its lines as rows of one table."""
    cells = F.concat_ws(" | ", (F.col("l_partkey") % 5).cast("string"), F.repeat(F.lit("x"), (F.col("l_suppkey") % 7).cast("int")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", cells.alias("c")))), lambda x: F.concat(F.lit("| "), x["c"], F.lit(" |")))
    text = F.concat(F.lit("text\n\n| a | b |\n|---|---|\n"), F.array_join(rows, "\n"))
    path = F.concat(F.col("l_orderkey").cast("string"), F.lit(".md"))
    return t("lineitem").groupBy("l_orderkey").agg(text.alias("text")).select(path.alias("path"), "text")


_LINES = (
    "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, a, b) AS n, a, b FROM "
    "(SELECT l_orderkey, l_linenumber, l_partkey % 5 || ' | ' || repeat('x', CAST(l_suppkey % 7 AS INT)) AS a, l_suppkey % 7 AS b FROM lineitem)"
)


@query(
    "R24_duplicate_rows",
    f"SELECT l_orderkey || '.md' AS file, CAST(n + 4 AS INTEGER) AS line FROM (SELECT *, min(n) OVER (PARTITION BY l_orderkey, a) AS first "
    f"FROM ({_LINES})) WHERE n > first",
)
def duplicate_rows(t):
    """Rows of a Markdown table equal to an earlier one of it."""
    return R.RULES["tables"](R.Context(_tabled(t))).where("check = 'duplicate-row'").select("file", "line")


@query("R25_long_cells", f"SELECT l_orderkey || '.md' AS file, CAST(n + 4 AS INTEGER) AS line FROM ({_LINES}) WHERE b > 4")
def long_cells(t):
    """Rows of a table with a cell past the limit."""
    return R.RULES["tables"](R.Context(_tabled(t), {"max_cell": 4})).where("check = 'long-cell'").select("file", "line")


@query(
    "W01_log_order",
    "SELECT o_custkey || '/log.md' AS file, CAST(n AS INTEGER) AS line FROM (SELECT o_custkey, n, d, lag(d) OVER (PARTITION BY o_custkey ORDER BY n) AS b "
    "FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)) WHERE d > b",
)
def log_order(t):
    """Dates of a log that are later than the one above them, with their lines."""
    line = F.concat(F.lit("## "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l"))))
    logs = t("orders").groupBy("o_custkey").agg(F.array_join(rows["l"], "\n").alias("text"))
    path = F.concat(F.col("o_custkey").cast("string"), F.lit("/log.md"))
    found = R.RULES["log-format"](R.Context(logs.select(path.alias("path"), "text")))
    return found.where("check = 'ordering'").select("file", "line")


def _cased(t, texts) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").cast("string").alias("path"), _pick(F.col("o_orderkey"), *texts).alias("text"))


CODE = (
    ("a MARK b", True),
    ("a `MARK` b", False),
    ("a ``x ` MARK`` b", False),
    ("a `open MARK", True),
    ("```\nMARK\n```", False),
    ("~~~ md\nMARK\n~~~\nend", False),
    ("```\nMARK", False),
    ("````\n```\nMARK\n````", False),
    ("para\n\n    MARK", False),
    ("- item\n\n    MARK", True),
    ("> ```\n> MARK\n> ```", False),
    ("```\nx\n```\nMARK", True),
)


@query("P10_strip_code", "SELECT CAST(o_orderkey AS VARCHAR) AS path, value AS text_left, lines FROM orders JOIN (VALUES " + ", ".join(f"({i}, {v}, {x.count(chr(10)) + 1})" for i, (x, v) in enumerate(CODE)) + f") AS v(r, value, lines) ON o_orderkey % {len(CODE)} = r")
def strip_code(t):
    """Whether a word is left once fences, indented code and spans are blanked; the number of lines stays."""
    bare = N.code_stripped("text")
    rows = _cased(t, [x for x, _ in CODE]).withColumn("bare", bare)
    return rows.select("path", F.contains("bare", F.lit("MARK")).alias("text_left"), F.size(F.split("bare", "\n")).alias("lines"))


TABLES = (
    ("| a |\n|---|\n| 1 |\n| 2 |", "1:2"),
    ("a | b\n---|---\n1 | 2", "1:1"),
    ("no table\n| a |", ""),
    ("| a |\n|---|\n\n| b |\n|---|\n| 1 |", "1:0,4:1"),
    ("| a |\n|---|\n| 1 |\ntext\n| 2 |", "1:1"),
    ("|---|\n|---|", ""),
)


@query("P12_table_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS path, value AS found FROM orders JOIN " + _values(*(_quoted(v) for _, v in TABLES)) + f" ON o_orderkey % {len(TABLES)} = r WHERE value <> ''")
def table_rows(t):
    """Every table with its header's line and how many data rows it has."""
    lines = _cased(t, [x for x, _ in TABLES]).select("path", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    rows = N.table_rows(lines.select("path", (F.col("at") + 1).alias("line"), "raw"), "path")
    per = rows.groupBy("path", "table").agg(F.count_if(F.col("kind") == "row").alias("n"))
    one = F.concat_ws(":", F.col("table").cast("string"), F.col("n").cast("string"))
    return per.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("found"))


SECTIONS = (
    ("# T\n## Open\na\n### sub\nb\n## Done\nc", "a|### sub|b"),
    ("## Open\n", ""),
    ("## Opened\na", None),
    ("# Open\na\n## Open\nb\n# End\nc", "b"),
    ("## Open\na\n## Open\nb", "a"),
    ("x\n ## Open \na", "a"),
)


@query("P18_section", "SELECT CAST(o_orderkey AS VARCHAR) AS path, value AS body FROM orders JOIN " + _values(*(_quoted(v) for _, v in SECTIONS)) + f" ON o_orderkey % {len(SECTIONS)} = r WHERE value IS NOT NULL")
def section(t):
    """The lines under a heading, up to the next of its level or above; only the first such heading counts."""
    lines = _cased(t, [x for x, _ in SECTIONS]).select("path", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    rows = N.sections(lines, "path", "## Open")
    told = F.array_join(F.array_sort(F.collect_list(F.struct("line", "raw")))["raw"], "|")
    return rows.groupBy("path").agg(told.alias("body"))


_FIELDS = {
    "orders": ("o_custkey", "strftime(o_orderdate, '%Y-%m-%d')", "replace(o_orderpriority, ' ', '_')", "o_orderstatus", "CAST(o_totalprice > 100 AS VARCHAR)"),
    "part": ("p_name", "p_size", "p_brand", "p_type"),
    "customer": ("c_name", "c_acctbal", "c_mktsegment"),
}
_VALUES = " UNION ALL ".join(f"SELECT '{table}.{i}' AS field, CAST({x} AS VARCHAR) AS value FROM {table}" for table, xs in _FIELDS.items() for i, x in enumerate(xs))
_DATE = "try_cast(value AS DATE) IS NOT NULL AND regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}')"


@query(
    "A09_infer_kinds",
    f"SELECT field, CASE WHEN bool_and(value IN ('true', 'false')) THEN 'boolean' WHEN bool_and({_DATE}) THEN 'date' WHEN bool_and(regexp_full_match(value, '-?[0-9]+([.][0-9]+)?')) THEN 'number' "
    f"WHEN count(DISTINCT value) <= 12 AND count(*) > count(DISTINCT value) AND bool_and(regexp_full_match(value, '[A-Za-z0-9_-]+')) THEN 'enum' ELSE 'string' END AS kind FROM ({_VALUES}) WHERE value IS NOT NULL GROUP BY 1",
)
def infer_kinds(t):
    """The strictest kind that all values of a field have."""
    out = None
    for table, xs in _FIELDS.items():
        made = [F.date_format("o_orderdate", "yyyy-MM-dd") if x.startswith("strftime") else F.expr(x.replace("VARCHAR", "STRING")).cast("string") for x in xs]
        each = F.explode(F.array(*(F.struct(F.lit(f"{table}.{i}").alias("field"), c.alias("value")) for i, c in enumerate(made)))).alias("x")
        one = t(table).select(each).select("x.*")
        out = one if out is None else out.unionByName(one)
    return A.kinds(out, "field", "value")


@query("A10_infer_collections", "SELECT p_brand || '-' || p_size % 3 AS dir, CASE WHEN count(DISTINCT p_type) = 1 THEN 'collection' ELSE 'domain' END AS role FROM part GROUP BY 1")
def infer_collections(t):
    """First-level folders of notes, told apart by whether their notes share one type."""
    path = F.concat("p_brand", F.lit("-"), (F.col("p_size") % 3).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"))
    return A.collections(t("part").select(path.alias("path"), "p_type"), "path", "p_type")


@query("A11_infer_enums", "SELECT 'brand' AS field, p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS options FROM part GROUP BY 2 UNION ALL SELECT 'size', p_type, string_agg(DISTINCT CAST(p_size % 4 AS VARCHAR), ',' ORDER BY CAST(p_size % 4 AS VARCHAR)) FROM part GROUP BY 2")
def infer_enums(t):
    """The values of each field for each type of note."""
    pair = lambda name, c: F.struct(F.lit(name).alias("field"), c.alias("value"))
    each = F.explode(F.array(pair("brand", F.col("p_brand")), pair("size", (F.col("p_size") % 4).cast("string"))))
    values = t("part").select("p_type", each.alias("x")).select("p_type", "x.*")
    return A.choices(values, "field", "p_type", "value").withColumn("options", F.array_join("options", ","))


@query(
    "A13_infer_confidential",
    "WITH d AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_type || '/' || p_brand END AS dir FROM part WHERE p_size < 4), k AS (SELECT dir FROM d WHERE dir <> 'PROMO' AND NOT starts_with(dir, 'PROMO/')) "
    "SELECT dir FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE starts_with(k.dir, o.dir || '/'))",
)
def infer_confidential(t):
    """Folders of marked notes outside the known ones, nested ones dropped."""
    folder = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.concat_ws("/", "p_type", "p_brand"))
    marked = t("part").where("p_size < 4").select(F.concat(folder, F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))
    return A.confidential_folders(marked, "path", ["PROMO"])


@query(
    "S18_pull_requests",
    "SELECT o_custkey, CASE WHEN bool_and(o_orderkey % 17 <> 0) THEN string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) END AS numbers FROM orders GROUP BY 1",
)
def pull_requests(t):
    """A listing's JSON lines, taken whole in the order of their numbers or, if one has the wrong shape, not at all."""
    k = F.col("o_orderkey")
    good = F.to_json(F.struct(k.alias("number"), F.lit("t").alias("title"), F.array("o_orderstatus").alias("labels")))
    wrong = F.when(k % 2 == 0, F.lit('{"number": "x"}')).otherwise(F.lit('{"title": 3'))
    lines = t("orders").select("o_custkey", F.when(k % 17 == 0, wrong).otherwise(good).alias("value"))
    valid = F.col("x.number").isNotNull() & F.col("x.title").isNotNull() & F.col("x.labels").isNotNull()
    listed = A.whole_listing(lines, "o_custkey", "value", "number long, title string, labels array<string>", "number", valid)
    return listed.select("o_custkey", F.array_join(F.col("items.number").cast("array<string>"), ",").alias("numbers"))


@query(
    "J17_push_tips",
    "SELECT sha1(CAST(o_custkey AS VARCHAR)) AS tip, min(o_orderkey) AS at FROM orders WHERE o_orderkey % 5 NOT IN (1, 2, 3) GROUP BY 1",
)
def push_tips(t):
    """The object third from last in each line of a push, the first line of each; null objects and short lines are none."""
    k, tip = F.col("o_orderkey"), F.sha1(F.col("o_custkey").cast("string"))
    lines = F.element_at(
        F.array(
            F.concat(F.lit("refs/heads/a "), tip, F.lit(" refs/heads/a "), F.repeat(F.lit("0"), 40)),
            F.concat(F.lit("refs/heads/a "), F.repeat(F.lit("0"), 40), F.lit(" refs/heads/a x")),
            F.lit("two words"),
            F.lit("(delete) nothex refs/heads/b y"),
            F.concat(F.lit("  odd name with spaces "), tip, F.lit("  refs/heads/c  z ")),
        ),
        (k % 5 + 1).cast("int"),
    )
    return A.pushed_tips(t("orders").select(k, lines.alias("line")), "o_orderkey", "line")
