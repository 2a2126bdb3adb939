"""Queries whose inputs are put together from many columns, and whose SQL works the answers out: link styles,
cells, settings and forbidden keys over whole tables (F10, P10, P11, R14, X34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import gates as G
from tidemark.operators import notes as N
from tidemark.operators import rules as R
from tidemark.operators.staging import stage

from .tables import query


@query("F10_severities", """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '"' || lower(split_part(o_orderpriority, '-', 2)) || '"' WHEN o_orderstatus = 'O' THEN '{"severity":"' || CASE WHEN o_totalprice > 200000 THEN 'error' WHEN o_totalprice > 100000 THEN 'off' WHEN o_totalprice > 50000 THEN 'loud' ELSE 'warn' END || '"}'
  ELSE CAST(o_custkey AS VARCHAR) END AS v, CASE WHEN o_custkey % 3 = 0 THEN 'error' WHEN o_custkey % 3 = 1 THEN 'urgent' END AS own FROM orders),
g AS (SELECT *, CASE json_type(CAST(v AS JSON)) WHEN 'VARCHAR' THEN json_extract_string(v, '$') WHEN 'OBJECT' THEN json_extract_string(v, '$.severity') END AS given FROM s)
SELECT o_orderkey, coalesce(CASE WHEN given IN ('off', 'warn', 'error') THEN given END, CASE WHEN own IN ('off', 'warn', 'error') THEN own END, 'warn') AS severity FROM g""")
def severities(t):
    """A setting as a word or in an object, else the rule's own, else warn; from what orders hold."""
    price, own = F.col("o_totalprice"), F.col("o_custkey") % 3
    word = F.concat(F.lit('"'), F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))), F.lit('"'))
    inside = F.concat(F.lit('{"severity":"'), F.when(price > 200000, "error").when(price > 100000, "off").when(price > 50000, "loud").otherwise("warn"), F.lit('"}'))
    setting = F.when(F.col("o_orderstatus") == "F", word).when(F.col("o_orderstatus") == "O", inside).otherwise(F.col("o_custkey").cast("string"))
    df = t("orders").select("o_orderkey", setting.alias("setting"), F.when(own == 0, "error").when(own == 1, "urgent").alias("own"))
    return df.select("o_orderkey", G.severity(F.try_parse_json("setting"), F.col("own")).alias("severity"))


_LINES = "SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10))) AS raw FROM documents"


@query("P11_cells_of_lines", rf"""WITH l AS (SELECT doc_id, '| ' || replace(replace(replace(raw, '|', '\|'), ' the ', ' | '), ' and ', '|') || CASE WHEN length(raw) % 2 = 0 THEN ' |' ELSE '' END AS raw FROM ({_LINES}) WHERE raw NOT LIKE '%\%')
SELECT doc_id, len(c) AS n, count(*) AS lines, CAST(sum(length(array_to_string(c, ','))) AS BIGINT) AS chars FROM (
  SELECT doc_id, list_transform(string_split(regexp_replace(regexp_replace(trim(replace(raw, '\|', chr(1)), E' \t'), '^\|', ''), '\|$', ''), '|'), lambda x: replace(trim(x, E' \t'), chr(1), '|')) AS c FROM l) GROUP BY doc_id, len(c)""")
def cells_of_lines(t):
    """Lines of documents as rows of tables: escaped pipes stay, the others part cells."""
    raw = F.explode(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), "\n"))
    lines = t("documents").select("doc_id", raw.alias("raw")).where(~F.contains("raw", F.lit("\\")))
    marked = F.replace(F.replace(F.replace("raw", F.lit("|"), F.lit("\\|")), F.lit(" the "), F.lit(" | ")), F.lit(" and "), F.lit("|"))
    row = F.concat(F.lit("| "), marked, F.when(F.length("raw") % 2 == 0, " |").otherwise(""))
    cells = lines.select("doc_id", N.table_cells(row).alias("c"))
    return cells.groupBy("doc_id", F.size("c").cast("long").alias("n")).agg(F.count("*").alias("lines"), F.sum(F.length(F.array_join("c", ","))).cast("long").alias("chars"))


_PLAIN = r"raw NOT LIKE '%`%' AND NOT regexp_matches(raw, '^(\s|>|[-*+] |[0-9]+[.)]|~~~|#)') AND raw <> ''"


@query("P10_spans_of_lines", rf"""WITH l AS (SELECT doc_id, replace(replace(raw, ' the ', ' `the` '), ' of ', ' ``o ` f`` ') AS raw FROM ({_LINES}) WHERE {_PLAIN})
SELECT doc_id, count(*) AS lines, CAST(sum(length(regexp_replace(regexp_replace(regexp_replace(raw, '``o ` f``', '', 'g'), '`the`', '', 'g'), '\s', '', 'g'))) AS BIGINT) AS left_over FROM l GROUP BY doc_id""")
def spans_of_lines(t):
    """What is left of lines of documents once the words that are put into code spans are blanked."""
    raw = F.explode(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), "\n"))
    lines = t("documents").select("doc_id", raw.alias("raw"))
    lines = lines.where(~F.contains("raw", F.lit("`")) & ~F.rlike("raw", F.lit(r"\A(\s|>|[-*+] |[0-9]+[.)]|~~~|#)")) & (F.col("raw") != ""))
    coded = F.replace(F.replace("raw", F.lit(" the "), F.lit(" `the` ")), F.lit(" of "), F.lit(" ``o ` f`` "))
    bare = lines.select("doc_id", coded.alias("text")).select("doc_id", N.code_stripped("text").alias("bare"))
    return bare.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length(F.regexp_replace("bare", r"\s", ""))).cast("long").alias("left_over"))


@query("R14_link_styles", """WITH l AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '/' || c_mktsegment || '/' || c_nationkey || '.md' WHEN c_acctbal < 3000 THEN '../' || c_mktsegment || '.md' WHEN c_acctbal < 5000 THEN 'https://' || lower(c_mktsegment) || '.org/x.md'
  WHEN c_acctbal < 7000 THEN '#' || c_nationkey WHEN c_acctbal < 8500 THEN 'mailto:' || c_nationkey || '@x.org' ELSE c_nationkey || '.md#' || lower(c_mktsegment) END AS raw FROM customer),
i AS (SELECT * FROM l WHERE NOT regexp_matches(raw, '^([a-zA-Z][a-zA-Z0-9+.-]*:|//)') AND raw NOT LIKE '#%')
SELECT c_custkey, style FROM i, (VALUES ('file-relative'), ('bundle-absolute'), ('any')) AS v(style) WHERE (style = 'file-relative' AND raw LIKE '/%') OR (style = 'bundle-absolute' AND raw NOT LIKE '/%')""")
def link_styles(t):
    """Targets of many forms against each style."""
    bal, seg, nat = F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    raw = (
        F.when(bal < 0, F.concat(F.lit("/"), seg, F.lit("/"), nat, F.lit(".md"))).when(bal < 3000, F.concat(F.lit("../"), seg, F.lit(".md"))).when(bal < 5000, F.concat(F.lit("https://"), F.lower(seg), F.lit(".org/x.md")))
        .when(bal < 7000, F.concat(F.lit("#"), nat)).when(bal < 8500, F.concat(F.lit("mailto:"), nat, F.lit("@x.org"))).otherwise(F.concat(nat, F.lit(".md#"), F.lower(seg)))
    )
    files = t("customer").select(F.concat(F.lit("c/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("see [x]("), raw, F.lit(")")).alias("text"))
    out = None
    for style in ("file-relative", "bundle-absolute", "any"):
        one = R.RULES["link-style"](R.Context(files, {"link_style": style})).select("file", F.lit(style).alias("style"))
        out = one if out is None else out.unionByName(one)
    return out.select(F.regexp_extract("file", r"c/(\d+)\.md", 1).cast("long").alias("c_custkey"), "style")


_NESTED = """'{"k":' || p_size || ',"' || CASE WHEN p_size % 2 = 0 THEN 'token' ELSE lower(split_part(p_type, ' ', 1)) END || '":{"list":[{"' || CASE WHEN p_retailprice > 1000 THEN 'password' ELSE 'name' END || '":"' || p_brand || '"},['
  || '{"' || lower(split_part(p_name, ' ', 1)) || '":{"token":' || p_partkey || '}}]]}}'"""


@query("X34_forbidden_in_parts", f"""SELECT p_partkey, key AS name, count(*) AS n FROM (SELECT p_partkey, CAST({_NESTED} AS JSON) AS v FROM part) AS t, json_tree(t.v) AS j WHERE key IN ('token', 'password') GROUP BY ALL""")
def forbidden_in_parts(t):
    """Forbidden keys wherever they stand in objects and lists of objects made of each part's columns."""
    c = F.col
    first = lambda x: F.lower(F.split_part(x, F.lit(" "), F.lit(1)))
    json = F.concat(
        F.lit('{"k":'), c("p_size").cast("string"), F.lit(',"'), F.when(c("p_size") % 2 == 0, "token").otherwise(first("p_type")), F.lit('":{"list":[{"'), F.when(c("p_retailprice") > 1000, "password").otherwise("name"), F.lit('":"'), "p_brand", F.lit('"},['),
        F.lit('{"'), first("p_name"), F.lit('":{"token":'), c("p_partkey").cast("string"), F.lit("}}]]}}"),
    )
    found = G.forbidden_keys(t("part").select("p_partkey", json.alias("json")), "p_partkey", "json", ["token", "password"], stage)
    return found.groupBy("p_partkey", F.regexp_extract("path", r"([^.\[\]]+)\z", 1).alias("name")).agg(F.count("*").alias("n"))
