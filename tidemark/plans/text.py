"""Text and path queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.functions import text as T
from tidemark.operators.staging import numbered

from .tables import query

_PS = r"[\p{P}\p{S}]+"


@query("X01_question_key", rf"SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '{_PS}', ' ', 'g'), '\s+', ' ', 'g')) AS normal FROM benchmark")
def question_key(t):
    return t("benchmark").select("item_id", T.normal_question(T.nfc("text")).alias("normal"))


@query("X02_question_id", rf"SELECT item_id, 'q-' || substr(sha256(trim(regexp_replace(regexp_replace(lower(text), '{_PS}', ' ', 'g'), '\s+', ' ', 'g'))), 1, 8) AS id FROM benchmark")
def question_id(t):
    return t("benchmark").select("item_id", T.question_id(T.normal_question(F.col("text"))).alias("id"))


@query("X03_slug", "SELECT c_custkey, nullif(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-'), '') AS slug FROM customer")
def slug(t):
    return t("customer").select("c_custkey", T.slug(T.without_marks("c_name")).alias("slug"))


@query("X04_edit_distance", "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS edits FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def edit_distance(t):
    a = t("nation").select(F.col("n_name").alias("a"), "n_regionkey")
    b = t("nation").select(F.col("n_name").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", F.levenshtein("a", "b").cast("long").alias("edits"))


@query("O06_nearest_names", """WITH t AS (SELECT p_partkey, lower(substr(p_brand, 1, 4)) || substr(p_brand, 6) AS typed FROM part), n AS (SELECT DISTINCT lower(p_brand) AS name FROM part),
d AS (SELECT p_partkey, typed, name, levenshtein(typed, name) AS e FROM t, n WHERE levenshtein(typed, name) <= CASE WHEN length(typed) <= 4 THEN 1 ELSE 2 END)
SELECT p_partkey, typed, string_agg(name, ',' ORDER BY name) AS nearest FROM (SELECT *, rank() OVER (PARTITION BY p_partkey ORDER BY e) AS r FROM d) WHERE r = 1 GROUP BY ALL""")
def nearest_names(t):
    """Names at the least distance within the allowance; ties stay.

    Words within two edits share one of the forms that up to two deletions leave of each, so pairs are met by these
    forms and only they are compared.
    """
    typed = t("part").select("p_partkey", F.concat(F.lower(F.substring("p_brand", 1, 4)), F.substring("p_brand", 6, 100)).alias("typed"))
    names = t("part").select(F.lower("p_brand").alias("name")).distinct()
    ours = typed.select("typed").distinct().select("typed", F.explode(T.deletions(F.col("typed"))).alias("form"))
    theirs = names.select("name", F.explode(T.deletions(F.col("name"))).alias("form"))
    pairs = ours.join(theirs, "form").select("typed", "name").distinct()
    near = pairs.withColumn("edits", F.levenshtein("typed", "name")).where(F.col("edits") <= T.allowed_edits(F.col("typed")))
    near = near.withColumn("r", F.rank().over(Window.partitionBy("typed").orderBy("edits"))).where("r = 1")
    near = near.groupBy("typed").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("nearest"))
    return typed.join(near, "typed").select("p_partkey", "typed", "nearest")


@query("X05_comparable", r"SELECT doc_id, md5(lower(regexp_replace(translate(text, '’ʼ‘', ''''''''), '\s+', ' ', 'g'))) AS folded FROM documents")
def comparable(t):
    return t("documents").select("doc_id", F.md5(T.comparable(F.col("text"))).alias("folded"))


@query("X06_fold", r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x00-\x1F]+', ' ', 'g'))) AS folded FROM documents")
def fold(t):
    return t("documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


_WIDE = r"regexp_extract_all(left(s, i), '[\x{10000}-\x{10FFFF}]')"


@query("X08_truncate_units", f"""WITH t AS (SELECT conv_id, turn, replace(text, 'o', 'o😀') AS s FROM conversations),
c AS (SELECT *, CASE WHEN length(s) + len(regexp_extract_all(s, '[\\x{{10000}}-\\x{{10FFFF}}]')) > 300 THEN list_max(list_filter(range(0, 301), lambda i: i + len({_WIDE}) <= 300)) END AS cut FROM t)
SELECT conv_id, turn, CASE WHEN cut IS NOT NULL THEN left(s, cut) || '…' ELSE s END AS shown FROM c""")
def truncate_units(t):
    """Texts with characters beyond the basic plane, cut by UTF-16 units without splitting one."""
    wide = F.replace(F.col("text"), F.lit("o"), F.lit("o😀"))
    return t("conversations").select("conv_id", "turn", T.truncate_units(wide, 300).alias("shown"))


@query("X08_truncate", "SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS shown FROM conversations")
def truncate(t):
    return t("conversations").select("conv_id", "turn", T.truncate(F.col("text"), 200).alias("shown"))


@query("X09_line_cost", "SELECT conv_id, turn, CAST(strlen(text) + 13 AS BIGINT) AS cost FROM conversations")
def line_cost(t):
    return t("conversations").select("conv_id", "turn", T.line_cost(F.col("text")).cast("long").alias("cost"))


@query("X10_hide_paths", "SELECT page_id, 'see ' || regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]+$') || ' there' AS shown FROM pages WHERE regexp_matches(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+/.*[^/]$')")
def hide_paths(t):
    clean = F.regexp_replace("url", r"[?#].*\z", "")
    rows = t("pages").where(F.rlike(clean, F.lit(r"\Ahttps?://[^/]+/.*[^/]\z")))
    return rows.select("page_id", T.without_paths(F.concat(F.lit("see "), F.regexp_replace(clean, r"\Ahttps?:/", ""), F.lit(" there"))).alias("shown"))


@query("X11_interpolate", "SELECT s_suppkey, 'Supplier ' || s_name || ' of ' || CAST(s_nationkey AS VARCHAR) || ' has {what}' AS said FROM supplier")
def interpolate(t):
    values = F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string"))
    return t("supplier").select("s_suppkey", T.interpolate(F.lit("Supplier {name} of {nation} has {what}"), values).alias("said"))


@query("X12_error_text", r"SELECT doc_id, left(regexp_replace(trim(regexp_replace(text, '[\s\x00-\x1F]+', ' ', 'g')), '(?i)(token|key|secret|password)(\s*[=:]\s*)\S+', '\1\2[hidden]', 'g'), 300) AS said FROM documents")
def error_text(t):
    return t("documents").select("doc_id", T.error_text(F.col("text")).alias("said"))


_ERRORS = ("Please log in again", "API Error 529 overloaded", "Usage limit reached", "getaddrinfo failed", "exit 3")


@query("X13_classify_error", "SELECT event_id, (list_value('login', 'api', 'usage_limit', 'offline', 'other'))[CAST(event_id % 5 + 1 AS INT)] AS class FROM events WHERE event_type = 'error'")
def classify_error(t):
    said = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 5 + 1).cast("int"))
    return t("events").where("event_type = 'error'").select("event_id", T.classify_error(said).alias("class"))


@query("X14_session_id", "SELECT user_id, left(substr(md5(CAST(user_id AS VARCHAR)), 1, 12), 8) AS session FROM (SELECT DISTINCT user_id FROM events)")
def session_id(t):
    path = F.concat(F.lit("/logs/p/"), F.substring(F.md5(F.col("user_id").cast("string")), 1, 12), F.lit(".jsonl"))
    return t("events").select("user_id").distinct().select("user_id", T.session_id(path).alias("session"))


@query("X15_project_name", "SELECT c_custkey, '-home-' || regexp_replace(c_name, '[^A-Za-z0-9]', '-', 'g') AS project FROM customer")
def project_name(t):
    return t("customer").select("c_custkey", T.project_name(F.concat(F.lit("/home/"), F.col("c_name"))).alias("project"))


@query("X16_signature_problem", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[\r\n]') THEN 'multiline' WHEN turn % 3 = 0 THEN 'padded' END AS problem FROM conversations WHERE length(text) > 0")
def signature_problem(t):
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return t("conversations").where("length(text) > 0").select("conv_id", "turn", T.signature_problem(text).alias("problem"))


@query("X17_compare_versions", "SELECT p_partkey, CAST(CASE WHEN (p_size, p_partkey % 7) > (25, 3) THEN 1 WHEN (p_size, p_partkey % 7) < (25, 3) THEN -1 ELSE 0 END AS BIGINT) AS cmp FROM part")
def compare_versions(t):
    a, b = T.version_key(F.concat_ws(".", F.lit("1"), F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"))), T.version_key(F.lit("1.25.3"))
    return t("part").select("p_partkey", F.when(a > b, 1).when(a < b, -1).otherwise(0).cast("long").alias("cmp"))


@query("X31_version_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS place FROM part")
def version_order(t):
    """The order of releases x.y.z as numbers, by ranges of the order."""
    key = T.version_key(F.concat_ws(".", F.lit("0"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")))
    return numbered(t("part").select("p_partkey", key.alias("key")), "place", "key").select("p_partkey", "place")


@query("X18_url_forms", r"SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/]+/[^/?#]+)$', 1) AS repo, url AS clean FROM pages WHERE regexp_matches(url, '^https?://[^/]+/[^/]+/[^/?#]+$')")
def url_forms(t):
    rows = t("pages").where(F.rlike("url", F.lit(r"\Ahttps?://[^/]+/[^/]+/[^/?#]+\z")))
    return rows.select("page_id", T.repository_of(F.col("url")).alias("repo"), T.without_credentials(F.regexp_replace("url", "://", "://user:pw@")).alias("clean"))


@query("X19_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def sha256(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("X20_json_safe", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_safe(t):
    return t("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("X21_text_blocks", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS said FROM conversations WHERE role = 'user' GROUP BY conv_id")
def text_blocks(t):
    """A message's content as JSON blocks, of which the text ones are joined."""
    block = F.struct(F.when(F.col("role") == "user", "text").otherwise("tool").alias("type"), F.col("text"), F.col("turn"))
    told = t("conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))).alias("content"))
    read = F.filter(F.from_json("content", "array<struct<turn:long,b:struct<type:string,text:string>>>"), lambda x: x["b"]["type"] == "text")
    return told.withColumn("kept", F.transform(read, lambda x: x["b"]["text"])).where(F.size("kept") > 0).select("conv_id", F.array_join("kept", "\n").alias("said"))


@query("X22_page_probe", "SELECT o_custkey, count(*) AS items, count(*) > 12 AS more FROM orders GROUP BY 1")
def page_probe(t):
    """A result page as one JSON object: its items and whether a next page is named."""
    page = F.to_json(F.struct(F.collect_list(F.struct("o_orderkey")).alias("events"), F.when(F.count("*") > 12, "n").alias("nextPageToken")))
    pages = t("orders").groupBy("o_custkey").agg(page.alias("page"))
    v = F.try_parse_json("page")
    items = F.coalesce(F.json_array_length(F.get_json_object("page", "$.events")), F.json_array_length(F.get_json_object("page", "$.files")))
    return pages.select("o_custkey", items.cast("long").alias("items"), (F.coalesce(F.try_variant_get(v, "$.nextPageToken", "string"), F.lit("")) != "").alias("more"))


@query("X24_manifest_check", "SELECT source AS path, CASE WHEN source IS NULL THEN 'path' WHEN count(*) > 1 THEN 'duplicate' END AS problem, count(*) AS n FROM documents GROUP BY source")
def manifest_check(t):
    path = F.col("source")
    shape = F.when(path.isNull() | F.rlike(path, F.lit(r"\A/|\\|(?:\A|/)\.\.?(?:/|\z)|//")), "path")
    return t("documents").groupBy(path.alias("path")).agg(F.count("*").alias("n")).select("path", F.coalesce(F.when(F.col("path").isNull(), "path"), F.when(F.rlike("path", F.lit(r"\A/|\\|(?:\A|/)\.\.?(?:/|\z)|//")), "path"), F.when(F.col("n") > 1, "duplicate")).alias("problem"), "n")


@query("X29_language_resolve", "SELECT doc_id, coalesce(nullif(lang, 'en'), source) AS first_set FROM documents")
def language_resolve(t):
    """The first variable that is set."""
    return t("documents").select("doc_id", F.coalesce(F.nullif("lang", F.lit("en")), "source").alias("first_set"))


@query("X30_path_region", "SELECT p_partkey, regexp_extract(p_name, '^[^ ]*') || '/' AS region FROM part")
def path_region(t):
    return t("part").select("p_partkey", T.literal_prefix(F.concat(F.substring_index("p_name", " ", 1), F.lit("/*.md"))).alias("region"))


@query("X35_state_key", "SELECT s_suppkey, substr(sha256('/vault/' || s_name), 1, 8) AS key FROM supplier")
def state_key(t):
    return t("supplier").select("s_suppkey", T.state_key(F.concat(F.lit("/vault/"), F.col("s_name"))).alias("key"))


_PATH = r"regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def page_paths(t):
    """Pages as files: host and path without scheme, query and fragment."""
    return t("pages").select("page_id", "url", "html", F.regexp_replace(F.regexp_replace("url", r"\Ahttps?://", ""), r"[?#].*\z", "").alias("path"))


@query("F01_reserved", "SELECT part.p_partkey, p_partkey % 5 = 0 OR p_partkey % 5 = 1 AS reserved FROM part")
def reserved(t):
    name = F.element_at(F.array(*map(F.lit, ("index.md", "log.md", "note.md", "index.md.bak", "Log.md"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t("part").select("p_partkey", P.is_reserved(F.concat(F.lit("a/b/"), name)).alias("reserved"))


@query("F02_under_path", f"SELECT page_id, regexp_extract({_PATH}, '^([^/]+)', 1) AS host, {_PATH} LIKE regexp_extract({_PATH}, '^([^/]+)', 1) || '/en/%' OR {_PATH} = regexp_extract({_PATH}, '^([^/]+)', 1) || '/en' AS under FROM pages")
def under_path(t):
    p = page_paths(t).withColumn("host", F.substring_index("path", "/", 1))
    return p.select("page_id", "host", P.is_under(F.col("path"), F.concat("host", F.lit("/en"))).alias("under"))


@query("F03_dot_segment", f"SELECT page_id, regexp_matches({_PATH}, '(^|/)\\.') AS dotted FROM pages".replace("\\\\", "\\"))
def dot_segment(t):
    return page_paths(t).select("page_id", P.has_dot_segment(F.col("path")).alias("dotted"))


@query("F04_never_read", f"SELECT page_id, {_PATH} AS path FROM pages WHERE NOT ({_PATH} LIKE '%/de/%' OR {_PATH} LIKE '%/de')")
def never_read(t):
    """Files that no never-read folder covers: folders above a path, equi-joined, instead of a prefix test for each pair."""
    p = page_paths(t)
    never = p.select(F.explode(F.array(F.concat(F.substring_index("path", "/", 1), F.lit("/de")), F.concat(F.substring_index("path", "/", 1), F.lit("/m/de")))).alias("folder")).distinct()
    above = p.select("page_id", F.explode(F.concat(P.ancestors(F.col("path")), F.array("path"))).alias("folder"))
    return p.join(above.join(never, "folder").select("page_id").distinct(), "page_id", "left_anti").select("page_id", "path")


@query("F05_markdown", "SELECT doc_id, doc_id % 2 = 0 AS markdown FROM documents")
def markdown(t):
    return t("documents").select("doc_id", P.is_markdown(F.concat(F.col("source"), F.when(F.col("doc_id") % 2 == 0, ".Md").otherwise(".mdx"))).alias("markdown"))


@query("P14_link_classes", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT page_id, CASE WHEN regexp_matches(target, '^([a-zA-Z][a-zA-Z0-9+.-]*:|//)') THEN 'external' WHEN target LIKE '#%' THEN 'fragment' ELSE 'internal' END AS class, count(*) AS n FROM l GROUP BY ALL""")
def link_classes(t):
    links = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    cls = F.when(P.is_external(F.col("target")), "external").when(F.startswith("target", F.lit("#")), "fragment").otherwise("internal")
    return links.groupBy("page_id", cls.alias("class")).agg(F.count("*").alias("n"))


@query("P15_resolve_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT page_id, target, trim(target, '/') AS dst FROM l WHERE regexp_matches(target, '^/[^/?#%.+]+$')""")
def resolve_links(t):
    links = page_paths(t).select("page_id", "path", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.where(F.rlike("target", F.lit(r"\A/[^/?#%.+]+\z"))).select("page_id", "target", P.resolve(F.col("path"), P.path_part(F.col("target"))).alias("dst"))


@query("J08_region_overlap", """WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS r FROM part), b AS (SELECT DISTINCT split_part(p_name, ' ', 1) || '/' || split_part(p_name, ' ', 2) AS r FROM part)
SELECT a.r AS a, b.r AS b FROM a JOIN b ON starts_with(b.r, a.r || '/') OR starts_with(a.r, b.r || '/') OR a.r = b.r""")
def region_overlap(t):
    """Regions of which one covers the other: each side's ancestors, equi-joined to the other side."""
    a = t("part").select(F.substring_index("p_name", " ", 1).alias("r")).distinct()
    b = t("part").select(F.concat_ws("/", F.substring_index("p_name", " ", 1), F.element_at(F.split("p_name", " "), 2)).alias("r")).distinct()
    up = lambda x, own, at: x.select(F.col("r").alias(own), F.explode(F.concat(P.ancestors(F.col("r")), F.array("r"))).alias(at))
    one = up(b, "b", "at").join(a.select(F.col("r").alias("a")), F.col("at") == F.col("a")).select("a", "b")
    two = up(a, "a", "at").join(b.select(F.col("r").alias("b")), F.col("at") == F.col("b")).select("a", "b")
    return one.union(two).distinct()
