"""Text functions over columns: folding, keys, classification, versions, URLs, paths."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)\s"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def without_marks(texts: pd.Series) -> pd.Series:
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c))
    return texts.map(plain, na_action="ignore")


def trim_space(text: Column) -> Column:
    """Unicode white space off both ends; the built-in takes blanks only."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def fold(text: Column) -> Column:
    """White space and control runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\p{Cc}]+", " "))


def normal_question(text: Column) -> Column:
    """Lower case, punctuation and symbols to spaces, runs collapsed; accents stay. The text is taken as composed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}]+", " "), r"(?U)\s+", " "))


def question_id(normal: Column) -> Column:
    return F.concat(F.lit("q-"), F.substring(F.sha2(normal, 256), 1, 8))


def slug(plain: Column) -> Column:
    """From text without marks: lower case, other runs to one dash, null if nothing is left."""
    made = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    return F.when(made != "", made)


def comparable(text: Column) -> Column:
    """Three apostrophes to one, white space runs to one space, lower case."""
    return F.lower(F.regexp_replace(F.translate(text, "’ʼ‘", "'''"), r"(?U)\s+", " "))


def allowed_edits(name: Column) -> Column:
    return F.when(F.length(name) <= 4, 1).otherwise(2)


def line_cost(text: Column) -> Column:
    """UTF-8 bytes, the line end and the marker."""
    return F.octet_length(text) + 13


def truncate(text: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def truncate_units(text: Column, limit: int = 1800, mark: str = "…") -> Column:
    """As `truncate`, by UTF-16 units: a character beyond the basic plane is two and is never split."""
    units = F.encode(text, "UTF-16BE")
    cut = F.substring(units, F.lit(1), F.lit(2 * limit))
    last = F.hex(F.substring(cut, F.lit(2 * limit - 1), F.lit(2)))
    whole = F.when(last.between("D800", "DBFF"), F.substring(cut, F.lit(1), F.lit(2 * limit - 2))).otherwise(cut)
    # Below half the limit no text can be too long.
    return F.when((F.length(text) * 2 > limit) & (F.octet_length(units) > 2 * limit), F.concat(F.decode(whole, "UTF-16BE"), F.lit(mark))).otherwise(text)


def without_paths(text: Column) -> Column:
    """Path tokens cut to their last part."""
    return F.regexp_replace(text, r"(?<![^\s\"'(])(?:~|[A-Za-z]:)?(?:[\\/][^\\/\s\"')]+)*[\\/]([^\\/\s\"')]+)", "$1")


def interpolate(template: Column, values: Column) -> Column:
    """{name} from a map in one pass; unknown names stay."""
    names = F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))
    gaps = F.split(template, r"\{\w+\}", -1)
    shown = F.transform(names, lambda n: F.coalesce(F.element_at(values, n), F.concat(F.lit("{"), n, F.lit("}"))))
    return F.concat(F.get(gaps, F.lit(0)), F.array_join(F.zip_with(shown, F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))), lambda a, b: F.concat(a, b)), ""))


def error_text(text: Column) -> Column:
    """Folded, token-like secrets hidden, the first 300 characters."""
    return F.left(F.regexp_replace(fold(text), r"(?i)(token|key|secret|password)(\s*[=:]\s*)\S+", "$1$2[hidden]"), F.lit(300))


def classify_error(text: Column) -> Column:
    """By the first class whose words it has."""
    has = lambda words: F.rlike(text, F.lit(words))
    return F.when(has(r"(?i)\b401\b|not logged in|log ?in|authentication"), "login").when(has(r"(?i)usage limit|limit reached"), "usage_limit").when(has(r"(?i)\bapi error\b|\b5\d\d\b"), "api").when(has(r"(?i)offline|network|getaddrinfo|timed? ?out"), "offline").otherwise("other")


def session_id(path: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_extract(path, r"([^/]+)\z", 1), r"\.[^.]*\z", ""), F.lit(8))


def project_name(path: Column) -> Column:
    made = F.regexp_replace(path, "[^A-Za-z0-9]", "-")
    return F.when(F.startswith(path, F.lit("/")) & (F.length(made) <= 200), made)


def signature_problem(text: Column) -> Column:
    return F.when(text.isNull(), "not_text").when(trim_space(text) == "", "blank").when(F.rlike(text, F.lit(r"[\r\n]")), "multiline").when(trim_space(text) != text, "padded")


def version_key(version: Column) -> Column:
    """Orders x.y.z with a pre-release below its release; null if it cannot be read."""
    shape = r"\Av?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?\z"
    part = lambda i: F.regexp_extract(version, shape, i)
    pre = part(4)
    # Numeric identifiers are below others and compare as numbers: padded digits under a lower first letter.
    rank = F.transform(F.split(pre, r"\."), lambda x: F.when(F.rlike(x, F.lit(r"\A\d+\z")), F.concat(F.lit("0"), F.lpad(x, 20, "0"))).otherwise(F.concat(F.lit("1"), x)))
    return F.when(F.rlike(version, F.lit(shape)), F.struct(*(part(i).cast("decimal(38,0)").alias(f"v{i}") for i in (1, 2, 3)), (pre == "").alias("release"), rank.alias("pre")))


def repository_of(url: Column) -> Column:
    """owner/name of an https, ssh or scp-like repository URL."""
    return F.nullif(F.regexp_extract(url, r"\A(?:https?://(?:[^/@]*@)?|ssh://(?:[^/@]*@)?|(?:[^/@:]+@))[^/:]+[:/]([^/]+/[^/]+?)(?:\.git)?/?\z", 1), F.lit(""))


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"\A([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1")


def state_key(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 8)


def literal_prefix(glob: Column) -> Column:
    """What stands before the first glob character."""
    return F.regexp_extract(glob, r"\A[^*?\[{]*", 0)


def kind_of(values: Column) -> Column:
    """boolean, number, date or string: the strictest shape that all values of a list have."""
    every = lambda shape: F.forall(values, lambda x: F.rlike(x, F.lit(shape)))
    return F.when(every(r"\A(true|false)\z"), "boolean").when(every(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), "date").when(every(r"\A-?[0-9]+(\.[0-9]+)?\z"), "number").otherwise("string")


def deletions(word: Column) -> Column:
    """The word and what is left of it after one or two deletions, each once."""

    def one(w: Column) -> Column:
        places = F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>"))
        rest = lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))
        return F.transform(places, rest)

    once = one(word)
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, one))))
