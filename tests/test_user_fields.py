"""Settings as a table give the findings of the rules that take them one by one."""

from tests.test_rule_lines import CASES, CONFIG
from tidemark.operators import rules as R
from tidemark.operators import user_fields as U

RULES = ["required-fields", "forbidden-fields", "type-enum", "extension-fields"]


def table(spark, config):
    rows = [("required", x, None, None) for x in config["required"]] + [("forbidden", x, None, None) for x in config["forbidden"]] + [("type", x, None, None) for x in config["types"]]
    return spark.createDataFrame(rows + [("extension", k, s["kind"], s.get("options")) for k, s in config["extensions"].items()], U.SETTINGS)


def test_findings_are_those_of_the_rules(spark):
    files = [(f"{i}/{p}", t) for i, (_, fs, _) in enumerate(CASES) for p, t in fs.items()]
    files += [("x.md", "---\ntitle: [a, b]\ntags:\n  - x\nsize: {a: 1}\ntype: [q]\n---\n"), ("y.md", "---\ntitle: ''\ntags: []\nflag:\n  - true\n---\n"), ("index.md", "---\nsecret: 1\n---\n")]
    c = R.Context(spark.createDataFrame(files, "path string, text string").coalesce(2), CONFIG).staged()
    want = [tuple(r) for rule in RULES for r in R.RULES[rule](c).select("id", "check", "level", "file", "line").collect()]
    got = [tuple(r) for r in U.user_fields(c, table(spark, CONFIG)).select("id", "check", "level", "file", "line").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {x[0] for x in got} == set(RULES)
    none = U.user_fields(c, table(spark, CONFIG).where("false"))
    assert none.count() == 0


def test_settings_that_say_nothing(spark):
    rows = [("required", "a", None, None), ("what", "a", None, None), ("type", " ", None, None), ("extension", "x", "colour", None), ("extension", "y", "enum", []), ("extension", "z", "enum", ["a"]), (None, None, None, None)]
    got = U.problems(spark.createDataFrame(rows, U.SETTINGS)).collect()
    assert sorted((r.setting or "", r.problem) for r in got) == [("", "unknown setting"), ("extension", "no options"), ("extension", "unknown kind"), ("type", "no name"), ("what", "unknown setting")]
