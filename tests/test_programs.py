"""Schemas compiled to rules, and rules joined with JSON values."""

import json
import os
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from lectern.operators import programs as P
from lectern.sources.stage import shared_folder


def schemas_of(spark, texts):
    x = spark.createDataFrame(list(enumerate(texts)), "schema_id int, markdown string")
    return {r.schema_id: (r.problem, r.schema and json.loads(r.schema)) for r in P.field_schemas(x, P.markdown_fields(x)).collect()}


def test_markdown_becomes_a_schema(spark):
    got = schemas_of(spark, ["# Top\n## id\nThe number\nof it\n## date\n", "no headings", "## a\n## a", None, "## 1bad\n### deeper\n## ok.x-y  \n\n text \n"])
    assert got[0][1]["properties"] == {"id": {"type": "string", "description": "The number\nof it"}, "date": {"type": "string", "description": ""}}
    assert got[0][1]["additionalProperties"] is False and "required" not in got[0][1]
    assert [got[k][0] for k in range(5)] == [None, "no_fields", "repeated_field", "no_fields", None]
    assert got[4][1]["properties"] == {"ok.x-y": {"type": "string", "description": "text"}}


def test_guided_rows_become_a_schema(spark):
    rows = [(1, 0, " n ", "number", None, True, " ", "^a", 1.0, None), (1, 1, " ", None, None, True, None, None, None, None), (1, 2, "m", None, "d", None, "date", "", None, 2.5), (2, 0, None, "string", "", False, None, None, None, None), (3, 0, "x", "string", "", False, None, None, None, None), (3, 1, "x ", "string", "", False, None, None, None, None)]
    fields = spark.createDataFrame(rows, "schema_id int, ord int, name string, type string, description string, required boolean, format string, pattern string, minimum double, maximum double")
    got = {r.schema_id: r for r in P.field_schemas(fields.select("schema_id"), fields).collect()}
    assert json.loads(got[1].schema) == {
        "type": "object", "required": ["n"], "additionalProperties": False,
        "properties": {"n": {"type": "number", "description": "", "pattern": "^a", "minimum": 1.0}, "m": {"type": "string", "description": "d", "format": "date", "maximum": 2.5}},
    }
    assert (got[2].problem, got[3].problem) == ("no_fields", "repeated_field")


def test_versions(spark):
    x = spark.createDataFrame([('{"x-schema-version": 3, "$id": "a"}',), ('{"$id": "v2"}',), ("{}",), (None,), ("no json",)], "s string")
    assert [r[0] for r in x.select(P.schema_version(F.col("s"))).collect()] == ["3", "v2", "unversioned", "unversioned", "unversioned"]


SCHEMA = {
    "type": "object", "required": ["id", "lines"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 10, "exclusiveMaximum": 20}, "day": {"type": ["string", "null"], "format": "date"}, "properties": {"enum": ["a", 1, {"k": [2]}]}, "a/b": {"const": 5}, "any": {},
        "lines": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["q"], "properties": {"q": {"type": "number", "multipleOf": 0.5}, "code": {"type": "string", "pattern": "^[A-Z]+$", "minLength": 2, "maxLength": 3}}, "additionalProperties": False}},
    },
}


def kinds_of(v):
    if isinstance(v, bool):
        return {"boolean"}
    if isinstance(v, int):
        return {"integer", "number"}
    if isinstance(v, float):
        return {"number", "integer"} if v == int(v) else {"number"}
    return {{str: "string", list: "array", dict: "object", type(None): "null"}[type(v)]}


def brute(schema, v, at=""):
    """(place, keyword) of what a value breaks, written apart from the operator."""
    out, number = [], isinstance(v, (int, float)) and not isinstance(v, bool)
    wanted = schema.get("type")
    if wanted and not kinds_of(v) & set([wanted] if isinstance(wanted, str) else wanted):
        out.append((at, "type"))
    dumped = lambda x: json.dumps(x, sort_keys=True)
    if "enum" in schema and dumped(v) not in map(dumped, schema["enum"]):
        out.append((at, "enum"))
    if "const" in schema and dumped(v) != dumped(schema["const"]):
        out.append((at, "const"))
    if number:
        tests = {"minimum": lambda a: v < a, "maximum": lambda a: v > a, "exclusiveMaximum": lambda a: v >= a, "exclusiveMinimum": lambda a: v <= a, "multipleOf": lambda a: abs(v / a - round(v / a)) > 1e-9}
        out += [(at, k) for k, t in tests.items() if k in schema and t(schema[k])]
    if isinstance(v, str):
        out += [(at, k) for k, bad in (("minLength", len(v) < schema.get("minLength", 0)), ("maxLength", len(v) > schema.get("maxLength", 10**9)), ("pattern", "pattern" in schema and not re.search(schema["pattern"], v))) if bad]
        if schema.get("format") == "date":
            try:
                date.fromisoformat(v) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", v) else int("x")
            except ValueError:
                out.append((at, "format"))
    if isinstance(v, list):
        out += [(at, k) for k, bad in (("minItems", len(v) < schema.get("minItems", 0)), ("maxItems", len(v) > schema.get("maxItems", 10**9))) if bad]
        for i, x in enumerate(v):
            out += brute(schema.get("items", {}), x, f"{at}/{i}")
    if isinstance(v, dict):
        out += [(f"{at}/{k}", "required") for k in schema.get("required", []) if k not in v]
        for k, x in v.items():
            place = f"{at}/{k.replace('/', '~1')}"
            if k in schema.get("properties", {}):
                out += brute(schema["properties"][k], x, place)
            elif schema.get("additionalProperties") is False:
                out.append((place, "additionalProperties"))
    return out


def test_violations_equal_brute_force(spark):
    rng = random.Random(3)
    loose = [None, True, 3, 12, 19, 20, 12.5, 14.0, "a", "AB", "ABCD", "2024-02-30", "2024-02-29", "2024-1-1", [], {}, {"k": [2]}, 1, 5, [1, 2, 3, 4]]
    line = lambda: {k: rng.choice(loose) for k in ("q", "code", "x") if rng.random() < 0.6}
    values = loose + [{k: ([line() for _ in range(rng.randint(0, 4))] if k == "lines" and rng.random() < 0.8 else rng.choice(loose)) for k in ("id", "day", "properties", "a/b", "any", "lines", "more") if rng.random() < 0.7} for _ in range(150)]
    texts = [(i, 0, json.dumps(v)) for i, v in enumerate(values)] + [(900, 0, "{no json"), (901, 0, None), (902, 1, "{}")]
    docs = spark.createDataFrame(texts, "doc int, schema_id int, value string")
    rules = P.schema_rules(spark.createDataFrame([(0, json.dumps(SCHEMA))], "schema_id int, schema string"))
    got = P.violations(P.json_nodes(docs, "value", 4, "doc", "schema_id"), rules, "doc").collect()
    want = [(i, *x) for i, v in enumerate(values) for x in brute(SCHEMA, v)]
    assert len(want) > 300
    assert sorted((r.doc, r.ppath, r.keyword) for r in got) == sorted(want)


def test_violations_take_each_value_by_itself_in_one_pass(spark):
    """Two values under one key, required and declared names with a slash or a tilde, and an object at the last level."""
    values = [(1, 0, '{"a/b": 1, "x~y": {"q": 1}}'), (1, 0, '{"x~y": {}}'), (2, 0, '{"a/b": 1, "x~y": {"q": 1, "z/": 2}, "c/d": 3}'), (3, 0, "null"), (4, 0, "[]")]
    docs = spark.createDataFrame(values, "doc int, schema_id int, value string")
    schema = {"type": "object", "required": ["a/b"], "additionalProperties": False, "properties": {"a/b": {}, "x~y": {"required": ["q"], "additionalProperties": False, "properties": {"q": {}}}}}
    rules = P.schema_rules(spark.createDataFrame([(0, json.dumps(schema))], "schema_id int, schema string"))
    for depth in (1, 2):
        got = P.violations(P.json_nodes(docs, "value", depth, "doc", "schema_id"), rules, "doc").collect()
        assert sorted((r.doc, r.ppath, r.keyword) for r in got) == [(1, "/a~1b", "required"), (1, "/x~0y/q", "required"), (2, "/c~1d", "additionalProperties"), (2, "/x~0y/z~1", "additionalProperties"), (3, "", "type"), (4, "", "type")], depth


def test_only_what_is_found_is_written(spark):
    """Values meet their rules where they are taken apart: their nodes are neither written nor joined with themselves."""
    docs = spark.range(2000).selectExpr("id as doc", "0 as schema_id", """'{"a":1,"b":[{"c":2},{"c":3}]}' as value""")
    rules = spark.createDataFrame([(0, "", "required", "a"), (0, "/b/*/c", "maximum", "2"), (0, "", "additionalProperties", "false"), (0, "/a", "declared", None), (0, "/b", "declared", None)], "schema_id int, path string, keyword string, argument string")
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    found = P.violations(P.json_nodes(docs, "value", 3, "doc", "schema_id"), rules, "doc")
    assert [spark.read.parquet(f"{folder}/{new}").count() for new in set(os.listdir(folder)) - before] == [2000] == [found.count()]


def test_schemas_that_are_none(spark):
    bad = [{"type": "array"}, {"type": "object", "properties": {}}, {"type": "object", "properties": {"a": {"type": "text", "minimum": "x", "minLength": 1.5, "enum": "z"}}}, {"type": "object", "properties": {"a": {"type": ["string", "null"]}}}]
    s = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(bad)], "schema_id int, schema string")
    got = sorted((r.schema_id, r.path, r.keyword, r.fault) for r in P.schema_faults(s, P.schema_rules(s)).collect())
    assert got == [
        (0, "", "properties", "no_fields"), (0, "", "type", "root_is_no_object"), (1, "", "properties", "no_fields"),
        (2, "/a", "enum", "not_a_list"), (2, "/a", "minLength", "not_a_count"), (2, "/a", "minimum", "not_a_number"), (2, "/a", "type", "unknown_kind"),
    ]


def test_rules_over_values(spark):
    values = [(1, "s", '{"a": 1, "b": 2.5, "t": 3.505, "items": [{"p": 1}, {"p": 2}, {"q": 0}, 5], "n": 3, "x": "u", "y": "v"}'), (2, "s", "{}"), (3, "other", "{}")]
    docs = spark.createDataFrame(values, "doc int, scope string, value string")
    rules = [
        ("adds", "sum_equals", ["a", "b"], "t", None, None), ("exact", "sum_equals", ["a", "b"], "t", None, 0.001), ("items", "sum_equals", ["items.*.p"], "n", None, None), ("words", "sum_equals", ["x"], "n", None, None),
        ("is", "equals", ["a"], None, "1.0", None), ("text", "equals", ["x"], None, "u", None), ("less", "less_than_or_equal", ["a"], "b", None, None), ("letters", "less_than_or_equal", ["x"], "y", None, None), ("mixed", "less_than_or_equal", ["x"], "a", None, None),
        ("many", "less_than_or_equal", ["items.*.p"], "n", None, None), ("odd", "between", ["a"], None, None, None),
    ]
    r = spark.createDataFrame([("s", *x) for x in rules], "scope string, rule_id string, op string, fields array<string>, target string, value string, tolerance double")
    found = P.operands(P.json_nodes(docs, "value", 3, "doc"), "doc")
    got = {(x.doc, x.rule_id): x.problem for x in P.value_rules(docs.select("doc", "scope"), found, r, "doc").collect()}
    assert {k[1] for k, v in got.items() if k[0] == 1 and v == "failed"} == {"exact", "words", "mixed", "many"}
    assert got[1, "odd"] == "unsupported" and len([k for k in got if k[0] == 2]) == len(rules) and not [k for k in got if k[0] == 3]


@pytest.mark.parametrize("checked, fails", [(set(), {"one", "least"}), ({"a"}, {"least"}), ({"a", "b"}, {"one", "most", "apart", "none"}), ({"b"}, {"least"}), ({"b", "c"}, {"one", "most", "apart"})])
def test_rules_over_controls(spark, checked, fails):
    c = spark.createDataFrame([(1, k, k.upper(), k in checked) for k in "abc"], "doc int, control_id string, label string, checked boolean")
    rules = [
        ("one", "exactly_one", ["a", "b", "c"], [], None, None), ("least", "min_selected", ["a", "b", "c"], [], None, 2), ("most", "max_selected", ["zz"], ["A", "B", "C"], None, None), ("apart", "mutually_exclusive", ["a", "b", "c"], ["A"], None, None),
        ("none", "none_exclusive", ["a", "b"], [], "a", None), ("gone", "exactly_one", ["zz"], ["ZZ"], None, None), ("odd", "odd", ["a"], [], None, None),
    ]
    r = spark.createDataFrame([("s", *x) for x in rules], "scope string, rule_id string, op string, ids array<string>, labels array<string>, none_id string, most int")
    docs = spark.createDataFrame([(1, "s")], "doc int, scope string")
    got = {x.rule_id: x.problem for x in P.control_rules(docs, c, r, "doc").collect()}
    assert got == {f: "failed" for f in fails} | {"gone": "no_match", "odd": "unsupported"}
