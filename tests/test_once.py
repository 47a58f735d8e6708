"""Steps whose rows several joins need: JSON is taken apart once."""

from lectern.operators import programs as P


def test_schema_rules_parse_once(spark):
    s = spark.createDataFrame([(1, '{"type":"object","properties":{"a":{"type":"string"}},"required":["a"]}')], "schema_id int, schema string")
    x = P.schema_rules(s)
    assert x._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    assert sorted(map(tuple, x.collect()), key=str) == sorted([(1, "", "type", "object"), (1, "", "required", "a"), (1, "/a", "declared", None), (1, "/a", "type", "string")], key=str)


def test_violations_and_value_rules_read_nodes_that_are_written(spark):
    rows = spark.createDataFrame([(7, 1, '{"a":5,"b":1}', "x")], "k int, schema_id int, value string, scope string")
    rules = spark.createDataFrame([(1, "/a", "maximum", "3"), (1, "", "required", "c"), (1, "", "additionalProperties", "false"), (1, "/a", "declared", None)], "schema_id int, path string, keyword string, argument string")
    x = P.violations(P.json_nodes(rows, "value", 2, "k", "schema_id"), rules, "k")
    assert "Generate " not in x._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r)[1:3] for r in x.collect()) == [("/a", "maximum"), ("/b", "additionalProperties"), ("/c", "required")]
    asked = spark.createDataFrame([("x", "r", "less_than_or_equal", ["a"], "b", None, None)], "scope string, rule_id string, op string, fields array<string>, target string, value string, tolerance double")
    y = P.value_rules(rows.select("k", "scope"), P.operands(P.json_nodes(rows, "value", 2, "k"), "k"), asked, "k")
    assert "Generate explode(concat" not in y._jdf.queryExecution().optimizedPlan().toString() and [tuple(r) for r in y.collect()] == [(7, "r", "failed")]
