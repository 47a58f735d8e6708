"""Queries over schemas and business rules as tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import programs as P
from ..sources import adapt


def _orders(spark: SparkSession, d: str, orders: DataFrame | None = None, *keep: str) -> DataFrame:
    """Orders as JSON: members that are missing, of another kind, not declared or out of range, by rules on their key. ``orders``: the
    table, or it with columns to ``keep``. All shuffle partitions are kept: what is done with the JSON costs far more than its bytes tell."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("bigint").alias("qty"), F.col("l_returnflag").alias("flag"))))
    lines = adapt.table(spark, d, "lineitem").repartition(parts, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(items.alias("items"))
    o = (adapt.table(spark, d, "orders") if orders is None else orders).repartition(parts, "o_orderkey").join(lines, "o_orderkey", "left")
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    note = F.when(key % 6 == 0, F.lit("7")).when(key % 3 == 0, F.lit('"seen"'))
    total = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["qty"])
    value = F.struct(
        F.when(key % 19 != 0, key).alias("order_id"), F.round(F.col("o_totalprice")).cast("bigint").alias("total"), F.when(key % 17 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(day).alias("date"), F.col("o_orderpriority").alias("priority"),
        F.transform("items", lambda x: F.struct(x["qty"], F.when(x["l_linenumber"] != 4, x["flag"]).alias("flag"))).alias("items"), F.col("o_orderstatus").alias("status"),
        F.when(key % 9 == 0, total + 1).when(key % 11 != 0, total).alias("sum"), F.when(key % 5 == 0, 1).alias("bonus"), F.when(key % 10 == 0, F.lit("x")).alias("extra"),
    )
    text = F.concat(F.regexp_replace(F.to_json(value), r"\}$", ""), F.coalesce(F.concat(F.lit(',"note":'), note), F.lit("")), F.lit("}"))
    return o.select("o_orderkey", F.col("o_orderstatus").alias("scope"), *keep, text.alias("value"))


#: (path, keyword, argument as an expression of n_nationkey, when the nation's schema has the rule)
_RULES = (
    ("", "type", "'object'", "true"), ("", "required", "'order_id'", "true"), ("", "required", "'note'", "n_nationkey % 5 = 0"), ("", "additionalProperties", "'false'", "n_nationkey % 4 = 0"),
    ("/order_id", "type", "'integer'", "true"), ("/order_id", "minimum", "cast(n_nationkey * 10 as string)", "true"), ("/total", "type", "'number'", "true"), ("/total", "maximum", "cast(100000 + n_nationkey * 2000 as string)", "true"),
    ("/total", "exclusiveMinimum", "cast(1000 * n_nationkey as string)", "n_nationkey % 2 = 1"), ("/date", "format", "'date'", "true"), ("/date", "pattern", "'^199[2-6]'", "n_nationkey % 3 = 0"), ("/priority", "minLength", "'6'", "n_nationkey % 2 = 0"),
    ("/priority", "enum", "'[\"1-URGENT\",\"2-HIGH\",\"5-LOW\"]'", "n_nationkey % 3 = 1"), ("/items", "type", "'array'", "true"), ("/items", "minItems", "'2'", "true"), ("/items", "maxItems", "cast(3 + n_nationkey % 4 as string)", "true"),
    ("/items/*", "required", "'flag'", "true"), ("/items/*/qty", "maximum", "cast(20 + n_nationkey as string)", "true"), ("/items/*/qty", "multipleOf", "'2'", "n_nationkey % 7 = 1"), ("/items/*/flag", "const", "'\"N\"'", "n_nationkey % 6 = 5"),
    ("/note", "type", "'[\"string\",\"null\"]'", "true"),
    *((f"/{f}", "declared", "null", "true") for f in ("order_id", "total", "date", "priority", "items", "note", "status", "sum")), ("/items/*/qty", "declared", "null", "true"), ("/items/*/flag", "declared", "null", "true"),
)


def x14_schema_violations(spark: SparkSession, d: str) -> DataFrame:
    """A schema for each nation, the orders of its customers as values."""
    rules = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(k).alias("keyword"), F.expr(f"cast({a} as string)").alias("argument"), F.expr(w).alias("here")) for p, k, a, w in _RULES))
    r = adapt.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("schema_id"), F.explode(rules).alias("r")).where("r.here").select("schema_id", "r.path", "r.keyword", "r.argument")
    c = adapt.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("schema_id"))
    o = _orders(spark, d, adapt.table(spark, d, "orders").join(c, "o_custkey"), "schema_id")
    return P.violations(P.json_nodes(o, "value", 3, "o_orderkey", "schema_id"), r, "o_orderkey")


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Guided rows: a schema an order, a field a line; some names are blank, some stand twice."""
    x = adapt.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("schema_id"), F.col("l_linenumber").cast("int").alias("ord")).agg(F.min(F.col("l_quantity").cast("int")).alias("q"), F.min("l_returnflag").alias("flag"))
    name = F.when(F.expr("ord = 3 and schema_id % 7 = 0"), " ").when(F.expr("ord = 2 and schema_id % 5 = 0"), "f1").otherwise(F.concat(F.lit("f"), "ord", F.lit(" ")))
    kind = F.element_at(F.array(*map(F.lit, ("string", "number", "integer"))), F.col("ord") % 3 + 1)
    return x.select(
        "schema_id", "ord", name.alias("name"), kind.alias("type"), F.when(F.expr("ord % 2 = 0"), F.concat(F.lit('say "'), "flag", F.lit('"'))).alias("description"), (F.col("flag") == "R").alias("required"),
        F.when(F.expr("ord % 4 = 1"), "date").otherwise(" ").alias("format"), F.when(F.expr("ord % 3 = 0"), "^[a-z]+$").alias("pattern"), F.when(F.expr("ord % 3 = 1"), F.col("q")).alias("minimum"), F.when(F.expr("ord % 3 = 2 and q > 25"), F.col("q")).alias("maximum"),
    )


def _guided(spark: SparkSession, d: str) -> DataFrame:
    return P.field_schemas(adapt.table(spark, d, "orders").select(F.col("o_orderkey").alias("schema_id")), _fields(spark, d))


def s12_guided_schemas(spark: SparkSession, d: str) -> DataFrame:
    return _guided(spark, d).select("schema_id", "problem", F.md5("schema").alias("schema_md5"))


def p05_schema_rules(spark: SparkSession, d: str) -> DataFrame:
    return P.schema_rules(_guided(spark, d).where("schema is not null"), 4)


def s13_schema_faults(spark: SparkSession, d: str) -> DataFrame:
    """The rules of the nations' schemas, some with arguments that are none."""
    n = adapt.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("schema_id"))
    at = lambda p, k, a, w: F.struct(F.lit(p).alias("path"), F.lit(k).alias("keyword"), F.lit(a).alias("argument"), F.expr(w).alias("here"))
    rules = F.array(
        at("", "type", "object", "schema_id % 6 <> 1"), at("/a", "declared", None, "schema_id % 5 <> 2"), at("/a/*", "declared", None, "true"), at("/a", "type", "text", "schema_id % 3 = 0"), at("/a", "type", '["array","null"]', "schema_id % 3 = 1"), at("/a", "minimum", "low", "schema_id % 4 = 0"),
        at("/a", "maximum", "1e3", "true"), at("/a/*", "minLength", "-1", "schema_id % 4 = 1"), at("/a/*", "maxLength", "2.5", "schema_id % 4 = 2"), at("/a", "multipleOf", "0", "schema_id % 4 = 3"), at("/a", "enum", "1,2", "schema_id % 2 = 0"),
    )
    r = n.select("schema_id", F.explode(rules).alias("r")).where("r.here").select("schema_id", "r.path", "r.keyword", "r.argument")
    return P.schema_faults(n, r)


def s11_markdown_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth line of a document heads a field; in some documents the third field has the name of the second."""
    named = lambda x, i: F.concat(F.when(i % 5 == 3, F.concat(F.lit("## f"), F.when((i == 13) & (F.col("doc_id") % 9 == 0), 1).otherwise((i / 5).cast("int")), F.lit("  \n"))).otherwise(""), x)
    m = adapt.table(spark, d, "documents").select(F.col("doc_id").alias("schema_id"), F.array_join(F.transform(F.split(F.replace("text", F.lit("#"), F.lit("+")), "\n"), named), "\n").alias("markdown"))
    return P.field_schemas(m, P.markdown_fields(m)).select("schema_id", "problem", F.md5("schema").alias("schema_md5"))


_VALUE_RULES = (
    ("F", "r1", "equals", ["status"], None, "F", None), ("F", "r2", "sum_equals", ["items.*.qty"], "sum", None, 0.5), ("F", "r3", "less_than_or_equal", ["order_id"], "total", None, None), ("F", "r4", "equals", ["order_id"], None, "33", None),
    ("O", "r5", "sum_equals", ["items.*.qty", "bonus"], "sum", None, None), ("O", "r6", "less_than_or_equal", ["date"], "priority", None, None), ("O", "r7", "equals", ["priority"], None, "5-LOW", None), ("O", "r8", "sum_equals", ["items.*.qty"], "sum", None, 1.0),
    ("P", "r9", "between", ["total"], None, None, None), ("P", "ra", "sum_equals", ["items.*.flag"], "sum", None, None), ("P", "rb", "less_than_or_equal", ["items.*.qty"], "sum", None, None),
)


def p04_value_rules(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    rules = spark.createDataFrame(_VALUE_RULES, "scope string, rule_id string, op string, fields array<string>, target string, value string, tolerance double")
    found = P.operands(P.json_nodes(o, "value", 3, "o_orderkey"), "o_orderkey")
    return P.value_rules(o.select("o_orderkey", "scope"), found, rules, "o_orderkey")


_CONTROL_RULES = (
    ("F", "c1", "exactly_one", ["c1", "c2", "c3"], [], None, None), ("F", "c2", "min_selected", ["c1", "c2", "c3", "c4"], [], None, 2), ("F", "c3", "max_selected", [], ["L0", "L2"], None, None), ("F", "c4", "none_exclusive", ["c1", "c2", "c3"], [], "c1", None),
    ("O", "c5", "mutually_exclusive", ["c8", "c9"], ["L1", "L2"], None, None), ("O", "c6", "none_exclusive", [], ["L1"], "c2", None), ("P", "c7", "any_of", ["c1"], [], None, None), ("P", "c8", "exactly_one", [], ["L7"], None, None),
)


def p04_control_rules(spark: SparkSession, d: str) -> DataFrame:
    """Controls are the lines of an order, checked if returned."""
    o = adapt.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("scope"))
    c = adapt.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.bool_or(F.col("l_returnflag") == "R").alias("checked"))
    c = c.select("o_orderkey", F.concat(F.lit("c"), "l_linenumber").alias("control_id"), F.concat(F.lit("L"), F.col("l_linenumber") % 3).alias("label"), "checked")
    rules = spark.createDataFrame(_CONTROL_RULES, "scope string, rule_id string, op string, ids array<string>, labels array<string>, none_id string, most int")
    return P.control_rules(o, c, rules, "o_orderkey")


QUERIES = {f.__name__: f for f in (x14_schema_violations, s12_guided_schemas, p05_schema_rules, s13_schema_faults, s11_markdown_schemas, p04_value_rules, p04_control_rules)}

_ORDERS = """WITH li AS (SELECT l_orderkey AS o_orderkey, l_linenumber, cast(trunc(l_quantity) AS bigint) AS qty, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, cast(trunc(l_quantity) AS bigint), l_returnflag) - 1 AS pos FROM lineitem),
  n AS (SELECT o_orderkey, count(*) AS n, cast(sum(qty) AS bigint) AS total FROM li GROUP BY 1),
  o AS (SELECT orders.o_orderkey AS k, o_custkey, o_orderstatus AS status, o_orderpriority AS priority, cast(round_even(o_totalprice, 0) AS bigint) AS total_r, cast(round(o_totalprice, 0) AS bigint) AS total, strftime(o_orderdate, '%Y-%m-%d') AS day,
    CASE WHEN orders.o_orderkey % 17 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, n.n AS n, CASE WHEN orders.o_orderkey % 9 = 0 THEN n.total + 1 WHEN orders.o_orderkey % 11 <> 0 THEN n.total END AS sum,
    CASE WHEN orders.o_orderkey % 5 = 0 THEN 1 END AS bonus FROM orders LEFT JOIN n USING (o_orderkey))"""
_X14 = (
    _ORDERS
    + """, s AS (SELECT o.*, c_nationkey AS s FROM o JOIN customer ON c_custkey = o_custkey), i AS (SELECT li.*, s FROM li JOIN s ON k = o_orderkey), v AS (
  SELECT k, '/order_id' AS ppath, 'required' AS keyword, 'order_id' AS argument FROM s WHERE k % 19 = 0 UNION ALL
  SELECT k, '/note', 'required', 'note' FROM s WHERE k % 3 <> 0 AND s % 5 = 0 UNION ALL
  SELECT k, '/extra', 'additionalProperties', 'false' FROM s WHERE k % 10 = 0 AND s % 4 = 0 UNION ALL SELECT k, '/bonus', 'additionalProperties', 'false' FROM s WHERE k % 5 = 0 AND s % 4 = 0 UNION ALL
  SELECT k, '/order_id', 'minimum', cast(s * 10 AS varchar) FROM s WHERE k % 19 <> 0 AND k < s * 10 UNION ALL SELECT k, '/total', 'maximum', cast(100000 + s * 2000 AS varchar) FROM s WHERE total > 100000 + s * 2000 UNION ALL
  SELECT k, '/total', 'exclusiveMinimum', cast(1000 * s AS varchar) FROM s WHERE total <= 1000 * s AND s % 2 = 1 UNION ALL SELECT k, '/date', 'format', 'date' FROM s WHERE k % 17 = 0 UNION ALL
  SELECT k, '/date', 'pattern', '^199[2-6]' FROM s WHERE s % 3 = 0 AND NOT regexp_matches(date, '^199[2-6]') UNION ALL SELECT k, '/priority', 'minLength', '6' FROM s WHERE s % 2 = 0 AND length(priority) < 6 UNION ALL
  SELECT k, '/priority', 'enum', '["1-URGENT","2-HIGH","5-LOW"]' FROM s WHERE s % 3 = 1 AND priority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') UNION ALL
  SELECT k, '/items', 'minItems', '2' FROM s WHERE n < 2 UNION ALL SELECT k, '/items', 'maxItems', cast(3 + s % 4 AS varchar) FROM s WHERE n > 3 + s % 4 UNION ALL
  SELECT o_orderkey, '/items/' || pos || '/flag', 'required', 'flag' FROM i WHERE l_linenumber = 4 UNION ALL SELECT o_orderkey, '/items/' || pos || '/qty', 'maximum', cast(20 + s AS varchar) FROM i WHERE qty > 20 + s UNION ALL
  SELECT o_orderkey, '/items/' || pos || '/qty', 'multipleOf', '2' FROM i WHERE s % 7 = 1 AND qty % 2 <> 0 UNION ALL SELECT o_orderkey, '/items/' || pos || '/flag', 'const', '"N"' FROM i WHERE s % 6 = 5 AND l_linenumber <> 4 AND flag <> 'N' UNION ALL
  SELECT k, '/note', 'type', '["string","null"]' FROM s WHERE k % 6 = 0
) SELECT k AS o_orderkey, ppath, keyword, argument FROM v"""
)
_FIELDS = """WITH x AS (SELECT l_orderkey AS schema_id, cast(l_linenumber AS int) AS ord, min(cast(trunc(l_quantity) AS int)) AS q, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
  f AS (SELECT *, CASE WHEN ord = 2 AND schema_id % 5 = 0 THEN 'f1' ELSE 'f' || ord END AS name, ['string', 'number', 'integer'][ord % 3 + 1] AS type, CASE WHEN ord % 2 = 0 THEN 'say "' || flag || '"' ELSE '' END AS description,
    flag = 'R' AS required, CASE WHEN ord % 4 = 1 THEN 'date' END AS format, CASE WHEN ord % 3 = 0 THEN '^[a-z]+$' END AS pattern, CASE WHEN ord % 3 = 1 THEN q END AS minimum, CASE WHEN ord % 3 = 2 AND q > 25 THEN q END AS maximum
    FROM x WHERE NOT (ord = 3 AND schema_id % 7 = 0)),
  bad AS (SELECT DISTINCT schema_id FROM f GROUP BY schema_id, name HAVING count(*) > 1)"""
_JSON_FIELD = """'"' || name || '":{"type":"' || type || '","description":' || cast(to_json(description) AS varchar) || CASE WHEN format IS NULL THEN '' ELSE ',"format":"' || format || '"' END || CASE WHEN pattern IS NULL THEN '' ELSE ',"pattern":"' || pattern || '"' END
    || CASE WHEN minimum IS NULL THEN '' ELSE ',"minimum":' || minimum || '.0' END || CASE WHEN maximum IS NULL THEN '' ELSE ',"maximum":' || maximum || '.0' END || '}'"""
_CONTROLS = """WITH c AS (SELECT l_orderkey AS k, 'c' || l_linenumber AS id, 'L' || (l_linenumber % 3) AS label, bool_or(l_returnflag = 'R') AS checked FROM lineitem GROUP BY l_orderkey, l_linenumber),
  l AS (SELECT k, label, arg_max(checked, id) AS checked, max(id) AS id FROM c GROUP BY k, label),
  t AS (SELECT o_orderkey AS k, o_orderstatus AS s, coalesce(p.n123, 0) AS n123, coalesce(p.c123, 0) AS c123, coalesce(p.n1234, 0) AS n1234, coalesce(p.c1234, 0) AS c1234, coalesce(p.none1, false) AS none1, coalesce(p.none2, false) AS none2, coalesce(p.n2, 0) AS n2, coalesce(p.c23, 0) AS c23,
      coalesce(q.n02, 0) AS n02, coalesce(q.c02, 0) AS c02, coalesce(q.n12, 0) AS n12, coalesce(q.c12, 0) AS c12, coalesce(q.n1, 0) AS n1, coalesce(q.o1, 0) AS o1, coalesce(p.n8, 0) AS n8, coalesce(p.has1, false) AS has1
    FROM orders LEFT JOIN (SELECT k, count(*) FILTER (WHERE id IN ('c1', 'c2', 'c3')) AS n123, count(*) FILTER (WHERE checked AND id IN ('c1', 'c2', 'c3')) AS c123, count(*) FILTER (WHERE id IN ('c1', 'c2', 'c3', 'c4')) AS n1234, count(*) FILTER (WHERE checked AND id IN ('c1', 'c2', 'c3', 'c4')) AS c1234,
      bool_or(checked AND id = 'c1') AS none1, bool_or(checked AND id = 'c2') AS none2, count(*) FILTER (WHERE id = 'c2') AS n2, count(*) FILTER (WHERE checked AND id IN ('c2', 'c3')) AS c23, count(*) FILTER (WHERE id IN ('c8', 'c9')) AS n8, bool_or(id = 'c1') AS has1 FROM c GROUP BY k) p ON p.k = o_orderkey
    LEFT JOIN (SELECT k, count(*) FILTER (WHERE label IN ('L0', 'L2')) AS n02, count(*) FILTER (WHERE checked AND label IN ('L0', 'L2')) AS c02, count(*) FILTER (WHERE label IN ('L1', 'L2')) AS n12, count(*) FILTER (WHERE checked AND label IN ('L1', 'L2')) AS c12,
      count(*) FILTER (WHERE label = 'L1') AS n1, count(*) FILTER (WHERE label = 'L1' AND checked AND id <> 'c2') AS o1 FROM l GROUP BY k) q ON q.k = o_orderkey)"""
ORACLES = {
    "x14_schema_violations": _X14,
    "s12_guided_schemas": _FIELDS + f""", j AS (SELECT schema_id, '{{"type":"object","properties":{{' || string_agg({_JSON_FIELD}, ',' ORDER BY ord) || '}},"additionalProperties":false' || CASE WHEN bool_or(required) THEN ',"required":["' || string_agg(name, '","' ORDER BY ord) FILTER (WHERE required) || '"]' ELSE '' END || '}}' AS s FROM f GROUP BY schema_id)
        SELECT o_orderkey AS schema_id, CASE WHEN s IS NULL THEN 'no_fields' WHEN bad.schema_id IS NOT NULL THEN 'repeated_field' END AS problem, CASE WHEN bad.schema_id IS NULL THEN md5(s) END AS schema_md5 FROM orders LEFT JOIN j ON j.schema_id = o_orderkey LEFT JOIN bad ON bad.schema_id = o_orderkey""",
    "p05_schema_rules": _FIELDS + """, ok AS (SELECT f.* FROM f SEMI JOIN orders ON o_orderkey = schema_id ANTI JOIN bad USING (schema_id)), ids AS (SELECT DISTINCT schema_id FROM ok)
        SELECT schema_id, '' AS path, 'type' AS keyword, 'object' AS argument FROM ids UNION ALL SELECT schema_id, '', 'additionalProperties', 'false' FROM ids UNION ALL SELECT schema_id, '', 'required', name FROM ok WHERE required UNION ALL
        SELECT schema_id, '/' || name, 'declared', NULL FROM ok UNION ALL SELECT schema_id, '/' || name, 'type', type FROM ok UNION ALL SELECT schema_id, '/' || name, 'description', description FROM ok UNION ALL SELECT schema_id, '/' || name, 'format', format FROM ok WHERE format IS NOT NULL UNION ALL
        SELECT schema_id, '/' || name, 'pattern', pattern FROM ok WHERE pattern IS NOT NULL UNION ALL SELECT schema_id, '/' || name, 'minimum', cast(minimum AS varchar) FROM ok WHERE minimum IS NOT NULL UNION ALL SELECT schema_id, '/' || name, 'maximum', cast(maximum AS varchar) FROM ok WHERE maximum IS NOT NULL""",
    "s13_schema_faults": """SELECT s AS schema_id, path, keyword, fault FROM (SELECT cast(n_nationkey AS int) AS s, unnest([
          {'path': '', 'keyword': 'type', 'fault': 'root_is_no_object', 'here': n_nationkey % 6 = 1}, {'path': '', 'keyword': 'properties', 'fault': 'no_fields', 'here': n_nationkey % 5 = 2}, {'path': '/a', 'keyword': 'type', 'fault': 'unknown_kind', 'here': n_nationkey % 3 = 0},
          {'path': '/a', 'keyword': 'minimum', 'fault': 'not_a_number', 'here': n_nationkey % 4 = 0}, {'path': '/a/*', 'keyword': 'minLength', 'fault': 'not_a_count', 'here': n_nationkey % 4 = 1}, {'path': '/a/*', 'keyword': 'maxLength', 'fault': 'not_a_count', 'here': n_nationkey % 4 = 2},
          {'path': '/a', 'keyword': 'multipleOf', 'fault': 'not_positive', 'here': n_nationkey % 4 = 3}, {'path': '/a', 'keyword': 'enum', 'fault': 'not_a_list', 'here': n_nationkey % 2 = 0}], recursive := true) FROM nation) WHERE here""",
    "s11_markdown_schemas": r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, '#', '+'), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
        g AS (SELECT doc_id, i, line, (i + 2) // 5 AS f FROM l), n AS (SELECT doc_id, f, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g') AS description FROM g WHERE f > 0 GROUP BY 1, 2),
        m AS (SELECT doc_id, f, 'f' || CASE WHEN f = 3 AND doc_id % 9 = 0 THEN 1 ELSE f - 1 END AS name, description FROM n),
        j AS (SELECT doc_id, bool_or(f = 3 AND doc_id % 9 = 0) AS bad, '{"type":"object","properties":{' || string_agg('"' || name || '":{"type":"string","description":' || cast(to_json(description) AS varchar) || '}', ',' ORDER BY f) || '},"additionalProperties":false}' AS s FROM m GROUP BY doc_id)
        SELECT doc_id AS schema_id, CASE WHEN s IS NULL THEN 'no_fields' WHEN bad THEN 'repeated_field' END AS problem, CASE WHEN NOT bad THEN md5(s) END AS schema_md5 FROM documents LEFT JOIN j USING (doc_id)""",
    "p04_value_rules": _ORDERS + """, r AS (
          SELECT k, 'r2' AS rule_id FROM o WHERE status = 'F' AND NOT coalesce(n > 0 AND abs(n_total - sum) <= 0.5, false) UNION ALL SELECT k, 'r3' FROM o WHERE status = 'F' AND NOT (k % 19 <> 0 AND k <= total) UNION ALL SELECT k, 'r4' FROM o WHERE status = 'F' AND k <> 33 UNION ALL
          SELECT k, 'r5' FROM o WHERE status = 'O' AND NOT coalesce((n > 0 OR bonus IS NOT NULL) AND abs(coalesce(n_total, 0) + coalesce(bonus, 0) - sum) <= 0.01, false) UNION ALL SELECT k, 'r6' FROM o WHERE status = 'O' AND NOT date <= priority UNION ALL SELECT k, 'r7' FROM o WHERE status = 'O' AND priority <> '5-LOW' UNION ALL
          SELECT k, 'r8' FROM o WHERE status = 'O' AND NOT coalesce(n > 0 AND abs(n_total - sum) <= 1.0, false) UNION ALL SELECT k, 'ra' FROM o WHERE status = 'P' UNION ALL SELECT k, 'rb' FROM o WHERE status = 'P' AND NOT coalesce(n = 1 AND n_total <= sum, false)
        ) SELECT k AS o_orderkey, rule_id, 'failed' AS problem FROM r UNION ALL SELECT k, 'r9', 'unsupported' FROM o WHERE status = 'P'""".replace("n_total", "(SELECT n.total FROM n WHERE n.o_orderkey = o.k)"),
    "p04_control_rules": _CONTROLS + """ SELECT k AS o_orderkey, rule_id, problem FROM (
          SELECT k, 'c1' AS rule_id, CASE WHEN n123 = 0 THEN 'no_match' WHEN c123 <> 1 THEN 'failed' END AS problem FROM t WHERE s = 'F' UNION ALL SELECT k, 'c2', CASE WHEN n1234 = 0 THEN 'no_match' WHEN c1234 < 2 THEN 'failed' END FROM t WHERE s = 'F' UNION ALL
          SELECT k, 'c3', CASE WHEN n02 = 0 THEN 'no_match' WHEN c02 > 1 THEN 'failed' END FROM t WHERE s = 'F' UNION ALL SELECT k, 'c4', CASE WHEN n123 = 0 THEN 'no_match' WHEN none1 AND c23 > 0 THEN 'failed' END FROM t WHERE s = 'F' UNION ALL
          SELECT k, 'c5', CASE WHEN n8 > 0 THEN NULL WHEN n12 = 0 THEN 'no_match' WHEN c12 > 1 THEN 'failed' END FROM t WHERE s = 'O' UNION ALL
          SELECT k, 'c6', CASE WHEN n2 > 0 THEN NULL WHEN n1 = 0 THEN 'no_match' WHEN none2 AND o1 > 0 THEN 'failed' END FROM t WHERE s = 'O' UNION ALL
          SELECT k, 'c7', CASE WHEN NOT has1 THEN 'no_match' ELSE 'unsupported' END FROM t WHERE s = 'P' UNION ALL SELECT k, 'c8', 'no_match' FROM t WHERE s = 'P') WHERE problem IS NOT NULL""",
}
