"""Schemas and business rules as tables: JSON values as rows, and joins of these with rows of rules.

A JSON value becomes one row for each of its nodes, in the row of its document, without a
shuffle. A schema is a table (schema_id, path, keyword, argument); field definitions, guided
rows and Markdown sections are compiled to a schema's text, a schema's text to such rows.
Validation and business rules are joins on (schema or rule, path), so neither the number of
schemas nor that of rules or fields enters a plan.

Paths are those of JSON Pointer, with ``*`` for the items of an array (``/items/*/price``).
Defined cases: a text that is no JSON has no nodes and no violations; null arguments hold
for every value; keywords that are not listed here are passed over, as unknown ones are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.stage import written

#: Headings that name a field, the dialect of compiled schemas, kinds of JSON values, formats that are checked.
FIELD_HEADING = r"(?m)^##\s+([A-Za-z_][A-Za-z0-9_.-]*)\s*$"
KINDS = ("array", "boolean", "integer", "null", "number", "object", "string")
DATE, DATE_TIME = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
#: Keywords with a number as their argument, and those with a whole number of 0 or more.
NUMBERS, COUNTS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"), ("minLength", "maxLength", "minItems", "maxItems")
#: Fixed value: how far a sum may be from its target.
TOLERANCE = 0.01


def _escaped(name: Column) -> Column:
    """A member's name as a segment of a path."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _leaf() -> Column:
    return F.col("members").isNull() & F.col("items").isNull()


def _shape() -> Column:
    """What kind of leaf a node (members, items, v) is, in Spark's words."""
    return F.when(_leaf(), F.schema_of_variant("v"))


def _kind() -> Column:
    """The kind of a node (members, items, _s: its shape)."""
    shape = F.col("_s")
    named = F.when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").when(shape == "BIGINT", "integer").otherwise("number")
    return F.when(F.col("members").isNotNull(), "object").when(F.col("items").isNotNull(), "array").otherwise(named)


def _size() -> Column:
    """Items, members or characters of a node (members, items, _s, text)."""
    return F.when(F.col("members").isNotNull(), F.size("members")).when(F.col("items").isNotNull(), F.col("items")).when(F.col("_s") == "STRING", F.length("text"))


def json_nodes(rows: DataFrame, value: str, depth: int, *keep: str) -> DataFrame:
    """(keep, ppath, path, parent, parent_path, name, members, items, v, kind, text, json, size): the nodes of the JSON in ``value``, down
    to ``depth`` below its root. ``ppath`` has the places of array items, ``path`` a star; ``members`` are the names of an object's
    members, ``items`` counts those of an array, ``v`` is the node itself; ``text`` is a leaf's value, ``json`` that of any node;
    ``size`` counts items, members or characters.

    A level at a time, all in one pass over the rows: the nodes of the last level give themselves and what is in them, those above only
    themselves. The plan grows with ``depth``."""
    none, unnamed = F.array().cast("array<variant>"), F.lit(None).cast("string")
    at = ["ppath", "path", "parent", "parent_path", "name"]
    state = [*keep, *at, "_level"]
    x = rows.select(*keep, F.try_parse_json(value).alias("v"), *(F.lit("").alias(c) for c in at[:2]), *(unnamed.alias(c) for c in at[2:]), F.lit(0).alias("_level"), F.lit(None).cast("array<string>").alias("members"), F.lit(None).cast("int").alias("items"))
    x = x.where("v is not null") if depth == 0 else x
    for d in range(depth + 1):
        last = lambda c: F.when(F.col("_level") == d, c)  # noqa: E731, B023
        x = x.select(*state, "v", "members", "items", last(F.col("v").try_cast("map<string,variant>")).alias("_m"), last(F.col("v").try_cast("array<variant>")).alias("_a"))
        items = F.coalesce(F.when(F.col("_a").isNotNull(), F.size("_a")), "items")
        x = x.select(*state, "v", F.coalesce(F.map_keys("_m"), "members").alias("members"), items.alias("items"), F.coalesce(F.map_values("_m"), "_a", none).alias("_in"))
        if d == depth:
            break
        x = x.select(*state, "members", "items", F.posexplode(F.when(F.col("v").isNotNull(), F.concat(F.array("v"), "_in"))).alias("_i", "v"))
        name = F.coalesce(_escaped(F.element_at("members", F.col("_i"))), (F.col("_i") - 1).cast("string"))
        x = x.select(*state, "members", "items", "v", (F.col("_i") == 0).alias("_own"), F.when(F.col("_i") > 0, name).alias("_n"))
        own, n = F.col("_own"), F.coalesce("_n", F.lit(""))
        x = x.select(
            *keep, F.when(own, F.col("ppath")).otherwise(F.concat("ppath", F.lit("/"), n)).alias("ppath"), F.when(own, F.col("path")).otherwise(F.concat("path", F.lit("/"), F.when(F.col("members").isNull(), "*").otherwise(n))).alias("path"),
            F.when(own, F.col("parent")).otherwise(F.col("ppath")).alias("parent"), F.when(own, F.col("parent_path")).otherwise(F.col("path")).alias("parent_path"), F.when(own, F.col("name")).otherwise(F.col("_n")).alias("name"),
            F.when(own, F.col("_level")).otherwise(d + 1).alias("_level"), "v", F.when(own, F.col("members")).alias("members"), F.when(own, F.col("items")).alias("items"),
        )
    x = x.select(*keep, *at, "members", "items", "v", _shape().alias("_s"), F.when(_leaf(), F.col("v").try_cast("string")).alias("text"))
    return x.select(*keep, *at, "members", "items", "v", _kind().alias("kind"), "text", F.to_json("v").alias("json"), _size().alias("size"))


def _json_places(rows: DataFrame, value: str, depth: int, *keep: str) -> DataFrame:
    """(keep, ppath, text, json) of ``json_nodes``, by arrays in arrays: slower, but the plan stays short for texts of many levels."""
    none = F.array().cast("array<struct<ppath:string,v:variant>>")
    node = lambda n, name, v: F.struct(F.concat(n["ppath"], F.lit("/"), name).alias("ppath"), v.alias("v"))

    def below(n: Column) -> Column:
        members = F.transform(F.map_entries(n["v"].try_cast("map<string,variant>")), lambda e: node(n, _escaped(e["key"]), e["value"]))
        items = F.transform(n["v"].try_cast("array<variant>"), lambda x, i: node(n, i.cast("string"), x))
        return F.coalesce(members, items, none)

    x = rows.select(*keep, F.try_parse_json(value).alias("_v")).where("_v is not null")
    x = x.select(*keep, F.array(F.struct(F.lit("").alias("ppath"), F.col("_v").alias("v"))).alias("_l0"))
    for d in range(1, depth + 1):
        x = x.withColumn(f"_l{d}", F.flatten(F.transform(f"_l{d - 1}", below)))
    x = x.select(*keep, F.explode(F.concat(*(f"_l{d}" for d in range(depth + 1)))).alias("n")).select(*keep, "n.ppath", F.to_json("n.v").alias("json"), F.col("n.v").alias("v"))
    return x.select(*keep, "ppath", F.when(~F.substr("json", F.lit(1), F.lit(1)).isin("{", "["), F.col("v").try_cast("string")).alias("text"), "json")


def markdown_fields(schemas: DataFrame) -> DataFrame:
    """(schema_id, ord, name, type, description) of Markdown schemas: a text field for each heading, described by what stands below it."""
    plain = FIELD_HEADING.replace("(", "(?:", 2).replace("(?:?m)", "(?m)")
    names = F.regexp_extract_all("markdown", F.lit(FIELD_HEADING), 1)
    below = F.split("markdown", plain, -1)
    x = schemas.select("schema_id", names.alias("names"), below.alias("below")).where(F.size("names") > 0)
    x = x.select("schema_id", F.posexplode("names").alias("ord", "name"), "below")
    return x.select("schema_id", "ord", "name", F.lit("string").alias("type"), strip(F.element_at("below", F.col("ord") + 2)).alias("description"))


def field_schemas(ids: DataFrame, fields: DataFrame) -> DataFrame:
    """(schema_id, problem, schema): the JSON Schema of the fields (ord, name, type, description, and as far as there are such columns
    required, format, pattern, minimum, maximum) of each of ``ids``. Blank names are passed over; a name that stands twice, or no
    field at all, is a problem, and there is no schema. Blank formats and patterns, and an empty list of required fields, are left out."""
    has = lambda c, t: F.col(c).cast(t) if c in fields.columns else F.lit(None).cast(t)
    filled = lambda c: F.nullif(strip(has(c, "string")), F.lit(""))
    definition = F.struct(
        F.coalesce(has("type", "string"), F.lit("string")).alias("type"), F.coalesce(has("description", "string"), F.lit("")).alias("description"), filled("format").alias("format"), filled("pattern").alias("pattern"),
        has("minimum", "double").alias("minimum"), has("maximum", "double").alias("maximum"),
    )
    x = fields.select("schema_id", "ord", strip(F.col("name")).alias("name"), F.coalesce(has("required", "boolean"), F.lit(False)).alias("required"), definition.alias("definition")).where("name <> ''")
    one = x.groupBy("schema_id", "name").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), F.min_by("definition", "ord").alias("definition"), F.min_by("required", "ord").alias("required"))
    listed = one.groupBy("schema_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "name", "definition", "required"))).alias("f"))
    whole = F.struct(
        F.lit("object").alias("type"), F.map_from_entries(F.transform("f", lambda f: F.struct(f["name"], f["definition"]))).alias("properties"), F.lit(False).alias("additionalProperties"),
        F.when(F.exists("f", lambda f: f["required"]), F.transform(F.filter("f", lambda f: f["required"]), lambda f: f["name"])).alias("required"),
    )
    problem = F.when(F.col("n").isNull(), "no_fields").when(F.col("n") > 1, "repeated_field")
    return ids.select("schema_id").distinct().join(listed, "schema_id", "left").select("schema_id", problem.alias("problem"), F.when(problem.isNull(), F.to_json(whole)).alias("schema"))


def schema_version(schema: Column) -> Column:
    """The version that a schema's text names, else "unversioned"."""
    named = lambda key: F.nullif(F.try_variant_get(F.try_parse_json(schema), f"$['{key}']", "string"), F.lit(""))
    return F.coalesce(named("x-schema-version"), named("$id"), F.lit("unversioned"))


def schema_rules(schemas: DataFrame, depth: int = 12) -> DataFrame:
    """(schema_id, path, keyword, argument) of the schemas' texts: a row a keyword, several for required names, and "declared" for every
    property. Arguments are plain text, lists and objects JSON. ``depth`` counts the levels of the schema's text."""
    n = _json_places(schemas, "schema", depth, "schema_id")

    def step(a: Column, seg: Column) -> Column:
        make = lambda path, mode, word: F.struct(path.alias("path"), F.lit(mode).alias("mode"), word.alias("word"))
        none = F.lit(None).cast("string")
        return (
            F.when(a["mode"] == 1, make(F.concat(a["path"], F.lit("/"), seg), 0, none))
            .when((a["mode"] == 0) & (seg == "properties"), make(a["path"], 1, none)).when((a["mode"] == 0) & (seg == "items"), make(F.concat(a["path"], F.lit("/*")), 0, none))
            .when(a["mode"] == 0, make(a["path"], 2, seg)).otherwise(make(a["path"], 3, a["word"]))
        )

    start = F.struct(F.lit("").alias("path"), F.lit(0).alias("mode"), F.lit(None).cast("string").alias("word"))
    x = n.withColumn("at", F.aggregate(F.filter(F.split("ppath", "/"), lambda s: s != ""), start, step))
    mode, word = F.col("at.mode"), F.col("at.word")
    keyword = F.when((mode == 2) & (word != "required"), word).when((mode == 3) & (word == "required"), "required").when((mode == 0) & (F.col("at.path") != ""), "declared")
    argument = F.when(mode == 2, F.coalesce("text", "json")).when(mode == 3, F.col("text"))
    return x.select("schema_id", "at.path", keyword.alias("keyword"), argument.alias("argument")).where("keyword is not null")


def schema_faults(ids: DataFrame, rules: DataFrame) -> DataFrame:
    """(schema_id, path, keyword, fault): what a schema may not be: without fields, at its root no object, with kinds or arguments that there are not."""
    number, listed = F.col("argument").try_cast("double"), F.from_json("argument", "array<string>")
    kinds = F.when(F.startswith("argument", F.lit("[")), listed).otherwise(F.array("argument"))
    fault = (
        F.when((F.col("keyword") == "type") & ~F.coalesce(F.forall(kinds, lambda k: k.isin(*KINDS)), F.lit(False)), "unknown_kind")
        .when(F.col("keyword").isin(*NUMBERS) & number.isNull(), "not_a_number").when((F.col("keyword") == "multipleOf") & (number <= 0), "not_positive")
        .when(F.col("keyword").isin(*COUNTS) & ~F.coalesce((number >= 0) & (number == F.floor(number)), F.lit(False)), "not_a_count")
        .when((F.col("keyword") == "enum") & ~F.startswith("argument", F.lit("[")), "not_a_list")
    )
    own = rules.withColumn("fault", fault).where("fault is not null").select("schema_id", "path", "keyword", "fault")
    root = rules.where("path = '' and keyword = 'type' and argument = 'object'").select("schema_id")
    fields = rules.where(F.col("keyword").eqNullSafe("declared") & F.col("path").rlike("^/[^/]*$")).select("schema_id")
    lacks = lambda have, word, name: ids.select("schema_id").distinct().join(have.distinct(), "schema_id", "left_anti").select("schema_id", F.lit("").alias("path"), F.lit(word).alias("keyword"), F.lit(name).alias("fault"))
    return own.unionByName(lacks(root, "type", "root_is_no_object")).unionByName(lacks(fields, "properties", "no_fields"))


#: Keywords that a node breaks by its kind or its items, by the value of a leaf, and all that it breaks by itself.
_BY_KIND, _BY_TEXT = ("type", "minItems", "maxItems"), ("pattern", "format", "minLength", "maxLength", *NUMBERS)
_OWN = (*_BY_KIND, *_BY_TEXT, "enum", "const")


def _breaks() -> Column:
    """Whether a node (kind, text, size, v) breaks the rule (keyword, argument, and what ``violations`` has read from it) of its path."""
    kind, word, arg = F.col("kind"), F.col("keyword"), F.col("argument")
    v, a = F.col("text").try_cast("double"), F.col("number")
    number, text, size = kind.isin("integer", "number"), kind == "string", F.col("size")
    kinds = F.col("kinds")
    in_kind = F.array_contains(kinds, kind) | ((kind == "integer") & F.array_contains(kinds, "number")) | ((kind == "number") & F.array_contains(kinds, "integer") & (v == F.floor(v)))
    listed = F.array_contains("listed", F.to_json("v"))
    steps = v / a
    no_date = ~F.col("text").rlike(DATE) | F.try_to_date("text", "yyyy-MM-dd").isNull()
    no_time = ~F.col("text").rlike(DATE_TIME) | F.try_to_timestamp("text").isNull()
    wrong_format = F.when(arg == "date", no_date).when(arg == "date-time", no_time).when(arg == "email", ~F.contains("text", F.lit("@"))).otherwise(False)
    cases = {
        "type": ~in_kind, "enum": ~listed, "const": ~listed, "pattern": text & ~F.rlike(F.col("text"), arg), "format": text & wrong_format,
        "minLength": text & (size < a), "maxLength": text & (size > a), "minItems": (kind == "array") & (size < a), "maxItems": (kind == "array") & (size > a),
        "minimum": number & (v < a), "maximum": number & (v > a), "exclusiveMinimum": number & (v <= a), "exclusiveMaximum": number & (v >= a), "multipleOf": number & (F.abs(steps - F.round(steps)) > 1e-9),
    }
    out = F
    for name in _OWN:
        out = out.when(word == name, cases[name])
    return F.coalesce(out, F.lit(False))


def violations(nodes: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    """(keys, ppath, keyword, argument): every rule that a value breaks, at the node that breaks it (for required and
    additionalProperties: at the member that is missing or not declared). ``nodes``: json_nodes with schema_id and the ``keys`` of
    a value among the columns kept; ``rules``: schema_rules.

    One pass over the nodes: an object has the names of its members, and a rule what was read from its argument and, where it lets in
    no other members, the names declared there. Of a node only what its rule looks at is worked out. What is found is written once."""
    word, arg, path = F.col("keyword"), F.col("argument"), F.col("path")
    declared, closed = word == "declared", (word == "additionalProperties") & (arg == "false")
    name = F.replace(F.replace(F.substring_index(path, "/", -1), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    r = rules.where(word.isin(*_OWN, "required") | closed | (declared & (path != "")))
    r = r.withColumn("_owner", F.when(declared, F.regexp_replace(path, "/[^/]*$", "")).otherwise(path))
    r = r.withColumn("names", F.collect_set(F.when(declared, name)).over(Window.partitionBy("schema_id", "_owner"))).where(~declared)
    as_list = F.startswith(arg, F.lit("["))
    listed = F.when(word == "enum", F.transform(F.try_parse_json(arg).try_cast("array<variant>"), lambda x: F.to_json(x))).when(word == "const", F.array(F.to_json(F.try_parse_json(arg))))
    r = r.select(
        "schema_id", "path", "keyword", "argument", F.when(closed, F.col("names")).alias("names"), listed.alias("listed"),
        F.when(word == "type", F.when(as_list, F.from_json(arg, "array<string>")).otherwise(F.array(arg))).alias("kinds"), arg.try_cast("double").alias("number"),
    )
    member = (
        F.when(word == "required", F.when(~F.array_contains("members", arg), F.array(arg))).when(word == "additionalProperties", F.array_except("members", "names"))
        .when(_breaks(), F.array(F.lit(None).cast("string")))
    )
    x = nodes.join(r, ["schema_id", "path"]).select(*keys, "ppath", "keyword", "argument", "names", "listed", "kinds", "number", "members", "items", "v")
    x = x.select("*", F.when(word.isin(*_BY_KIND, *_BY_TEXT), _shape()).alias("_s"))
    x = x.select("*", F.when(word.isin(*_BY_KIND, *_BY_TEXT), _kind()).alias("kind"))
    read = (word.isin(*_BY_TEXT) & _leaf()) | ((word == "type") & (F.col("kind") == "number"))
    x = x.select("*", F.when(read, F.col("v").try_cast("string")).alias("text"))
    x = x.select("*", _size().alias("size"))
    x = x.select(*keys, "ppath", "keyword", "argument", F.explode(member).alias("_member"))
    place = F.when(F.col("_member").isNull(), F.col("ppath")).otherwise(F.concat("ppath", F.lit("/"), _escaped(F.col("_member"))))
    return written(x.select(*keys, place.alias("ppath"), "keyword", "argument"), "violations")


def operands(nodes: DataFrame, *keys: str) -> DataFrame:
    """(keys, field, kind, text, number): what a rule's field names: a member of the value ("total"), or that of all objects in a list ("items.*.price")."""
    x = nodes.where(F.col("path").rlike(r"^/[^/]+$") | (F.col("path").rlike(r"^/[^/]+/\*/[^/]+$") & ~F.endswith("parent_path", F.lit("/*/*"))))
    field = F.replace(F.substr("path", F.lit(2)), F.lit("/"), F.lit("."))
    return x.select(*keys, field.alias("field"), "kind", F.coalesce("text", "json").alias("text"), F.when(F.col("kind").isin("integer", "number"), F.col("text").try_cast("double")).alias("number"))


def value_rules(documents: DataFrame, found: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule_id, problem) of every document and rule that fails it. ``rules``: rule_id, op, fields (array), target, value,
    tolerance, and for which documents by ``scope`` (a column of ``documents``):

    equals: the one field has the value; sum_equals: the fields' numbers add up to the target's one number; less_than_or_equal:
    the field's one value is at most the target's. Fields that are not there, that stand several times where one is asked for, or
    whose values cannot be compared, fail. Any other op is "unsupported". ``found`` is written once."""
    found = written(found, "operands")
    r = rules.withColumn("tolerance", F.coalesce("tolerance", F.lit(TOLERANCE)))
    asked = documents.select(*keys, "scope").join(r, "scope").drop("scope")
    part = asked.select(*keys, "rule_id", F.explode("fields").alias("field")).join(found, [*keys, "field"])
    parts = part.groupBy(*keys, "rule_id").agg(F.count("*").alias("n"), F.count("number").alias("n_numbers"), F.sum("number").alias("total"), F.min("kind").alias("kind"), F.min("text").alias("text"), F.min("number").alias("number"))
    aim = asked.where("target is not null").select(*keys, "rule_id", F.col("target").alias("field")).join(found, [*keys, "field"])
    aims = aim.groupBy(*keys, "rule_id").agg(F.count("*").alias("t_n"), F.min("kind").alias("t_kind"), F.min("text").alias("t_text"), F.min("number").alias("t_number"))
    x = asked.join(parts, [*keys, "rule_id"], "left").join(aims, [*keys, "rule_id"], "left")
    one = (F.col("n") == 1) & (F.col("t_n") == 1)
    equal = F.when(F.col("number").isNotNull(), F.col("number") == F.col("value").try_cast("double")).otherwise(F.col("text") == F.col("value"))
    adds = (F.col("n") > 0) & (F.col("n_numbers") == F.col("n")) & (F.col("t_n") == 1) & (F.abs(F.col("total") - F.col("t_number")) <= F.col("tolerance"))
    below = one & F.when(F.col("number").isNotNull() & F.col("t_number").isNotNull(), F.col("number") <= F.col("t_number")).when((F.col("kind") == "string") & (F.col("t_kind") == "string"), F.col("text") <= F.col("t_text"))
    ok = F.when(F.col("op") == "equals", (F.col("n") == 1) & equal).when(F.col("op") == "sum_equals", adds).when(F.col("op") == "less_than_or_equal", below)
    problem = F.when(~F.col("op").isin("equals", "sum_equals", "less_than_or_equal"), "unsupported").when(~F.coalesce(ok, F.lit(False)), "failed")
    return x.select(*keys, "rule_id", problem.alias("problem")).where("problem is not null")


def control_rules(documents: DataFrame, controls: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule_id, problem) of every document and rule over its controls (control_id, label, checked) that fails it. ``rules``:
    rule_id, op, ids and labels (arrays), none_id, most (minimum or maximum, 1 if null), scope. A rule looks at the controls with
    its ids, or if there are none at those with its labels; "no_match" if there are none either. An op is exactly_one, min_selected,
    max_selected, mutually_exclusive or none_exclusive (a checked none_id and another one); any other is "unsupported"."""
    ids = F.when((F.col("op") == "none_exclusive") & (F.size("ids") == 0), F.array("none_id")).otherwise(F.col("ids"))
    asked = documents.select(*keys, "scope").join(rules, "scope").drop("scope").withColumn("ids", ids)
    c = controls.select(*keys, "control_id", "label", "checked")
    by_id = asked.select(*keys, "rule_id", "none_id", F.posexplode("ids").alias("at", "control_id")).join(c, [*keys, "control_id"]).withColumn("way", F.lit(0))
    last = c.groupBy(*keys, "label").agg(F.max_by(F.struct("control_id", "checked"), "control_id").alias("l")).select(*keys, "label", "l.*")
    by_label = asked.select(*keys, "rule_id", "none_id", F.posexplode("labels").alias("at", "label")).join(last, [*keys, "label"]).withColumn("way", F.lit(1))
    way = F.col("way")
    is_none = F.col("control_id").eqNullSafe(F.col("none_id"))
    count = lambda w, c: F.count_if((way == w) & c)
    both = by_id.unionByName(by_label, allowMissingColumns=True)
    n = both.groupBy(*keys, "rule_id").agg(*(f.alias(f"{name}{w}") for w in (0, 1) for name, f in (("n", count(w, F.lit(True))), ("c", count(w, F.col("checked"))), ("o", count(w, F.col("checked") & ~is_none)))))
    pick = lambda name: F.coalesce(F.when(F.col("n0") > 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")), F.lit(0))
    none = c.where("checked").select(*keys, F.col("control_id").alias("none_id"), F.lit(True).alias("none_checked")).distinct()
    x = asked.join(n, [*keys, "rule_id"], "left").join(none, [*keys, "none_id"], "left").withColumns({"seen": pick("n"), "on": pick("c"), "others": pick("o"), "most": F.coalesce("most", F.lit(1))})
    ok = (
        F.when(F.col("op") == "exactly_one", F.col("on") == 1).when(F.col("op") == "min_selected", F.col("on") >= F.col("most")).when(F.col("op") == "max_selected", F.col("on") <= F.col("most"))
        .when(F.col("op") == "mutually_exclusive", F.col("on") <= 1).when(F.col("op") == "none_exclusive", ~F.coalesce("none_checked", F.lit(False)) | (F.col("others") == 0))
    )
    problem = F.when(F.col("seen") == 0, "no_match").when(ok.isNull(), "unsupported").when(~ok, "failed")
    return x.select(*keys, "rule_id", problem.alias("problem")).where("problem is not null")
