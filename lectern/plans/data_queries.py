"""Queries over usage, adjudication, evaluation, links, sources and jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import adjudicate as A
from ..operators import control as C
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import layout as L
from ..operators import usage as U
from ..sources import adapt
from ..sources.adapt import BLOCKS_SQL, USAGE_SQL
from .layout_queries import TYPED_SQL

STAGES = ("click", "view", "purchase", "login", "error", "logout", "search", "scroll")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return adapt.table(spark, d, name)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return U.with_cost(adapt.usage_calls(_t(spark, d, "events")))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return adapt.blocks(_t(spark, d, "documents"))


def x15_usage_cost(spark: SparkSession, d: str) -> DataFrame:
    x = _calls(spark, d)
    return x.select("call_id", F.round("input_cost", 9).alias("input_cost"), F.round("output_cost", 9).alias("output_cost"), "cost_status")


def a03_usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return U.usage_rollup(_calls(spark, d), "run")


def a16_session_totals(spark: SparkSession, d: str) -> DataFrame:
    x = _calls(spark, d).withColumn("session", F.expr("run % 10"))
    return x.groupBy("session").agg(F.count("*").alias("n_calls"), F.count_if(F.col("cost_status") == "unavailable").alias("n_failed"), F.round(F.sum(F.coalesce("input_cost", F.lit(0.0)) + F.coalesce("output_cost", F.lit(0.0))), 4).alias("known_cost"))


def a17_page_allocation(spark: SparkSession, d: str) -> DataFrame:
    calls = adapt.usage_calls(_t(spark, d, "events"))
    pages = calls.select("call_id", F.explode(F.sequence(F.lit(1), (F.col("call_id") % 4 + 1).cast("int"))).alias("page"))
    return U.page_allocation(calls, pages, "output_tokens").select("call_id", "page", F.round("tokens", 6).alias("tokens"))


def a04_stage_summary(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    stages = e.sparkSession.createDataFrame([(s, i) for i, s in enumerate(STAGES)], "stage string, ord int")
    cents = F.floor(F.col("value") * 100).cast("bigint")
    x = e.select("user_id", F.col("event_type").alias("stage"), F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(cents.cast("double")).alias("seconds"))
    return U.stage_summary(x, stages, "user_id")


def a05_accumulated_stages(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "events").where("value is not null and not isnan(value) and value >= 0")
    return x.groupBy(F.col("event_type").alias("stage")).agg(F.sum(F.floor(F.col("value") * 100).cast("bigint")).alias("cents"), F.count("*").alias("n"))


def w13_budget_admission(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), ((F.col("event_id") * 37) % 1000 + 100).alias("worst"), F.when(F.col("event_id") % 41 != 0, (F.col("event_id") * 37) % 1000).alias("actual"))
    return U.admissions(x, "user_id", "seq", 20_000)


def j20_label_allowlist(spark: SparkSession, d: str) -> DataFrame:
    lab = _t(spark, d, "labels").select("doc_id", "quality")
    x = _t(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("")).alias("label")).join(lab, "doc_id", "left").withColumn("grounded", F.coalesce(F.col("quality") == 1, F.lit(False)))
    return A.allowed_labels(x, ["en", "de", "fr"]).select("doc_id", "label", "status")


def j21_missing_fields(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    declared = spark.createDataFrame([("total", True), ("vendor", False), ("date", True)], "field string, required boolean")
    proposed = docs.select("doc_id", F.when(F.expr("doc_id % 3 = 0"), "total").when(F.expr("doc_id % 3 = 1"), "vendor").otherwise("other").alias("field"))
    return A.missing_fields(docs, declared, proposed)


def _refinements(b: DataFrame) -> DataFrame:
    x = b.where("ord % 2 = 0").select("doc_id", F.when(F.expr("ord % 10 = 8"), F.lit("p0-b0")).otherwise(F.col("block_id")).alias("block_id"), "ord", F.when(F.expr("ord % 8 != 0"), F.when(F.expr("ord % 6 = 0"), F.concat("text", F.lit(" 7"))).otherwise(F.translate("text", "abcdefg", "ABCDEFG"))).alias("new_text"), F.expr("ord % 4 != 0").alias("verified"))
    return A.adjudicate_refinements(x, b)


def j08_adjudicate_refinements(spark: SparkSession, d: str) -> DataFrame:
    return _refinements(_blocks(spark, d)).select("doc_id", "ord", "status")


def j24_low_conf_coverage(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    return A.low_score_coverage(b, _refinements(b))


def j30_accepted_overlay(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    return A.overlay_accepted(b, _refinements(b), "ord").select("doc_id", "block_id", F.md5("shown").alias("shown_md5"))


def w10_split_coverage(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).select("doc_id", "page").distinct()
    splits = b.select("doc_id", F.col("page").alias("start_page"), F.when(F.expr("doc_id % 4 = 0 and page % 3 = 2"), F.col("page") - 1).otherwise(F.col("page")).alias("end_page")).where("doc_id % 7 <> 0 or page > 1")
    return A.split_coverage(splits, b)


def a09_sum_equals(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").select("l_orderkey", F.round(F.col("l_quantity"), 0).cast("decimal(18,2)").alias("q"))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("cast(o_orderkey % 60 * 2 as decimal(18,2))").alias("want"))
    return A.sum_equals(li, o, "l_orderkey", "q", "want", 30).select("l_orderkey", F.col("diff").cast("double").alias("diff"), "ok")


def a10_checkbox_rules(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 1, "none").otherwise("choice").alias("label"), F.when(F.col("l_returnflag") == "R", "CHECKED").otherwise("UNCHECKED").alias("state"))
    return A.checkbox_rules(x, "l_orderkey")


def j19_section_parents(spark: SparkSession, d: str) -> DataFrame:
    x = _blocks(spark, d).select("doc_id", "ord", ((F.col("ord") * 7 + F.col("doc_id")) % 4 + 1).cast("int").alias("level"))
    return A.section_parents(x)


def w09_last_audit(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", "event_type", "event_id", F.expr("event_id % 3").alias("verdict"))
    return A.last_wins(e, ["user_id", "event_type"], ["event_id"])


def j22_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return A.upsert(o, o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("Z").alias("o_orderstatus")), ["o_orderkey"])


def u02_covered_once(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).select("doc_id", "page").distinct()
    done = b.where("(doc_id + page) % 5 <> 0").union(b.where("(doc_id + page) % 11 = 0")).union(b.where("page = 1 and doc_id % 50 = 0").select("doc_id", (F.col("page") + 1000).alias("page")))
    return A.covered_once(b, done, ["doc_id", "page"])


def st3_workflow_state(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", F.when(F.expr("event_id % 211 = 0"), "error").when(F.expr("event_id % 17 = 0"), "review").otherwise("stage").alias("kind"))
    return A.workflow_state(e, "user_id")


def st1_job_ttl(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    now = e.agg(F.max("ts").alias("m")).first()["m"]
    x = e.select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, ("PROCESSING", "ACCEPTED", "REVIEW_REQUIRED", "FAILED"))), (F.col("event_id") % 4 + 1).cast("int")).alias("state"))
    return C.job_states(x, F.lit(now)).select("job", "state", "expired")


def x13_normalise_values(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    n = F.expr("o_orderkey * 1234567")
    value = F.expr("case o_orderkey % 5 when 0 then concat(cast(o_orderkey * 1234567 as string), ',000') when 1 then ' True ' when 2 then concat('1,', cast(o_orderkey as string), '.25') when 3 then o_orderpriority else cast(o_orderkey as string) end")
    kind = F.expr("case o_orderkey % 5 when 0 then 'integer' when 1 then 'boolean' when 2 then 'number' when 3 then 'integer' else 'string' end")
    return o.where(n > 0).select("o_orderkey", A.normalised(value, kind).alias("value"))


def x14_field_validation(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    x = o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("value"), F.when(F.expr("o_orderkey % 3 = 0"), F.lit("^[0-9]*[02468]$")).alias("pattern"), F.when(F.expr("o_orderkey % 3 = 1"), 100.0).alias("minimum"), F.when(F.expr("o_orderkey % 7 = 1"), 5000.0).alias("maximum"), (F.expr("o_orderkey % 100") / 100.0).alias("confidence"), F.lit(0.2).alias("min_confidence"))
    return A.field_errors(x).select("o_orderkey", "status")


def x19_message_kinds(spark: SparkSession, d: str) -> DataFrame:
    x = _blocks(spark, d).select("doc_id", "ord", F.concat(F.element_at(F.array(*map(F.lit, ("Table", "Field", "low-confidence block", "Page", "Checkbox on page", "note", "Table requires review"))), (F.col("ord") % 7 + 1).cast("int")), F.lit(" "), "text").alias("m"))
    return x.groupBy(A.message_stage(F.col("m")).alias("stage")).agg(F.count("*").alias("n"))


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = _t(spark, d, "orders")
    nodes = o.where("o_orderkey % 20 <> 0").select(F.col("o_orderkey").alias("node"), F.expr("o_custkey % 50").alias("page"), F.col("o_orderkey").alias("reading_order"))
    links = o.select(F.expr("o_orderkey - o_orderkey % 2").alias("src"), F.expr("o_orderkey - o_orderkey % 2 + 1 + o_custkey % 3").alias("dst"), F.when(F.expr("o_custkey % 2 = 0"), "continues").otherwise("cites").alias("relation"), F.col("o_orderkey").alias("ord"))
    return links, nodes


def g01_link_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return A.link_issues(*_links(spark, d)).select("src", "dst", "relation", "ord", "issue")


def g01_accepted_links(spark: SparkSession, d: str) -> DataFrame:
    links = _t(spark, d, "orders").select("o_custkey", F.expr("o_orderkey % 5").alias("src"), F.expr("(o_orderkey * 3 + o_custkey) % 5").alias("dst"), F.col("o_orderkey").alias("ord"))
    return G.accepted_links(links, "o_custkey")


def g01_checked_links(spark: SparkSession, d: str) -> DataFrame:
    """Six nodes a customer, links between them by the keys of its orders; some ends are no nodes."""
    o = _t(spark, d, "orders")
    nodes = o.select("o_custkey").distinct().select("o_custkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("node")).select("o_custkey", "node", F.expr("node div 3").alias("page"), F.expr("(node * 2) % 3").alias("reading_order"))
    links = o.select("o_custkey", F.expr("cast(o_orderkey % 7 as int)").alias("src"), F.expr("cast((o_orderkey * 3 + o_custkey) % 6 as int)").alias("dst"), F.when(F.expr("o_orderkey % 3 = 0"), "continues").otherwise("cites").alias("relation"), F.col("o_orderkey").alias("ord"))
    return G.checked_links(links, nodes, "o_custkey")


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = L.typed(_blocks(spark, d)).select("doc_id", "page", "type", "ord", "box")
    by = (F.col("doc_id") % 7) * 4 / 1000.0
    return b, b.where("(doc_id + ord) % 9 <> 0").withColumn("box", g.box(F.col("box.l"), F.col("box.t") + by, F.col("box.r"), F.col("box.b") + by))


def j25_box_matching(spark: SparkSession, d: str) -> DataFrame:
    o, c = _boxes(spark, d)
    return E.match_scores(o, c, E.greedy_matches(o, c))


def x11_text_agreement(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).select("doc_id", "ord", "text", F.regexp_replace("text", "[aeiou]", "").alias("other"))
    return E.text_agreement(b, "text", "other").select("doc_id", "ord", "agreement")


def f24_constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    again = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations")).select(F.lit("unique_line").alias("rule"), "violations")
    lost = li.join(o, li["l_orderkey"] == o["o_orderkey"], "left_anti").agg(F.count("*").alias("violations")).select(F.lit("known_order").alias("rule"), "violations")
    bad = li.agg(F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") > 0.1)).alias("violations")).select(F.lit("discount_range").alias("rule"), "violations")
    return again.union(lost).union(bad)


def s05_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    x = _blocks(spark, d).groupBy("doc_id").agg(F.max("page").alias("total")).select("doc_id", (F.expr("doc_id % 4")).alias("first"), (F.expr("doc_id % 5")).alias("last"), "total")
    return x.select("doc_id", C.range_problem(F.col("first"), F.col("last"), F.col("total")).alias("problem"))


def s06_selected_pages(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).select("doc_id", "page").distinct()
    return C.selected_pages(b, b.select("doc_id", (F.col("page") + F.expr("doc_id % 2")).cast("int").alias("page")))


def s14_base64_uploads(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "documents").select("doc_id", F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "").alias("u"))
    x = x.withColumn("u", F.when(F.expr("doc_id % 6 = 0"), F.concat("u", F.lit("*"))).otherwise(F.col("u")))
    return x.select("doc_id", F.octet_length(C.decoded(F.col("u"))).cast("bigint").alias("n_bytes"))


def s16_pairing(spark: SparkSession, d: str) -> DataFrame:
    stem = _t(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("stem"), "doc_id")
    files = stem.select("stem", F.lit(".pdf").alias("suffix")).union(stem.where("doc_id % 3 <> 0").select("stem", F.lit(".parse.json"))).union(stem.where("doc_id % 5 <> 0").select("stem", F.lit(".parse.md")))
    return C.pairing(files)


def w21_dense_order(spark: SparkSession, d: str) -> DataFrame:
    x = _blocks(spark, d).select("doc_id", "page", "block_id", F.expr("(ord * 7) % 10").alias("raw_order"))
    return C.normalised_order(x).select("doc_id", "page", "block_id", "order_no")


def e01_event_windows(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.windows import tumbling

    return tumbling(_t(spark, d, "events"), "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


_FUNCTIONS = (
    x15_usage_cost, a03_usage_rollup, a16_session_totals, a17_page_allocation, a04_stage_summary, a05_accumulated_stages, w13_budget_admission, j20_label_allowlist, j21_missing_fields, j08_adjudicate_refinements, j24_low_conf_coverage,
    j30_accepted_overlay, w10_split_coverage, a09_sum_equals, a10_checkbox_rules, j19_section_parents, w09_last_audit, j22_upsert, u02_covered_once, st3_workflow_state, st1_job_ttl, x13_normalise_values, x14_field_validation, x19_message_kinds,
    g01_link_endpoints, g01_accepted_links, g01_checked_links, j25_box_matching, x11_text_agreement, f24_constraint_violations, s05_page_ranges, s06_selected_pages, s14_base64_uploads, s16_pairing, w21_dense_order, e01_event_windows,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_COST = """costed AS (SELECT *, coalesce(cached_tokens, 0) AS c0, coalesce(write_tokens, 0) AS w0, output_tokens IS NULL OR coalesce(cached_tokens, 0) + coalesce(write_tokens, 0) > input_tokens AS bad FROM calls),
  costs AS (SELECT *, CASE WHEN NOT bad THEN ((input_tokens - c0 - w0) / 1e6 * 2.0::DOUBLE + c0 / 1e6 * 0.2::DOUBLE + w0 / 1e6 * 2.5::DOUBLE) * CASE WHEN input_tokens > 272000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END END AS input_cost,
    CASE WHEN NOT bad THEN output_tokens / 1e6 * 10.0::DOUBLE * CASE WHEN input_tokens > 272000 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END END AS output_cost,
    CASE WHEN bad THEN 'unavailable' WHEN cached_tokens IS NULL OR write_tokens IS NULL THEN 'estimate' ELSE 'exact' END AS cost_status FROM costed)"""
_REFINED = """refined AS (SELECT doc_id, CASE WHEN ord % 10 = 8 THEN 'p0-b0' ELSE block_id END AS block_id, ord, CASE WHEN ord % 8 <> 0 THEN CASE WHEN ord % 6 = 0 THEN text || ' 7' ELSE translate(text, 'abcdefg', 'ABCDEFG') END END AS new_text, ord % 4 <> 0 AS verified FROM blocks WHERE ord % 2 = 0),
  outcomes AS (SELECT f.*, CASE WHEN new_text IS NULL THEN 'abstained' WHEN b.text IS NULL THEN 'rejected' WHEN NOT verified THEN 'abstained' WHEN b.text <> new_text AND (regexp_matches(b.text, '[0-9<>]') OR regexp_matches(new_text, '[0-9<>]')) THEN 'rejected' ELSE 'accepted' END AS status
    FROM refined f LEFT JOIN blocks b ON b.doc_id = f.doc_id AND b.block_id = f.block_id)"""
_POISON = lambda c: f"CASE WHEN count({c}) = count(*) THEN cast(sum({c}) AS bigint) END AS {c}"
ORACLES = {
    "x15_usage_cost": f"WITH {USAGE_SQL}, {_COST} SELECT call_id, round(input_cost, 9) AS input_cost, round(output_cost, 9) AS output_cost, cost_status FROM costs",
    "a03_usage_rollup": f"WITH {USAGE_SQL}, {_COST} SELECT run, count(*) AS n_calls, cast(sum(millis) AS bigint) AS millis, {', '.join(map(_POISON, U.TOKENS))}, CASE WHEN bool_or(cost_status = 'unavailable') THEN 'unavailable' WHEN bool_or(cost_status = 'estimate') THEN 'estimate' ELSE 'exact' END AS cost_status FROM costs GROUP BY run",
    "a16_session_totals": f"WITH {USAGE_SQL}, {_COST} SELECT run % 10 AS session, count(*) AS n_calls, count(*) FILTER (WHERE bad) AS n_failed, round(sum(coalesce(input_cost, 0) + coalesce(output_cost, 0)), 4) AS known_cost FROM costs GROUP BY 1",
    "a17_page_allocation": f"WITH {USAGE_SQL} SELECT call_id, cast(page AS integer) AS page, round(output_tokens / (call_id % 4 + 1), 6) AS tokens FROM (SELECT *, unnest(generate_series(1, call_id % 4 + 1)) AS page FROM calls)",
    "a04_stage_summary": f"""WITH stages AS (SELECT unnest({list(STAGES)}) AS stage, generate_subscripts({list(STAGES)}, 1) - 1 AS ord), s AS (SELECT user_id, event_type AS stage, sum(cast(floor(value * 100) AS double)) AS seconds FROM events WHERE event_id % 13 <> 0 AND floor(value * 100) > 0 GROUP BY ALL),
        p AS (SELECT s.*, row_number() OVER (PARTITION BY user_id ORDER BY seconds DESC, ord) AS place, sum(seconds) OVER (PARTITION BY user_id) AS total FROM s JOIN stages USING (stage))
        SELECT user_id, stage, cast(place AS integer) AS place, seconds, round_even(seconds / total * 100, 1) AS share, place = 1 AS bottleneck FROM p""",
    "a05_accumulated_stages": "SELECT event_type AS stage, cast(sum(cast(floor(value * 100) AS bigint)) AS bigint) AS cents, count(*) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND value >= 0 GROUP BY 1",
    "j20_label_allowlist": "SELECT doc_id, lang AS label, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'abstained' WHEN coalesce(quality, 0) <> 1 THEN 'rejected' ELSE 'accepted' END AS status FROM documents LEFT JOIN labels USING (doc_id)",
    "j21_missing_fields": "SELECT doc_id, field, field <> 'vendor' AS required, 'abstained' AS status FROM (SELECT doc_id, unnest(['total', 'vendor', 'date']) AS field FROM documents) WHERE NOT ((doc_id % 3 = 0 AND field = 'total') OR (doc_id % 3 = 1 AND field = 'vendor'))",
    "j08_adjudicate_refinements": f"WITH {BLOCKS_SQL}, {_REFINED} SELECT doc_id, cast(ord AS integer) AS ord, status FROM outcomes",
    "j24_low_conf_coverage": f"WITH {BLOCKS_SQL}, {_REFINED}, best AS (SELECT doc_id, block_id, min(list_position(['accepted', 'abstained', 'rejected', 'missing'], status)) AS p FROM outcomes GROUP BY ALL) SELECT doc_id, block_id, coalesce(['accepted', 'abstained', 'rejected', 'missing'][p], 'missing') AS status FROM blocks LEFT JOIN best USING (doc_id, block_id) WHERE score < 0.85",
    "j30_accepted_overlay": f"WITH {BLOCKS_SQL}, {_REFINED}, last AS (SELECT doc_id, block_id, arg_max(new_text, ord) AS new_text FROM outcomes WHERE status = 'accepted' GROUP BY ALL) SELECT doc_id, block_id, md5(coalesce(new_text, text)) AS shown_md5 FROM blocks LEFT JOIN last USING (doc_id, block_id)",
    "w10_split_coverage": f"""WITH {BLOCKS_SQL}, p AS (SELECT DISTINCT doc_id, page FROM blocks), s AS (SELECT doc_id, page AS a, CASE WHEN doc_id % 4 = 0 AND page % 3 = 2 THEN page - 1 ELSE page END AS b FROM p WHERE doc_id % 7 <> 0 OR page > 1),
        w AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b) + 1, 1) AS want FROM s), v AS (SELECT doc_id, bool_and(want = a) AS joined, arg_max(b, a) AS last FROM w GROUP BY 1), n AS (SELECT doc_id, max(page) AS n FROM p GROUP BY 1)
        SELECT doc_id, coalesce(joined AND last = n, false) AS valid FROM n LEFT JOIN v USING (doc_id)""",
    "a09_sum_equals": """WITH s AS (SELECT l_orderkey, sum(cast(round(l_quantity, 0) AS decimal(18, 2))) AS total FROM lineitem GROUP BY 1)
        SELECT o_orderkey AS l_orderkey, cast(total - o_orderkey % 60 * 2 AS double) AS diff, coalesce(abs(total - o_orderkey % 60 * 2) <= 30, false) AS ok FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""",
    "a10_checkbox_rules": """WITH c AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n, bool_or(l_linenumber = 1 AND l_returnflag = 'R') AS none FROM lineitem GROUP BY 1)
        SELECT l_orderkey, n = 1 AS exactly_one, n >= 1 AS min_one, n <= 1 AS mutually_exclusive, NOT coalesce(none, false) OR n <= 1 AS none_exclusive FROM c""",
    "w09_last_audit": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(event_id % 3, event_id) AS verdict FROM events GROUP BY ALL",
    "j22_upsert": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "u02_covered_once": f"""WITH {BLOCKS_SQL}, p AS (SELECT DISTINCT doc_id, page FROM blocks), n AS (SELECT doc_id, page, CASE WHEN (doc_id + page) % 5 <> 0 THEN 1 ELSE 0 END + CASE WHEN (doc_id + page) % 11 = 0 THEN 1 ELSE 0 END AS n FROM p)
        SELECT doc_id, page, CASE WHEN n = 0 THEN 'missing' ELSE 'repeated' END AS problem FROM n WHERE n <> 1 UNION ALL SELECT doc_id, page + 1000, 'unrequested' FROM p WHERE page = 1 AND doc_id % 50 = 0""",
    "st3_workflow_state": "SELECT user_id, CASE WHEN bool_or(event_id % 211 = 0) THEN 'FAILED' WHEN bool_or(event_id % 17 = 0) THEN 'REVIEW_REQUIRED' ELSE 'ACCEPTED' END AS state FROM events GROUP BY 1",
    "st1_job_ttl": """SELECT user_id AS job, ['PROCESSING', 'ACCEPTED', 'REVIEW_REQUIRED', 'FAILED'][arg_max(event_id, (ts, event_id)) % 4 + 1] AS state, epoch_us((SELECT max(ts) FROM events)) - epoch_us(min(ts)) >= 3600000000 AS expired FROM events GROUP BY 1""",
    "x13_normalise_values": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN cast(o_orderkey * 1234567 AS varchar) || '000' WHEN 1 THEN 'true' WHEN 2 THEN '1' || o_orderkey || '.2500' WHEN 3 THEN o_orderpriority ELSE cast(o_orderkey AS varchar) END AS value FROM orders WHERE o_orderkey > 0""",
    "x14_field_validation": """SELECT o_orderkey, CASE WHEN (o_orderkey % 3 = 0 AND NOT regexp_matches(cast(o_orderkey AS varchar), '^[0-9]*[02468]$')) OR (o_orderkey % 3 = 1 AND o_orderkey < 100) OR (o_orderkey % 7 = 1 AND o_orderkey > 5000) THEN 'invalid' WHEN o_orderkey % 100 < 20 THEN 'uncertain' ELSE 'valid' END AS status FROM orders""",
    "x19_message_kinds": f"""WITH {BLOCKS_SQL}, m AS (SELECT lower(['Table', 'Field', 'low-confidence block', 'Page', 'Checkbox on page', 'note', 'Table requires review'][ord % 7 + 1] || ' ' || text) AS m FROM blocks)
        SELECT CASE WHEN contains(m, 'checkbox') THEN 'checkbox' WHEN contains(m, 'classification') THEN 'classify' WHEN contains(m, 'section') THEN 'section' WHEN contains(m, 'split') THEN 'split' WHEN contains(m, 'field') THEN 'extract'
          WHEN contains(m, 'low-confidence block') OR contains(m, 'table') AND contains(m, 'requires review') OR contains(m, 'page') THEN 'parse' ELSE 'validate' END AS stage, count(*) AS n FROM m GROUP BY 1""",
    "w13_budget_admission": """WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, event_id * 37 % 1000 + 100 AS worst, CASE WHEN event_id % 41 <> 0 THEN event_id * 37 % 1000 END AS actual, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        f AS (SELECT DISTINCT user_id, cast(0 AS bigint) AS n, cast(0 AS bigint) AS spent, false AS blocked, false AS ok FROM e UNION ALL
          SELECT e.user_id, e.n, cast(spent + CASE WHEN o.ok THEN coalesce(actual, worst) ELSE 0 END AS bigint), blocked OR (o.ok AND actual IS NULL), o.ok FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1, LATERAL (SELECT NOT blocked AND spent + worst <= 20000 AS ok) o)
        SELECT user_id, seq, ok AS admitted, max(spent) OVER (PARTITION BY user_id) AS spent FROM f JOIN e USING (user_id, n)""",
    "j19_section_parents": f"""WITH RECURSIVE {BLOCKS_SQL}, s AS (SELECT doc_id, ord, cast((ord * 7 + doc_id) % 4 + 1 AS int) AS level FROM blocks),
        f AS (SELECT DISTINCT doc_id, cast(0 AS bigint) AS ord, cast([] AS STRUCT(ord BIGINT, level INT)[]) AS open, cast(NULL AS bigint) AS parent, false AS kept FROM s UNION ALL
          SELECT s.doc_id, s.ord, CASE WHEN s.level = 1 OR p.parent IS NOT NULL THEN list_append(list_filter(open, lambda o: o.level < s.level), {{'ord': s.ord, 'level': s.level}}) ELSE open END, p.parent, s.level = 1 OR p.parent IS NOT NULL
          FROM f JOIN s ON s.doc_id = f.doc_id AND s.ord = f.ord + 1, LATERAL (SELECT list_filter(open, lambda o: o.level < s.level)[-1].ord AS parent) p)
        SELECT doc_id, ord, parent, kept FROM f WHERE ord > 0""",
    "g01_accepted_links": """WITH RECURSIVE l AS (SELECT o_custkey AS c, o_orderkey % 5 AS s, (o_orderkey * 3 + o_custkey) % 5 AS t, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
        f AS (SELECT DISTINCT c, cast(0 AS bigint) AS n, cast([] AS bigint[]) AS pairs, false AS ok FROM l UNION ALL
          SELECT l.c, l.n, CASE WHEN i.ok THEN list_distinct(list_concat(pairs, flatten(list_transform(list_append(list_transform(list_filter(pairs, lambda p: p % 10 = s), lambda p: p // 10), s), lambda x: list_transform(list_append(list_transform(list_filter(pairs, lambda p: p // 10 = t), lambda p: p % 10), t), lambda y: x * 10 + y))))) ELSE pairs END, i.ok
          FROM f JOIN l ON l.c = f.c AND l.n = f.n + 1, LATERAL (SELECT s <> t AND NOT list_contains(pairs, t * 10 + s) AS ok) i)
        SELECT c AS o_custkey, s AS src, t AS dst, ord, ok AS accepted FROM f JOIN l USING (c, n)""",
    "g01_checked_links": """WITH RECURSIVE l AS (SELECT o_custkey AS c, cast(o_orderkey % 7 AS int) AS s, cast((o_orderkey * 3 + o_custkey) % 6 AS int) AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'continues' ELSE 'cites' END AS r, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
        f AS (SELECT DISTINCT c, cast(0 AS bigint) AS n, cast([] AS integer[]) AS pairs, cast([] AS varchar[]) AS seen, NULL::VARCHAR AS issue FROM l UNION ALL
          SELECT l.c, l.n, CASE WHEN i.issue IS NULL THEN list_distinct(list_concat(pairs, flatten(list_transform(list_append(list_transform(list_filter(pairs, lambda p: p % 10 = s), lambda p: p // 10), s), lambda x: list_transform(list_append(list_transform(list_filter(pairs, lambda p: p // 10 = t), lambda p: p % 10), t), lambda y: x * 10 + y)))))
              ELSE pairs END, CASE WHEN i.issue IS NULL THEN list_append(seen, s || '-' || t || r) ELSE seen END, i.issue
          FROM f JOIN l ON l.c = f.c AND l.n = f.n + 1, LATERAL (SELECT CASE WHEN s > 5 THEN 'unknown_endpoint' WHEN list_contains(seen, s || '-' || t || r) THEN 'duplicate' WHEN r = 'continues' AND (s // 3) * 10 + (s * 2) % 3 >= (t // 3) * 10 + (t * 2) % 3 THEN 'not_forward'
            WHEN s = t OR list_contains(pairs, t * 10 + s) THEN 'cycle' END AS issue) i)
        SELECT c AS o_custkey, s AS src, t AS dst, r AS relation, ord, issue FROM f JOIN l USING (c, n)""",
    "g01_link_endpoints": """WITH nodes AS (SELECT o_orderkey AS node, o_custkey % 50 AS page, o_orderkey AS ro FROM orders WHERE o_orderkey % 20 <> 0),
        links AS (SELECT o_orderkey - o_orderkey % 2 AS src, o_orderkey - o_orderkey % 2 + 1 + o_custkey % 3 AS dst, CASE WHEN o_custkey % 2 = 0 THEN 'continues' ELSE 'cites' END AS relation, o_orderkey AS ord FROM orders),
        x AS (SELECT l.*, s.node AS sn, t.node AS tn, (s.page, s.ro) >= (t.page, t.ro) AS back, row_number() OVER (PARTITION BY src, dst, relation ORDER BY ord) AS i FROM links l LEFT JOIN nodes s ON s.node = src LEFT JOIN nodes t ON t.node = dst)
        SELECT src, dst, relation, ord, CASE WHEN sn IS NULL OR tn IS NULL THEN 'unknown_endpoint' WHEN i > 1 THEN 'duplicate' WHEN relation = 'continues' AND back THEN 'not_forward' END AS issue FROM x""",
    "f24_constraint_violations": """SELECT 'unique_line' AS rule, count(*) AS violations FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        UNION ALL SELECT 'known_order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) UNION ALL SELECT 'discount_range', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.1""",
    "s05_page_ranges": f"WITH {BLOCKS_SQL}, t AS (SELECT doc_id, max(page) AS total FROM blocks GROUP BY 1) SELECT doc_id, CASE WHEN doc_id % 4 < 1 THEN 'start_below_1' WHEN doc_id % 5 < doc_id % 4 THEN 'end_before_start' WHEN doc_id % 5 > total THEN 'end_after_last' END AS problem FROM t",
    "s06_selected_pages": f"WITH {BLOCKS_SQL}, p AS (SELECT DISTINCT doc_id, page FROM blocks), w AS (SELECT doc_id, cast(page + doc_id % 2 AS integer) AS page FROM p) SELECT w.doc_id, w.page, CASE WHEN p.page IS NULL THEN 'unknown_page' END AS problem FROM w LEFT JOIN p USING (doc_id, page)",
    "s14_base64_uploads": "SELECT doc_id, CASE WHEN doc_id % 6 <> 0 THEN cast(strlen(text) AS bigint) END AS n_bytes FROM documents",
    "s16_pairing": "SELECT 'd' || doc_id AS stem, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN '.parse.json' END, CASE WHEN doc_id % 5 = 0 THEN '.parse.md' END) AS missing FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0",
    "w21_dense_order": f"WITH {BLOCKS_SQL} SELECT doc_id, page, block_id, cast(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY (ord * 7) % 10) AS integer) AS order_no FROM blocks",
    "e01_event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
