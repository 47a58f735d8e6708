"""Queries over tables, semantic groups, signatures, order and proposals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as T
from ..operators import control as C
from ..operators import layout as L
from ..operators import publish as P
from ..operators import structure as S
from ..sources import adapt
from ..sources.adapt import BLOCKS_SQL, REGIONS_SQL
from .layout_queries import LINKS_SQL

PAGE = list(S.PAGE)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return adapt.table(spark, d, "documents")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return adapt.blocks(_documents(spark, d))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return adapt.regions(_documents(spark, d))


def _primary(spark: SparkSession, d: str) -> DataFrame:
    return L.link_regions(_blocks(spark, d), _regions(spark, d)).where("is_primary")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return adapt.table(spark, d, "events")


def j03_table_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Layout links of every fifth document were not recorded."""
    t = _regions(spark, d).where("label = 'table'").withColumn("table_id", F.col("region_id")).withColumn("window", g.pad(F.col("box"), 0.02))
    return S.table_blocks(t, _blocks(spark, d), _primary(spark, d).where("doc_id % 5 <> 0"))


def f19_cells_inside(spark: SparkSession, d: str) -> DataFrame:
    t = _regions(spark, d).withColumns({"table_id": F.col("region_id"), "width": F.lit(1000), "height": F.lit(1000)})
    c = t.select(*PAGE, "table_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c"), "box", "region_ord")
    out = F.when(F.expr("(doc_id + page * 3 + region_ord + c) % 11 = 0"), 0.004).otherwise(0.0005)
    return S.tables_with_cells_inside(t, c.select(*PAGE, "table_id", g.box(F.col("box.l") + F.col("c") * 0.24, F.col("box.t"), F.col("box.l") + F.col("c") * 0.24 + 0.24, F.col("box.b") + out).alias("box")))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Regions with scores that vary by document."""
    return _regions(spark, d).withColumn("score", F.col("score") - F.col("doc_id") % 5 / 10.0)


def f22_table_candidates(spark: SparkSession, d: str) -> DataFrame:
    return S.table_candidates(_scored(spark, d)).select(*PAGE, "region_id", "selected")


def a12_candidate_pages(spark: SparkSession, d: str) -> DataFrame:
    return S.candidate_counts(S.table_candidates(_scored(spark, d)))


def f29_accepted_tables(spark: SparkSession, d: str) -> DataFrame:
    r = _regions(spark, d)
    t = r.select(*PAGE, F.col("region_id").alias("table_id"), F.when(F.expr("(region_ord + page) % 4 = 0"), "invalid").otherwise("valid").alias("status"), F.expr("(doc_id + region_ord) % 6 = 0").alias("review_required"))
    a = r.where("doc_id % 3 = 0").select("doc_id", F.col("region_id").alias("table_id"), F.when(F.expr("(region_ord + doc_id) % 2 = 0"), "accepted").otherwise("abstained").alias("status"))
    return S.accepted_tables(t, a).select(*PAGE, "table_id")


def j34_refreshed_cells(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    ids = F.array(F.col("block_id"), F.concat(F.lit("p"), "page", F.lit("-b"), F.col("ord") + 1), F.concat(F.lit("p"), "page", F.lit("-b"), F.col("ord") - 1))
    cells = b.where("ord % 3 = 1").select("doc_id", F.lit("t1").alias("table_id"), F.concat(F.lit("c"), "ord").alias("cell_id"), ids.alias("source_block_ids"))
    return S.refreshed_cells(cells, b).select("doc_id", "cell_id", F.md5("source_text").alias("text_md5"))


def a14_table_counts(spark: SparkSession, d: str) -> DataFrame:
    x = adapt.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr("cast(l_linenumber % 2 as int)").alias("page"), F.expr("l_partkey % 3").alias("table_id"))
    return S.table_counts(x)


def f15_semantic_types(spark: SparkSession, d: str) -> DataFrame:
    r = _regions(spark, d).select(*PAGE, "region_id", F.when(F.expr("region_ord = 4 and doc_id % 2 = 0"), "company_logo").when(F.expr("region_ord = 5 and doc_id % 2 = 1"), "Seal").otherwise(F.col("label")).alias("label"))
    x = _blocks(spark, d).join(_primary(spark, d).select(*PAGE, "block_id", "region_id"), [*PAGE, "block_id"], "left").join(r, [*PAGE, "region_id"], "left")
    x = x.select(*PAGE, F.expr("k div 5").alias("group_id"), F.when(F.expr("(doc_id + k div 5) % 13 = 0"), "figure").otherwise("text").alias("preferred"), F.when(F.expr("ord % 17 = 0"), F.concat(F.lit("[signed] "), "text")).otherwise(F.col("text")).alias("text"), "label")
    return S.semantic_types(x)


def j14_semantic_groups(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).withColumn("chunk", F.when(F.expr("ord % 10 <> 0"), F.expr("ord div 3")))
    return S.semantic_groups(b, _primary(spark, d).where("(doc_id + region_ord) % 2 = 0"), "chunk")


def j10_signature_attestations(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).withColumn("text", F.when(F.expr("ord % 3 = 0"), F.concat(F.lit("Electronically  signed by: "), "text")).otherwise(F.col("text")))
    return S.signature_attestations(b, _regions(spark, d))


def j32_redaction_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    r = b.where("ord % 6 = 0").select(*PAGE, F.concat(F.lit("r"), "ord").alias("redaction_id"), F.col("ord").alias("red_ord"), F.when(F.expr("ord % 12 = 0"), F.concat(F.lit("p"), "page", F.lit("-b"), F.col("ord") - 2)).alias("label_block_id"))
    return S.with_redactions(b, r).select(*PAGE, "pos", "block_id")


def w07_requested_order(spark: SparkSession, d: str) -> DataFrame:
    return S.ordered_first(_blocks(spark, d), F.when(F.expr("ord % 3 = 0"), F.expr("(ord * 7) % 11"))).select(*PAGE, "block_id", "pos")


def j28_reading_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence places of a page's blocks, those of every fourth one missing."""
    b = _blocks(spark, d)
    e = b.where("ord % 4 <> 0").select(*PAGE, "block_id", F.expr("(k * 7) % 40").alias("place"))
    return S.ordered_first(b.join(e, [*PAGE, "block_id"], "left"), F.col("place")).select(*PAGE, "block_id", "pos")


def _members(b: DataFrame) -> DataFrame:
    """Overlapping chunks of four blocks, a step of three apart; each sixth chunk has no known block."""
    x = b.select(*PAGE, "block_id", "ord", F.explode(F.expr("filter(array(k div 3, k div 3 - 1), x -> x >= 0 and (x = k div 3 or k % 3 = 0))")).alias("chunk_ord"))
    return x.select(*PAGE, "block_id", F.when(F.col("chunk_ord") % 6 != 5, F.col("ord")).alias("ord"), F.concat(F.lit("c"), "chunk_ord").alias("chunk_id"), "chunk_ord")


def j07_first_chunks(spark: SparkSession, d: str) -> DataFrame:
    return S.first_chunks(_members(_blocks(spark, d)))


def w05_chunk_order(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk_order(_members(_blocks(spark, d)))


def w12_page_batches(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a block: its text and 600 characters for its ids, box and scores."""
    p = _blocks(spark, d).groupBy(*PAGE).agg(F.sum(F.length("text") + 600).alias("size")).withColumn("is_full", F.expr("(doc_id + page) % 5 = 0"))
    return S.page_batches(p)


def f12_valid_ranges(spark: SparkSession, d: str) -> DataFrame:
    p = _blocks(spark, d).select(*PAGE).distinct()
    return S.valid_ranges(p.select("doc_id", F.col("page").alias("start_page"), F.expr("cast(page + doc_id % 4 - 1 as int)").alias("end_page")), p)


def f25_valid_spans(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    x = _documents(spark, d).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    at = F.expr("n * i div 5")
    return S.spans_valid(x.select("doc_id", "n", (F.col("i") != 3).alias("grounded"), at.alias("start_at"), F.when(F.expr("doc_id % 7 = i"), F.expr("n * i div 5 - 1")).when(F.expr("doc_id % 11 = i"), F.lit(None)).otherwise(F.expr("n * (i + 1) div 5")).alias("end_at")), "n")


def _items(b: DataFrame) -> DataFrame:
    o = F.col("ord")
    return b.where("ord % 5 = 0").select("doc_id", F.when(o % 35 == 0, F.col("page") + 500).otherwise(F.col("page")).alias("page"), F.concat(F.lit("v"), F.when(o % 40 == 0, o - 5).otherwise(o)).alias("item_id"), "ord", F.element_at(F.array(*map(F.lit, ("pending", "model_verified", "rejected"))), o % 3 + 1).alias("status"), F.array(F.col("block_id"), F.when(o % 25 == 0, "p0-b0").otherwise(F.col("block_id"))).alias("source_block_ids"), "text")


def f23_visual_problems(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    return S.visual_problems(_items(b), b)


def j27_visual_decisions(spark: SparkSession, d: str) -> DataFrame:
    x = _blocks(spark, d).where("ord % 5 = 0").select("doc_id", F.concat(F.lit("v"), "ord").alias("item_id"), "ord", F.col("text").alias("content"))
    made = x.where("ord % 4 <> 0").select("doc_id", "item_id", F.expr("ord % 7 <> 0").alias("supported"), F.when(F.expr("ord % 3 = 0"), F.concat(F.lit(" "), "content")).when(F.expr("ord % 11 = 0"), F.concat("content", F.lit("."))).otherwise(F.col("content")).alias("transcription"), F.explode(F.expr("sequence(1, if(ord % 9 = 0, 2, 1))")).alias("nth"))
    return S.visual_decisions(x, made)


def t09_inspected_pages(spark: SparkSession, d: str) -> DataFrame:
    return S.inspected_pages(_blocks(spark, d).where("ord % 9 = 0"))


def f27_answers_shown(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    x = _documents(spark, d).select(
        "doc_id", F.when(i % 4 == 0, "insufficient_evidence").otherwise("answered").alias("disposition"), F.when(i % 9 == 0, " ").otherwise(F.concat(F.lit("answer "), "lang")).alias("answer"),
        F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e1"), F.concat(F.lit("e"), i % 4))).alias("cited"), F.array(F.lit("e1"), F.lit("e2"), F.lit("e3")).alias("supplied"),
    )
    return S.answers_shown(x).select("doc_id", "shown")


def st7_retried_pages(spark: SparkSession, d: str) -> DataFrame:
    p = _blocks(spark, d).select(*PAGE).distinct()
    first = p.select(*PAGE, F.lit(1).alias("attempt"), F.expr("(doc_id + page) % 3 <> 0").alias("ok"))
    return S.retried_pages(first.unionByName(first.where("not ok").select(*PAGE, F.lit(2).alias("attempt"), F.expr("(doc_id * 7 + page) % 2 = 0").alias("ok"))))


def a13_warning_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.warning_counts(_events(spark, d).select("user_id", F.col("event_type").alias("warning"), F.col("event_id").alias("seq")), "user_id")


def a15_ocr_rollup(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).select("user_id", F.expr("(event_id * 11) % 1000").alias("millis"), F.expr("event_id % 4 = 0").alias("hit"), F.expr("user_id % 50 * 64").alias("wall_millis"))
    return S.ocr_rollup(x, "user_id")


def s04_pixel_cap(spark: SparkSession, d: str) -> DataFrame:
    x = _documents(spark, d).select("doc_id", F.expr("doc_id * 37 % 9000").alias("width"), F.expr("doc_id * 53 % 7000").alias("height"))
    return S.within_pixel_cap(x, C.MAX_PIXELS).select("doc_id", "ok")


def x26_block_words(spark: SparkSession, d: str) -> DataFrame:
    at = "named_struct('text', w, 'score', if(i % 7 = 3, 'none', '0.5'), 'polygon', case i % 5 when 0 then array(1.0D + i, 2.0D, 9.0D + i, 12.0D) when 1 then array(3.0D, 1.0D, 8.0D, 1.0D, 8.0D, 6.0D, 3.0D, 6.0D) when 2 then array(1.0D, 2.0D) when 3 then array(4.0D, 4.0D, 6.0D, 8.0D) end)"
    x = _blocks(spark, d).select(*PAGE, "block_id", F.expr(f"transform(split(text, ' '), (w, i) -> {at})").alias("words"), F.lit(100).alias("width"), F.lit(200).alias("height"))
    w = S.words_of_blocks(x)
    last = F.max(F.expr("cast(substring_index(word_id, '-w', -1) as int)"))
    return w.groupBy(*PAGE, "block_id").agg(F.count("*").alias("n_words"), F.sum(F.length("text")).alias("n_chars"), last.alias("last_word"), F.round(F.sum("box.r"), 4).alias("sum_r"), F.round(F.sum("box.b"), 4).alias("sum_b"))


def x21_block_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("doc_id", F.when(F.expr("ord % 5 = 0"), F.concat("block_id", F.lit("x"))).otherwise(F.col("block_id")).alias("block_id")).select("doc_id", "block_id", T.block_number(F.col("block_id")).alias("number"))


def x22_money_shown(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).select("event_id", F.when(F.expr("event_id % 6 <> 0"), F.expr("event_id * 37 % 400000 / 64.0D")).alias("usd"), F.element_at(F.array(*map(F.lit, ("exact", "estimate", "unavailable"))), (F.col("event_id") % 3 + 1).cast("int")).alias("status"))
    return x.select("event_id", T.money(F.col("usd"), F.col("status")).alias("shown"))


def x23_positive_ints(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).select("event_id", F.expr("case event_id % 5 when 0 then '' when 1 then ' 3 ' when 2 then '-4' when 3 then 'two' else cast(event_id as string) end").alias("span"))
    return x.select("event_id", T.positive_int(F.col("span")).alias("span"))


def x24_control_labels(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).where("ord % 4 = 0").withColumn("text", F.concat(F.expr("case ord % 3 when 0 then 'X' when 1 then 'x' else '' end"), F.expr("if(doc_id % 2 = 0, 'Yes', 'no')"), F.lit(" "), F.substring("text", 1, 5), F.lit(".")))
    by = F.when(F.expr("ord % 8 = 0"), 0.02).otherwise(0.05)
    control = g.box(F.col("box.l") - 0.005, F.col("box.t"), F.col("box.l") + by, F.col("box.b"))
    state = F.when(F.expr("ord % 5 = 0"), "UNCHECKED").otherwise("CHECKED")
    return b.select("doc_id", "block_id", T.label_of_control(F.col("text"), F.col("box"), control, state).alias("label"))


def x25_rebound_ids(spark: SparkSession, d: str) -> DataFrame:
    old = F.when(F.expr("ord % 7 = 0"), F.col("page") + 10).otherwise(F.col("page"))
    return _blocks(spark, d).select("doc_id", "block_id", T.rebound(F.col("block_id"), old, F.col("page") + 3).alias("new_id"))


def k03_page_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in pairs that changed places; every seventh has a text that the page lacks."""
    b = _blocks(spark, d)
    c = b.select(*PAGE, F.expr("cast(k + 1 - 2 * (k % 2) as bigint)").alias("chunk_ord"), F.when(F.expr("ord % 11 = 0"), "logo").otherwise("text").alias("type"), F.when(F.expr("k div 4 <> 2"), F.concat(F.lit("l"), F.expr("k div 4"))).alias("region_id"), F.when(F.expr("ord % 7 = 0 or doc_id % 17 = 0"), F.concat(F.lit("not there: "), "text")).otherwise(F.col("text")).alias("markdown"))
    return S.page_nodes(P.page_bodies(b), c)


def j11_table_reviews(spark: SparkSession, d: str) -> DataFrame:
    t = _regions(spark, d).select("doc_id", "page", F.col("region_id").alias("table_id"), F.when(F.expr("(doc_id + region_ord) % 5 = 0"), "invalid").otherwise("valid").alias("status"), F.col("region_ord").alias("n_cells"), "region_ord")
    i = F.col("doc_id") + F.col("region_ord") * 3
    r = t.where("(doc_id + region_ord) % 13 <> 0").select(
        "doc_id", "table_id", F.when(i % 19 == 0, F.col("page") + 1).otherwise(F.col("page")).alias("page"), F.element_at(F.array(*map(F.lit, ("confirmed", "not_table", "corrected", "abstained"))), (i % 4 + 1).cast("int")).alias("outcome"),
        F.when(i % 4 == 1, (i % 8 == 1).cast("int")).otherwise(F.when(i % 7 == 0, 9).otherwise(F.col("n_cells"))).alias("visible_cells"), F.when(i % 4 == 2, 3).when(i % 12 == 0, 1).otherwise(0).alias("n_cells"),
        (i % 5 == 0).alias("applied"), (i % 3 != 0).alias("grounded"), (i % 10 == 2).alias("one_row"), F.explode(F.expr("sequence(1, if((doc_id + region_ord * 3) % 23 = 0, 2, 1))")).alias("nth"),
    )
    return S.table_reviews(t, r)


def j33_signature_texts(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    found = b.where("ord % 8 = 4").select(*PAGE, "block_id", F.concat(F.lit("p"), "page", F.lit("-b"), F.col("ord") - 1).alias("attestation_id"))
    b = b.withColumn("text", F.when(F.expr("ord % 16 = 3"), F.concat(F.lit("[E-SIGNED]\n"), "text")).otherwise(F.col("text")))
    return S.signature_texts(b, found).select("doc_id", "block_id", F.md5("shown").alias("shown_md5"))


def x12_page_markdown(spark: SparkSession, d: str) -> DataFrame:
    x = _documents(spark, d).select("doc_id", F.col("text").alias("markdown"), F.length("text").alias("n"))
    spans = x.select("doc_id", F.posexplode(F.expr("transform(sequence(0, 3), i -> struct(n * i div 5 as s, n * (i + 1) div 5 + if(i = 3 and doc_id % 3 = 0, n, 0) as e))")).alias("page", "p"))
    return S.markdown_of_pages(x, spans.where("page <> 1").select("doc_id", "page", F.col("p.s").alias("start_at"), F.col("p.e").alias("end_at"))).select("doc_id", F.md5("selected").alias("selected_md5"))


def st5_corrected_fields(spark: SparkSession, d: str) -> DataFrame:
    o = adapt.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("value"))
    f = o.withColumn("path", F.lit("/status"))
    c = o.where("doc_id % 4 <> 0").select("doc_id", F.lit("/status").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq"), F.col("value").alias("was"))
    c = c.select("doc_id", "path", "seq", F.expr("case when (doc_id + seq) % 3 = 0 then was else 'O' end").alias("value"), F.expr("if((doc_id + seq) % 5 < 3, 'seen', ' ')").alias("reason"))
    return S.corrected_fields(f, c).select("doc_id", "shown", "action", "n_corrections")


def w18_event_log(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("state"), F.expr("(event_id * 11) % 1000").alias("millis"))
    return S.event_log(x, "user_id").select("user_id", "seq", "elapsed", "entered")


def a18_evidence_metrics(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    return S.evidence_metrics(b, b.where("ord % 40 = 7 and doc_id % 3 = 0"))


def j23_for_targets(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    return S.for_targets(b, b.where("ord % 9 = 0"), "doc_id", "page").groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def f16_checkbox_risks(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("ord")
    b = F.col("box")
    x = _blocks(spark, d).where("ord % 4 = 0").select(
        *PAGE, F.concat(F.lit("k"), "ord").alias("control_id"), g.box(b["l"], b["t"], b["l"] + F.when(o % 12 == 0, 0.06).otherwise(0.015), b["t"] + F.when(o % 20 == 0, -0.01).otherwise(0.014)).alias("box"),
        F.when(o % 8 == 0, g.box(b["l"], b["t"], b["r"] + F.when(o % 16 == 0, 0.2).otherwise(0.0), b["b"])).alias("label_box"), F.when(o % 28 == 0, "NOT_DETERMINABLE").otherwise("CHECKED").alias("state"), F.expr("(doc_id + page) % 6 <> 0").alias("reviewed"), F.lit(1000).alias("width"), F.lit(1000).alias("height"),
        *[(F.col("doc_id") % n == 0).alias(c) for n, c in ((5, "blur"), (7, "contrast"), (11, "shadow"), (13, "compression"), (17, "edges"))],
    )
    return S.checkbox_risks(x)


_FUNCTIONS = (
    k03_page_nodes, j11_table_reviews, j33_signature_texts, x12_page_markdown, st5_corrected_fields, w18_event_log, a18_evidence_metrics, j23_for_targets, f16_checkbox_risks,
    j03_table_blocks, f19_cells_inside, f22_table_candidates, a12_candidate_pages, f29_accepted_tables, j34_refreshed_cells, a14_table_counts, f15_semantic_types, j14_semantic_groups, j10_signature_attestations, j32_redaction_blocks,
    w07_requested_order, j28_reading_evidence, j07_first_chunks, w05_chunk_order, w12_page_batches, f12_valid_ranges, f25_valid_spans, f23_visual_problems, j27_visual_decisions, t09_inspected_pages, f27_answers_shown, st7_retried_pages,
    a13_warning_counts, a15_ocr_rollup, s04_pixel_cap, x26_block_words, x21_block_numbers, x22_money_shown, x23_positive_ints, x24_control_labels, x25_rebound_ids,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_B = "WITH " + BLOCKS_SQL
_R = "WITH " + REGIONS_SQL
_L = _B + ", " + REGIONS_SQL + ", " + LINKS_SQL
_PAGES = ", pages AS (SELECT DISTINCT doc_id, page FROM blocks)"
_MEMBERS = """, m0 AS (SELECT doc_id, page, block_id, ord, k, k // 3 AS c FROM blocks UNION ALL SELECT doc_id, page, block_id, ord, k, k // 3 - 1 FROM blocks WHERE k % 3 = 0 AND k >= 3),
  m AS (SELECT doc_id, page, block_id, c, 'c' || c AS chunk_id, CASE WHEN c % 6 <> 5 THEN ord END AS ord FROM m0)"""
_CENTRE = "(b.l + b.r) / 2 BETWEEN {0}.l AND {0}.r AND (b.t + b.b) / 2 BETWEEN {0}.t AND {0}.b"
_STRIPPED = r"regexp_replace({}, '^[\s\x0b\x1c-\x1f\x85\p{{Z}}]+|[\s\x0b\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"
ORACLES = {
    "j03_table_blocks": _L + f""", t AS (SELECT doc_id, page, region_id, l, t, r, b FROM regions WHERE label = 'table'), w AS (SELECT doc_id, page, region_id, greatest(0, l - 0.02::DOUBLE) AS l, greatest(0, t - 0.02::DOUBLE) AS t, least(1, r + 0.02::DOUBLE) AS r, least(1, b + 0.02::DOUBLE) AS b FROM t),
        x AS (SELECT b.doc_id, b.page, t.region_id AS table_id, b.block_id, coalesce(k.region_id = t.region_id, false) AS linked, {_CENTRE.format('t')} AS inside, {_CENTRE.format('w')} AS near
          FROM t JOIN w USING (doc_id, page, region_id) JOIN blocks b ON b.doc_id = t.doc_id AND b.page = t.page LEFT JOIN links k ON k.is_primary AND k.doc_id % 5 <> 0 AND k.doc_id = b.doc_id AND k.page = b.page AND k.block_id = b.block_id),
        y AS (SELECT *, CASE WHEN bool_or(linked) OVER (PARTITION BY doc_id, page, table_id) THEN linked ELSE inside END AS own FROM x)
        SELECT doc_id, page, table_id, block_id, CASE WHEN own THEN 'own' ELSE 'adjacent' END AS scope FROM y WHERE own OR (near AND NOT inside)""",
    "f19_cells_inside": _R + """, c AS (SELECT *, unnest([0, 1, 2, 3]) AS c FROM regions) SELECT doc_id, cast(page AS integer) AS page, region_id AS table_id, count(*) AS n_cells,
        bool_and((doc_id + page * 3 + region_ord + c) % 11 <> 0) AS ok FROM c GROUP BY 1, 2, 3""",
    "f22_table_candidates": _R + " SELECT doc_id, cast(page AS integer) AS page, region_id, score - doc_id % 5 / 10.0::DOUBLE >= 0.5 AS selected FROM regions WHERE label = 'table'",
    "a12_candidate_pages": _R + """, c AS (SELECT doc_id, page, score - doc_id % 5 / 10.0::DOUBLE >= 0.5 AS s FROM regions WHERE label = 'table') SELECT doc_id, count(*) AS n_candidates, string_agg(page, ',' ORDER BY page) AS candidate_pages,
        coalesce(string_agg(page, ',' ORDER BY page) FILTER (WHERE NOT s), '') AS skipped_pages FROM c GROUP BY 1""",
    "f29_accepted_tables": _R + """ SELECT doc_id, cast(page AS integer) AS page, region_id AS table_id FROM regions
        WHERE (region_ord + page) % 4 <> 0 AND (doc_id + region_ord) % 6 <> 0 AND (doc_id % 3 <> 0 OR (region_ord + doc_id) % 2 = 0)""",
    "j34_refreshed_cells": _B + f""", c AS (SELECT doc_id, page, ord, unnest([0, 1, 2]) AS i, unnest([ord, ord + 1, ord - 1]) AS o FROM blocks WHERE ord % 3 = 1),
        x AS (SELECT c.doc_id, c.ord, c.i, {_STRIPPED.format('b.text')} AS text FROM c LEFT JOIN blocks b ON b.doc_id = c.doc_id AND b.page = c.page AND b.ord = c.o)
        SELECT doc_id, 'c' || ord AS cell_id, md5(coalesce(string_agg(text, ' ' ORDER BY i) FILTER (WHERE text <> ''), '')) AS text_md5 FROM x GROUP BY doc_id, ord""",
    "a14_table_counts": "SELECT l_orderkey AS doc_id, cast(l_linenumber % 2 AS integer) AS page, count(DISTINCT l_partkey % 3) AS n_tables, count(*) AS n_cells FROM lineitem GROUP BY 1, 2",
    "f15_semantic_types": _L + """, x AS (SELECT b.doc_id, b.page, b.k // 5 AS group_id, (b.doc_id + b.k // 5) % 13 = 0 AS figure, b.ord % 17 = 0 OR regexp_matches(upper(b.text), '\\[(E-SIGNED|SIGNED|ILLEGIBLE_SIGNATURE)\\]') AS mark,
          CASE WHEN k.region_ord = 4 AND b.doc_id % 2 = 0 THEN 'logo' WHEN k.region_ord = 5 AND b.doc_id % 2 = 1 THEN 'seal' WHEN k.region_ord = 3 THEN 'margin' END AS kind
          FROM blocks b LEFT JOIN links k ON k.is_primary AND k.doc_id = b.doc_id AND k.page = b.page AND k.block_id = b.block_id)
        SELECT doc_id, page, group_id, CASE WHEN bool_or(figure) THEN 'figure' WHEN bool_or(mark) THEN 'attestation' WHEN bool_or(kind = 'margin') THEN 'marginalia' WHEN bool_or(kind = 'logo') THEN 'logo' WHEN bool_or(kind = 'seal') THEN 'attestation' ELSE 'text' END AS type FROM x GROUP BY 1, 2, 3""",
    "j14_semantic_groups": _L + """, x AS (SELECT b.doc_id, b.page, b.ord, b.block_id, k.region_id, CASE WHEN b.ord % 10 <> 0 THEN b.ord // 3 END AS chunk
          FROM blocks b LEFT JOIN links k ON k.is_primary AND (k.doc_id + k.region_ord) % 2 = 0 AND k.doc_id = b.doc_id AND k.page = b.page AND k.block_id = b.block_id),
        y AS (SELECT doc_id, page, region_id, CASE WHEN region_id IS NULL THEN chunk END AS chunk, CASE WHEN region_id IS NULL AND chunk IS NULL THEN block_id END AS alone, min(ord) AS first, count(*) AS n_blocks FROM x GROUP BY ALL)
        SELECT doc_id, page, coalesce(region_id, 'p' || page || '-sr-fallback-' || row_number() OVER (PARTITION BY doc_id, page, region_id IS NULL ORDER BY alone IS NOT NULL, chunk, first)) AS group_id,
          cast(row_number() OVER (PARTITION BY doc_id, page ORDER BY first) AS integer) AS reading_order, n_blocks FROM y""",
    "j10_signature_attestations": _B + ", " + REGIONS_SQL + f""", low AS (SELECT b.* FROM blocks b JOIN regions r USING (doc_id, page) WHERE r.label = 'image' AND b.score < 0.85 AND {_CENTRE.format('r')}),
        x AS (SELECT s.doc_id, s.page, s.block_id, a.block_id AS attestation_id, a.ord, s.t - a.b AS gap FROM low s JOIN blocks a USING (doc_id, page) WHERE a.ord % 3 = 0 AND regexp_matches(a.text, '\\S') AND abs(s.l - a.l) <= 0.08::DOUBLE)
        SELECT doc_id, page, block_id, attestation_id FROM x WHERE gap >= -0.005::DOUBLE AND gap <= 0.05::DOUBLE QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_id ORDER BY abs(gap), ord) = 1""",
    "j32_redaction_blocks": _B + """, r AS (SELECT doc_id, page, ord, (ord % 12 = 0 AND k >= 2) AS placed FROM blocks WHERE ord % 6 = 0),
        x AS (SELECT doc_id, page, block_id, cast(ord AS double) AS place FROM blocks UNION ALL SELECT doc_id, page, 'r' || ord, CASE WHEN placed THEN ord - 1.5 ELSE 1e9 + ord END FROM r)
        SELECT doc_id, page, cast(row_number() OVER (PARTITION BY doc_id, page ORDER BY place) AS integer) AS pos, block_id FROM x""",
    "w07_requested_order": _B + " SELECT doc_id, page, block_id, cast(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN ord % 3 = 0 THEN (ord * 7) % 11 ELSE 1000000 END, ord) AS integer) AS pos FROM blocks",
    "j28_reading_evidence": _B + " SELECT doc_id, page, block_id, cast(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN ord % 4 <> 0 THEN (k * 7) % 40 ELSE 1000000 END, ord) AS integer) AS pos FROM blocks",
    "j07_first_chunks": _B + _MEMBERS + " SELECT doc_id, page, block_id, 'c' || min(c) AS chunk_id FROM m GROUP BY 1, 2, 3",
    "w05_chunk_order": _B + _MEMBERS + """, f AS (SELECT doc_id, page, chunk_id, c, min(ord) AS first FROM m GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY first NULLS LAST, c) AS n FROM f)
        SELECT doc_id, page, chunk_id, cast(n AS integer) AS reading_order, 'p' || page || '-c' || n AS new_id FROM n""",
    "w12_page_batches": "WITH RECURSIVE " + BLOCKS_SQL + """, p AS (SELECT doc_id, page, sum(length(text) + 600) AS size, (doc_id + page) % 5 = 0 AS is_full FROM blocks GROUP BY 1, 2),
        o AS (SELECT doc_id, page, cast(size AS bigint) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS n FROM p WHERE NOT is_full),
        f AS (SELECT doc_id, page, n, size AS used, 1 AS batch FROM o WHERE n = 1 UNION ALL
          SELECT o.doc_id, o.page, o.n, CASE WHEN f.used + o.size > 80000 THEN o.size ELSE f.used + o.size END, CASE WHEN f.used + o.size > 80000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1),
        m AS (SELECT doc_id, max(batch) AS batch FROM f GROUP BY 1)
        SELECT doc_id, page, 'compact' AS kind, batch FROM f UNION ALL
        SELECT p.doc_id, p.page, 'full', cast(coalesce(m.batch, 0) + row_number() OVER (PARTITION BY p.doc_id ORDER BY p.page) AS integer) FROM p LEFT JOIN m USING (doc_id) WHERE is_full""",
    "f12_valid_ranges": _B + _PAGES + ", r AS (SELECT doc_id, page AS start_page, cast(page + doc_id % 4 - 1 AS integer) AS end_page FROM pages) SELECT r.*, start_page <= end_page AND p.page IS NOT NULL AS ok FROM r LEFT JOIN pages p ON p.doc_id = r.doc_id AND p.page = r.end_page",
    "f25_valid_spans": """WITH x AS (SELECT doc_id, length(text) AS n, unnest([0, 1, 2, 3, 4]) AS i FROM documents), y AS (SELECT doc_id, n, i, n * i // 5 AS s, CASE WHEN doc_id % 7 = i THEN n * i // 5 - 1 WHEN doc_id % 11 = i THEN NULL ELSE n * (i + 1) // 5 END AS e FROM x)
        SELECT doc_id, bool_and(i = 3 OR coalesce(s >= 0 AND s <= e AND e <= n, false)) AS ok FROM y GROUP BY 1""",
    "f23_visual_problems": _B + """, i AS (SELECT doc_id, ord, CASE WHEN ord % 35 = 0 THEN page + 500 ELSE page END AS page, 'v' || CASE WHEN ord % 40 = 0 THEN ord - 5 ELSE ord END AS item_id FROM blocks WHERE ord % 5 = 0),
        c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id) > 1 OR ord % 35 = 0 OR ord % 25 = 0 AS invalid FROM i)
        SELECT doc_id, cast(page AS integer) AS page, item_id, CASE WHEN invalid THEN 'invalid' ELSE 'pending' END AS problem FROM c WHERE ord % 3 <> 2 AND (invalid OR ord % 3 = 0)""",
    "j27_visual_decisions": _B + """ SELECT doc_id, 'v' || ord AS item_id, CASE WHEN ord % 4 <> 0 AND ord % 9 <> 0 AND ord % 7 <> 0 AND (ord % 3 = 0 OR ord % 11 <> 0) THEN 'model_verified' ELSE 'pending' END AS status FROM blocks WHERE ord % 5 = 0""",
    "t09_inspected_pages": _B + ", n AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM blocks WHERE ord % 9 = 0) SELECT DISTINCT doc_id, page FROM n WHERE n <= 16",
    "f27_answers_shown": """SELECT doc_id, CASE WHEN (doc_id % 5 = 0 OR doc_id % 4 <> 0) AND (doc_id % 4 = 0 OR (doc_id % 9 <> 0 AND doc_id % 5 <> 0)) THEN CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE 'answer ' || lang END ELSE '' END AS shown FROM documents""",
    "st7_retried_pages": _B + _PAGES + """ SELECT doc_id, page, CASE WHEN (doc_id + page) % 3 <> 0 THEN 'completed' WHEN (doc_id * 7 + page) % 2 = 0 THEN 'completed_after_retry' ELSE 'failed' END AS status,
        cast(CASE WHEN (doc_id + page) % 3 <> 0 THEN 1 ELSE 2 END AS bigint) AS n_attempts FROM pages""",
    "a13_warning_counts": "WITH w AS (SELECT user_id, event_type AS warning, count(*) AS n, min(event_id) AS s FROM events GROUP BY 1, 2) SELECT user_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY s) AS integer) AS place, warning, n FROM w",
    "a15_ocr_rollup": """WITH x AS (SELECT user_id, (event_id * 11) % 1000 AS m, event_id % 4 = 0 AS hit FROM events), y AS (SELECT user_id, cast(coalesce(sum(m) FILTER (WHERE NOT hit), 0) AS bigint) AS ocr_millis, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses,
          cast(coalesce(sum(m) FILTER (WHERE hit), 0) AS bigint) AS avoided_millis FROM x GROUP BY 1)
        SELECT user_id, ocr_millis, CASE WHEN user_id % 50 > 0 THEN round(ocr_millis / (user_id % 50 * 64), 3) ELSE 0.0::DOUBLE END AS concurrency_ratio, hits, misses, avoided_millis FROM y""",
    "s04_pixel_cap": "SELECT doc_id, (doc_id * 37 % 9000) * (doc_id * 53 % 7000) <= 25000000 AS ok FROM documents",
    "x26_block_words": _B + """, w AS (SELECT doc_id, page, block_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM blocks), v AS (SELECT * FROM w WHERE i % 7 <> 3 AND i % 5 IN (0, 1, 3))
        SELECT doc_id, page, block_id, count(*) AS n_words, cast(sum(length(w)) AS bigint) AS n_chars, cast(max(i) + 1 AS integer) AS last_word, round(sum(CASE i % 5 WHEN 0 THEN 9 + i WHEN 1 THEN 8 ELSE 6 END) / 100.0::DOUBLE, 4) AS sum_r,
          round(sum(CASE i % 5 WHEN 0 THEN 12 WHEN 1 THEN 6 ELSE 8 END) / 200.0::DOUBLE, 4) AS sum_b FROM v GROUP BY 1, 2, 3""",
    "x21_block_numbers": _B + " SELECT doc_id, CASE WHEN ord % 5 = 0 THEN block_id || 'x' ELSE block_id END AS block_id, cast(CASE WHEN ord % 5 = 0 THEN 0 ELSE ord END AS integer) AS number FROM blocks",
    "x22_money_shown": """SELECT event_id, CASE WHEN event_id % 6 = 0 OR event_id % 3 = 2 THEN 'Unavailable' ELSE printf('$%.6f', event_id * 37 % 400000 / 64.0::DOUBLE) || CASE WHEN event_id % 3 = 1 THEN ' estimated' ELSE '' END END AS shown FROM events""",
    "x23_positive_ints": "SELECT event_id, cast(CASE event_id % 5 WHEN 1 THEN 3 WHEN 4 THEN event_id ELSE 1 END AS integer) AS span FROM events",
    "x24_control_labels": _B + f""", x AS (SELECT doc_id, block_id, ord, CASE ord % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'x' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'no' END || ' ' || text[1:5] || '.' AS text, ord % 5 <> 0 AND ord % 3 <> 2 AND doc_id % 2 = 0 AND ord % 8 = 0 AS fused FROM blocks WHERE ord % 4 = 0)
        SELECT doc_id, block_id, CASE WHEN fused THEN substr({_STRIPPED.format('text')}, 2) ELSE {_STRIPPED.format('text')} END AS label FROM x""",
    "x25_rebound_ids": _B + " SELECT doc_id, block_id, CASE WHEN ord % 7 = 0 THEN block_id ELSE 'p' || (page + 3) || '-b' || ord END AS new_id FROM blocks",
    "k03_page_nodes": "WITH RECURSIVE " + BLOCKS_SQL + f""", body AS (SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS body FROM blocks GROUP BY 1, 2),
        c AS (SELECT doc_id, page, CASE WHEN ord % 11 = 0 THEN 'logo' ELSE 'text' END AS type, CASE WHEN k // 4 <> 2 THEN 'l' || (k // 4) END AS region_id, CASE WHEN ord % 7 = 0 OR doc_id % 17 = 0 THEN 'not there: ' ELSE '' END || text AS md,
          row_number() OVER (PARTITION BY doc_id, page ORDER BY k + 1 - 2 * (k % 2)) AS n FROM blocks),
        s AS (SELECT c.*, body, {_STRIPPED.format('md')} AS v FROM c JOIN body USING (doc_id, page)),
        f AS (SELECT doc_id, page, cast(0 AS bigint) AS n, cast(0 AS bigint) AS cursor, cast(-1 AS bigint) AS spot, '' AS type, NULL::VARCHAR AS region_id FROM body UNION ALL
          SELECT s.doc_id, s.page, s.n, CASE WHEN a.spot >= 0 THEN a.spot + length(s.v) ELSE f.cursor END, a.spot, s.type, s.region_id FROM f JOIN s ON s.doc_id = f.doc_id AND s.page = f.page AND s.n = f.n + 1,
          LATERAL (SELECT CASE WHEN s.v = '' THEN -1 WHEN strpos(substr(s.body, f.cursor + 1), s.v) > 0 THEN f.cursor + strpos(substr(s.body, f.cursor + 1), s.v) - 1 ELSE strpos(s.body, s.v) - 1 END AS spot) a),
        g AS (SELECT *, coalesce(region_id = lag(region_id) OVER w AND type = lag(type) OVER w AND type <> 'logo', false) AS joins FROM f WHERE spot >= 0 WINDOW w AS (PARTITION BY doc_id, page ORDER BY n)),
        i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY n) AS run FROM g),
        r AS (SELECT doc_id, page, run, any_value(type) AS type, any_value(region_id) AS region_id, cast(arg_min(spot, n) AS integer) AS start_at, cast(arg_max(cursor, n) AS integer) AS end_at FROM i GROUP BY 1, 2, 3)
        SELECT doc_id, page, type, region_id, start_at, end_at FROM r UNION ALL
        SELECT doc_id, page, 'text', NULL, 0, cast(length(body) AS integer) FROM body ANTI JOIN r USING (doc_id, page) WHERE length(body) > 0""",
    "j11_table_reviews": _R + """, t AS (SELECT *, doc_id + region_ord * 3 AS i, (doc_id + region_ord) % 5 <> 0 AS valid FROM regions)
        SELECT doc_id, region_id AS table_id, CASE WHEN (doc_id + region_ord) % 13 = 0 OR i % 23 = 0 OR i % 19 = 0 THEN 'unresolved' WHEN i % 4 = 0 THEN CASE WHEN valid AND i % 12 <> 0 AND i % 7 <> 0 THEN 'accepted' ELSE 'unresolved' END
          WHEN i % 4 = 1 THEN CASE WHEN i % 8 <> 1 THEN 'rejected' ELSE 'unresolved' END WHEN i % 4 = 2 THEN CASE WHEN i % 5 = 0 THEN 'accepted' WHEN i % 3 = 0 THEN 'unresolved' WHEN i % 10 = 2 THEN 'rejected' ELSE 'accepted' END ELSE 'unresolved' END AS status FROM t""",
    "j33_signature_texts": _B + """, a AS (SELECT *, ord % 8 = 4 AS signed, ord % 8 = 3 AND k < 39 AND lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) IS NOT NULL AS attested FROM blocks)
        SELECT doc_id, block_id, md5(CASE WHEN signed THEN '[SIGNED]' || chr(10) || '[ILLEGIBLE_SIGNATURE]' WHEN ord % 16 = 3 OR (attested AND NOT starts_with(text, '[E-SIGNED]')) THEN '[E-SIGNED]' || chr(10) || text ELSE text END) AS shown_md5 FROM a""",
    "x12_page_markdown": """WITH x AS (SELECT doc_id, text, length(text) AS n FROM documents) SELECT doc_id, md5(text[1:n // 5] || chr(10) || chr(10) || substr(text, 2 * n // 5 + 1, 3 * n // 5 - 2 * n // 5)
        || CASE WHEN doc_id % 3 <> 0 OR n = 0 THEN chr(10) || chr(10) || substr(text, 3 * n // 5 + 1, 4 * n // 5 - 3 * n // 5) ELSE '' END) AS selected_md5 FROM x""",
    "st5_corrected_fields": """WITH c AS (SELECT o_orderkey AS doc_id, unnest([1, 2, 3]) AS seq, o_orderstatus AS was FROM orders WHERE o_orderkey % 4 <> 0), k AS (SELECT doc_id, seq, CASE WHEN (doc_id + seq) % 3 = 0 THEN was ELSE 'O' END AS v FROM c WHERE (doc_id + seq) % 5 < 3),
        l AS (SELECT doc_id, arg_max(v, seq) AS v, count(*) AS n FROM k GROUP BY 1)
        SELECT o_orderkey AS doc_id, coalesce(v, o_orderstatus) AS shown, CASE WHEN v = o_orderstatus THEN 'accept' WHEN v IS NOT NULL THEN 'correct' END AS action, coalesce(n, 0) AS n_corrections FROM orders LEFT JOIN l ON l.doc_id = o_orderkey""",
    "w18_event_log": """SELECT user_id, event_id AS seq, cast(sum((event_id * 11) % 1000) OVER w AS bigint) AS elapsed, lag(event_type) OVER w IS DISTINCT FROM event_type AS entered FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "a18_evidence_metrics": _B + """, p AS (SELECT doc_id, page, count(*) AS n, sum(length(text)) AS c, bool_or(ord % 40 = 7 AND doc_id % 3 = 0) AS f FROM blocks GROUP BY 1, 2)
        SELECT doc_id, cast(sum(n) AS bigint) AS n_blocks, cast(sum(c) AS bigint) AS n_chars, coalesce(string_agg(page, ',' ORDER BY page) FILTER (WHERE f), '') AS full_pages, coalesce(string_agg(page, ',' ORDER BY page) FILTER (WHERE NOT f), '') AS compact_pages FROM p GROUP BY 1""",
    "j23_for_targets": _B + " SELECT doc_id, page, count(*) AS n FROM blocks GROUP BY 1, 2 HAVING bool_or(ord % 9 = 0)",
    "f16_checkbox_risks": _B + """, x AS (SELECT *, (doc_id + page) % 6 = 0 OR ord % 20 = 0 OR l + CASE WHEN ord % 12 = 0 THEN 0.06::DOUBLE ELSE 0.015::DOUBLE END > 1 OR t + 0.014::DOUBLE > 1 AS bad FROM blocks WHERE ord % 4 = 0)
        SELECT doc_id, page, 'k' || ord AS control_id, concat_ws('; ', CASE WHEN bad THEN 'invalid or unreviewed visual geometry' END, CASE WHEN NOT bad AND ord % 12 = 0 THEN 'control geometry is not checkbox-shaped' END,
          CASE WHEN ord % 8 = 0 AND (b > 1 OR r + CASE WHEN ord % 16 = 0 THEN 0.2::DOUBLE ELSE 0 END > 1) THEN 'label geometry is invalid' END, CASE WHEN ord % 28 = 0 THEN 'state is NOT_DETERMINABLE' END, CASE WHEN doc_id % 5 = 0 THEN 'blur' END,
          CASE WHEN doc_id % 7 = 0 THEN 'low contrast' END, CASE WHEN doc_id % 11 = 0 THEN 'shadows' END, CASE WHEN doc_id % 13 = 0 THEN 'compression artifacts' END, CASE WHEN doc_id % 17 = 0 THEN 'cropped edges' END) AS risks FROM x""",
}
