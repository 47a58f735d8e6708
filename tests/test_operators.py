"""Operators on small literal rows: the cases that decide between readings of the rules."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.functions import text as T
from lectern.operators import adjudicate as A
from lectern.operators import control as C
from lectern.operators import evaluate as E
from lectern.operators import graph as G
from lectern.operators import layout as L
from lectern.operators import publish as P
from lectern.operators import retrieval as R
from lectern.operators import usage as U

BLOCK = "doc_id int, page int, ord int, block_id string, text string, score double, l double, t double, r double, b double"


def blocks(spark, rows):
    x = spark.createDataFrame(rows, BLOCK)
    return x.withColumn("box", F.when(F.col("l").isNotNull(), g.box(F.col("l"), F.col("t"), F.col("r"), F.col("b")))).drop("l", "t", "r", "b")


def line(i, text, score=0.9, top=None, high=0.02, left=0.1):
    top = i * 0.05 if top is None else top
    return (1, 1, i, f"b{i}", text, score, left, top, left + 0.3, top + high)


def test_types_of_lines(spark):
    rows = [line(1, "Report", high=0.04), line(2, "- First"), line(3, "Total: 42.00"), line(4, "A | B | C"), line(5, "1 | 2 | 3"), line(6, "12. item"), line(7, "1234. not an item"), line(8, "plain"), line(9, "tab\there"), line(10, "x" * 41 + ": late colon")]
    got = {r.ord: r.type for r in L.typed(blocks(spark, rows)).collect()}
    assert got == {1: "heading", 2: "list_item", 3: "key_value", 4: "table_row", 5: "table_row", 6: "list_item", 7: "paragraph", 8: "paragraph", 9: "table_row", 10: "paragraph"}


def test_runs_of_rows_become_tables_from_their_consistent_end(spark):
    rows = [line(1, "a|b|c|d"), line(2, "a|b|c"), line(3, "d|e|f"), line(4, "- x"), line(5, "- y"), line(6, "k: v"), line(7, "single|pair|x|y"), line(8, "k: 1"), line(9, "k: 2")]
    got = L.chunks(L.typed(blocks(spark, rows))).orderBy("ord").collect()
    assert [(r.chunk_no, r.chunk_type) for r in got] == [(1, "paragraph"), (2, "table"), (2, "table"), (3, "list"), (3, "list"), (4, "key_value"), (5, "paragraph"), (6, "form"), (6, "form")]


def test_two_columns_and_blocks_without_a_box(spark):
    left = [line(i, f"l{i}", top=0.1 * i, left=0.05) for i in (1, 2, 3)]
    right = [line(i, f"r{i}", top=0.1 * (i - 3), left=0.6) for i in (4, 5, 6)]
    loose = (1, 1, 7, "b7", "loose", None, None, None, None, None)
    got = L.reading_order(blocks(spark, [right[1], loose, left[2], right[0], left[0], right[2], left[1]])).orderBy("pos").collect()
    assert [r.text for r in got] == ["l1", "l2", "l3", "r1", "r2", "r3", "loose"] or [r.ord for r in got] == [1, 2, 3, 4, 5, 6, 7]
    assert got[0].columns == 2 and L.columns_of_pages(blocks(spark, [*left, *right, loose])).first().ambiguous


def test_routing_thresholds(spark):
    low = [line(i, "word", score=0.849 if i == 1 else 0.85) for i in (1, 2)]
    assert "low_confidence" in L.routing_reasons(L.typed(blocks(spark, low))).first().reasons
    sure = [line(i, "word", score=0.85, high=0.2) for i in (1, 2)]
    assert L.routing_reasons(L.typed(blocks(spark, sure))).first().reasons == ""
    forced = spark.createDataFrame([(1, 1)], "doc_id int, page int")
    assert L.routing_reasons(L.typed(blocks(spark, sure)), forced).first().reasons == "user_requested"


def test_scores_that_are_missing(spark):
    got = {r.ord: (r.strict, r.routed) for r in L.review_flags(blocks(spark, [line(1, "a", None), line(2, "a", 0.84), line(3, "10:30", 0.99), line(4, "a", 0.85)])).collect()}
    assert got == {1: (False, True), 2: (True, True), 3: (True, False), 4: (False, False)}


def test_boxes(spark):
    x = spark.createDataFrame([(0.0, 0.0, 0.4, 0.4, 0.2, 0.2, 0.6, 0.6), (0.1, 0.1, 0.1, 0.2, 0.0, 0.0, 1.0, 1.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    one, two = g.box(*map(F.col, "abcd")), g.box(*map(F.col, "efgh"))
    r = x.select(F.round(g.iou(one, two), 6).alias("i"), g.coverage(one, two).alias("c"), g.valid(one).alias("v"), g.gap(one, two).alias("g")).collect()
    assert r[0].i == round(0.04 / 0.28, 6) and r[0].v and r[0].g == 0
    assert (r[1].i, r[1].c, r[1].v) == (0.0, 0.0, False)


def test_nearest_label_is_unique_only_if_clear(spark):
    b = blocks(spark, [line(1, "Yes", top=0.10, left=0.20), line(2, "No", top=0.30, left=0.20), line(3, "☑", top=0.10, left=0.19)])
    c = spark.createDataFrame([(1, 1, "c1", 0.10)], "doc_id int, page int, control_id string, y double").withColumn("box", g.box(F.lit(0.17), F.col("y"), F.lit(0.19), F.col("y") + 0.02))
    assert [(r.block_id, r.is_unique) for r in L.nearest_labels(c, b).collect()] == [("b1", True)]


MARKDOWN = "intro\n<!-- page: 1 -->\n# Invoice\ntotal due\n<!-- page: 3 -->\n# Receipt\nBananas\n\n" + "\n\n".join("p" * 900 for _ in range(5))


def test_excerpts_follow_pages_headings_and_paragraphs(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, ""), (3, None), (4, "x" * 7000)], "doc_id int, markdown string")
    got = R.excerpts(docs).orderBy("doc_id", "excerpt_no").collect()
    assert [(r.doc_id, r.page, r.heading, len(r.excerpt)) for r in got] == [(1, None, None, 5), (1, 1, "Invoice", 19), (1, 3, "Receipt", 2723), (1, 3, "Receipt", 1802), (4, None, None, 3000), (4, None, None, 3000), (4, None, None, 1000)]


def test_scores_and_fair_choice(spark):
    docs = spark.createDataFrame([(1, "# Totals\nthe total is 4"), (2, "# Other\nnothing"), (3, "# More\ntotal total total")], "doc_id int, markdown string")
    s = R.scored(R.excerpts(docs), "What is the total")
    assert {r.doc_id: r.score for r in s.collect()} == {1: 1, 2: 0, 3: 3}
    assert [(r.doc_id, r.score) for r in R.fair_topk(s, 2).orderBy("rank").collect()] == [(1, 1), (2, 0)]
    assert [r.doc_id for r in R.retrieve(docs, "total", max_chars=30, limit=2).orderBy("rank").collect()] == [1]
    assert R.retrieve(docs, "total").count() == 3


def test_stratified_indices_round_half_even(spark):
    found = spark.createDataFrame([(1, i, None, None, "x") for i in range(1, 7)] + [(2, 1, None, None, "x")], "doc_id int, excerpt_no int, page int, heading string, excerpt string")
    got = sorted((r.doc_id, r.excerpt_no) for r in R.stratified(found, 3).collect())
    assert got == [(1, 1), (1, 3), (1, 6), (2, 1)]


def test_budget_skips_what_does_not_fit(spark):
    x = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 9, 4, 1, 1])], "k string, i int, n int")
    assert sorted(r.i for r in R.within_budget(x, "k", "i", "n", 10, 3).collect()) == [0, 2, 3]


def test_tokens_fold_sharp_s(spark):
    r = spark.createDataFrame([("Die STRASSE und Straße, the été_1",)], "t string").select(T.search_terms(F.col("t")).alias("w")).first()
    assert r.w == ["die", "strasse", "und", "strasse", "été_1"]


def test_costs(spark):
    rows = [(1, 100_000, 25_000, 10_000, 10_000), (2, 300_000, 0, 0, 30_000), (3, 10, 20, 0, 1), (4, 10, None, 0, 1), (5, 10, 0, 0, None), (6, 272_000, 0, 0, 0)]
    got = {r.id: r for r in U.with_cost(spark.createDataFrame(rows, "id int, input_tokens long, cached_tokens long, write_tokens long, output_tokens long")).collect()}
    assert abs(got[1].input_cost - 0.16) < 1e-12 and abs(got[1].output_cost - 0.10) < 1e-12 and got[1].cost_status == "exact"
    assert abs(got[2].input_cost - 1.2) < 1e-12 and abs(got[2].output_cost - 0.45) < 1e-12
    assert [got[i].cost_status for i in (3, 4, 5)] == ["unavailable", "estimate", "unavailable"] and got[3].input_cost is None
    assert abs(got[6].input_cost - 0.544) < 1e-12


def test_unknown_parts_poison_sums(spark):
    x = spark.createDataFrame([("r", 1, 1), ("r", 1, None), ("s", 1, 2)], "k string, a long, b long").groupBy("k").agg(U.poisoned_sum("a").alias("a"), U.poisoned_sum("b").alias("b"))
    assert {(r.k, r.a, r.b) for r in x.collect()} == {("r", 2, None), ("s", 1, 2)}


def test_stage_shares(spark):
    t = spark.createDataFrame([(1, "a", 10.0), (1, "b", 5.0), (1, "c", 5.0), (1, "b", float("nan")), (1, "z", 9.0), (1, "a", 0.0)], "doc int, stage string, seconds double")
    s = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "stage string, ord int")
    got = U.stage_summary(t, s, "doc").orderBy("place").collect()
    assert [(r.stage, r.seconds, r.share, r.bottleneck) for r in got] == [("a", 10.0, 50.0, True), ("b", 5.0, 25.0, False), ("c", 5.0, 25.0, False)]


def test_budget_admission(spark):
    x = spark.createDataFrame([("r", 1, 60, 30), ("r", 2, 80, 80), ("r", 3, 60, None), ("r", 4, 1, 1)], "run string, seq int, worst int, actual int")
    assert {r.seq: r.admitted for r in U.admissions(x, "run", "seq", 100).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_refinement_ladder(spark):
    b = blocks(spark, [line(1, "total 12"), line(2, "name")])
    x = spark.createDataFrame([(1, "b1", "total 13", True), (1, "b2", "Name", True), (1, "b2", "Name", False), (1, "b9", "x", True), (1, "b2", None, True)], "doc_id int, block_id string, new_text string, verified boolean")
    assert sorted((r.block_id, r.new_text or "", r.verified, r.status) for r in A.adjudicate_refinements(x, b).collect()) == [("b1", "total 13", True, "rejected"), ("b2", "", True, "abstained"), ("b2", "Name", False, "abstained"), ("b2", "Name", True, "accepted"), ("b9", "x", True, "rejected")]


def test_section_parents(spark):
    x = spark.createDataFrame([(1, i, v) for i, v in enumerate([2, 1, 2, 3, 2, 1, 3])], "doc_id int, ord int, level int")
    got = {r.ord: (r.parent, r.kept) for r in A.section_parents(x).collect()}
    assert got == {0: (None, False), 1: (None, True), 2: (1, True), 3: (2, True), 4: (1, True), 5: (None, True), 6: (5, True)}


@pytest.mark.parametrize("splits, valid", [([(1, 2), (3, 4)], True), ([(1, 2), (4, 4)], False), ([(1, 3)], False), ([(1, 2), (2, 4)], False), ([], False)])
def test_split_coverage(spark, splits, valid):
    s = spark.createDataFrame([(1, a, b) for a, b in splits], "doc_id int, start_page int, end_page int")
    p = spark.createDataFrame([(1, i) for i in range(1, 5)], "doc_id int, page int")
    assert A.split_coverage(s, p).first().valid is valid


def test_values_by_type(spark):
    x = spark.createDataFrame([("1,234", "integer"), ("1,234.5", "number"), (" TRUE ", "boolean"), ("n/a", "number"), ("12x", "integer"), ("1,2", "string")], "v string, k string")
    assert [r.o for r in x.select(A.normalised(F.col("v"), F.col("k")).alias("o")).collect()] == ["1234", "1234.5000", "true", "n/a", "12x", "1,2"]


def test_links(spark):
    n = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 2, 1)], "node string, page int, reading_order int")
    e = spark.createDataFrame([("a", "b", "continues", 1), ("a", "b", "continues", 2), ("c", "a", "continues", 3), ("c", "a", "cites", 4), ("a", "z", "cites", 5)], "src string, dst string, relation string, ord int")
    assert {r.ord: r.issue for r in A.link_issues(e, n).collect()} == {1: None, 2: "duplicate", 3: "not_forward", 4: None, 5: "unknown_endpoint"}
    x = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "c", 2), (1, "c", "a", 3), (1, "a", "c", 4), (1, "b", "b", 5)], "doc int, src string, dst string, ord int")
    assert {r.ord: r.accepted for r in G.accepted_links(x, "doc").collect()} == {1: True, 2: True, 3: False, 4: True, 5: False}
    got = {(r.start, r.node) for r in G.reachable(x.where("ord < 3"), spark.createDataFrame([("a",)], "start string")).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c")}


def test_long_chains_are_followed_to_their_end(spark):
    x = spark.range(70).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).coalesce(1)
    assert G.reachable(x, spark.createDataFrame([(0,)], "start bigint").coalesce(1)).count() == 71


def test_message_stages(spark):
    said = {"Classification of page 2": "classify", "Section 3 is open": "section", "Split 1": "split", "Field total on page 1": "extract", "low-confidence block b1": "parse", "Table p1-t1 requires review": "parse", "Table p1-t1": "validate", "Page 4": "parse", "a Checkbox of a table": "checkbox", "": "validate"}
    x = spark.createDataFrame(list(said.items()), "m string, s string")
    assert {r.m: r.o for r in x.select("m", A.message_stage(F.col("m")).alias("o")).collect()} == said


def test_box_matching_scores(spark):
    o = blocks(spark, [line(1, "x", top=0.1), line(2, "x", top=0.6)]).withColumn("type", F.lit("logo"))
    c = blocks(spark, [line(1, "x", top=0.105)]).withColumn("type", F.lit("logo"))
    r = E.match_scores(o, c, E.greedy_matches(o, c)).first()
    assert (r.matched, r.precision, r.recall, r.f1) == (1, 1.0, 0.5, 0.6667)


def test_published_tables(spark):
    x = spark.createDataFrame([([["A&B", "x|y"], ["<s>"]],)], "rows array<array<string>>")
    r = x.select(P.html_table(F.col("rows")).alias("h"), P.pipe_table(F.col("rows")).alias("p")).first()
    assert r.h == "<table><tr><th>A&amp;B</th><th>x|y</th></tr><tr><td>&lt;s&gt;</td></tr></table>"
    assert r.p == "| A&B | x\\|y |\n| --- | --- |\n| <s> |  |"


def test_ingest_reads_kinds_from_content(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"\x89PNG")
    (tmp_path / "c.pdf").write_bytes(b"")
    got = {r.path[-5:]: (r.bytes, r.kind, r.problem) for r in C.ingest(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (10, "pdf", None), "b.pdf": (4, "image", None)}


def test_uploads_are_decoded_strictly(spark):
    x = spark.createDataFrame([("aGk=",), ("aGk",), ("a*k=",), ("",)], "u string").select(C.decoded(F.col("u")).alias("b"))
    assert [r.b and bytes(r.b) for r in x.collect()][:3] == [b"hi", None, None]
