"""Edge cases of tables, nodes, orders and batches."""

from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.functions import text as T
from lectern.operators import structure as S


def rows(x, *order):
    return [tuple(r) for r in x.orderBy(*order).collect()]


def test_nodes_of_empty_and_unmatched_pages(spark):
    pages = spark.createDataFrame([(1, 1, "alpha\n\nbeta\n\nalpha"), (1, 2, ""), (1, 3, "left over")], "doc_id long, page int, body string")
    chunks = spark.createDataFrame([(1, 1, 1, "text", "a", " alpha "), (1, 1, 2, "text", "a", "alpha"), (1, 1, 3, "text", "b", "beta"), (1, 1, 4, "text", "b", "none"), (1, 3, 1, "text", "a", "")], "doc_id long, page int, chunk_ord long, type string, region_id string, markdown string")
    got = rows(S.page_nodes(pages, chunks).select("page", "type", "region_id", "start_at", "end_at"), "page", "start_at")
    assert got == [(1, "text", "a", 0, 18), (1, "text", "b", 7, 11), (3, "text", None, 0, 9)]


def test_batches_keep_large_pages_whole(spark):
    pages = spark.createDataFrame([(1, 1, 60, False), (1, 2, 40, False), (1, 3, 500, False), (1, 4, 1, False), (1, 5, 9, True), (2, 1, 9, True)], "doc_id long, page int, size long, is_full boolean")
    got = rows(S.page_batches(pages, 100).select("doc_id", "page", "kind", "batch"), "doc_id", "page")
    assert got == [(1, 1, "compact", 1), (1, 2, "compact", 1), (1, 3, "compact", 2), (1, 4, "compact", 3), (1, 5, "full", 4), (2, 1, "full", 1)]


def test_redactions_stand_behind_their_label_or_last(spark):
    blocks = spark.createDataFrame([(1, 1, "a", 1, "x"), (1, 1, "b", 2, "y")], "doc_id long, page int, block_id string, ord int, text string")
    red = spark.createDataFrame([(1, 1, "r1", 1, "a"), (1, 1, "r2", 2, "a"), (1, 1, "r3", 3, "gone"), (1, 1, "r4", 4, None)], "doc_id long, page int, redaction_id string, red_ord int, label_block_id string")
    assert [r[3] for r in rows(S.with_redactions(blocks, red), "pos")] == ["a", "r2", "r1", "b", "r3", "r4"]


def test_reviews_and_audits(spark):
    tables = spark.createDataFrame([(1, 1, t, "valid", 4) for t in "abcd"], "doc_id long, page int, table_id string, status string, n_cells int")
    reviews = spark.createDataFrame([(1, "a", 1, "confirmed", 4, 0), (1, "b", 1, "confirmed", 4, 0), (1, "b", 1, "confirmed", 4, 0), (1, "c", 2, "confirmed", 4, 0)], "doc_id long, table_id string, page int, outcome string, visible_cells int, n_cells int")
    reviews = reviews.select("*", *[F.lit(None).cast("boolean").alias(c) for c in ("applied", "grounded", "one_row")])
    assert rows(S.table_reviews(tables, reviews), "table_id") == [(1, "a", "accepted"), (1, "b", "unresolved"), (1, "c", "unresolved"), (1, "d", "unresolved")]
    plain = tables.withColumn("review_required", F.lit(False))
    audits = spark.createDataFrame([(1, "a", "accepted"), (1, None, "accepted"), (1, "b", "abstained")], "doc_id long, table_id string, status string")
    assert [r.table_id for r in S.accepted_tables(plain, audits).collect()] == ["a"]
    assert S.accepted_tables(plain, audits.limit(0)).count() == 4


def test_boxes_numbers_and_shown_values(spark):
    x = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([3.0, 1.0, 8.0, 1.0, 8.0, 6.0, 3.0, 6.0],), ([1.0, None, 3.0, 4.0],), ([1.0],), (None,)], "p array<double>")
    assert [None if r.b is None else tuple(r.b) for r in x.select(g.raw_box(F.col("p")).alias("b")).collect()] == [(1, 2, 3, 4), (3, 1, 8, 6), None, None, None]
    y = spark.createDataFrame([("p1-b12", " 7 "), ("p1-b", "0"), (None, None)], "i string, s string")
    assert [tuple(r) for r in y.select(T.block_number(F.col("i")), T.positive_int(F.col("s")), T.rebound(F.col("i"), F.lit(1), F.lit(3))).collect()] == [(12, 7, "p3-b12"), (0, 1, "p3-b"), (0, 1, None)]
    z = spark.createDataFrame([(1.5, "exact"), (2.0, "estimate"), (None, "exact"), (1.0, "unavailable")], "v double, s string")
    assert [r[0] for r in z.select(T.money(F.col("v"), F.col("s"))).collect()] == ["$1.500000", "$2.000000 estimated", "Unavailable", "Unavailable"]
