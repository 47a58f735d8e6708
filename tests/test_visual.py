"""Checkboxes, grids and windows on small literal rows."""

from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.operators import visual as V


def boxed(spark, rows, schema):
    return spark.createDataFrame(rows, schema + ", l double, t double, r double, b double").withColumn("box", g.box(*map(F.col, "ltrb"))).drop("l", "t", "r", "b")


def test_checkbox_grades(spark):
    base = (1000, 1000, 0.9, "CHECKED", 0.9, True, "b1", "Yes", [])
    rows = [(1, *base), (2, *base[:2], 0.69, *base[3:]), (3, *base[:4], 0.84, *base[5:]), (4, *base[:7], "123", []), (5, *base[:8], ["blur_warning"]), (6, *base[:3], "NOT_DETERMINABLE", *base[4:])]
    schema = "id int, width int, height int, detector_score double, state string, ocr_score double, label_unique boolean, label_id string, label string, risks array<string>"
    got = {r.id: (r.visual, r.credible, r.automatic) for r in V.graded_checkboxes(boxed(spark, [(*r, 0.1, 0.1, 0.12, 0.12) for r in rows], schema)).collect()}
    assert got == {1: (True, True, True), 2: (False,) * 3, 3: (True, False, False), 4: (True, False, False), 5: (True, True, False), 6: (False,) * 3}


def test_ink_thresholds(spark):
    x = spark.createDataFrame([(0.06,), (0.061,), (0.0999,), (0.10,)], "r double").select(V.ink_state(F.col("r")).alias("s"))
    assert [r.s for r in x.collect()] == ["UNCHECKED", "NOT_DETERMINABLE", "NOT_DETERMINABLE", "CHECKED"]


def test_published_lines(spark):
    rows = [(1, 1, "CHECKED", " Yes ", "automated", 0.1, 0.5, 0.2, 0.6), (1, 1, "UNCHECKED", "No", "user_verified", 0.1, 0.1, 0.2, 0.2), (1, 1, "CHECKED", " ", "automated", 0.1, 0.1, 0.2, 0.2), (1, 1, "CHECKED", "x", "rejected", 0.1, 0.1, 0.2, 0.2)]
    got = V.checkbox_lines(boxed(spark, rows, "doc_id int, page int, state string, label string, status string")).first()
    assert (got.lines, got.n) == ("[ ] No\n[x] Yes", 2)


def test_first_of_overlapping_boxes(spark):
    rows = [(1, 1, 1, 0.1, 0.1, 0.3, 0.3), (1, 1, 2, 0.11, 0.1, 0.31, 0.3), (1, 1, 3, 0.12, 0.12, 0.14, 0.14), (1, 1, 4, 0.5, 0.5, 0.6, 0.6)]
    assert sorted(r.ord for r in V.first_of_overlapping(boxed(spark, rows, "doc_id int, page int, ord int")).collect()) == [1, 4]


def test_spans_that_collide(spark):
    cells = spark.createDataFrame([(1, "t", 1, 1, 2, 1), (1, "t", 1, 2, 1, 1), (1, "t", 2, 1, 1, 2)], "doc_id int, table_id string, row int, column int, row_span int, column_span int")
    assert [(r.y, r.x, r.n) for r in V.grid_problems(cells).collect()] == [(2, 1, 2)]


def test_windows_are_cut_by_neighbours(spark):
    rows = [(1, 1, "a", 0.1, 0.10, 0.9, 0.195), (1, 1, "b", 0.1, 0.20, 0.9, 0.40), (1, 1, "c", 0.1, 0.41, 0.9, 0.5)]
    got = {r.table_id: (round(r.t, 3), round(r.b, 3)) for r in V.review_windows(boxed(spark, rows, "doc_id int, page int, table_id string")).collect()}
    assert got == {"a": (0.08, 0.2), "b": (0.2, 0.41), "c": (0.41, 0.52)}


def test_rounds_and_runs(spark):
    x = spark.createDataFrame([(1, i, "pending") for i in range(1, 20)], "doc_id int, ord int, status string")
    rounds = [r.round for r in V.pending_round(x).orderBy("ord").collect()]
    assert rounds == [1] * 8 + [2] * 8 + [None] * 3
    p = spark.createDataFrame([(1, 1), (1, 6), (1, 12), (1, 13)], "g int, at int")
    assert [(r.first, r.last, r.n) for r in V.runs_with_gap(p, "g", "at").orderBy("run").collect()] == [(1, 6, 2), (12, 13, 2)]
