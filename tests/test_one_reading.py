"""Cells are read by one pattern each; evidence for them, and boxes of words, need no shuffle and no lambda."""

from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.operators import markup as M
from lectern.plans import markup_queries as Q

FOLDER = "/root/testdata/sf0.001"


def test_marked_documents_need_no_shuffle_and_no_text_reaches_the_grid(spark):
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(Q.k18_display_markdown(spark, FOLDER))
    grid = plan(Q.w19_grid_columns(spark, FOLDER))
    assert "md5(" in grid[grid.index("RepartitionByExpression") :] and "md5(" not in grid[: grid.index("RepartitionByExpression")]


def test_cells_with_odd_tags(spark):
    text = '<table><tr><td>a<th colspan="2" rowspan=x>b > c</TH ></tr><tr><td\n>x</td><td</td></tr><tr><td>open</tr></table>'
    got = M.html_cells(spark.createDataFrame([(1, text)], "k int, text string"), "text", "k").orderBy("row", "ord").collect()
    assert [(r.row, r.ord, r.tag, r.row_span, r.col_span, r.text) for r in got] == [(1, 1, "th", 1, 2, "b > c"), (2, 1, "td", 1, 1, "x"), (2, 2, "", 1, 1, "")]


def test_boxes_without_lambdas(spark):
    rows = [[1.0, 2.0, 9.0, 12.0], [3.0, 1.0, 8.0, 1.0, 8.0, 6.0, 3.0, 6.0], [1.0, 2.0], [1.0, None, 2.0, 3.0], [3.0, 1.0, None, 1.0, 8.0, 6.0, 3.0, 6.0], None, [], [1.0] * 9]
    x = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, p array<double>").select("i", g.raw_box(F.col("p")).alias("b"))
    assert "lambda" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert [r.b and tuple(r.b) for r in x.orderBy("i").collect()] == [(1.0, 2.0, 9.0, 12.0), (3.0, 1.0, 8.0, 6.0), *[None] * 6]
