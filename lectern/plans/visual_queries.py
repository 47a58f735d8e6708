"""Queries over checkboxes, tables and visual objects, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import visual as V
from ..sources import adapt
from ..sources.adapt import BLOCKS_SQL, REGIONS_SQL

PAGE = list(V.PAGE)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return adapt.blocks(adapt.table(spark, d, "documents"))


def _controls(b: DataFrame) -> DataFrame:
    """A control at every fourth line, with scores, states, labels and risks that follow from its place."""
    o = F.col("ord")
    size = F.lit(14) / 1000.0 + (o % 3) / 1000.0
    x = b.where("ord % 4 = 0").select(
        *PAGE, "ord", F.concat(F.lit("k"), "ord").alias("control_id"), g.box(F.col("box.l"), F.col("box.t"), F.col("box.l") + size, F.col("box.t") + 0.014).alias("box"), F.lit(1000).alias("width"), F.lit(1000).alias("height"),
        ((60 + o * 7 % 40) / 100.0).alias("detector_score"), V.ink_state((o * 3 % 20) / 100.0).alias("state"), F.col("score").alias("ocr_score"), (o % 5 != 0).alias("label_unique"),
        F.when(o % 8 != 0, F.col("block_id")).alias("label_id"), F.substring("text", 1, 20).alias("label"), F.when(o % 12 == 0, F.array(F.lit("blur_warning"))).otherwise(F.array().cast("array<string>")).alias("risks"),
        F.when(o % 16 == 0, "rejected").otherwise("automated").alias("status"),
    )
    return x


def f05_graded_checkboxes(spark: SparkSession, d: str) -> DataFrame:
    x = V.graded_checkboxes(_controls(_blocks(spark, d)))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("visual").alias("n_visual"), F.count_if("credible").alias("n_credible"), F.count_if("automatic").alias("n_automatic"))


def x09_checkbox_lines(spark: SparkSession, d: str) -> DataFrame:
    return V.checkbox_lines(_controls(_blocks(spark, d))).select(*PAGE, F.md5("lines").alias("lines_md5"), "n")


def f17_ink_states(spark: SparkSession, d: str) -> DataFrame:
    return _controls(_blocks(spark, d)).groupBy("state").agg(F.count("*").alias("n"))


def j17_best_local_match(spark: SparkSession, d: str) -> DataFrame:
    c = _controls(_blocks(spark, d))
    by = (F.col("ord") % 7) / 1000.0
    p = c.select(*PAGE, F.concat(F.lit("m"), "ord").alias("control_id"), g.box(F.col("box.l") + by, F.col("box.t") + by, F.col("box.r") + by, F.col("box.b") + by).alias("box"))
    return V.best_local_match(p, c)


def u06_first_of_overlapping(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    wide = b.withColumn("box", g.box(F.col("box.l"), F.col("box.t"), F.col("box.r"), F.col("box.b") + F.when(F.col("ord") % 3 == 0, 0.06).otherwise(0.0)))
    return V.first_of_overlapping(wide).groupBy(*PAGE).agg(F.count("*").alias("n_kept"))


def f18_redaction_filter(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("ord")
    c = _blocks(spark, d).select("doc_id", "ord", g.box(F.col("box.l"), F.col("box.t"), F.col("box.l") + (o * 7 % 50) / 100.0, F.col("box.t") + (4 + o * 3 % 40) / 1000.0).alias("box"), ((50 + o * 11 % 50) / 100.0).alias("fill_ratio"))
    return c.where(V.redaction_filter(c)).select("doc_id", "ord")


def j09_redactions_left(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    return V.redaction_outcomes(b.where("ord % 6 = 0").select("doc_id", F.col("block_id").alias("candidate_id")), b.where("ord % 4 = 0"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as table cells; some span two columns."""
    x = adapt.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("t1").alias("table_id"), F.col("l_linenumber").cast("int").alias("row"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("column"))
    return x.withColumns({"row_span": F.when(F.expr("(doc_id + row) % 17 = 0"), 2).otherwise(1), "column_span": F.when(F.expr("(doc_id * row + column) % 23 = 0"), 2).otherwise(1)})


def w19_grid_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return V.grid_problems(_cells(spark, d)).select("doc_id", "y", "x", "n")


def f20_consistent_tables(spark: SparkSession, d: str) -> DataFrame:
    x = adapt.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("t1").alias("table_id"), (F.when(F.expr("l_partkey % 9 = 0"), 3).otherwise(4)).alias("n_cells"))
    return V.consistent_text_tables(x).select("doc_id", "consistent")


def j05_review_windows(spark: SparkSession, d: str) -> DataFrame:
    r = adapt.regions(adapt.table(spark, d, "documents"))
    t = r.where("region_ord in (1, 2, 4)").select(*PAGE, F.col("region_id").alias("table_id"), g.box(F.col("box.l") + 0.02, F.col("box.t") + 0.015, F.col("box.r"), F.col("box.b") - 0.015).alias("box"))
    x = V.review_windows(t)
    return x.select(*PAGE, "table_id", *[F.round(c, 6).alias(c) for c in "ltrb"])


def w06_slot_reorder(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).withColumn("want", F.when(F.expr("ord % 3 = 0"), F.expr("(ord * 7) % 11")))
    return V.slot_reorder(b, "want")


def w20_runs_with_gap(spark: SparkSession, d: str) -> DataFrame:
    x = _blocks(spark, d).where("(ord * ord + doc_id) % 7 < 2").select("doc_id", "ord")
    return V.runs_with_gap(x, "doc_id", "ord", 4)


def a11_image_area(spark: SparkSession, d: str) -> DataFrame:
    x = V.image_area_ratio(adapt.regions(adapt.table(spark, d, "documents")).where("region_ord <= 1 + page % 5"))
    return x.select(*PAGE, F.round("ratio", 6).alias("ratio"))


def t08_page_edges(spark: SparkSession, d: str) -> DataFrame:
    return V.edges_of_page(_blocks(spark, d)).select(*PAGE, "block_id", F.length("text").cast("bigint").alias("n_chars"))


def t06_pending_rounds(spark: SparkSession, d: str) -> DataFrame:
    x = _blocks(spark, d).select("doc_id", "ord", F.when(F.expr("ord % 3 = 1"), "done").otherwise("pending").alias("status"))
    return V.pending_round(x).select("doc_id", "ord", "round")


def u05_content_ids(spark: SparkSession, d: str) -> DataFrame:
    x = _blocks(spark, d).select("doc_id", "page", "ord", F.lit("logo").alias("kind"), F.col("text").alias("content"))
    return V.content_ids(x)


def k15_crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("box")
    by = F.greatest(2 * (b["r"] - b["l"]), 2 * (b["b"] - b["t"]), F.lit(0.02))
    x = _controls(_blocks(spark, d)).select("doc_id", "ord", F.greatest(F.lit(0.0), b["l"] - by).alias("l"), F.greatest(F.lit(0.0), b["t"] - by).alias("t"), F.least(F.lit(1.0), b["r"] + by).alias("r"), F.least(F.lit(1.0), b["b"] + by).alias("b"))
    return x.select("doc_id", "ord", *[F.round(c, 6).alias(c) for c in "ltrb"])


_FUNCTIONS = (f05_graded_checkboxes, x09_checkbox_lines, f17_ink_states, j17_best_local_match, u06_first_of_overlapping, f18_redaction_filter, j09_redactions_left, w19_grid_overlaps, f20_consistent_tables, j05_review_windows, w06_slot_reorder, w20_runs_with_gap, a11_image_area, t08_page_edges, t06_pending_rounds, u05_content_ids, k15_crop_boxes)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_CONTROLS = """controls AS (
  SELECT doc_id, page, ord, 'k' || ord AS control_id, l, t, l + (14 / 1000.0::DOUBLE + (ord % 3) / 1000.0::DOUBLE) AS r, t + 0.014::DOUBLE AS b, (60 + ord * 7 % 40) / 100.0::DOUBLE AS det,
    CASE WHEN (ord * 3 % 20) / 100.0::DOUBLE <= 0.06::DOUBLE THEN 'UNCHECKED' WHEN (ord * 3 % 20) / 100.0::DOUBLE >= 0.10::DOUBLE THEN 'CHECKED' ELSE 'NOT_DETERMINABLE' END AS state, score AS ocr, ord % 5 <> 0 AS uni,
    CASE WHEN ord % 8 <> 0 THEN block_id END AS label_id, text[1:20] AS label, ord % 12 = 0 AS risk, CASE WHEN ord % 16 = 0 THEN 'rejected' ELSE 'automated' END AS status
  FROM blocks WHERE ord % 4 = 0
), graded AS (
  SELECT *, l >= 0 AND t >= 0 AND r <= 1 AND b <= 1 AND l < r AND t < b AND (r - l) * 1000 / ((b - t) * 1000) >= 0.85::DOUBLE AND (r - l) * 1000 / ((b - t) * 1000) <= 1 / 0.85::DOUBLE AND det >= 0.70::DOUBLE AND state IN ('CHECKED', 'UNCHECKED') AS visual FROM controls
), credit AS (
  SELECT *, visual AND uni AND coalesce(ocr, 0) >= 0.85::DOUBLE AND label_id IS NOT NULL AND regexp_matches(label, '\\p{L}') AS credible FROM graded
)""".replace("\\\\p", "\\p")
_W = "WITH " + BLOCKS_SQL + ", "
_STRIP = r"regexp_replace(label, '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g')"
ORACLES = {
    "u06_first_of_overlapping": "WITH RECURSIVE " + BLOCKS_SQL + """, w AS (SELECT doc_id, page, {'l': l, 't': t, 'r': r, 'b': b + CASE WHEN ord % 3 = 0 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END} AS box, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS n FROM blocks),
        f AS (SELECT DISTINCT doc_id, page, cast(0 AS bigint) AS n, cast([] AS STRUCT(l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE, a DOUBLE)[]) AS kept FROM w UNION ALL
          SELECT w.doc_id, w.page, w.n, CASE WHEN len(list_filter(kept, lambda k: k.both / (k.a + o.a - k.both) > 0.6 OR k.both / least(k.a, o.a) > 0.8)) > 0 THEN f.kept ELSE list_append(f.kept, {'l': w.box.l, 't': w.box.t, 'r': w.box.r, 'b': w.box.b, 'a': o.a}) END
          FROM f JOIN w ON w.doc_id = f.doc_id AND w.page = f.page AND w.n = f.n + 1, LATERAL (SELECT (w.box.r - w.box.l) * (w.box.b - w.box.t) AS a) o,
          LATERAL (SELECT list_transform(f.kept, lambda k: {'a': k.a, 'both': greatest(0.0::DOUBLE, least(w.box.r, k.r) - greatest(w.box.l, k.l)) * greatest(0.0::DOUBLE, least(w.box.b, k.b) - greatest(w.box.t, k.t))}) AS kept) h)
        SELECT doc_id, page, max(len(kept)) AS n_kept FROM f GROUP BY doc_id, page""".replace("len(list_filter(kept,", "len(list_filter(h.kept,"),
    "f05_graded_checkboxes": _W + _CONTROLS + " SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE visual) AS n_visual, count(*) FILTER (WHERE credible) AS n_credible, count(*) FILTER (WHERE credible AND NOT risk) AS n_automatic FROM credit GROUP BY 1",
    "x09_checkbox_lines": _W + _CONTROLS + f""" SELECT doc_id, page, md5(string_agg(CASE state WHEN 'CHECKED' THEN '[x] ' ELSE '[ ] ' END || {_STRIP}, chr(10) ORDER BY t, l, CASE state WHEN 'CHECKED' THEN '[x] ' ELSE '[ ] ' END || {_STRIP})) AS lines_md5, count(*) AS n
        FROM controls WHERE status = 'automated' AND state <> 'NOT_DETERMINABLE' AND {_STRIP} <> '' GROUP BY 1, 2""",
    "f17_ink_states": _W + _CONTROLS + " SELECT state, count(*) AS n FROM controls GROUP BY 1",
    "j17_best_local_match": _W + _CONTROLS + """, p AS (SELECT doc_id, page, 'm' || ord AS control_id, l + (ord % 7) / 1000.0::DOUBLE AS l, t + (ord % 7) / 1000.0::DOUBLE AS t, r + (ord % 7) / 1000.0::DOUBLE AS r, b + (ord % 7) / 1000.0::DOUBLE AS b FROM controls),
        x AS (SELECT p.doc_id, p.page, p.control_id, c.control_id AS local_id, c.ord, greatest(0.0::DOUBLE, least(p.r, c.r) - greatest(p.l, c.l)) * greatest(0.0::DOUBLE, least(p.b, c.b) - greatest(p.t, c.t)) AS i, (p.r - p.l) * (p.b - p.t) AS pa, (c.r - c.l) * (c.b - c.t) AS ca FROM p JOIN controls c USING (doc_id, page)),
        y AS (SELECT *, i / (pa + ca - i) AS iou FROM x) SELECT doc_id, page, control_id, CASE WHEN iou > 0.2 THEN local_id END AS local_id FROM y QUALIFY row_number() OVER (PARTITION BY doc_id, page, control_id ORDER BY iou DESC, ord) = 1""",
    "f18_redaction_filter": _W + """c AS (SELECT doc_id, ord, (l + (ord * 7 % 50) / 100.0::DOUBLE) - l AS w, (t + (4 + ord * 3 % 40) / 1000.0::DOUBLE) - t AS h, (50 + ord * 11 % 50) / 100.0::DOUBLE AS f FROM blocks)
        SELECT doc_id, cast(ord AS integer) AS ord FROM c WHERE w >= 0.03::DOUBLE AND w <= 0.40::DOUBLE AND h >= 0.006::DOUBLE AND h <= 0.04::DOUBLE AND w / h >= 3 AND w / h <= 30 AND f >= 0.65::DOUBLE""",
    "j09_redactions_left": "WITH " + BLOCKS_SQL + " SELECT doc_id, block_id AS candidate_id FROM blocks WHERE ord % 6 = 0 AND ord % 4 <> 0",
    "w19_grid_overlaps": """WITH c AS (SELECT l_orderkey AS doc_id, cast(l_linenumber AS integer) AS row, unnest([1, 2, 3]) AS col FROM lineitem), s AS (SELECT *, CASE WHEN (doc_id + row) % 17 = 0 THEN 2 ELSE 1 END AS rs, CASE WHEN (doc_id * row + col) % 23 = 0 THEN 2 ELSE 1 END AS cs FROM c),
        y AS (SELECT doc_id, unnest(generate_series(row, row + rs - 1)) AS y, col, cs FROM s), x AS (SELECT doc_id, y, unnest(generate_series(col, col + cs - 1)) AS x FROM y) SELECT doc_id, cast(y AS integer) AS y, cast(x AS integer) AS x, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1""",
    "f20_consistent_tables": "SELECT l_orderkey AS doc_id, count(*) >= 2 AND count(DISTINCT l_partkey % 9 = 0) = 1 AS consistent FROM lineitem GROUP BY 1",
    "j05_review_windows": "WITH " + REGIONS_SQL + """, t0 AS (SELECT doc_id, page, region_id AS id, l + 0.02::DOUBLE AS l, t + 0.015::DOUBLE AS t, r, b - 0.015::DOUBLE AS b FROM regions WHERE region_ord IN (1, 2, 4)),
        w AS (SELECT *, greatest(0, l - 0.02::DOUBLE) AS wl, greatest(0, t - 0.02::DOUBLE) AS wt, least(1, r + 0.02::DOUBLE) AS wr, least(1, b + 0.02::DOUBLE) AS wb FROM t0),
        x AS (SELECT w.*, n.t AS nt, n.b AS nb FROM w LEFT JOIN t0 n ON n.doc_id = w.doc_id AND n.page = w.page AND n.id <> w.id)
        SELECT doc_id, cast(page AS integer) AS page, id AS table_id, round(any_value(wl), 6) AS l, round(CASE WHEN coalesce(bool_or(nb <= t AND nb > wt), false) THEN any_value(t) ELSE any_value(wt) END, 6) AS t, round(any_value(wr), 6) AS r,
          round(least(any_value(wb), coalesce(min(nt) FILTER (WHERE nt >= b), 9)), 6) AS b FROM x GROUP BY doc_id, page, id""",
    "w06_slot_reorder": _W + """o AS (SELECT *, (ord * 7) % 11 AS want FROM blocks WHERE ord % 3 = 0), s AS (SELECT doc_id, page, ord AS slot, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS n FROM o),
        k AS (SELECT doc_id, page, block_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY want, t, l, ord) AS n FROM o)
        SELECT doc_id, page, block_id, cast(slot AS integer) AS slot FROM k JOIN s USING (doc_id, page, n) UNION ALL SELECT doc_id, page, block_id, cast(ord AS integer) FROM blocks WHERE ord % 3 <> 0""",
    "w20_runs_with_gap": _W + """p AS (SELECT doc_id, ord FROM blocks WHERE (ord * ord + doc_id) % 7 < 2), f AS (SELECT *, CASE WHEN coalesce(ord - lag(ord) OVER (PARTITION BY doc_id ORDER BY ord) > 4, true) THEN 1 ELSE 0 END AS new FROM p),
        r AS (SELECT *, cast(sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS bigint) AS run FROM f) SELECT doc_id, run, cast(min(ord) AS integer) AS first, cast(max(ord) AS integer) AS last, count(*) AS n FROM r GROUP BY 1, 2""",
    "a11_image_area": "WITH " + REGIONS_SQL + " SELECT doc_id, cast(page AS integer) AS page, round(least(1, sum((r - l) * (b - t))), 6) AS ratio FROM regions WHERE region_ord <= 1 + page % 5 GROUP BY 1, 2",
    "t08_page_edges": _W + "e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord DESC) AS z FROM blocks) SELECT doc_id, page, block_id, length(text[1:500]) AS n_chars FROM e WHERE a <= 2 OR z <= 2",
    "t06_pending_rounds": _W + "p AS (SELECT doc_id, ord, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) // 8 + 1 AS r FROM blocks WHERE ord % 3 <> 1) SELECT doc_id, cast(ord AS integer) AS ord, CASE WHEN r <= 2 THEN cast(r AS integer) END AS round FROM p",
    "u05_content_ids": "WITH " + BLOCKS_SQL + " SELECT doc_id, 'visual-p' || page || '-' || sha256(page || '|logo|' || text)[1:20] AS id, cast(min(ord) AS integer) AS ord FROM blocks GROUP BY 1, 2",
    "k15_crop_boxes": _W + _CONTROLS + """, p AS (SELECT *, greatest(2 * (r - l), 2 * (b - t), 0.02::DOUBLE) AS m FROM controls)
        SELECT doc_id, cast(ord AS integer) AS ord, round(greatest(0, l - m), 6) AS l, round(greatest(0, t - m), 6) AS t, round(least(1, r + m), 6) AS r, round(least(1, b + m), 6) AS b FROM p""",
}
