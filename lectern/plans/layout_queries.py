"""Queries over recorded text blocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import layout as L
from ..sources import adapt
from ..sources.adapt import BLOCKS_SQL, REGIONS_SQL

PAGE = list(L.PAGE)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return adapt.blocks(adapt.table(spark, d, "documents"))


def w03_upper_median(spark: SparkSession, d: str) -> DataFrame:
    return L.upper_median_height(_blocks(spark, d)).select(*PAGE, F.round("median_h", 6).alias("median_h"))


def x06_block_types(spark: SparkSession, d: str) -> DataFrame:
    return L.typed(_blocks(spark, d)).groupBy(*PAGE, "type").agg(F.count("*").alias("n"))


def w02_columns(spark: SparkSession, d: str) -> DataFrame:
    return L.columns_of_pages(_blocks(spark, d)).select(*PAGE, "columns", F.round("split", 6).alias("split"), "ambiguous")


def w01_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return L.reading_order(_blocks(spark, d)).select(*PAGE, "block_id", "pos", "columns")


def w04_list_islands(spark: SparkSession, d: str) -> DataFrame:
    return L.chunks(L.typed(_blocks(spark, d))).groupBy(*PAGE, "chunk_no", "chunk_type").agg(F.count("*").alias("n_blocks"))


def a01_page_quality(spark: SparkSession, d: str) -> DataFrame:
    return L.page_quality(_blocks(spark, d)).select(*PAGE, "n_blocks", F.round("mean_score", 6).alias("mean_score"), F.round("low_share", 6).alias("low_share"), F.round("area", 6).alias("area"))


def a02_union_bbox(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).groupBy(*PAGE).agg(g.union_of("box").alias("u")).select(*PAGE, "u.l", "u.t", "u.r", "u.b")


def f01_routing_reasons(spark: SparkSession, d: str) -> DataFrame:
    return L.routing_reasons(L.typed(_blocks(spark, d)))


def f02_review_blocks(spark: SparkSession, d: str) -> DataFrame:
    return L.review_flags(_blocks(spark, d)).groupBy(*PAGE).agg(F.count_if("strict").alias("n_strict"), F.count_if("routed").alias("n_routed"), F.count_if("risk").alias("n_risk"))


def f08_box_validity(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("box")
    return _blocks(spark, d).groupBy("doc_id").agg(F.count_if(g.valid(b)).alias("n_valid"), F.count_if(g.valid(g.pad(b, 0.06))).alias("n_padded_valid"), F.count_if(b["r"] > 0.94).alias("n_right_edge"))


def j01_block_region(spark: SparkSession, d: str) -> DataFrame:
    x = L.link_regions(_blocks(spark, d), adapt.regions(adapt.table(spark, d, "documents")))
    return x.select(*PAGE, "block_id", "region_id", F.round("coverage", 6).alias("coverage"), "is_primary")


def j29_chunk_region(spark: SparkSession, d: str) -> DataFrame:
    b = L.typed(_blocks(spark, d))
    return L.region_of_chunks(L.chunks(b), L.link_regions(b, adapt.regions(adapt.table(spark, d, "documents"))))


def _cells(blocks: DataFrame) -> DataFrame:
    """A grid of five rows and two columns on every page."""
    c = blocks.select(*PAGE).distinct().withColumn("cell_ord", F.explode(F.sequence(F.lit(0), F.lit(9))))
    row, col = F.expr("cell_ord div 2"), F.expr("cell_ord % 2")
    return c.withColumns({"cell_id": F.concat(F.lit("c"), "cell_ord"), "box": g.box(col * 500 / 1000.0, row * 200 / 1000.0, (col * 500 + 500) / 1000.0, (row * 200 + 200) / 1000.0)})


def j02_block_cell(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    return L.assign_cells(b, _cells(b))


def j06_nearest_label(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    c = b.where("ord % 6 = 0").select(*PAGE, F.concat(F.lit("x"), "ord").alias("control_id"), g.box(F.col("box.l") - 0.04, F.col("box.t"), F.col("box.l") - 0.01, F.col("box.b")).alias("box"))
    return L.nearest_labels(c, b)


def k02_markdown_offsets(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.publish import page_offsets

    return page_offsets(_blocks(spark, d))


def a06_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.evaluate import type_histogram

    b = L.typed(_blocks(spark, d))
    return type_histogram(b, b.withColumn("type", F.when(F.expr("ord % 50 = 0"), "logo").otherwise(F.col("type"))))


TYPED_SQL = (
    BLOCKS_SQL
    + r""", heights AS (
  SELECT doc_id, page, list_sort(list(b - t)) AS h FROM blocks GROUP BY doc_id, page
), medians AS (
  SELECT doc_id, page, h[len(h) // 2 + 1] AS median_h FROM heights
), stripped AS (
  SELECT *, regexp_replace(text, '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g') AS x FROM blocks JOIN medians USING (doc_id, page)
), typed AS (
  SELECT *, CASE WHEN x[1] = '•' OR x[1:2] IN ('- ', '* ') OR regexp_matches(x, '^\d{1,3}\.') THEN 'list_item'
    WHEN contains(x, chr(9)) OR length(x) - length(replace(x, '|', '')) >= 2 THEN 'table_row'
    WHEN contains(x, ':') AND instr(x, ':') - 1 <= 40 THEN 'key_value'
    WHEN median_h > 0 AND b - t >= median_h * 1.35::DOUBLE AND length(x) <= 100 THEN 'heading' ELSE 'paragraph' END AS type
  FROM stripped
)"""
)
COLUMNS_SQL = """centres AS (
  SELECT doc_id, page, list_sort(list((l + r) / 2)) AS c FROM blocks GROUP BY doc_id, page
), gaps AS (
  SELECT doc_id, page, c, CASE WHEN len(c) > 1 THEN list_max([{'gap': c[i + 1] - c[i], 'i': i - 1} FOR i IN range(1, len(c))]) ELSE {'gap': 0.0::DOUBLE, 'i': 0} END AS w FROM centres
), cols AS (
  SELECT doc_id, page, c, w, w.gap > 0.25 AND w.i >= 1 AND len(c) - w.i >= 3 AS two FROM gaps
), columns_found AS (
  SELECT doc_id, page, CASE WHEN two THEN 2 ELSE 1 END AS columns, CASE WHEN two THEN (c[w.i + 1] + c[w.i + 2]) / 2 END AS split, w.gap > 0.12 AND w.gap <= 0.25 AS ambiguous FROM cols
)"""
CHUNKS_SQL = r"""runs0 AS (
  SELECT *, type IN ('list_item', 'key_value', 'table_row') AND coalesce(lag(type) OVER w = type, false) AS joins,
    len(string_split(regexp_replace(replace(text, chr(9), '|'), '^\|+|\|+$', '', 'g'), '|')) AS cells FROM typed WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)
), runs1 AS (
  SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY ord) AS run FROM runs0
), runs2 AS (
  SELECT *, last_value(cells) OVER (PARTITION BY doc_id, page, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_cells FROM runs1
), runs3 AS (
  SELECT *, max(CASE WHEN cells <> last_cells THEN ord END) OVER (PARTITION BY doc_id, page, run) AS changed, count(*) OVER (PARTITION BY doc_id, page, run) AS size FROM runs2
), runs4 AS (
  SELECT *, changed IS NULL OR ord > changed AS tail FROM runs3
), runs5 AS (
  SELECT *, type = 'table_row' AND tail AND count(*) FILTER (WHERE tail) OVER (PARTITION BY doc_id, page, run) >= 2 AND last_cells >= 2 AS in_table FROM runs4
), runs6 AS (
  SELECT *, CASE WHEN in_table THEN 'table' WHEN type = 'table_row' THEN 'paragraph' WHEN type = 'list_item' THEN 'list' WHEN type = 'key_value' AND size > 1 THEN 'form' ELSE type END AS chunk_type,
    joins AND (type <> 'table_row' OR (in_table AND coalesce(lag(in_table) OVER (PARTITION BY doc_id, page ORDER BY ord), false))) AS same FROM runs5
), chunked AS (
  SELECT *, cast(sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY ord) AS bigint) AS chunk_no FROM runs6
)"""
LINKS_SQL = """pairs AS (
  SELECT x.*, y.region_id, y.region_ord, y.score AS r_score, (y.r - y.l) * (y.b - y.t) AS r_area,
    greatest(0.0::DOUBLE, least(x.r, y.r) - greatest(x.l, y.l)) * greatest(0.0::DOUBLE, least(x.b, y.b) - greatest(x.t, y.t)) / ((x.r - x.l) * (x.b - x.t)) AS coverage,
    (x.l + x.r) / 2 BETWEEN y.l AND y.r AND (x.t + x.b) / 2 BETWEEN y.t AND y.b AS inside
  FROM blocks x JOIN regions y USING (doc_id, page)
), links AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page, block_id ORDER BY coverage DESC, r_score DESC, r_area, region_ord) = 1 AS is_primary FROM pairs WHERE inside OR coverage >= 0.5
)"""
_W = "WITH "

QUERIES = {f.__name__: f for f in (w03_upper_median, x06_block_types, w02_columns, w01_reading_order, w04_list_islands, a01_page_quality, a02_union_bbox, f01_routing_reasons, f02_review_blocks, f08_box_validity, j01_block_region, j29_chunk_region, j02_block_cell, j06_nearest_label, k02_markdown_offsets, a06_type_histogram)}
ORACLES = {
    "w03_upper_median": _W + BLOCKS_SQL + ", h AS (SELECT doc_id, page, list_sort(list(b - t)) AS h FROM blocks GROUP BY ALL) SELECT doc_id, page, round(h[len(h) // 2 + 1], 6) AS median_h FROM h",
    "x06_block_types": _W + TYPED_SQL + " SELECT doc_id, page, type, count(*) AS n FROM typed GROUP BY ALL",
    "w02_columns": _W + BLOCKS_SQL + ", " + COLUMNS_SQL + " SELECT doc_id, page, columns, round(split, 6) AS split, ambiguous FROM columns_found",
    "w01_reading_order": _W + BLOCKS_SQL + ", " + COLUMNS_SQL + """ SELECT doc_id, page, block_id, cast(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN columns = 2 AND (l + r) / 2 >= split THEN 1 ELSE 0 END, t, l, ord) AS integer) AS pos, columns
        FROM blocks JOIN columns_found USING (doc_id, page)""",
    "w04_list_islands": _W + TYPED_SQL + ", " + CHUNKS_SQL + " SELECT doc_id, page, chunk_no, chunk_type, count(*) AS n_blocks FROM chunked GROUP BY ALL",
    "a01_page_quality": _W + BLOCKS_SQL + """ SELECT doc_id, page, count(*) AS n_blocks, round(avg(score), 6) AS mean_score, round(count(*) FILTER (WHERE score < 0.70) / nullif(count(score), 0), 6) AS low_share,
        round(sum((r - l) * (b - t)), 6) AS area FROM blocks GROUP BY ALL""",
    "a02_union_bbox": _W + BLOCKS_SQL + " SELECT doc_id, page, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM blocks GROUP BY ALL",
    "f01_routing_reasons": _W + TYPED_SQL + ", " + COLUMNS_SQL + """, page AS (
        SELECT doc_id, page, count(*) AS n, avg(score) AS mean, count(score) AS scored, count(*) FILTER (WHERE score < 0.70) AS low, bool_or(type IN ('table_row', 'key_value')) AS form, sum((r - l) * (b - t)) AS area,
          count(*) FILTER (WHERE l < 0.45 AND r < 0.60) AS lefts, count(*) FILTER (WHERE l > 0.40) AS rights, count(*) FILTER (WHERE contains(text, '|') OR contains(text, chr(9))) AS rows FROM typed GROUP BY ALL)
        SELECT doc_id, page, concat_ws(',', CASE WHEN mean IS NULL OR mean < 0.85 THEN 'low_confidence' END, CASE WHEN scored > 0 AND low / scored > 0.20 THEN 'conflicting_confidence' END, CASE WHEN n >= 80 THEN 'dense_layout' END,
          CASE WHEN form THEN 'table_or_form' END, CASE WHEN columns = 2 THEN 'multi_column' END, CASE WHEN ambiguous THEN 'ambiguous_reading_order' END, CASE WHEN area < 0.005 THEN 'low_coverage' END,
          CASE WHEN columns <> 2 AND ((lefts >= 4 AND rights >= 4) OR rows >= 3) THEN 'complex_layout' END) AS reasons FROM page JOIN columns_found USING (doc_id, page)""",
    "f02_review_blocks": _W + BLOCKS_SQL + r""", risk AS (SELECT *, regexp_matches(text, '(?i)(?:\d\|\d|\d:\d|>/=|</=|\b(?:mcg|mg|ml|mmhg)\b[^\x00-\x7f]|\b[A-Z]\d{2}(?:\.\d{1,4})?\b|\b1\d{2}\.\d{1,4}\s*-\s*\d{3}(?:\.\d+)?\b)') AS risk FROM blocks)
        SELECT doc_id, page, count(*) FILTER (WHERE coalesce(score < 0.85, false) OR risk) AS n_strict, count(*) FILTER (WHERE coalesce(score, 0) < 0.85) AS n_routed, count(*) FILTER (WHERE risk) AS n_risk FROM risk GROUP BY ALL""",
    "f08_box_validity": _W + BLOCKS_SQL + """ SELECT doc_id, count(*) FILTER (WHERE l >= 0 AND t >= 0 AND r <= 1 AND b <= 1 AND l < r AND t < b) AS n_valid,
        count(*) FILTER (WHERE greatest(0, l - 0.06) < least(1, r + 0.06) AND greatest(0, t - 0.06) < least(1, b + 0.06)) AS n_padded_valid, count(*) FILTER (WHERE r > 0.94) AS n_right_edge FROM blocks GROUP BY ALL""",
    "j01_block_region": _W + BLOCKS_SQL + ", " + REGIONS_SQL + ", " + LINKS_SQL + " SELECT doc_id, page, block_id, region_id, round(coverage, 6) AS coverage, is_primary FROM links",
    "j29_chunk_region": _W + TYPED_SQL + ", " + CHUNKS_SQL + ", " + REGIONS_SQL + ", " + LINKS_SQL + """, n AS (SELECT c.doc_id, c.page, c.chunk_no, l.region_id, count(*) AS n FROM chunked c JOIN links l USING (doc_id, page, block_id) GROUP BY ALL)
        SELECT doc_id, page, chunk_no, region_id FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, page, chunk_no ORDER BY n DESC, region_id) = 1""",
    "j02_block_cell": _W + BLOCKS_SQL + """, cells AS (SELECT DISTINCT doc_id, page, o AS cell_ord, (o % 2) * 0.5::DOUBLE AS cl, (o // 2) * 200 / 1000.0::DOUBLE AS ct, ((o % 2) * 500 + 500) / 1000.0::DOUBLE AS cr, ((o // 2) * 200 + 200) / 1000.0::DOUBLE AS cb
          FROM (SELECT DISTINCT doc_id, page FROM blocks), (SELECT unnest(generate_series(0, 9)) AS o)),
        cover AS (SELECT doc_id, page, block_id, cell_ord, greatest(0.0::DOUBLE, least(r, cr) - greatest(l, cl)) * greatest(0.0::DOUBLE, least(b, cb) - greatest(t, ct)) / ((r - l) * (b - t)) AS c FROM blocks JOIN cells USING (doc_id, page))
        SELECT doc_id, page, block_id, CASE WHEN c > 0 THEN 'c' || cell_ord END AS cell_id FROM cover QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_id ORDER BY c DESC, cell_ord) = 1""",
    "j06_nearest_label": _W + BLOCKS_SQL + """, controls AS (SELECT doc_id, page, 'x' || ord AS control_id, l - 0.04::DOUBLE AS cl, t AS ct, l - 0.01::DOUBLE AS cr, b AS cb FROM blocks WHERE ord % 6 = 0),
        near AS (SELECT c.*, x.block_id, x.ord, x.score, x.l - c.cr AS dx, abs((x.t + x.b) / 2 - (c.ct + c.cb) / 2) AS dy, greatest(0.0::DOUBLE, least(x.b, c.cb) - greatest(x.t, c.ct)) / least(x.b - x.t, c.cb - c.ct) AS yo, x.text FROM controls c JOIN blocks x USING (doc_id, page)),
        ranked AS (SELECT *, greatest(dx, 0.0::DOUBLE) + 2 * dy AS rank FROM near WHERE dx >= -0.03 AND dx <= 0.04 AND dy <= 0.02 AND yo >= 0.35 AND lower(trim(text)) NOT IN ('x', '✓', '✔', '☑')),
        placed2 AS (SELECT *, row_number() OVER w AS n, lead(rank) OVER w AS next FROM ranked WINDOW w AS (PARTITION BY doc_id, page, control_id ORDER BY rank, ord))
        SELECT doc_id, page, control_id, block_id, (next IS NULL OR next - rank >= 0.03) AND coalesce(score >= 0.85, false) AS is_unique FROM placed2 WHERE n = 1""",
    "k02_markdown_offsets": _W + BLOCKS_SQL + """, pages AS (SELECT doc_id, page, sum(length(text)) + 2 * (count(*) - 1) AS n FROM blocks GROUP BY ALL),
        o AS (SELECT *, coalesce(sum(n + 23) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pages)
        SELECT doc_id, page, cast(start AS bigint) AS start_at, cast(start + n AS bigint) AS end_at FROM o""",
    "a06_type_histogram": _W + TYPED_SQL + """, other AS (SELECT *, CASE WHEN ord % 50 = 0 THEN 'logo' ELSE type END AS type2 FROM typed),
        a AS (SELECT doc_id, type, count(*) AS n FROM other GROUP BY ALL), b AS (SELECT doc_id, type2 AS type, count(*) AS n FROM other GROUP BY ALL),
        e AS (SELECT doc_id, bool_and(type = type2) AS order_exact FROM other GROUP BY ALL)
        SELECT doc_id, type, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, order_exact FROM a FULL JOIN b USING (doc_id, type) JOIN e USING (doc_id)""",
}
