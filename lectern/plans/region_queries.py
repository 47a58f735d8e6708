"""Queries over review regions and semantic regions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import strip
from ..operators import claims as C
from ..operators import review as R
from ..sources import adapt
from ..sources.adapt import BLOCKS_SQL, REGIONS_SQL

PAGE = list(R.PAGE)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return adapt.blocks(adapt.table(spark, d, "documents"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return adapt.regions(adapt.table(spark, d, "documents"))


def u07_review_regions(spark: SparkSession, d: str) -> DataFrame:
    """A word of each uncertain line, every tenth line as a redaction, the image of a page as a chart; some words have no place."""
    b = _blocks(spark, d)
    x, w = F.col("box"), F.col("box.r") - F.col("box.l")
    left = F.col("box.l") + w * ((F.col("ord") * 37) % 60) / 100.0
    word = F.when(F.expr("ord % 211 <> 7"), g.pad(g.box(left, x["t"], left + w * 0.06, x["b"])))
    low = b.where("score is null or score < 0.85").select(*PAGE, (F.col("ord") * 2).alias("cand_ord"), word.alias("box"), F.array(F.lit("low_ocr_confidence")).alias("reasons"), F.array("block_id").alias("sources"))
    red = b.where("ord % 10 = 0").select(*PAGE, (F.col("ord") * 2 + 1).alias("cand_ord"), g.pad(x).alias("box"), F.array(F.lit("redaction_candidate")).alias("reasons"), F.array(F.concat(F.lit("r"), "ord"), F.col("block_id")).alias("sources"))
    chart = _regions(spark, d).where("region_ord = 4").select(*PAGE, F.lit(10**9).alias("cand_ord"), g.pad(x).alias("box"), F.array(F.lit("complex_layout_region")).alias("reasons"), F.array("region_id").alias("sources"))
    columns = b.where("doc_id % 4 = 0").select(*PAGE).distinct().withColumn("reasons", F.array(F.lit("multi_column")))
    r = R.review_regions(low.unionByName(red).unionByName(chart), columns)
    corner = lambda k: F.round(F.col(f"box.{k}"), 9).alias(k)
    return r.select(*PAGE, "region_no", *map(corner, "ltrb"), F.array_join("reasons", ",").alias("reasons"), F.array_join("sources", ",").alias("sources"))


def _row(name: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("k", "block_id")))


def j13_table_claims(spark: SparkSession, d: str) -> DataFrame:
    """Tables are the regions 2 and 4 of a page; six proposals of five blocks and of some of the next five."""
    b = _blocks(spark, d)
    t = _regions(spark, d).where("region_ord in (2, 4)").select(*PAGE, F.concat("region_id", F.lit("-t")).alias("table_id"), F.col("region_id").alias("layout_region_id"), "box")
    held = b.where("k div 8 in (1, 3)").select(*PAGE, F.concat(F.lit("p"), "page", F.lit("-l"), F.when(F.expr("k div 8 = 1"), 2).otherwise(4), F.lit("-t")).alias("table_id"), "block_id")
    some = b.where("(doc_id + page) % 7 <> 0").select(*PAGE, "k", "block_id", F.explode(F.expr("filter(array(k div 5, k div 5 - 1), x -> x between 0 and 5 and (x = k div 5 or (doc_id + k) % 4 = 0))")).alias("proposal_ord"))
    p = some.groupBy(*PAGE, "proposal_ord").agg(F.transform(_row("k"), lambda x: x["block_id"]).alias("block_ids"))
    ids = F.when(F.expr("(doc_id + page + proposal_ord) % 11 = 0"), F.concat("block_ids", F.array(F.lit("p0-b0")))).when(F.expr("(doc_id + proposal_ord) % 13 = 0"), F.concat("block_ids", F.slice("block_ids", 1, 1))).otherwise(F.col("block_ids"))
    region = lambda n: F.array(F.concat(F.lit("p"), "page", F.lit(f"-l{n}")))
    cited = F.when(F.expr("proposal_ord in (1, 2) and doc_id % 3 = 0"), region(2)).when(F.expr("proposal_ord = 4 and doc_id % 2 = 0"), region(4)).otherwise(F.array().cast("array<string>"))
    p = p.select(*PAGE, "proposal_ord", F.concat(F.lit("s"), F.col("proposal_ord")).alias("proposal_id"), ids.alias("block_ids"), cited.alias("region_ids"))
    out = C.table_claims(t, held, p, b.select(*PAGE, "block_id", F.when(F.expr("k div 5 <> 3"), F.col("box")).alias("box")))
    return out.select(*PAGE, "table_id", "layout_region_id", F.to_json("box").alias("box"), "origin")


def _partition(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Eight proposals of five blocks; by (doc_id + page) % 9 one of five faults or none. Every tenth block is named by none, every 17th is derived."""
    b = _blocks(spark, d).withColumn("source", F.when(F.expr("ord % 17 = 5"), "derived"))
    read = b.where("source is null")
    m = "(doc_id + page) % 9"
    each = read.where("(doc_id + page) % 10 <> 9").select(*PAGE, "k", "block_id", F.explode(F.expr(f"filter(array(k div 5, if({m} = 4 and k div 5 = 6, 2, -1)), x -> x >= 0 and k % 10 <> 7)")).alias("i"))
    p = each.groupBy(*PAGE, "i").agg(F.transform(_row("k"), lambda x: x["block_id"]).alias("ids"))
    ids = F.when(F.expr(f"{m} = 2 and i = 1"), F.concat("ids", F.slice("ids", 1, 1))).when(F.expr(f"{m} = 3 and i = 5"), F.concat("ids", F.array(F.lit("gone")))).otherwise(F.col("ids"))
    region = F.when(F.expr(f"{m} = 1 and i = 4"), F.lit("p0-l1")).when(F.expr("i = 6"), F.concat(F.lit("p"), "page", F.lit("-sr-fallback-"), F.col("i") + 1)).otherwise(F.concat(F.lit("p"), "page", F.lit("-l"), F.col("i") % 5 + 1))
    kind = F.element_at(F.array(*map(F.lit, ("text", "heading", "table", "list"))), (F.col("i") % 4 + 1).cast("int"))
    name = F.concat(F.lit("s"), F.when(F.expr(f"{m} = 0 and i = 3"), 2).otherwise(F.col("i")))
    proposals = p.select(*PAGE, F.col("i").alias("proposal_ord"), F.expr("(i * 3) % 8").alias("reading_order"), name.alias("proposal_id"), kind.alias("type"), ids.alias("block_ids"), F.array(region).alias("region_ids"))
    own = F.array_sort(F.collect_list(F.struct("k", "block_id", strip(F.col("text")).alias("text"))))
    f = read.groupBy(*PAGE, F.expr("k div 4").alias("c")).agg(own.alias("own"))
    fallback = f.select(*PAGE, (F.col("c") + 1).alias("chunk_ord"), F.concat(F.lit("c"), "c").alias("chunk_id"), F.when(F.col("c") == 3, "table").otherwise("text").alias("type"), F.transform("own", lambda x: x["block_id"]).alias("block_ids"), F.array_join(F.transform("own", lambda x: x["text"]), "\n").alias("text"))
    return proposals, b, _regions(spark, d), fallback


def j15_semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = C.semantic_chunks(*_partition(spark, d))
    return x.select(*PAGE, "reading_order", "chunk_id", "type", F.array_join("block_ids", ",").alias("blocks"), F.md5("text").alias("text_md5"), "origin")


def j15_partition_faults(spark: SparkSession, d: str) -> DataFrame:
    p, b, r, _ = _partition(spark, d)
    return C.partition_faults(p, b.where("source is null"), r)


QUERIES = {f.__name__: f for f in (u07_review_regions, j13_table_claims, j15_semantic_chunks, j15_partition_faults)}

_STRIP = r"regexp_replace({}, '^[\s\x0b\x1c-\x1f\x85\p{{Z}}]+|[\s\x0b\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"
_AREA = "greatest(0.0::DOUBLE, {0}.r - {0}.l) * greatest(0.0::DOUBLE, {0}.b - {0}.t)"
_BOTH = "greatest(0.0::DOUBLE, greatest({0}.r, {1}.r) - least({0}.l, {1}.l)) * greatest(0.0::DOUBLE, greatest({0}.b, {1}.b) - least({0}.t, {1}.t))"
_MERGE = "{{'l': least({0}.l, {1}.l), 't': least({0}.t, {1}.t), 'r': greatest({0}.r, {1}.r), 'b': greatest({0}.b, {1}.b), 'ids': list_concat({0}.ids, {1}.ids)}}"
_JOINS = (
    "greatest({0}.l, {1}.l) <= least({0}.r, {1}.r) AND greatest({0}.t, {1}.t) <= least({0}.b, {1}.b) AND " + f"{_BOTH} <= {R.MOST_AREA} AND {_BOTH} <= ({_AREA.format('{0}')} + {_AREA.format('{1}')}) * {R.MOST_GROWTH}"
)
_PAD = lambda l, t, r, b: f"greatest(0.0::DOUBLE, {l} - 0.02::DOUBLE) AS l, greatest(0.0::DOUBLE, {t} - 0.02::DOUBLE) AS t, least(1.0::DOUBLE, {r} + 0.02::DOUBLE) AS r, least(1.0::DOUBLE, {b} + 0.02::DOUBLE) AS b"  # noqa: E731, E741


def _halved(source: str) -> str:
    big, across = f"({_AREA.format('h')} > {R.MOST_AREA})", "h.r - h.l >= h.b - h.t"
    return f"""SELECT doc_id, page, merged, reasons, sources, cut OR {big} AS cut, part * 2 + s AS part,
      CASE WHEN {big} AND s = 1 AND {across} THEN (l + r) / 2 ELSE l END AS l, CASE WHEN {big} AND s = 1 AND NOT ({across}) THEN (t + b) / 2 ELSE t END AS t,
      CASE WHEN {big} AND s = 0 AND {across} THEN (l + r) / 2 ELSE r END AS r, CASE WHEN {big} AND s = 0 AND NOT ({across}) THEN (t + b) / 2 ELSE b END AS b
      FROM ({source}) h, (SELECT unnest([0, 1]) AS s) WHERE s = 0 OR {big}"""


_OWN = f"""own AS (
  SELECT doc_id, page, n - 1 AS merged, o.l, o.t, o.r, o.b, o.ids AS ids FROM (SELECT doc_id, page, unnest(done) AS o, generate_subscripts(done, 1) AS n FROM last_of)
), parts0 AS (
  SELECT doc_id, page, merged, any_value(own.l) AS l, any_value(own.t) AS t, any_value(own.r) AS r, any_value(own.b) AS b, flatten(list(c.reasons)) AS reasons, flatten(list(c.sources)) AS sources, false AS cut, 0 AS part
  FROM (SELECT *, unnest(ids) AS cand_ord FROM own) own JOIN local c USING (doc_id, page, cand_ord) GROUP BY doc_id, page, merged
), parts AS ({_halved(_halved(_halved("SELECT * FROM parts0")))})"""
_U07 = (
    "WITH RECURSIVE "
    + BLOCKS_SQL
    + ", "
    + REGIONS_SQL
    + f""", words AS (SELECT *, l + (r - l) * ((ord * 37) % 60) / 100.0::DOUBLE AS x FROM blocks), cand AS (
  SELECT doc_id, page, ord * 2 AS cand_ord, ord % 211 <> 7 AS placed, {_PAD("x", "t", "(x + (r - l) * 0.06::DOUBLE)", "b")}, ['low_ocr_confidence'] AS reasons, [block_id] AS sources FROM words WHERE score IS NULL OR score < 0.85 UNION ALL
  SELECT doc_id, page, ord * 2 + 1, true, {_PAD("l", "t", "r", "b")}, ['redaction_candidate'], ['r' || ord, block_id] FROM blocks WHERE ord % 10 = 0 UNION ALL
  SELECT doc_id, page, 1000000000, true, {_PAD("l", "t", "r", "b")}, ['complex_layout_region'], [region_id] FROM regions WHERE region_ord = 4
), placeless AS (SELECT doc_id, page FROM cand GROUP BY doc_id, page HAVING NOT bool_and(placed)
), told AS (SELECT * REPLACE (CASE WHEN doc_id % 4 = 0 THEN reasons || ['multi_column'] ELSE reasons END AS reasons) FROM cand
), local AS (SELECT * FROM told ANTI JOIN placeless USING (doc_id, page)
), merge AS (
  SELECT doc_id, page, list({{'l': l, 't': t, 'r': r, 'b': b, 'ids': [cand_ord]}} ORDER BY cand_ord) AS todo, list({{'l': l, 't': t, 'r': r, 'b': b, 'ids': [cand_ord]}}) FILTER (WHERE cand_ord < 0) AS done, false AS ended FROM local GROUP BY doc_id, page UNION ALL
  SELECT doc_id, page, CASE WHEN len(todo) > 0 AND hit > 0 THEN [{_MERGE.format("todo[1]", "rest[hit]")}] || rest[:hit - 1] || rest[hit + 1:] WHEN len(todo) > 0 THEN rest
      WHEN near IS NOT NULL THEN done[:near.i - 1] || done[near.i + 1:near.j - 1] || done[near.j + 1:] || [{_MERGE.format("done[near.i]", "done[near.j]")}] ELSE todo END,
    CASE WHEN len(todo) > 0 AND hit > 0 THEN done WHEN len(todo) > 0 THEN coalesce(done, []) || [todo[1]] WHEN near IS NOT NULL THEN [] ELSE done END, len(todo) = 0 AND near IS NULL
  FROM (SELECT *, todo[2:] AS rest, coalesce(list_position(list_transform(todo[2:], lambda x: {_JOINS.format("todo[1]", "x")}), true), 0) AS hit,
      CASE WHEN len(todo) = 0 AND len(done) > {R.TARGET} THEN list_sort(list_filter(flatten(list_transform(range(1, len(done)), lambda i: list_transform(range(i + 1, len(done) + 1), lambda j: {{
        'd': ((done[i].l + done[i].r - done[j].l - done[j].r) / 2) * ((done[i].l + done[i].r - done[j].l - done[j].r) / 2) + ((done[i].t + done[i].b - done[j].t - done[j].b) / 2) * ((done[i].t + done[i].b - done[j].t - done[j].b) / 2),
        'i': i, 'j': j, 'a': {_BOTH.format("done[i]", "done[j]")}}}))), lambda p: p.a <= {R.MOST_AREA}))[1] END AS near
    FROM merge WHERE NOT ended)
), last_of AS (SELECT * FROM merge WHERE ended), {_OWN}, every AS (
  SELECT doc_id, page, merged, l, t, r, b, CASE WHEN cut THEN reasons || ['{R.TILED}'] ELSE reasons END AS reasons, sources FROM parts UNION ALL
  SELECT doc_id, page, 0, 0.0, 0.0, 1.0, 1.0, flatten(list(reasons)) || ['{R.NO_GEOMETRY}'], [] FROM told SEMI JOIN placeless USING (doc_id, page) GROUP BY doc_id, page
) SELECT doc_id, page, cast(row_number() OVER (PARTITION BY doc_id, page ORDER BY t, l, merged) AS int) AS region_no, round(l, 9) AS l, round(t, 9) AS t, round(r, 9) AS r, round(b, 9) AS b,
  array_to_string(list_sort(list_distinct(reasons)), ',') AS reasons, array_to_string(list_sort(list_distinct(sources)), ',') AS sources FROM every"""
)
_J13 = (
    "WITH RECURSIVE "
    + BLOCKS_SQL
    + ", "
    + REGIONS_SQL
    + """, tabs AS (SELECT doc_id, page, region_id || '-t' AS table_id, region_id, {'l': l, 't': t, 'r': r, 'b': b} AS box FROM regions WHERE region_ord IN (2, 4)
), raw AS (SELECT doc_id, page, k, block_id, unnest(list_distinct([k // 5, CASE WHEN (doc_id + k) % 4 = 0 THEN k // 5 - 1 ELSE k // 5 END])) AS i FROM blocks WHERE (doc_id + page) % 7 <> 0
), prop AS (
  SELECT doc_id, page, i, CASE WHEN (doc_id + page + i) % 11 = 0 THEN ids || ['p0-b0'] WHEN (doc_id + i) % 13 = 0 THEN ids || ids[1:1] ELSE ids END AS ids,
    CASE WHEN i IN (1, 2) AND doc_id % 3 = 0 THEN 'p' || page || '-l2' WHEN i = 4 AND doc_id % 2 = 0 THEN 'p' || page || '-l4' END AS cited
  FROM (SELECT doc_id, page, i, list(block_id ORDER BY k) AS ids FROM raw WHERE i BETWEEN 0 AND 5 GROUP BY doc_id, page, i)
), split AS (SELECT doc_id, page, cited AS region_id FROM prop WHERE cited IS NOT NULL GROUP BY doc_id, page, cited HAVING count(*) > 1
), kept AS (SELECT * FROM tabs SEMI JOIN prop USING (doc_id, page) ANTI JOIN split USING (doc_id, page, region_id)
), bx AS (SELECT doc_id, page, block_id, k, CASE WHEN k // 5 <> 3 THEN {'l': l, 't': t, 'r': r, 'b': b} END AS box FROM blocks
), sound AS (
  SELECT doc_id, page, i, bool_and(bx.block_id IS NOT NULL) AS sound, min(box.l) AS l, min(box.t) AS t, max(box.r) AS r, max(box.b) AS b FROM (SELECT *, unnest(ids) AS block_id FROM prop) LEFT JOIN bx USING (doc_id, page, block_id) GROUP BY doc_id, page, i
), able AS (
  SELECT doc_id, page, i, ids, l, t, r, b, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS n FROM prop JOIN sound USING (doc_id, page, i)
  WHERE sound AND l IS NOT NULL AND len(ids) = len(list_distinct(ids)) AND (cited IS NULL OR (doc_id, page, cited) IN (SELECT (doc_id, page, region_id) FROM split))
), taken AS (SELECT doc_id, page, list(block_id) AS ids FROM kept JOIN (SELECT doc_id, page, block_id, 'p' || page || '-l' || CASE WHEN k // 8 = 1 THEN 2 ELSE 4 END AS region_id FROM blocks WHERE k // 8 IN (1, 3)) USING (doc_id, page, region_id) GROUP BY doc_id, page
), claim AS (
  SELECT doc_id, page, cast(0 AS bigint) AS n, coalesce(t.ids, []) AS used, false AS won, cast(0 AS bigint) AS i FROM (SELECT DISTINCT doc_id, page FROM able) LEFT JOIN taken t USING (doc_id, page) UNION ALL
  SELECT a.doc_id, a.page, a.n, CASE WHEN list_has_any(c.used, a.ids) THEN c.used ELSE c.used || a.ids END, NOT list_has_any(c.used, a.ids), a.i FROM claim c JOIN able a ON a.doc_id = c.doc_id AND a.page = c.page AND a.n = c.n + 1
) SELECT doc_id, page, table_id, region_id AS layout_region_id, cast(to_json(box) AS varchar) AS box, 'retained' AS origin FROM kept UNION ALL
SELECT doc_id, page, 's' || i || '-table', 's' || i || '-semantic-table', cast(to_json({'l': l, 't': t, 'r': r, 'b': b}) AS varchar), 'added' FROM claim JOIN able USING (doc_id, page, n, i) WHERE won"""
)
_PARTITION = (
    "WITH "
    + BLOCKS_SQL
    + f""", b AS (SELECT *, (doc_id + page) % 9 AS m, ord % 17 = 5 AS derived, {_STRIP.format("text")} AS bare FROM blocks
), raw AS (SELECT *, unnest(CASE WHEN m = 4 AND k // 5 = 6 THEN [6, 2] ELSE [k // 5] END) AS i FROM b WHERE NOT derived AND (doc_id + page) % 10 <> 9 AND k % 10 <> 7
), prop AS (
  SELECT doc_id, page, m, i, (i * 3) % 8 AS reading_order, 's' || CASE WHEN m = 0 AND i = 3 THEN 2 ELSE i END AS proposal_id, list(block_id ORDER BY k) AS ids FROM raw GROUP BY doc_id, page, m, i
), fault0 AS (
  SELECT doc_id, page, m, CASE WHEN m = 0 AND bool_or(i = 2) AND bool_or(i = 3) THEN 'repeated_id' WHEN m = 1 AND bool_or(i = 4) THEN 'unknown_region' WHEN m = 2 AND bool_or(i = 1) THEN 'repeated_block' WHEN m = 3 AND bool_or(i = 5) THEN 'unknown_or_reused_block'
    WHEN m = 4 AND bool_or(i = 6) THEN 'unknown_or_reused_block' END AS fault FROM prop GROUP BY doc_id, page, m
), faults AS (SELECT doc_id, page, fault, CASE m WHEN 1 THEN 's4' WHEN 2 THEN 's1' WHEN 3 THEN 's5' WHEN 4 THEN 's2' END AS proposal_id FROM fault0 WHERE fault IS NOT NULL
), sound AS (SELECT doc_id, page FROM fault0 WHERE fault IS NULL
), fb AS (
  SELECT doc_id, page, k // 4 AS c, list(block_id ORDER BY k) AS ids, string_agg(bare, chr(10) ORDER BY k) AS text FROM b WHERE NOT derived GROUP BY doc_id, page, k // 4
), made AS (
  SELECT doc_id, page, i, (i * 3) % 8 AS place, 0 AS stage, i AS seq, 's' || i AS chunk_id, ['text', 'heading', 'text', 'list'][i % 4 + 1] AS type, list(block_id ORDER BY k) AS ids, string_agg(bare, chr(10) ORDER BY k) AS text, 'proposed' AS origin
  FROM raw SEMI JOIN sound USING (doc_id, page) WHERE k // 4 <> 3 GROUP BY doc_id, page, i
), n AS (SELECT doc_id, page, p.n + coalesce(c.n, 0) AS n FROM (SELECT doc_id, page, count(*) AS n FROM prop SEMI JOIN sound USING (doc_id, page) GROUP BY doc_id, page) p LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM made GROUP BY doc_id, page) c USING (doc_id, page)
), missing AS (SELECT doc_id, page, block_id, text, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS seq FROM b SEMI JOIN sound USING (doc_id, page) WHERE NOT derived AND k % 10 = 7
), before AS (
  SELECT doc_id, page, place, stage, seq, chunk_id, type, ids, text, origin FROM made UNION ALL
  SELECT doc_id, page, n + seq, 1, seq, 'p' || page || '-semantic-fallback-' || block_id, 'text', [block_id], text, 'missing' FROM missing JOIN n USING (doc_id, page) UNION ALL
  SELECT doc_id, page, c + 1, 2, c + 1, 'c' || c, 'table', ids, text, 'table' FROM fb SEMI JOIN sound USING (doc_id, page) WHERE c = 3
), late AS (SELECT doc_id, page, block_id, text, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS seq FROM b SEMI JOIN sound USING (doc_id, page) WHERE derived
), every AS (
  SELECT * FROM before UNION ALL
  SELECT doc_id, page, coalesce(c.n, 0) + seq, 3, seq, 'p' || page || '-derived-' || seq, 'text', [block_id], text, 'derived' FROM late LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM before GROUP BY doc_id, page) c USING (doc_id, page)
)"""
)
ORACLES = {
    "u07_review_regions": _U07,
    "j13_table_claims": _J13,
    "j15_semantic_chunks": _PARTITION
    + """ SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY place, stage, seq) AS reading_order, chunk_id, type, array_to_string(ids, ',') AS blocks, md5(text) AS text_md5, origin FROM every UNION ALL
        SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY c), 'c' || c, CASE WHEN c = 3 THEN 'table' ELSE 'text' END, array_to_string(ids, ','), md5(text), 'fallback' FROM fb ANTI JOIN sound USING (doc_id, page)""",
    "j15_partition_faults": _PARTITION + " SELECT doc_id, page, fault, proposal_id FROM faults",
}
