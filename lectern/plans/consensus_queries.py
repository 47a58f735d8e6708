"""Queries over checkboxes that several signals agree on, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as X
from ..operators import consensus as C
from ..sources import adapt
from ..sources.adapt import BLOCKS_SQL
from ..sources.stage import written

PAGE = list(C.PAGE)


def _digest(label: Column) -> Column:
    """The MD5 of a label, which is all that the query shows of it; a blank one stays, as blank labels are filled."""
    return F.when(X.strip(label) == "", label).otherwise(F.md5(label))


def _md5_of(digest: Column) -> Column:
    return F.when(X.strip(digest) != "", digest).otherwise(F.md5(F.coalesce(digest, F.lit(""))))


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Main candidates at every third line, local ones at every second and again at every tenth, by up to 6 thousandths apart; ids that
    stand twice or are none; verifications of most ids. Labels are given as digests, so that no text is shuffled."""
    b = adapt.blocks(adapt.table(spark, d, "documents"))
    o = F.col("ord")
    control = lambda by: g.box(F.col("box.l"), F.col("box.t") + by / 1000.0, F.col("box.l") + 0.02, F.col("box.t") + by / 1000.0 + 0.018)
    state = lambda n: F.element_at(F.array(*map(F.lit, ("CHECKED", "UNCHECKED", "UNCLEAR", "CHECKED"))), n % 4 + 1)
    name = F.when(o % 41 == 0, F.concat(F.lit("bad id "), "ord")).when(o % 33 == 0, F.concat(F.lit("m"), o - 3)).otherwise(F.concat(F.lit("m"), "ord"))
    main = b.where("ord % 3 = 0").select(*PAGE, "ord", name.alias("id"), _digest(F.when(o % 4 == 0, " ").otherwise(F.col("text"))).alias("label"), state(o).alias("state"), control(F.lit(0)).alias("box"), F.when(o % 11 != 0, F.col("block_id")).alias("label_block_id"), ((50 + o % 50) / 100.0).alias("confidence"))
    near = b.where("ord % 2 = 0").withColumn("by", (o % 4) * 3).unionByName(b.where("ord % 10 = 0").withColumn("by", F.lit(2) + o % 3))
    again = F.col("by") < 5
    twin = F.when((o % 10 == 0) & again & (F.col("by") > 0), F.concat(F.lit("c"), "ord", F.lit("b"))).when(o % 14 == 0, F.concat(F.lit("m"), o + 1)).otherwise(F.concat(F.lit("c"), "ord"))
    local = near.select(*PAGE, (o * 2 + (F.col("by") % 3 > 0).cast("int")).alias("ord"), twin.alias("id"), _digest(F.concat(F.lit("local "), "text")).alias("label"), state(o + F.when(o % 9 == 0, 1).otherwise(0)).alias("state"), control(F.col("by")).alias("box"), "block_id", F.lit(0.5).alias("confidence")).withColumnRenamed("block_id", "label_block_id")
    return main, local, C.joint_candidates(main, local), b


def j16_joint_candidates(spark: SparkSession, d: str) -> DataFrame:
    x = _evidence(spark, d)[2]
    return x.select(*PAGE, "pos", "id", "state", "discovered", F.round("box.t", 9).alias("t"))


def j18_consensus(spark: SparkSession, d: str) -> DataFrame:
    _, local, joint, b = _evidence(spark, d)
    joint = written(joint, "joint")
    n = F.coalesce(F.regexp_extract("id", r"(\d+)", 1).try_cast("int"), F.lit(0))
    shown = F.element_at(F.array(*map(F.lit, ("CHECKED", "UNCHECKED", "UNCLEAR", "CHECKED"))), (n + F.when(n % 15 == 0, 1).otherwise(0)) % 4 + 1)
    v = joint.withColumn("n", n).where("n % 7 <> 0").groupBy("doc_id", "id").agg(F.min("page").alias("v_page"), F.min("n").alias("m")).select(
        "doc_id", "id", (F.col("v_page") + F.when(F.col("m") % 51 == 0, 1).otherwise(0)).alias("v_page"), F.when(F.col("m") % 13 == 0, "other").otherwise("checkbox").alias("control_status"), F.col("m").alias("n"),
    ).select("doc_id", "id", "v_page", "control_status", shown.alias("v_state"), ((85 + F.col("n") % 3 * 5) / 100.0).alias("v_confidence"))
    c = joint.withColumn("n", n).withColumns({"given_risks": F.when(F.expr("n % 17 = 0"), F.array(F.lit("no_alphabetic_label"))), "label_grounded": F.expr("n % 19 <> 0")}).drop("n")
    out = C.consensus(c, v, local, b)
    return out.select(*PAGE, "id", _md5_of(F.col("label")).alias("label_md5"), "state", "confidence", "decision", "agreement", F.array_join("risks", ";").alias("risks"))


QUERIES = {f.__name__: f for f in (j16_joint_candidates, j18_consensus)}

_STATE = "['CHECKED', 'UNCHECKED', 'UNCLEAR', 'CHECKED'][cast(({0}) % 4 + 1 AS bigint)]"
_AREA = "greatest(0.0::DOUBLE, {0}.r - {0}.l) * greatest(0.0::DOUBLE, {0}.b - {0}.t)"
_BOTH = "greatest(0.0::DOUBLE, least({0}.r, {1}.r) - greatest({0}.l, {1}.l)) * greatest(0.0::DOUBLE, least({0}.b, {1}.b) - greatest({0}.t, {1}.t))"
_HIT = lambda x, y, limit: f"{_BOTH.format(x, y)} > {limit} * ({_AREA.format(x)} + {_AREA.format(y)} - {_BOTH.format(x, y)})"
_BOX = "{{'l': l, 't': t + {0} / 1000.0::DOUBLE, 'r': l + 0.02::DOUBLE, 'b': t + {0} / 1000.0::DOUBLE + 0.018::DOUBLE}}"
_J16 = (
    "WITH RECURSIVE "
    + BLOCKS_SQL
    + f""", main0 AS (
  SELECT doc_id, page, ord, CASE WHEN ord % 41 = 0 THEN 'bad id ' || ord WHEN ord % 33 = 0 THEN 'm' || (ord - 3) ELSE 'm' || ord END AS id, CASE WHEN ord % 4 = 0 THEN ' ' ELSE text END AS label, {_STATE.format("ord")} AS state, {_BOX.format("0")} AS box,
    CASE WHEN ord % 11 <> 0 THEN block_id END AS label_block_id, (50 + ord % 50) / 100.0::DOUBLE AS confidence FROM blocks WHERE ord % 3 = 0
), main AS (SELECT * FROM main0 QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY ord) = 1
), near AS (SELECT *, (ord % 4) * 3 AS by_ FROM blocks WHERE ord % 2 = 0 UNION ALL SELECT *, 2 + ord % 3 FROM blocks WHERE ord % 10 = 0
), loc AS (
  SELECT doc_id, page, ord * 2 + CASE WHEN by_ % 3 > 0 THEN 1 ELSE 0 END AS ord, CASE WHEN ord % 10 = 0 AND by_ < 5 AND by_ > 0 THEN 'c' || ord || 'b' WHEN ord % 14 = 0 THEN 'm' || (ord + 1) ELSE 'c' || ord END AS id, 'local ' || text AS label,
    {_STATE.format("ord + CASE WHEN ord % 9 = 0 THEN 1 ELSE 0 END")} AS state, {_BOX.format("by_")} AS box, block_id AS label_block_id, 0.5::DOUBLE AS confidence FROM near
), every AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY NOT discovered, ord, id) AS pos FROM (SELECT *, true AS discovered FROM main UNION ALL SELECT *, false FROM loc)
), fold AS (
  SELECT DISTINCT doc_id, page, cast(0 AS bigint) AS pos, cast([] AS STRUCT(l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE)[]) AS kept, false AS taken FROM every UNION ALL
  SELECT e.doc_id, e.page, e.pos, CASE WHEN h.ok THEN list_append(f.kept, e.box) ELSE f.kept END, h.ok FROM fold f JOIN every e ON e.doc_id = f.doc_id AND e.page = f.page AND e.pos = f.pos + 1,
  LATERAL (SELECT e.discovered OR len(list_filter(f.kept, lambda k: {_HIT("k", "e.box", C.SAME)})) = 0 AS ok) h
), joint AS (
  SELECT * REPLACE (CASE WHEN row_number() OVER (PARTITION BY doc_id, id ORDER BY discovered DESC, page, pos) > 1 THEN id || '-local' ELSE id END AS id) FROM every SEMI JOIN (SELECT doc_id, page, pos FROM fold WHERE taken) USING (doc_id, page, pos)
)"""
)
ORACLES = {
    "j16_joint_candidates": _J16 + " SELECT doc_id, page, pos, id, state, discovered, round(box.t, 9) AS t FROM joint",
    "j18_consensus": _J16 + f""", numbered AS (SELECT *, coalesce(try_cast(regexp_extract(id, '(\\d+)', 1) AS int), 0) AS n FROM joint),
        v AS (SELECT doc_id, id, min(page) + CASE WHEN min(n) % 51 = 0 THEN 1 ELSE 0 END AS v_page, min(n) % 13 = 0 AS other, {_STATE.format("min(n) + CASE WHEN min(n) % 15 = 0 THEN 1 ELSE 0 END")} AS v_state, (85 + min(n) % 3 * 5) / 100.0::DOUBLE AS v_confidence FROM numbered WHERE n % 7 <> 0 GROUP BY doc_id, id),
        named AS (SELECT * FROM numbered WHERE regexp_matches(id, '^[A-Za-z0-9._-]{{1,80}}$') QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY discovered DESC, page, pos) = 1),
        seen AS (SELECT named.*, v_page, v_state, v_confidence, v_page = page AND v_state = state AND v_state IN ('CHECKED', 'UNCHECKED') AND v_confidence >= 0.9 AS sure FROM named JOIN v USING (doc_id, id) WHERE NOT other),
        marked AS (SELECT s.*, EXISTS (SELECT 1 FROM seen e WHERE e.doc_id = s.doc_id AND e.page = s.page AND e.pos < s.pos AND {_HIT("e.box", "s.box", C.SAME)}) AS hits FROM seen s),
        pairs AS (SELECT m.doc_id, m.page, m.id, x.id AS local_id, x.state AS l_state, x.label AS l_label, x.label_block_id AS l_block, {_BOTH.format("m.box", "x.box")} / ({_AREA.format("m.box")} + {_AREA.format("x.box")} - {_BOTH.format("m.box", "x.box")}) AS iou, x.ord AS l_ord FROM marked m JOIN loc x ON x.doc_id = m.doc_id AND x.page = m.page),
        best AS (SELECT * FROM pairs WHERE iou > 0.2 QUALIFY row_number() OVER (PARTITION BY doc_id, page, id ORDER BY iou DESC, l_ord) = 1),
        filled AS (SELECT m.* EXCLUDE (label, label_block_id), local_id, l_state, l_block, CASE WHEN local_id IS NOT NULL AND trim(m.label) = '' THEN l_label ELSE m.label END AS label, CASE WHEN local_id IS NOT NULL AND trim(m.label) = '' THEN l_block ELSE m.label_block_id END AS label_block_id FROM marked m LEFT JOIN best USING (doc_id, page, id)),
        r AS (SELECT f.*, list_filter([CASE WHEN n % 17 = 0 THEN 'no_alphabetic_label' END, CASE WHEN hits THEN 'overlaps_another' END, CASE WHEN local_id IS NULL THEN 'not_found_locally' END, CASE WHEN local_id IS NOT NULL AND l_state <> f.state THEN 'states_disagree' END,
            CASE WHEN local_id IS NOT NULL AND NOT coalesce(l_block = f.label_block_id, false) THEN 'labels_disagree' END, CASE WHEN n % 19 = 0 THEN 'label_not_grounded' END, CASE WHEN NOT coalesce(b.score >= 0.85, false) THEN 'label_score_low' END,
            CASE WHEN NOT discovered AND NOT sure THEN 'not_confirmed' END, CASE WHEN NOT sure THEN 'verification_disagrees' END], lambda x: x IS NOT NULL) AS risks FROM filled f LEFT JOIN blocks b ON b.doc_id = f.doc_id AND b.page = f.page AND b.block_id = f.label_block_id)
        SELECT doc_id, page, id, md5(coalesce(label, '')) AS label_md5, state, CASE WHEN len(risks) = 0 THEN v_confidence ELSE confidence END AS confidence, CASE WHEN len(risks) = 0 THEN 'automated' ELSE 'review_required' END AS decision,
          CASE WHEN len(risks) = 0 THEN 'consensus' WHEN local_id IS NOT NULL AND (l_state <> state OR v_state <> state) THEN 'disagreement' ELSE 'incomplete' END AS agreement, array_to_string(risks, ';') AS risks FROM r""",
}
