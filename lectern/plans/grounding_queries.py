"""Queries over evidence of types, places of texts and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import grounding as G
from ..sources import adapt
from ..sources.adapt import BLOCKS_SQL

PAGE = list(G.PAGE)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return adapt.blocks(adapt.table(spark, d, "documents"))


def _pick(i, *names: str):
    return F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))


def f14_validated_types(spark: SparkSession, d: str) -> DataFrame:
    """A proposal for every five blocks, one block each at the end; labels, signature words and evidence by their places."""
    b = _blocks(spark, d).withColumn("i", F.when(F.expr("k >= 35"), F.col("k")).otherwise(F.expr("k div 5")))
    p = b.select(*PAGE, "i").distinct().select(*PAGE, "i", F.concat(F.lit("s"), "i").alias("proposal_id"), _pick(F.col("i") + F.col("doc_id"), "marginalia", "logo", "attestation", "figure", "scan_code", "text").alias("type"))
    text = F.when(F.expr("(doc_id + i) % 4 = 1"), F.concat("text", F.lit(" [signed]"))).when(F.expr("ord % 24 = 0"), F.concat("text", F.lit(" Signature"))).otherwise(F.col("text"))
    members = b.select(*PAGE, F.concat(F.lit("s"), "i").alias("proposal_id"), "ord", text.alias("text"), "box", F.when(F.expr("ord % 13 = 0"), _pick(F.col("ord"), "Header", "image", "number")).when(F.expr("ord % 2 = 0"), "text").alias("label"))
    by = F.expr("(i % 3) * 10") / 1000.0
    evidence = b.where("k % 5 = 0 or k >= 35").where("(doc_id + i) % 3 <> 0").select(F.col("doc_id"), (F.col("page") + F.expr("cast(i % 7 = 6 as int)")).alias("page"), F.concat(F.lit("s"), "i").alias("proposal_id"), F.when(F.expr("(doc_id * 3 + i) % 5 <> 0"), "visual").otherwise("ocr").alias("source"), g.box(F.col("box.l"), F.col("box.t") + by, F.col("box.r"), F.col("box.b") + by + F.when(F.expr("i % 2 = 0"), 0.03).otherwise(0.0)).alias("box"))
    return G.validated_types(p, members, evidence)


def j31_grounding_index(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of four blocks, three apart; every third is visual, verified or not."""
    b = _blocks(spark, d).withColumn("type", F.when(F.expr("ord % 7 = 1"), "list_item").otherwise("text"))
    m = b.select(*PAGE, "block_id", F.explode(F.expr("filter(array(k div 3 - 1, k div 3), x -> x >= 0 and x % 4 <> 3 and (x = k div 3 or k % 3 = 0))")).alias("chunk_ord")).withColumn("chunk_id", F.concat(F.lit("c"), "chunk_ord"))
    c = b.groupBy(*PAGE, F.expr("k div 3").alias("c")).agg(g.union_of("box").alias("box"), F.min("text").alias("text"))
    v = c.select(*PAGE, F.concat(F.lit("c"), "c").alias("chunk_id"), F.lit("figure").alias("type"), "box", "text", F.when(F.expr("c % 3 = 0"), "visual").otherwise("text").alias("provenance"), _pick(F.col("c") + F.col("doc_id"), "pending", "model_verified", "human_approved", "rejected").alias("verification"))
    return G.grounding_index(b, m, v).select(*PAGE, "block_id", "chunk_id", "type", "score", F.round("box.t", 9).alias("t"), F.md5("text").alias("text_md5"))


def w09_audited_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Up to three audits of every fourth block; the proposals of every third of them changed after the second."""
    b = _blocks(spark, d).where("ord % 4 = 0")
    fields = ["item_id", "kind", "content"]
    old = b.select("doc_id", "ord", F.concat(F.lit("v"), "ord").alias("item_id"), F.when(F.expr("ord % 8 = 0"), "figure").alias("kind"), F.col("text").alias("content"))
    new = old.withColumn("content", F.when(F.expr("ord % 12 = 0"), F.concat("content", F.lit("."))).otherwise(F.col("content")))
    told = lambda x, n: x.where(f"(doc_id + ord) % 5 >= {n}").select("doc_id", "item_id", G.proposal_digest(*fields).alias("digest"), F.lit(n).alias("ord"), _pick(F.col("ord") + n, "human_approved", "rejected", "corrected").alias("status"), F.when(F.expr(f"(ord + {n}) % 3 = 2"), F.concat(F.lit("fixed "), "ord")).otherwise(F.col("content")).alias("content"))
    audits = told(old, 1).unionByName(told(old, 2)).unionByName(told(new, 4))
    return G.audited(new, audits, fields).select("doc_id", "item_id", "status", F.md5("shown").alias("shown_md5"))


QUERIES = {f.__name__: f for f in (f14_validated_types, j31_grounding_index, w09_audited_proposals)}

_B = "WITH " + BLOCKS_SQL
_COVER = "greatest(0.0::DOUBLE, least(a.r, e.r) - greatest(a.l, e.l)) * greatest(0.0::DOUBLE, least(a.b, e.b) - greatest(a.t, e.t))"
ORACLES = {
    "f14_validated_types": _B + f""", x AS (SELECT *, CASE WHEN k >= 35 THEN k ELSE k // 5 END AS i FROM blocks),
        y AS (SELECT *, CASE WHEN (doc_id + i) % 4 = 1 THEN text || ' [signed]' WHEN ord % 24 = 0 THEN text || ' Signature' ELSE text END AS shown, CASE WHEN ord % 13 = 0 THEN ['header', 'image', 'number'][ord % 3 + 1] WHEN ord % 2 = 0 THEN 'text' END AS label FROM x),
        m AS (SELECT doc_id, page, i, list(label) AS labels, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS n, bool_and(contains(upper(shown), '[SIGNED]') OR contains(upper(shown), '[E-SIGNED]') OR contains(upper(shown), '[ILLEGIBLE_SIGNATURE]')) AS all_marked, string_agg(shown, chr(10) ORDER BY ord) AS shown FROM y GROUP BY 1, 2, 3),
        e AS (SELECT doc_id, page + CASE WHEN i % 7 = 6 THEN 1 ELSE 0 END AS page, i, (doc_id * 3 + i) % 5 <> 0 AS visual, l, t + ((i % 3) * 10) / 1000.0::DOUBLE AS t, r, b + ((i % 3) * 10) / 1000.0::DOUBLE + CASE WHEN i % 2 = 0 THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END AS b FROM x WHERE (k % 5 = 0 OR k >= 35) AND (doc_id + i) % 3 <> 0),
        s AS (SELECT a.doc_id, a.page, a.i, max(e.b - e.t) AS height FROM m a JOIN e ON e.doc_id = a.doc_id AND e.page = a.page AND e.i = a.i WHERE visual AND greatest({_COVER} / ((a.r - a.l) * (a.b - a.t)), {_COVER} / ((e.r - e.l) * (e.b - e.t))) >= 0.4 GROUP BY 1, 2, 3),
        z AS (SELECT m.*, height, ['marginalia', 'logo', 'attestation', 'figure', 'scan_code', 'text'][(i + doc_id) % 6 + 1] AS type, list_contains(labels, 'image') AS picture FROM m LEFT JOIN s USING (doc_id, page, i)),
        k AS (SELECT *, CASE WHEN type = 'marginalia' AND NOT list_has_any(labels, ['header', 'number']) THEN 'text' WHEN type = 'logo' AND ((height IS NULL AND NOT picture) OR (height IS NOT NULL AND NOT picture AND n = 1 AND height < 0.04)) THEN 'text'
          WHEN type = 'attestation' AND height IS NULL AND NOT regexp_matches(shown, '(?i)\\b(?:attest(?:ation)?|electronically\\s+(?:signed|authenticated)|signature|signed\\s+by)\\b|\\[(?:E-)?SIGNED\\]|\\[ILLEGIBLE_SIGNATURE\\]') THEN 'text' WHEN type IN ('figure', 'scan_code') AND height IS NULL THEN 'text' ELSE type END AS kind FROM z)
        SELECT doc_id, page, 's' || i AS proposal_id, kind AS type, cast(CASE WHEN kind = 'attestation' AND all_marked AND n > 1 THEN n ELSE 1 END AS int) AS n_parts FROM k""",
    "j31_grounding_index": _B + """, m AS (SELECT doc_id, page, block_id, min(c) AS c FROM (SELECT doc_id, page, block_id, k, unnest([k // 3 - 1, k // 3]) AS c FROM blocks) WHERE c >= 0 AND c % 4 <> 3 AND (c = k // 3 OR k % 3 = 0) GROUP BY ALL),
        v AS (SELECT doc_id, page, k // 3 AS c, min(t) AS t, min(text) AS text FROM blocks GROUP BY ALL)
        SELECT doc_id, page, block_id, CASE WHEN c IS NOT NULL THEN 'c' || c END AS chunk_id, CASE WHEN ord % 7 = 1 THEN 'list_item' ELSE 'text' END AS type, score, round(t, 9) AS t, md5(text) AS text_md5 FROM blocks LEFT JOIN m USING (doc_id, page, block_id) UNION ALL
        SELECT doc_id, page, NULL, 'c' || c, 'figure', NULL, round(t, 9), md5(text) FROM v WHERE c % 3 = 0 AND (c + doc_id) % 4 IN (1, 2)""",
    "w09_audited_proposals": _B + """, x AS (SELECT doc_id, ord, text AS old, CASE WHEN ord % 12 = 0 THEN text || '.' ELSE text END AS new FROM blocks WHERE ord % 4 = 0),
        a AS (SELECT *, CASE WHEN (doc_id + ord) % 5 >= 4 THEN 4 WHEN ord % 12 = 0 THEN NULL WHEN (doc_id + ord) % 5 >= 2 THEN 2 WHEN (doc_id + ord) % 5 >= 1 THEN 1 END AS n FROM x)
        SELECT doc_id, 'v' || ord AS item_id, CASE WHEN n IS NULL THEN 'pending' ELSE ['human_approved', 'rejected', 'corrected'][(ord + n) % 3 + 1] END AS status, md5(CASE WHEN n IS NOT NULL AND (ord + n) % 3 = 2 THEN 'fixed ' || ord ELSE new END) AS shown_md5 FROM a""",
}
