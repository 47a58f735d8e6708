"""Queries over repair scopes and repair rounds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import repair as R
from ..sources import adapt
from ..sources.adapt import BLOCKS_SQL


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return adapt.blocks(adapt.table(spark, d, "documents"))


def t05_repair_scope(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of ten blocks; a review item for each block of very low score, of which every third names its block."""
    b = _blocks(spark, d)
    own = F.array_sort(F.collect_list(F.struct("k", "block_id", "text")))
    c = b.groupBy("doc_id", "page", F.expr("k div 10").alias("chunk_ord")).agg(own.alias("own"))
    texts = F.transform("own", lambda x: x["text"])
    chunks = c.select("doc_id", "page", "chunk_ord", F.concat(F.lit("p"), "page", F.lit("-c"), "chunk_ord").alias("chunk_id"), F.transform("own", lambda x: x["block_id"]).alias("block_ids"), F.array_join(texts, "\n").alias("text"), F.array_join(texts, "\n\n").alias("markdown"))
    low = b.where("score < 0.54")
    items = low.select("doc_id", F.concat(F.lit("Field line_"), "ord", F.lit(" requires review: "), "text").alias("message"))
    named = low.where("ord % 3 = 0").select("doc_id", "block_id", F.lit(None).cast("string").alias("chunk_id"))
    return R.repair_scope(R.chunk_scores(chunks, items, named))


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An item for each block of very low score; answers by (doc_id + ord * round) % 3: resolved, changed or none."""
    docs = adapt.table(spark, d, "documents").select("doc_id")
    x = _blocks(spark, d).where("score < 0.54")
    stage = F.element_at(F.array(*map(F.lit, ("parse", "extract", "checkbox", "classify"))), F.col("ord") % 4 + 1)
    sources = F.when(F.expr("ord % 7 <> 0"), F.array("block_id")).otherwise(F.array().cast("array<string>"))
    items = x.select("doc_id", F.concat(F.lit("i"), "ord").alias("item_id"), stage.alias("stage"), F.concat(F.lit("m"), "ord").alias("message"), F.expr("ord % 5 <> 0").alias("retryable"), sources.alias("source_ids"))
    a = x.select("doc_id", "ord", F.explode(F.array(F.lit(1), F.lit(2))).alias("round")).withColumn("m", F.expr("(doc_id + ord * round) % 3")).where("m < 2")
    answers = a.select("doc_id", "round", F.concat(F.lit("i"), "ord").alias("item_id"), F.when(F.col("m") == 0, "resolved").otherwise("changed").alias("outcome"), F.concat(F.lit("m"), "ord", F.lit(" again "), "round").alias("message"))
    return docs, items, answers


def st6_repair_ends(spark: SparkSession, d: str) -> DataFrame:
    return R.repair_rounds(*_state(spark, d))[0]


def st6_items_left(spark: SparkSession, d: str) -> DataFrame:
    return R.repair_rounds(*_state(spark, d))[1].select("doc_id", "item_id", "message")


QUERIES = {f.__name__: f for f in (t05_repair_scope, st6_repair_ends, st6_items_left)}

_FOLD = lambda c: f"lower(replace({c}, 'ß', 'ss'))"
_IGNORED = ", ".join(f"'{w}'" for w in R.IGNORED)
_T05 = (
    "WITH RECURSIVE "
    + BLOCKS_SQL
    + f""", c AS (SELECT doc_id, page, k // 10 AS chunk_ord, list(block_id) AS ids, {_FOLD("string_agg(text, chr(10) ORDER BY k)")} AS folded, length(string_agg(text, chr(10) || chr(10) ORDER BY k)) AS size FROM blocks GROUP BY 1, 2, 3
), low AS (SELECT * FROM blocks WHERE score < 0.54
), words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({_FOLD("replace('Field line_' || ord || ' requires review: ' || text, '_', ' ')")}, '[a-z0-9]+')) AS w FROM low
), terms AS (SELECT doc_id, list(w) AS terms FROM words WHERE length(w) > 2 AND w NOT IN ({_IGNORED}) GROUP BY doc_id
), named AS (SELECT doc_id, list(block_id) AS named FROM low WHERE ord % 3 = 0 GROUP BY doc_id
), scored AS (
  SELECT c.*, CASE WHEN coalesce(list_has_any(ids, named), false) THEN {R.DIRECT} ELSE 0 END + cast(list_sum(list_transform(terms, lambda t: (length(folded) - length(replace(folded, t, ''))) // length(t))) AS bigint) AS score FROM c JOIN terms USING (doc_id) LEFT JOIN named USING (doc_id)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page, chunk_ord) AS n FROM scored WHERE score > 0
), fill AS (
  SELECT DISTINCT doc_id, cast(0 AS bigint) AS n, cast(0 AS bigint) AS used, cast(0 AS bigint) AS taken, false AS took FROM ranked UNION ALL
  SELECT r.doc_id, r.n, used + CASE WHEN fits THEN size ELSE 0 END, taken + CASE WHEN fits THEN 1 ELSE 0 END, fits FROM fill f JOIN ranked r ON r.doc_id = f.doc_id AND r.n = f.n + 1,
  LATERAL (SELECT taken < {R.MOST_CHUNKS} AND (taken = 0 OR used + size <= {R.MOST_CHARACTERS}) AS fits)
) SELECT doc_id, page, 'p' || page || '-c' || chunk_ord AS chunk_id, score, cast(taken AS int) AS place FROM fill JOIN ranked USING (doc_id, n) WHERE took"""
)
_ST6 = (
    "WITH "
    + BLOCKS_SQL
    + """, i AS (SELECT doc_id, ord, ord % 5 <> 0 AND ord % 4 <> 2 AND ord % 7 <> 0 AS can, (doc_id + ord) % 3 AS m1, (doc_id + ord * 2) % 3 AS m2 FROM blocks WHERE score < 0.54
), d0 AS (SELECT doc_id, count(ord) AS n, count(*) FILTER (WHERE can) AS asked FROM documents LEFT JOIN i USING (doc_id) GROUP BY doc_id
), l1 AS (SELECT *, can AND m1 = 0 AS gone, can AND m1 = 1 AS changed FROM i
), d1 AS (SELECT doc_id, d0.n, asked, count(ord) FILTER (WHERE NOT gone) AS left1, count(*) FILTER (WHERE gone OR changed) AS moved1, count(*) FILTER (WHERE NOT gone AND can) AS asked2 FROM d0 LEFT JOIN l1 USING (doc_id) GROUP BY doc_id, d0.n, asked
), e1 AS (SELECT *, CASE WHEN n = 0 OR left1 = 0 THEN 'accepted' WHEN asked = 0 THEN 'nothing_retryable' WHEN moved1 = 0 THEN 'unchanged' END AS reason1, CASE WHEN n > 0 AND asked > 0 THEN 1 ELSE 0 END AS r1 FROM d1
), l2 AS (SELECT l1.*, reason1 IS NULL AND can AND m2 = 0 AS gone2, reason1 IS NULL AND can AND m2 = 1 AS changed2 FROM l1 JOIN e1 USING (doc_id) WHERE NOT gone
), d2 AS (SELECT doc_id, r1, reason1, asked2, count(ord) FILTER (WHERE NOT gone2) AS left2, count(*) FILTER (WHERE gone2 OR changed2) AS moved2 FROM e1 LEFT JOIN l2 USING (doc_id) GROUP BY doc_id, r1, reason1, asked2
), e2 AS (SELECT doc_id, cast(r1 + CASE WHEN reason1 IS NULL AND asked2 > 0 THEN 1 ELSE 0 END AS int) AS rounds, coalesce(reason1, CASE WHEN left2 = 0 THEN 'accepted' WHEN asked2 = 0 THEN 'nothing_retryable' WHEN moved2 = 0 THEN 'unchanged' ELSE 'exhausted' END) AS reason FROM d2)"""
)
ORACLES = {
    "t05_repair_scope": _T05,
    "st6_repair_ends": _ST6 + " SELECT doc_id, rounds, CASE WHEN reason = 'accepted' THEN 'ACCEPTED' ELSE 'REVIEW_REQUIRED' END AS state, reason FROM e2",
    "st6_items_left": _ST6 + " SELECT doc_id, 'i' || ord AS item_id, 'm' || ord || CASE WHEN changed2 THEN ' again 2' WHEN changed THEN ' again 1' ELSE '' END AS message FROM l2 WHERE NOT gone2",
}
