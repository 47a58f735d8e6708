"""Queries over bundles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import bundles as B
from ..operators import publish as P
from ..sources import adapt
from ..sources.adapt import BLOCKS_SQL
from .tree_queries import TREE_SQL, _evidence


def k14_bundle_entries(spark: SparkSession, d: str) -> DataFrame:
    """Splits of two pages, some labels without a letter; fields are the blocks that name one."""
    b = adapt.blocks(adapt.table(spark, d, "documents"))
    bodies = P.page_bodies(b)
    documents = P.document_markdown(b).select("doc_id", "markdown")
    n = b.groupBy("doc_id").agg(F.max("page").alias("page_count"), F.count("*").alias("n_blocks"), F.array_sort(F.collect_set(F.when(F.expr("(doc_id + page) % 6 = 0"), F.col("page")))).alias("failed_pages"))
    manifests = n.select("doc_id", F.when(F.size("failed_pages") > 0, "REVIEW_REQUIRED").otherwise("ACCEPTED").alias("state"), "page_count", "n_blocks", "failed_pages", F.lit(None).cast("string").alias("schema_version"))
    fields = b.where("ord % 7 = 2 and doc_id % 4 <> 0").select("doc_id", F.concat(F.lit("field_"), F.col("ord") % 5).alias("path"), F.col("text").alias("value"))
    splits = b.select("doc_id", F.expr("(page - 1) div 2").alias("split_ord")).distinct().select("doc_id", "split_ord", F.when(F.expr("split_ord % 3 = 1"), "!?").otherwise(F.concat(F.lit("Part "), "split_ord")).alias("label"), F.expr("cast(split_ord * 2 + 1 as int)").alias("start_page"), F.expr("cast(split_ord * 2 + 2 as int)").alias("end_page"))
    return B.bundle_entries(B.bundle_contents(documents, manifests, b.select("doc_id", "page", "ord", "block_id", "score", "text"), fields, splits, bodies))


def k07_bundle_check(spark: SparkSession, d: str) -> DataFrame:
    pages, chunks, *_ = _evidence(spark, d)
    accepted = chunks.where("table_id is not null").select("doc_id", "page", strip(F.col("markdown")).alias("markup"))
    return B.bundle_check(accepted, pages.select("doc_id", "page", F.col("body").alias("text")))


QUERIES = {f.__name__: f for f in (k14_bundle_entries, k07_bundle_check)}

_BREAK = "chr(10) || chr(10) || '<!-- PAGE BREAK -->' || chr(10) || chr(10)"
ORACLES = {
    "k14_bundle_entries": "WITH " + BLOCKS_SQL + f""", p AS (SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS body FROM blocks GROUP BY 1, 2),
        n AS (SELECT doc_id, max(page) AS page_count, count(*) AS n_blocks, coalesce(list_sort(list_distinct(list(page) FILTER (WHERE (doc_id + page) % 6 = 0))), []) AS failed FROM blocks GROUP BY 1),
        s AS (SELECT DISTINCT doc_id, (page - 1) // 2 AS s FROM blocks), v AS (SELECT doc_id, 'field_' || (ord % 5) AS path, max(text) AS value FROM blocks WHERE ord % 7 = 2 AND doc_id % 4 <> 0 GROUP BY 1, 2),
        e AS (SELECT doc_id, 'document.md' AS name, string_agg(body, {_BREAK} ORDER BY page) AS content FROM p GROUP BY 1 UNION ALL
          SELECT doc_id, 'metadata.json', cast(to_json({{'state': CASE WHEN len(failed) > 0 THEN 'REVIEW_REQUIRED' ELSE 'ACCEPTED' END, 'page_count': page_count, 'n_blocks': n_blocks, 'failed_pages': failed, 'schema_version': NULL}}) AS varchar) FROM n UNION ALL
          SELECT doc_id, 'blocks.jsonl', string_agg(cast(to_json({{'page': page, 'ord': ord, 'block_id': block_id, 'score': score, 'text': text}}) AS varchar), chr(10) ORDER BY ord) FROM blocks GROUP BY 1 UNION ALL
          SELECT doc_id, 'extraction.json', '{{' || string_agg('"' || path || '":' || cast(to_json(value) AS varchar), ',' ORDER BY path) || '}}' FROM v GROUP BY 1 UNION ALL
          SELECT doc_id, 'splits/' || lpad(cast(s + 1 AS varchar), 2, '0') || '-' || CASE WHEN s % 3 = 1 THEN 'document' ELSE 'Part-' || s END || '.md', string_agg(body, {_BREAK} ORDER BY page) FROM s JOIN p USING (doc_id) WHERE page IN (s * 2 + 1, s * 2 + 2) GROUP BY doc_id, s)
        SELECT doc_id, name, cast(strlen(content) AS bigint) AS bytes, sha256(content) AS sha256, true AS generated FROM e""",
    "k07_bundle_check": TREE_SQL + """, w AS (SELECT doc_id, page, v, count(*) AS n FROM cs WHERE accepted GROUP BY 1, 2, 3), x AS (SELECT doc_id, n, least(n, (length(body) - length(replace(body, v, ''))) // length(v)) AS found FROM w JOIN bodies USING (doc_id, page))
        SELECT doc_id, cast(sum(n) AS bigint) AS expected, cast(sum(found) AS bigint) AS exported, sum(n) = sum(found) AS complete FROM x GROUP BY doc_id""",
}
