"""Gold sets as nested JSON, with the SQL of their faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gold as G
from ..sources import adapt


def _sets(spark: SparkSession, d: str) -> DataFrame:
    """A gold set a document: a table and two checkboxes a page of 40 lines, with faults by the document's id."""
    x = adapt.table(spark, d, "documents").select("doc_id", F.expr("cast((size(split(text, '\n')) + 39) div 40 as int)").alias("n"))
    status = "if(doc_id % 2 = 0, 'human_approved', 'pending_human_review')"
    counts = "transform(sequence(1, 1 + p % 3), r -> 1 + (r + p) % 2)"
    table = f"""named_struct('id', concat('p', p, '-t'), 'page', p, 'bbox', if(doc_id % 31 = 0, array(0.5D, 0.1D, 0.4D, 0.2D), array(0.1D, 0.1D, 0.9D, 0.3D)), 'review_status', {status}, 'semantic_role', 'r',
      'expected_rows', 1 + p % 3 + cast(doc_id % 43 = 0 as int), 'expected_columns', if(doc_id % 41 = 0, 1, 2), 'expected_cells', aggregate({counts}, 0, (a, v) -> a + v) + cast(doc_id % 47 = 0 as int), 'row_cell_counts', {counts})"""
    box = f"""named_struct('id', concat('p', p, '-c', if(doc_id % 23 = 0 and p = 1, 1, c)), 'page', if(doc_id % 29 = 0 and p = 1 and c = 2, 99, p), 'bbox', array(0D, 0D, 0.1D, 0.1D),
      'review_status', if(doc_id % 5 = 0 and p = 1 and c = 2, 'pending_human_review', {status}), 'group', 'g', 'label', 'x', 'state', 'checked')"""
    summary = "named_struct('page', p, 'table_count', 1 + cast((doc_id + p) % 17 = 0 as int), 'checkbox_count', 2)"
    each = lambda one: f"transform(sequence(1, n), p -> {one})"
    value = F.struct(
        F.lit("1.0").alias("schema_version"), F.concat(F.lit("set-"), "doc_id").alias("dataset_id"), F.when(F.expr("doc_id % 37 = 0"), "pixels").otherwise(G.SPACE).alias("coordinate_space"),
        F.struct(F.lit("f.pdf").alias("filename"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"), F.expr("concat(sequence(1, n), if(doc_id % 13 = 0, array(1), cast(array() as array<int>)))").alias("selected_pages")).alias("source"),
        F.struct(F.expr(status).alias("status"), F.expr("if(doc_id % 8 = 0, ' ', 'Ann')").alias("reviewer_name"), F.lit("2026-01-02T03:04:05Z").alias("reviewed_at")).alias("approval"), F.array(F.lit("made")).alias("candidate_provenance"),
        F.expr(f"filter({each(summary)}, s -> doc_id % 19 <> 0 or s.page < n)").alias("page_summaries"), F.expr(each(table)).alias("tables"), F.expr(f"flatten({each(f'transform(sequence(1, 2), c -> {box})')})").alias("checkboxes"),
    )
    return x.select("doc_id", F.to_json(value).alias("json"))


def s15_gold_faults(spark: SparkSession, d: str) -> DataFrame:
    sets = _sets(spark, d).select("doc_id", G.parsed_gold(F.col("json")).alias("g")).select("doc_id", "g.*")
    return G.gold_faults(sets, "doc_id", require_approval=True)


QUERIES = {f.__name__: f for f in (s15_gold_faults,)}
ORACLES = {
    "s15_gold_faults": """WITH d AS (SELECT doc_id AS i, (len(string_split(text, chr(10))) + 39) // 40 AS n, doc_id % 2 = 0 AS ok FROM documents), p AS (SELECT *, unnest(generate_series(1, n)) AS p FROM d)
        SELECT i AS doc_id, 'repeated_page' AS rule, '1' AS subject FROM d WHERE i % 13 = 0 UNION ALL SELECT i, 'uncovered_page', cast(n AS varchar) FROM d WHERE i % 19 = 0 UNION ALL SELECT i, 'page_not_selected', CASE WHEN i % 23 = 0 THEN 'p1-c1' ELSE 'p1-c2' END FROM d WHERE i % 29 = 0 AND n < 99 UNION ALL
        SELECT i, 'repeated_id', 'p1-c1' FROM d WHERE i % 23 = 0 UNION ALL SELECT i, 'table_count', cast(p AS varchar) FROM p WHERE (i + p) % 17 = 0 AND NOT (i % 19 = 0 AND p = n) UNION ALL SELECT i, 'checkbox_count', '1' FROM d WHERE i % 29 = 0 AND NOT (i % 19 = 0 AND n = 1) UNION ALL
        SELECT i, 'unapproved_annotation', CASE WHEN i % 23 = 0 THEN 'p1-c1' ELSE 'p1-c2' END FROM d WHERE ok AND i % 5 = 0 UNION ALL SELECT i, 'no_reviewer', 'approval' FROM d WHERE ok AND i % 8 = 0 UNION ALL SELECT i, 'invalid_box', 'p' || p || '-t' FROM p WHERE i % 31 = 0 UNION ALL
        SELECT i, 'row_count_length', 'p' || p || '-t' FROM p WHERE i % 43 = 0 UNION ALL SELECT i, 'row_count_sum', 'p' || p || '-t' FROM p WHERE i % 47 = 0 UNION ALL SELECT i, 'row_count_range', 'p' || p || '-t' FROM p WHERE i % 41 = 0 AND (p % 3 > 0 OR (1 + p) % 2 = 1) UNION ALL
        SELECT i, 'invalid_value', 'coordinate_space' FROM d WHERE i % 37 = 0 UNION ALL SELECT i, 'not_approved', 'approval' FROM d WHERE NOT ok""",
}
