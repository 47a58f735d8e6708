"""What is handed on for a document: the entries of its bundle, and whether every accepted table is in its Markdown.

Defined cases: a document without blocks, fields or splits lacks those entries; a split
without pages is left out; names without a letter or digit become "document".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import occurrences, safe_name
from .publish import PAGE_BREAK, artifact_entries

#: Names of the entries.
MARKDOWN, BLOCKS, MANIFEST, FIELDS, SPLITS = "document.md", "blocks.jsonl", "metadata.json", "extraction.json", "splits/"
WHOLE = {"ignoreNullFields": "false"}


def bundle_contents(documents: DataFrame, manifests: DataFrame, blocks: DataFrame, fields: DataFrame, splits: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc_id, name, content) of every entry. ``documents``: markdown; ``manifests``: one row a document, all columns are dumped; ``blocks``: ord
    and the columns of a line; ``fields``: path, value; ``splits``: split_ord, label, start_page, end_page, whose pages' ``bodies``
    (page, body) are the content. The entries of a document are rows of their own, never one value."""
    plain = documents.select("doc_id", F.lit(MARKDOWN).alias("name"), F.col("markdown").alias("content"))
    dumped = manifests.select("doc_id", F.lit(MANIFEST).alias("name"), F.to_json(F.struct(*(c for c in manifests.columns if c != "doc_id")), WHOLE).alias("content"))
    line = F.to_json(F.struct(*(c for c in blocks.columns if c != "doc_id")), WHOLE)
    listed = lambda x, what: F.transform(F.array_sort(F.collect_list(x)), lambda r: r[what])
    lines = blocks.groupBy("doc_id").agg(F.array_join(listed(F.struct("ord", line.alias("line")), "line"), "\n").alias("content")).select("doc_id", F.lit(BLOCKS).alias("name"), "content")
    last = fields.groupBy("doc_id", "path").agg(F.max("value").alias("value"))
    values = last.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value"))))).alias("content")).select("doc_id", F.lit(FIELDS).alias("name"), "content")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("split_ord"))
    label = F.coalesce(F.nullif(safe_name(F.coalesce("label", F.lit(""))), F.lit("")), F.lit("document"))
    s = splits.withColumn("name", F.concat(F.lit(SPLITS), F.lpad(number.cast("string"), 2, "0"), F.lit("-"), label, F.lit(".md")))
    own = s.select("doc_id", "name", F.explode(F.sequence("start_page", "end_page")).alias("page")).join(bodies.select("doc_id", "page", "body"), ["doc_id", "page"])
    parts = own.groupBy("doc_id", "name").agg(F.array_join(listed(F.struct("page", "body"), "body"), PAGE_BREAK).alias("content"))
    return plain.unionByName(dumped).unionByName(lines).unionByName(values).unionByName(parts)


def bundle_entries(contents: DataFrame) -> DataFrame:
    """(doc_id, name, bytes, sha256, generated) of the entries."""
    return artifact_entries(contents, "name", "content")


def bundle_check(accepted: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, expected, exported, complete): how many tables of a document were accepted, and how many of them its texts hold, a markup
    as often as it was accepted at most. ``accepted``: page, markup; ``texts``: page, text."""
    wanted = accepted.groupBy("doc_id", "page", "markup").agg(F.count("*").alias("n"))
    found = wanted.join(texts.select("doc_id", "page", "text"), ["doc_id", "page"], "left").withColumn("found", F.least(F.col("n"), F.coalesce(occurrences(F.col("text"), F.col("markup")), F.lit(0))))
    return found.groupBy("doc_id").agg(F.sum("n").alias("expected"), F.sum("found").alias("exported")).withColumn("complete", F.col("expected") == F.col("exported"))
