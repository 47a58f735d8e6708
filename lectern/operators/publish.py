"""Published artifacts: Markdown with offsets, tables, manifests, entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import html_escape

#: Stands between two pages.
PAGE_BREAK = "\n\n<!-- PAGE BREAK -->\n\n"


def page_bodies(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, body): the texts of a page in order, an empty line between two."""
    lines = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return blocks.groupBy("doc_id", "page").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n\n").alias("body"))


def page_offsets(blocks: DataFrame) -> DataFrame:
    """Where each page's body lies in its document's Markdown, in code points, end exclusive. Only lengths are summed;
    no text is shuffled."""
    page = blocks.groupBy("doc_id", "page").agg((F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("n"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + len(PAGE_BREAK)).over(before), F.lit(0))
    return page.withColumn("start_at", start).select("doc_id", "page", "start_at", (F.col("start_at") + F.col("n")).alias("end_at"))


def document_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown, document_key): bodies joined by page breaks; the key is the start of its SHA-256."""
    pages = F.array_sort(F.collect_list(F.struct("page", "body")))
    whole = page_bodies(blocks).groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda p: p["body"]), PAGE_BREAK).alias("markdown"))
    return whole.withColumn("document_key", F.substring(F.sha2(F.col("markdown").cast("binary"), 256), 1, 20))


def artifact_entries(named: DataFrame, name: str, content: str) -> DataFrame:
    """Name, bytes, SHA-256 and whether the artifact is there; what is not there has nulls."""
    data = F.col(content).cast("binary")
    return named.select("doc_id", F.col(name).alias("name"), F.octet_length(data).cast("bigint").alias("bytes"), F.sha2(data, 256).alias("sha256"), data.isNotNull().alias("generated"))


def html_table(rows: Column) -> Column:
    """Markup of an array of rows (arrays of cells); the first row is the head."""
    line = lambda cells, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), html_escape(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.transform(rows, lambda cells, i: F.when(i == 0, line(cells, "th")).otherwise(line(cells, "td")))
    return F.concat(F.lit("<table>"), F.array_join(body, ""), F.lit("</table>"))


def pipe_table(rows: Column) -> Column:
    """The same rows as a pipe table: short rows are filled up, pipes in cells escaped."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(cells, F.array_repeat(F.lit(""), width - F.size(cells))), lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def page_manifest(selected: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for every selected page, with nothing parsed counted as 0 and status "missing"."""
    return selected.join(pages, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("n_blocks", F.lit(0)).cast("bigint").alias("n_blocks"), F.when(F.col("n_blocks").isNull(), "missing").otherwise("parsed").alias("status"))


def markup_short(markups: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, markup, wanted, found) where a document's text holds a markup less often than it should."""
    from ..functions.text import occurrences

    wanted = markups.groupBy("doc_id", "markup").agg(F.count("*").alias("wanted"))
    x = wanted.join(texts, "doc_id").withColumn("found", occurrences(F.col("text"), F.col("markup")))
    return x.where("found < wanted").select("doc_id", "markup", "wanted", "found")


def not_done(work: DataFrame, done: DataFrame, outputs: int) -> DataFrame:
    """Resume: the stems of ``work`` without all ``outputs`` files in ``done`` (stem, name)."""
    full = done.groupBy("stem").agg(F.count_distinct("name").alias("n")).where(F.col("n") >= outputs)
    return work.join(full, "stem", "left_anti")
