"""Evidence tables made from the plain tables, by whole-number rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g

#: Lines on one page.
PAGE_LINES = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(documents: DataFrame) -> DataFrame:
    """(doc_id, ord, page, k, block_id, text, score, box): one block per line, on pages of 40, some in two columns."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", *(c.alias(name) for name, c in block(F.col("doc_id"), F.col("pos"), F.col("line")).items()))


def block(doc: Column, pos: Column, line: Column) -> dict[str, Column]:
    """The fields of the block that the line ``pos`` (from 0) of a document becomes."""
    order, k = pos + 1, pos % PAGE_LINES
    page = (1 + (pos - k) / PAGE_LINES).cast("int")
    two = doc % 3 == 0
    right = two & (k >= 20)
    left = F.when(right, 550).otherwise(50)
    width = F.when(two, 400).otherwise(900)
    top = F.when(two, 20 + 45 * (k % 20)).otherwise(20 + 24 * k)
    high = F.when(order % 11 == 1, 27).otherwise(18)
    return {
        "ord": order, "page": page, "k": k, "block_id": F.concat(F.lit("p"), page, F.lit("-b"), order),
        "text": F.when(order % 7 == 1, F.concat(F.lit("- "), line)).when(order % 7 == 2, F.concat(F.lit("Field "), order, F.lit(": "), line)).otherwise(line),
        "score": F.when((doc + order) % 29 != 0, (50 + (doc * 31 + order * 17) % 50) / 100.0),
        "box": g.box(left / 1000.0, top / 1000.0, (left + width) / 1000.0, (top + high) / 1000.0),
    }


def regions(documents: DataFrame) -> DataFrame:
    """(doc_id, page, region_ord, region_id, label, score, box): five bands per page."""
    pages = documents.select("doc_id", F.explode(F.sequence(F.lit(1), F.expr("cast((size(split(text, '\n')) + 39) div 40 as int)"))).alias("page"))
    each = pages.select("doc_id", "page", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("region_ord"))
    label = F.element_at(F.array(*map(F.lit, ("text", "table", "header", "image", "doc_title"))), F.col("region_ord"))
    top = 195 * (F.col("region_ord") - 1)
    return each.select(
        "doc_id", "page", "region_ord", F.concat(F.lit("p"), "page", F.lit("-l"), "region_ord").alias("region_id"), label.alias("label"),
        ((40 + (F.col("region_ord") * 13 + F.col("page") * 7) % 60) / 100.0).alias("score"),
        g.box(F.lit(20) / 1000.0, top / 1000.0, F.lit(980) / 1000.0, (top + 200) / 1000.0).alias("box"),
    )


def markdown(documents: DataFrame) -> DataFrame:
    """(doc_id, markdown): a page marker before every 40th line from the first on, a heading before every 11th."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.concat(F.when(i % 40 == 0, F.concat(F.lit("<!-- page: "), (i / 40 + 1).cast("int"), F.lit(" -->\n"))).otherwise(""), F.when(i % 11 == 0, F.concat(F.lit("# Section "), (i / 11 + 1).cast("int"), F.lit("\n"))).otherwise(""), x),
    )
    return documents.select("doc_id", F.array_join(lines, "\n").alias("markdown"))


def usage_calls(events: DataFrame) -> DataFrame:
    """(call_id, run, input_tokens, cached_tokens, write_tokens, output_tokens, seconds)."""
    i = (F.col("event_id") * 37) % 400000
    return events.select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("run"), i.alias("input_tokens"),
        F.when(F.col("event_id") % 5 != 0, F.expr("((event_id * 37) % 400000) div 4")).alias("cached_tokens"),
        F.when(F.col("event_id") % 7 != 0, F.expr("((event_id * 37) % 400000) div 10")).alias("write_tokens"),
        F.when(F.col("event_id") % 97 != 0, (F.col("event_id") * 13) % 20000).alias("output_tokens"),
        ((F.col("event_id") * 11) % 1000).alias("millis"),
    )


#: The same tables in SQL, for common table expressions.
BLOCKS_SQL = """lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents
), placed AS (
  SELECT *, cast(1 + (ord - 1) // 40 AS integer) AS page, (ord - 1) % 40 AS k, doc_id % 3 = 0 AS two FROM lines
), sized AS (
  SELECT *, CASE WHEN two AND k >= 20 THEN 550 ELSE 50 END AS li, CASE WHEN two THEN 400 ELSE 900 END AS wi,
    CASE WHEN two THEN 20 + 45 * (k % 20) ELSE 20 + 24 * k END AS ti, CASE WHEN ord % 11 = 1 THEN 27 ELSE 18 END AS hi FROM placed
), blocks AS (
  SELECT doc_id, ord, page, k, 'p' || page || '-b' || ord AS block_id,
    CASE ord % 7 WHEN 1 THEN '- ' || line WHEN 2 THEN 'Field ' || ord || ': ' || line ELSE line END AS text,
    CASE WHEN (doc_id + ord) % 29 <> 0 THEN (50 + (doc_id * 31 + ord * 17) % 50) / 100.0::DOUBLE END AS score,
    li / 1000.0::DOUBLE AS l, ti / 1000.0::DOUBLE AS t, (li + wi) / 1000.0::DOUBLE AS r, (ti + hi) / 1000.0::DOUBLE AS b FROM sized
)"""
REGIONS_SQL = """region_pages AS (
  SELECT doc_id, unnest(generate_series(1, (len(string_split(text, chr(10))) + 39) // 40)) AS page FROM documents
), regions AS (
  SELECT doc_id, page, o AS region_ord, 'p' || page || '-l' || o AS region_id, ['text', 'table', 'header', 'image', 'doc_title'][o] AS label,
    (40 + (o * 13 + page * 7) % 60) / 100.0::DOUBLE AS score, 0.02::DOUBLE AS l, (195 * (o - 1)) / 1000.0::DOUBLE AS t, 0.98::DOUBLE AS r, (195 * (o - 1) + 200) / 1000.0::DOUBLE AS b
  FROM (SELECT *, unnest(generate_series(1, 5)) AS o FROM region_pages)
)"""
USAGE_SQL = """calls AS (
  SELECT event_id AS call_id, user_id AS run, (event_id * 37) % 400000 AS input_tokens, CASE WHEN event_id % 5 <> 0 THEN ((event_id * 37) % 400000) // 4 END AS cached_tokens,
    CASE WHEN event_id % 7 <> 0 THEN ((event_id * 37) % 400000) // 10 END AS write_tokens, CASE WHEN event_id % 97 <> 0 THEN (event_id * 13) % 20000 END AS output_tokens, (event_id * 11) % 1000 AS millis
  FROM events
)"""
