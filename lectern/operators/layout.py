"""Reading order, block types, chunks and page-level routing of recorded text blocks.

Blocks are rows (doc_id, page, ord, block_id, text, score, box); a page is a bounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.text import strip
from ..sources.stage import in_turn

PAGE = ("doc_id", "page")
LOW_CONFIDENCE = 0.85
#: Fixed pattern: recognised text whose errors change its meaning.
HIGH_RISK = r"(?i)(?:\d\|\d|\d:\d|>/=|</=|\b(?:mcg|mg|ml|mmhg)\b[^\x00-\x7f]|\b[A-Z]\d{2}(?:\.\d{1,4})?\b|\b1\d{2}\.\d{1,4}(?=\s*-\s*\d{3}(?:\.\d+)?\b))"


def upper_median_height(blocks: DataFrame) -> DataFrame:
    """Per page the height at rank n // 2 of the sorted heights (the upper one of two middles)."""
    heights = F.sort_array(F.collect_list(F.col("box.b") - F.col("box.t")))
    return blocks.where("box is not null").groupBy(*PAGE).agg(heights.alias("h")).select(*PAGE, F.get("h", F.expr("size(h) div 2")).alias("median_h"))


def is_list_text(x: Column) -> Column:
    return x.startswith("•") | x.startswith("- ") | x.startswith("* ") | x.rlike(r"^\d{1,3}\.")


def pipes(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))


def typed(blocks: DataFrame) -> DataFrame:
    """``blocks`` with type: list_item, table_row, key_value, heading or paragraph, the first that fits."""
    found = blocks.join(upper_median_height(blocks), list(PAGE), "left")
    t = strip(F.col("text"))
    height = F.coalesce(F.col("box.b") - F.col("box.t"), F.lit(0.0))
    tall = (F.col("median_h") > 0) & (height >= F.col("median_h") * 1.35) & (F.length(t) <= 100)
    kind = (
        F.when(is_list_text(t), "list_item").when(F.contains(t, F.lit("\t")) | (pipes(t) >= 2), "table_row")
        .when(F.contains(t, F.lit(":")) & (F.instr(t, ":") - 1 <= 40), "key_value").when(tall, "heading").otherwise("paragraph")
    )
    return found.withColumn("type", kind).drop("median_h")


def columns_of_pages(blocks: DataFrame) -> DataFrame:
    """Per page the number of columns, where they split, and whether the order is ambiguous. Two columns stand if
    the widest gap between neighbouring centres (the later one of equals) is over 0.25 with enough blocks on both sides."""
    centre = g.centre_x(F.col("box"))
    page = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(centre)).alias("c"), F.count_if(F.col("box").isNull()).alias("loose"))
    gaps = F.transform(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda x, i: F.struct((x - F.get("c", i)).alias("gap"), i.alias("i")))
    page = page.withColumn("widest", F.coalesce(F.array_max(gaps), F.struct(F.lit(0.0).alias("gap"), F.lit(0).alias("i"))))
    w, i = F.col("widest.gap"), F.col("widest.i")
    two = (w > 0.25) & (i >= 1) & (F.size("c") - i >= 3)
    return page.select(*PAGE, F.when(two, 2).otherwise(1).alias("columns"), F.when(two, (F.get("c", i) + F.get("c", i + 1)) / 2).alias("split"), ((F.col("loose") > 0) | ((w > 0.12) & (w <= 0.25))).alias("ambiguous"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` with pos (1..n per page) and columns: column by column, top to bottom, left to right, blocks without a box last."""
    found = blocks.join(columns_of_pages(blocks), list(PAGE))
    side = F.when((F.col("columns") == 2) & (g.centre_x(F.col("box")) >= F.col("split")), 1).otherwise(0)
    order = Window.partitionBy(*PAGE).orderBy(F.col("box").isNull(), F.when(F.col("box").isNotNull(), side), F.col("box.t"), F.col("box.l"), "ord")
    return found.withColumn("pos", F.row_number().over(order))


def table_cells(x: Column) -> Column:
    """Cells of a table row: tabs count as pipes, outer pipes do not."""
    bare = F.regexp_replace(F.replace(x, F.lit("\t"), F.lit("|")), r"^\|+|\|+$", "")
    return F.transform(F.split(bare, r"\|", -1), strip)


def chunks(typed_blocks: DataFrame, order: str = "ord") -> DataFrame:
    """Blocks with (chunk_no, chunk_type): neighbouring list items, key-values and table rows of a page are one chunk.
    A run of table rows is a table from where all later rows have equally many cells; rows before are paragraphs."""
    w = Window.partitionBy(*PAGE).orderBy(order)
    joins = F.col("type").isin("list_item", "key_value", "table_row") & F.coalesce(F.lag("type").over(w) == F.col("type"), F.lit(False))
    x = typed_blocks.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    run = Window.partitionBy(*PAGE, "run")
    cells = F.when(F.col("type") == "table_row", F.size(table_cells(F.col("text"))))
    x = x.withColumn("cells", cells).withColumn("last_cells", F.max_by("cells", order).over(run))
    x = x.withColumn("changed", F.max(F.when(F.col("cells") != F.col("last_cells"), F.col(order))).over(run))
    tail = F.col("changed").isNull() | (F.col(order) > F.col("changed"))
    x = x.withColumn("tail", F.when(F.col("type") == "table_row", tail)).withColumn("rows", F.count_if("tail").over(run)).withColumn("size", F.count("*").over(run))
    in_table = F.coalesce(F.col("tail") & (F.col("rows") >= 2) & (F.col("last_cells") >= 2), F.lit(False))
    kind = (
        F.when(in_table, "table").when(F.col("type") == "table_row", "paragraph").when(F.col("type") == "list_item", "list")
        .when((F.col("type") == "key_value") & (F.col("size") > 1), "form").otherwise(F.col("type"))
    )
    x = x.withColumn("chunk_type", kind).withColumn("in_table", in_table)
    same = joins & ~((F.col("type") == "table_row") & ~(F.col("in_table") & F.coalesce(F.lag("in_table").over(w), F.lit(False))))
    return x.withColumn("chunk_no", F.sum(F.when(same, 0).otherwise(1)).over(w)).drop("run", "cells", "last_cells", "changed", "tail", "rows", "size", "in_table")


def page_quality(blocks: DataFrame) -> DataFrame:
    """Per page: blocks, mean score and share of scores under 0.70 (of those there are), summed area."""
    return blocks.groupBy(*PAGE).agg(
        F.count("*").alias("n_blocks"), F.avg("score").alias("mean_score"), (F.count_if(F.col("score") < 0.70) / F.nullif(F.count("score"), F.lit(0))).alias("low_share"),
        F.sum(F.when(F.col("box").isNotNull(), g.area(F.col("box"))).otherwise(0.0)).alias("area"),
    )


def routing_reasons(typed_blocks: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Per page the ordered reasons for a review. ``forced``: (doc_id, page) that users ask for."""
    b = F.col("box")
    page = typed_blocks.groupBy(*PAGE).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.count("score").alias("scored"), F.count_if(F.col("score") < 0.70).alias("low"), F.bool_or(F.col("type").isin("table_row", "key_value")).alias("form"),
        F.sum(F.when(b.isNotNull(), g.area(b)).otherwise(0.0)).alias("area"), F.count_if((b["l"] < 0.45) & (b["r"] < 0.60)).alias("left"), F.count_if(b["l"] > 0.40).alias("right"),
        F.count_if(F.contains("text", F.lit("|")) | F.contains("text", F.lit("\t"))).alias("rows"),
    ).join(columns_of_pages(typed_blocks), list(PAGE))
    ask = F.lit(False)
    if forced is not None:
        page = page.join(forced.select(*PAGE).distinct().withColumn("asked", F.lit(True)), list(PAGE), "left")
        ask = F.coalesce("asked", F.lit(False))
    two = F.col("columns") == 2
    rules = [
        ("user_requested", ask), ("low_confidence", F.col("mean").isNull() | (F.col("mean") < LOW_CONFIDENCE)), ("conflicting_confidence", (F.col("scored") > 0) & (F.col("low") / F.nullif(F.col("scored"), F.lit(0)) > 0.20)),
        ("dense_layout", F.col("n") >= 80), ("table_or_form", F.col("form")), ("multi_column", two), ("ambiguous_reading_order", F.col("ambiguous")), ("low_coverage", F.col("area") < 0.005),
        ("complex_layout", (((F.col("left") >= 4) & (F.col("right") >= 4)) | (F.col("rows") >= 3)) & ~two),
    ]
    return page.select(*PAGE, F.concat_ws(",", *[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]).alias("reasons"))


def review_flags(blocks: DataFrame) -> DataFrame:
    """``blocks`` with strict (a low score, or text at risk; no score is no reason) and routed (no score is one)."""
    risk = F.coalesce(F.col("text").rlike(HIGH_RISK), F.lit(False))
    strict = F.coalesce(F.col("score") < LOW_CONFIDENCE, F.lit(False)) | risk
    return blocks.withColumns({"strict": strict, "routed": F.coalesce("score", F.lit(0.0)) < LOW_CONFIDENCE, "risk": risk})


def link_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Every (block, region) of a page with the block's centre inside or half of it covered, and whether the region
    is the block's primary one (coverage, then score, then the smaller area, then the earlier)."""
    r = regions.select(*PAGE, "region_id", "region_ord", F.col("score").alias("r_score"), F.col("box").alias("r_box"))
    cover = g.coverage(F.col("box"), F.col("r_box"))
    x = blocks.where("box is not null").join(r, list(PAGE)).withColumn("coverage", cover).where(g.centre_inside(F.col("box"), F.col("r_box")) | (F.col("coverage") >= 0.5))
    best = Window.partitionBy(*PAGE, "block_id").orderBy(F.desc("coverage"), F.desc("r_score"), g.area(F.col("r_box")), "region_ord")
    return x.withColumn("is_primary", F.row_number().over(best) == 1)


def region_of_chunks(chunked: DataFrame, links: DataFrame) -> DataFrame:
    """Per chunk the region that most of its links name (of equals the smallest id)."""
    n = chunked.select(*PAGE, "chunk_no", "block_id").join(links.select(*PAGE, "block_id", "region_id"), [*PAGE, "block_id"]).groupBy(*PAGE, "chunk_no", "region_id").agg(F.count("*").alias("n"))
    return n.groupBy(*PAGE, "chunk_no").agg(F.min_by("region_id", F.struct(-F.col("n"), "region_id")).alias("region_id"))


def nearest_labels(controls: DataFrame, blocks: DataFrame, most: float = 0.02) -> DataFrame:
    """Per control the nearest label block: to its right by -0.03 to 0.04 with half-height overlap of 0.35 or more and
    centres within ``most``; unique if the next one is 0.03 or more behind and the label's score is 0.85 or more."""
    c = controls.select(*PAGE, "control_id", F.col("box").alias("c_box"))
    x = c.join(blocks.where("box is not null"), list(PAGE))
    dx, dy = F.col("box.l") - F.col("c_box.r"), F.abs(g.centre_y(F.col("box")) - g.centre_y(F.col("c_box")))
    x = x.withColumns({"dx": dx, "dy": dy}).where((F.col("dx") >= -0.03) & (F.col("dx") <= 0.04) & (F.col("dy") <= most) & (g.y_overlap(F.col("box"), F.col("c_box")) >= 0.35) & ~F.lower(strip(F.col("text"))).isin("x", "✓", "✔", "☑"))
    x = x.withColumn("rank", F.greatest(F.col("dx"), F.lit(0.0)) + 2 * F.col("dy"))
    w = Window.partitionBy(*PAGE, "control_id").orderBy("rank", "ord")
    x = x.withColumns({"n": F.row_number().over(w), "next": F.lead("rank").over(w)})
    sure = (F.col("next").isNull() | (F.col("next") - F.col("rank") >= 0.03)) & F.coalesce(F.col("score") >= LOW_CONFIDENCE, F.lit(False))
    return x.where("n = 1").select(*PAGE, "control_id", "block_id", sure.alias("is_unique"))


def assign_cells(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Per block the cell that covers most of it (of equals the earlier cell); null if none covers any."""
    c = cells.select(*PAGE, "cell_ord", "cell_id", F.col("box").alias("c_box"))
    cover = g.coverage(F.col("box"), F.col("c_box"))
    x = blocks.join(c, list(PAGE), "left").withColumn("coverage", F.coalesce(cover, F.lit(0.0)))
    best = F.max_by(F.struct("cell_id", "coverage"), F.struct("coverage", -F.col("cell_ord")))
    return x.groupBy(*PAGE, "block_id").agg(best.alias("best")).select(*PAGE, "block_id", F.when(F.col("best.coverage") > 0, F.col("best.cell_id")).alias("cell_id"))


def kept_in_turn(rows: DataFrame, keys: list[str], order: list, seen: list[str], start: Callable[[], Callable[[tuple], bool]]) -> DataFrame:
    """The rows that are taken when those of each group of ``keys`` are shown in ``order``, one after another, to what
    ``start`` gives for the group. A task passes over its sorted rows and holds one group's memory at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, take = None, None
        for b in batches:
            keep = []
            for key, row in zip(zip(*(b.column(k).to_pylist() for k in keys)), zip(*(b.column(c).to_pylist() for c in seen))):
                if take is None or key != last:
                    last, take = key, start()
                keep.append(take(row))
            yield b.filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return in_turn(rows, keys, *order).mapInArrow(work, schema)
