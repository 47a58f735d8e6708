"""Checkboxes, redactions, visual objects and review regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.text import strip
from .layout import kept_in_turn

PAGE = ("doc_id", "page")
#: Marks shown for the states of a checkbox.
MARKS = {"CHECKED": "[x]", "UNCHECKED": "[ ]", "CROSSED": "[-]", "PARTIAL": "[~]"}


def ink_state(ratio: Column) -> Column:
    """The state that the share of ink inside a control speaks for."""
    return F.when(ratio <= 0.06, "UNCHECKED").when(ratio >= 0.10, "CHECKED").otherwise("NOT_DETERMINABLE")


def is_visual(c: DataFrame) -> Column:
    """A square enough box (by pixels), detected with 0.70 or more, of a clear state."""
    b = F.col("box")
    aspect = (b["r"] - b["l"]) * F.col("width") / ((b["b"] - b["t"]) * F.col("height"))
    return g.valid(b) & (aspect >= 0.85) & (aspect <= 1 / 0.85) & (F.col("detector_score") >= 0.70) & F.col("state").isin("CHECKED", "UNCHECKED")


def graded_checkboxes(candidates: DataFrame) -> DataFrame:
    """Candidates with visual, credible (also clearly labelled) and automatic (also without risks)."""
    visual = is_visual(candidates)
    credible = visual & F.col("label_unique") & (F.coalesce("ocr_score", F.lit(0.0)) >= 0.85) & F.col("label_id").isNotNull() & F.col("label").rlike(r"\p{L}")
    return candidates.withColumns({"visual": F.coalesce(visual, F.lit(False)), "credible": F.coalesce(credible, F.lit(False)), "automatic": F.coalesce(credible & (F.size("risks") == 0), F.lit(False))})


def publishable(checkboxes: DataFrame) -> DataFrame:
    return checkboxes.where(F.col("status").isin("automated", "user_verified") & (F.col("state") != "NOT_DETERMINABLE") & (strip(F.coalesce("label", F.lit(""))) != ""))


def checkbox_lines(checkboxes: DataFrame) -> DataFrame:
    """Per page the published controls as marks with labels, from top to bottom and left to right."""
    mark = F.lit("[?]")
    for state, m in MARKS.items():
        mark = F.when(F.col("state") == state, m).otherwise(mark)
    x = publishable(checkboxes).withColumn("line", F.concat(mark, F.lit(" "), strip(F.col("label"))))
    lines = F.array_sort(F.collect_list(F.struct(F.col("box.t").alias("t"), F.col("box.l").alias("l"), "line")))
    return x.groupBy(*PAGE).agg(F.array_join(F.transform(lines, lambda i: i["line"]), "\n").alias("lines"), F.count("*").alias("n"))


def best_local_match(proposed: DataFrame, local: DataFrame, least: float = 0.2) -> DataFrame:
    """Per proposed control the local one that overlaps it most, if by more than ``least`` (of equals the first)."""
    b = local.select(*PAGE, F.col("control_id").alias("local_id"), F.col("ord").alias("l_ord"), F.col("box").alias("l_box"))
    x = proposed.join(b, list(PAGE), "left").withColumn("overlap", F.coalesce(g.iou(F.col("box"), F.col("l_box")), F.lit(0.0)))
    best = x.groupBy(*PAGE, "control_id").agg(F.max_by(F.struct("local_id", "overlap"), F.struct("overlap", -F.coalesce("l_ord", F.lit(0)))).alias("m"))
    return best.select(*PAGE, "control_id", F.when(F.col("m.overlap") > least, F.col("m.local_id")).alias("local_id"))


def first_of_overlapping(boxes: DataFrame, least: float = 0.6, most_covered: float = 0.8) -> DataFrame:
    """Boxes in order per page, without those that overlap a kept one by more than ``least``, or where one covers more
    than ``most_covered`` of the smaller. A page's boxes are few; each is held against the kept ones in turn."""

    def start() -> Callable[[tuple], bool]:
        kept: list[tuple[float, float, float, float]] = []

        def take(row: tuple) -> bool:
            l, t, r, b = row  # noqa: E741
            own = max(0.0, r - l) * max(0.0, b - t)
            for kl, kt, kr, kb in kept:
                both = max(0.0, min(r, kr) - max(l, kl)) * max(0.0, min(b, kb) - max(t, kt))
                other = (kr - kl) * (kb - kt)
                union, small = own + other - both, min(own, other)
                if (union > 0 and both / union > least) or (small > 0 and both / small > most_covered):
                    return False
            kept.append(row)
            return True

        return take

    flat = boxes.select(*PAGE, "ord", "box.l", "box.t", "box.r", "box.b")
    return kept_in_turn(flat, list(PAGE), ["ord"], list("ltrb"), start)


def redaction_filter(candidates: DataFrame) -> Column:
    """Width 3 to 40 %, height 0.6 to 4 %, aspect 3 to 30 and filled by 0.65 or more."""
    w, h = F.col("box.r") - F.col("box.l"), F.col("box.b") - F.col("box.t")
    return (w >= 0.03) & (w <= 0.40) & (h >= 0.006) & (h <= 0.04) & (w / h >= 3) & (w / h <= 30) & (F.col("fill_ratio") >= 0.65)


def redaction_outcomes(candidates: DataFrame, refinements: DataFrame) -> DataFrame:
    """Redaction candidates that no refinement speaks of."""
    return candidates.join(refinements.select("doc_id", F.col("block_id").alias("candidate_id")).distinct(), ["doc_id", "candidate_id"], "left_anti")


def grid_problems(cells: DataFrame) -> DataFrame:
    """Per table the slots (row, column) that more than one cell covers with its spans."""
    slot = cells.select("doc_id", "table_id", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("y"), "column", "column_span")
    slot = slot.select("doc_id", "table_id", "y", F.explode(F.sequence(F.col("column"), F.col("column") + F.col("column_span") - 1)).alias("x"))
    return slot.groupBy("doc_id", "table_id", "y", "x").agg(F.count("*").alias("n")).where("n > 1")


def consistent_text_tables(rows: DataFrame) -> DataFrame:
    """Per table whether it has two rows or more with equally many cells, two at least."""
    return rows.groupBy("doc_id", "table_id").agg(((F.count("*") >= 2) & (F.count_distinct("n_cells") == 1) & (F.min("n_cells") >= 2)).alias("consistent"))


def review_windows(tables: DataFrame, by: float = 0.02) -> DataFrame:
    """Tables with their window: padded, then cut by neighbours that share half the width. A neighbour above that
    reaches into the pad puts the top back to the table's own; the bottom is cut at the nearest neighbour below."""
    t = tables.withColumn("window", g.pad(F.col("box"), by))
    n = tables.select(*PAGE, F.col("table_id").alias("n_id"), F.col("box").alias("n_box"))
    x = t.join(n, list(PAGE), "left")
    near = (F.col("n_id") != F.col("table_id")) & (g.x_overlap(F.col("box"), F.col("n_box")) >= 0.5)
    above = near & (F.col("n_box.b") <= F.col("box.t")) & (F.col("n_box.b") > F.col("window.t"))
    below = F.when(near & (F.col("n_box.t") >= F.col("box.b")), F.col("n_box.t"))
    x = x.groupBy(*PAGE, "table_id").agg(F.first("box").alias("box"), F.first("window").alias("w"), F.coalesce(F.bool_or(above), F.lit(False)).alias("cut"), F.min(below).alias("low"))
    return x.select(*PAGE, "table_id", "w.l", F.when(F.col("cut"), F.col("box.t")).otherwise(F.col("w.t")).alias("t"), "w.r", F.least(F.col("w.b"), F.col("low")).alias("b"))


def slot_reorder(blocks: DataFrame, order: str) -> DataFrame:
    """Only blocks with a value in ``order`` trade places, among their own; others keep theirs. Gives slot per block."""
    has = F.col(order).isNotNull()
    x = blocks.withColumn("_has", has)
    slots = x.where("_has").select(*PAGE, F.col("ord").alias("slot"), F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord")).alias("_n"))
    ranked = x.where("_has").select(*PAGE, "block_id", F.row_number().over(Window.partitionBy(*PAGE).orderBy(order, "box.t", "box.l", "ord")).alias("_n"))
    moved = ranked.join(slots, [*PAGE, "_n"]).select(*PAGE, "block_id", "slot")
    return moved.union(x.where("not _has").select(*PAGE, "block_id", F.col("ord").alias("slot")))


def runs_with_gap(positions: DataFrame, group: str, at: str, gap: int = 5) -> DataFrame:
    """Islands of positions: a new one begins after more than ``gap``."""
    w = Window.partitionBy(group).orderBy(at)
    x = positions.withColumn("_new", F.when(F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True)), 1).otherwise(0))
    x = x.withColumn("run", F.sum("_new").over(w))
    return x.groupBy(group, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def image_area_ratio(regions: DataFrame) -> DataFrame:
    """Share of each page that its review regions take up, 1 at most."""
    return regions.groupBy(*PAGE).agg(F.least(F.lit(1.0), F.sum(g.area(F.col("box")))).alias("ratio"))


def edges_of_page(blocks: DataFrame, each: int = 2, most: int = 500) -> DataFrame:
    """The first and last blocks of each page (all, if there are few), their text cut to ``most`` characters."""
    up, down = Window.partitionBy(*PAGE).orderBy("ord"), Window.partitionBy(*PAGE).orderBy(F.desc("ord"))
    x = blocks.withColumns({"_a": F.row_number().over(up), "_b": F.row_number().over(down)})
    return x.where((F.col("_a") <= each) | (F.col("_b") <= each)).withColumn("text", F.substring("text", 1, most)).drop("_a", "_b")


def pending_round(objects: DataFrame, most: int = 8, rounds: int = 2) -> DataFrame:
    """The pending objects of each document with the review round that takes them; null if none does."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    x = objects.where("status = 'pending'").withColumn("round", F.floor(n / most).cast("int") + 1)
    return x.withColumn("round", F.when(F.col("round") <= rounds, F.col("round")))


def content_ids(objects: DataFrame) -> DataFrame:
    """Proposals once per content, the first ones, named by page and a hash of what they say."""
    spelled = F.concat_ws("|", F.col("page"), F.col("kind"), F.col("content"))
    x = objects.withColumn("id", F.concat(F.lit("visual-p"), "page", F.lit("-"), F.substring(F.sha2(spelled.cast("binary"), 256), 1, 20)))
    return x.groupBy("doc_id", "id").agg(F.min("ord").alias("ord"))
