"""Review regions: boxes of uncertain evidence, merged and tiled, a crop each.

The merging depends on the order of the boxes, so a page is handled as a whole: its boxes
(four doubles and a number each, no text and no ids) pass in order through one task, which
says for every box which merged box it went into. Ids and reasons stay in Spark and follow
by that number; the halving of large boxes is an expression within the row.

Defined cases: a page with a box that is missing or not valid is one region of its own with
all reasons and no sources; pages without candidates have no regions; equal boxes are taken
in order of their number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..sources.stage import in_turn

PAGE = ("doc_id", "page")
#: Share of the page that a region may cover, how much larger a merged box may be than its parts together, regions aimed at.
MOST_AREA, MOST_GROWTH, TARGET = 0.15, 1.5, 12
#: Reasons that the plan itself adds.
TILED, NO_GEOMETRY = "oversized_region_tiled", "missing_uncertain_geometry"
#: Halvings after which no part of a page is larger than MOST_AREA.
HALVINGS = 3


def _union(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([np.minimum(x[..., :2], y[..., :2]), np.maximum(x[..., 2:], y[..., 2:])], axis=-1)


def _area(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, x[..., 2] - x[..., 0]) * np.maximum(0.0, x[..., 3] - x[..., 1])


def _joins(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` touch ``x`` and make one box with it that is not too large."""
    touch = (np.maximum(x[..., :2], others[..., :2]) <= np.minimum(x[..., 2:], others[..., 2:])).all(-1)
    union = _area(_union(x, others))
    return touch & (union <= MOST_AREA) & (union <= (_area(x) + _area(others)) * MOST_GROWTH)


class _Boxes:
    """Boxes of one page, in order, each with the numbers of those it was made of."""

    def __init__(self, boxes: np.ndarray):
        self.boxes, self.members = boxes, [[i] for i in range(len(boxes))]

    def settle(self) -> None:
        """Every box takes in those behind it that join it, the first of them first, until none does."""
        boxes, members, left = [], [], np.arange(len(self.boxes))
        while len(left):
            box, own, left = self.boxes[left[0]], self.members[left[0]], left[1:]
            while len(hits := np.flatnonzero(_joins(box, self.boxes[left]))):
                box, own = _union(box, self.boxes[left[hits[0]]]), own + self.members[left[hits[0]]]
                left = np.delete(left, hits[0])
            boxes.append(box)
            members.append(own)
        self.boxes, self.members = np.array(boxes).reshape(-1, 4), members

    def reduce(self, target: int) -> None:
        """The nearest two (by their centres) whose common box is not too large become one, behind all others, until ``target`` are left."""
        while len(self.boxes) > target and self._merge_nearest(target):
            self.settle()

    def _merge_nearest(self, target: int) -> bool:
        """Merges until a merged box could join another one; whether there is more to do."""
        boxes, members, alive = list(self.boxes), list(self.members), dict.fromkeys(range(len(self.boxes)))
        loose = any(_joins(boxes[i], self.boxes[i + 1 :]).any() for i in range(len(boxes) - 1))
        heap: list[tuple[float, int, int]] = []

        def push(j: int) -> None:
            before = np.array([i for i in alive if i < j], np.int64)
            if len(before):
                old = np.array([boxes[i] for i in before])
                away = (old[:, :2] + old[:, 2:] - boxes[j][:2] - boxes[j][2:]) / 2
                near = (away * away).sum(1)
                for k in np.flatnonzero(_area(_union(old, boxes[j])) <= MOST_AREA):
                    heapq.heappush(heap, (float(near[k]), int(before[k]), j))

        for j in range(len(boxes)):
            push(j)
        more = False
        while len(alive) > target and heap:
            _, i, j = heapq.heappop(heap)
            if i not in alive or j not in alive:
                continue
            new = len(boxes)
            boxes.append(_union(boxes[i], boxes[j]))
            members.append(members[i] + members[j])
            del alive[i], alive[j]
            others = np.array([boxes[k] for k in alive]).reshape(-1, 4)
            alive[new] = None
            more = True
            if loose or _joins(boxes[new], others).any():
                break
            push(new)
        self.boxes, self.members = np.array([boxes[k] for k in alive]).reshape(-1, 4), [members[k] for k in alive]
        return more


def merged(boxes: np.ndarray, target: int = TARGET) -> tuple[np.ndarray, list[list[int]]]:
    """The merged boxes in order, and the numbers of the boxes in each. ``target`` is aimed at: boxes that would be too large stay apart."""
    x = _Boxes(boxes)
    x.settle()
    x.reduce(target)
    return x.boxes, x.members


def merged_boxes(candidates: DataFrame, target: int = TARGET) -> DataFrame:
    """(doc_id, page, cand_ord, merged, box): for every candidate the number of the merged box it went into, and that box."""
    kinds = {c: candidates.schema[c].dataType.simpleString() for c in (*PAGE, "cand_ord")}
    x = candidates.select(*PAGE, "cand_ord", *(F.col(f"box.{k}").alias(k) for k in "ltrb"))
    names = [*PAGE, "cand_ord", "merged", *"ltrb"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            own = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            boxes = np.stack([own.column(k).to_numpy() for k in "ltrb"], 1)
            out, members = merged(boxes, target)
            number = np.zeros(len(boxes), np.int32)
            for k, m in enumerate(members):
                number[m] = k
            return pa.RecordBatch.from_arrays([*(own.column(c) for c in (*PAGE, "cand_ord")), pa.array(number), *(pa.array(out[number, k]) for k in range(4))], names=names)

        last: tuple | None = None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in PAGE)))
            begin = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != last:
                    if i > begin:
                        rows.append(b.slice(begin, i - begin))
                    if i < len(keys):
                        if rows:
                            yield flush()
                            rows.clear()
                        last, begin = keys[i], i
        if rows:
            yield flush()

    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", merged int, l double, t double, r double, b double"
    out = in_turn(x, list(PAGE), "cand_ord").mapInArrow(work, schema)
    return out.select(*PAGE, "cand_ord", "merged", g.box(*(F.col(k) for k in "ltrb")).alias("box"))


def tiles(box: Column) -> Column:
    """The box in halves of its longer side (of equal sides: upright), until no part is larger than MOST_AREA."""

    def halves(x: Column) -> Column:
        mx, my = (x["l"] + x["r"]) / 2, (x["t"] + x["b"]) / 2
        across = x["r"] - x["l"] >= x["b"] - x["t"]
        one = g.box(x["l"], x["t"], F.when(across, mx).otherwise(x["r"]), F.when(across, x["b"]).otherwise(my))
        two = g.box(F.when(across, mx).otherwise(x["l"]), F.when(across, x["t"]).otherwise(my), x["r"], x["b"])
        return F.when(g.area(x) > MOST_AREA, F.array(one, two)).otherwise(F.array(x))

    out = F.array(box)
    for _ in range(HALVINGS):
        out = F.flatten(F.transform(out, halves))
    return out


def review_regions(candidates: DataFrame, page_reasons: DataFrame, target: int = TARGET) -> DataFrame:
    """(doc_id, page, region_no, box, reasons, sources): the regions of each page from top to bottom. ``candidates``: cand_ord, box,
    reasons, sources (arrays of strings); ``page_reasons``: reasons that hold for all regions of a page."""
    ok = g.valid(F.col("box"))
    placeless = candidates.groupBy(*PAGE).agg(F.bool_or(~ok).alias("placeless"))
    extra = page_reasons.select(*PAGE, F.col("reasons").alias("page_reasons"))
    x = candidates.join(placeless, list(PAGE)).join(extra, list(PAGE), "left").withColumn("reasons", F.concat("reasons", F.coalesce("page_reasons", F.array().cast("array<string>"))))
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    whole = x.where("placeless").groupBy(*PAGE).agg(F.array_sort(F.array_union(names("reasons"), F.array(F.lit(NO_GEOMETRY)))).alias("reasons"))
    whole = whole.select(*PAGE, F.lit(0).alias("merged"), g.box(*map(F.lit, (0, 0, 1, 1))).alias("box"), "reasons", F.array().cast("array<string>").alias("sources"))
    local = x.where("not placeless")
    group = merged_boxes(local, target).withColumnRenamed("box", "merged_box")
    own = local.join(group, [*PAGE, "cand_ord"]).groupBy(*PAGE, "merged").agg(F.first("merged_box").alias("m"), names("reasons").alias("reasons"), names("sources").alias("sources"))
    parts = own.withColumn("parts", tiles(F.col("m"))).withColumn("reasons", F.when(F.size("parts") > 1, F.array_sort(F.array_union("reasons", F.array(F.lit(TILED))))).otherwise(F.col("reasons")))
    cut = parts.select(*PAGE, "merged", F.explode("parts").alias("box"), "reasons", "sources")
    order = Window.partitionBy(*PAGE).orderBy("box.t", "box.l", "merged")
    return cut.unionByName(whole).withColumn("region_no", F.row_number().over(order)).drop("merged")
