"""Checkboxes that several signals agree on: one list of candidates from two, and records with what speaks against each.

Whether a box overlaps an earlier one depends on the order of the boxes of a page; they pass,
without text, through one task each page, which holds the boxes kept so far. All else is
joins. Defined cases: an id that is not valid or stands twice in a document is passed over
after its first place; a null box overlaps nothing; a missing score is below any limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..sources.stage import in_turn
from .visual import best_local_match

PAGE = ("doc_id", "page")
#: Overlap from which boxes are one control, least confidence of a verification and of a label's text, form of an id.
SAME, SURE, LEGIBLE, NAME = 0.5, 0.90, 0.85, r"^[A-Za-z0-9._-]{1,80}$"


def overlaps_earlier(boxes: DataFrame, limit: float = SAME) -> DataFrame:
    """``boxes`` (doc_id, page, pos, box, droppable) with overlaps: an earlier box of the page (by pos) covers the same place, by
    intersection over union above ``limit``. Of the droppable ones those that overlap do not count as earlier boxes."""
    keys = [*PAGE, "pos"]
    x = boxes.select(*keys, "droppable", *(F.col(f"box.{k}").alias(k) for k in "ltrb"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, kept, n = object(), np.zeros((8, 4)), 0
        for b in batches:
            out = []
            values = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in "ltrb"], 1) if b.num_rows else np.zeros((0, 4))
            for own, droppable, box in zip(zip(*(b.column(c).to_pylist() for c in PAGE)), b.column("droppable").to_pylist(), values):
                if own != page:
                    page, n = own, 0
                held = kept[:n]
                both = np.maximum(0.0, np.minimum(held[:, 2:], box[2:]) - np.maximum(held[:, :2], box[:2])).prod(1)
                union = np.maximum(0.0, held[:, 2:] - held[:, :2]).prod(1) + np.maximum(0.0, box[2:] - box[:2]).prod() - both
                hit = bool((both > limit * union).any())
                out.append(hit)
                if not (hit and droppable):
                    if n == len(kept):
                        kept = np.concatenate([kept, np.zeros_like(kept)])
                    kept[n] = box
                    n += 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(out, pa.bool_())], names=[*keys, "overlaps"])

    schema = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in keys) + ", overlaps boolean"
    found = in_turn(x, list(PAGE), "pos").mapInArrow(work, schema)
    found = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    return boxes.join(found, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])).drop(*(f"_{k}" for k in keys))


def joint_candidates(main: DataFrame, local: DataFrame) -> DataFrame:
    """(doc_id, page, pos, id, label, state, box, label_block_id, confidence, discovered): the main candidates, each id of a document once,
    and behind them on each page the credible ``local`` ones that overlap none kept before. A local id that is taken gets a suffix.
    Both: ord, id, label, state, box, label_block_id, confidence."""
    columns = [*PAGE, "ord", "id", "label", "state", "box", "label_block_id", "confidence"]
    first = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("ord"))
    m = main.select(*columns).withColumn("nth", first).where("nth = 1").drop("nth").withColumn("discovered", F.lit(True))
    both = m.unionByName(local.select(*columns).withColumn("discovered", F.lit(False)))
    x = both.withColumns({"pos": F.struct(~F.col("discovered"), "ord", "id"), "droppable": ~F.col("discovered")})
    x = x.withColumn("pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy("pos")))
    kept = overlaps_earlier(x).where("discovered or not overlaps")
    again = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(F.desc("discovered"), "page", "pos")) > 1
    return kept.withColumn("id", F.when(again, F.concat("id", F.lit("-local"))).otherwise(F.col("id"))).drop("overlaps", "droppable", "ord")


def consensus(candidates: DataFrame, verifications: DataFrame, local: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, id, label, state, confidence, decision, agreement, risks): a record for each candidate that the verification of its
    crop calls a checkbox. Without risks it is "automated" with the confidence of the verification, else to be reviewed.

    ``candidates``: joint_candidates with given_risks (what is known against its geometry and label) and label_grounded;
    ``verifications``: id, v_page, control_status, v_state, v_confidence; ``local``: local candidates with a checkbox's shape (id, ord,
    box, state, label, label_block_id); ``blocks``: block_id, text, score."""
    first = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(F.desc("discovered"), "page", "pos"))
    named = candidates.withColumn("id", strip(F.col("id"))).where(F.col("id").rlike(NAME)).withColumn("nth", first).where("nth = 1").drop("nth")
    seen = named.join(verifications.where("control_status = 'checkbox'"), ["doc_id", "id"])
    marked = overlaps_earlier(seen.withColumn("droppable", F.lit(False)))
    match = best_local_match(marked.select(*PAGE, F.col("id").alias("control_id"), "box"), local.select(*PAGE, F.col("id").alias("control_id"), "ord", "box"))
    own = local.select(*PAGE, F.col("id").alias("local_id"), F.struct("state", "label", "label_block_id").alias("local"))
    match = match.where("local_id is not null").join(own, [*PAGE, "local_id"]).select(*PAGE, F.col("control_id").alias("id"), "local")
    x = marked.join(match, [*PAGE, "id"], "left")
    blank = (strip(F.coalesce("label", F.lit(""))) == "") & F.col("local").isNotNull()
    x = x.withColumns({"label": F.when(blank, F.col("local.label")).otherwise(F.col("label")), "label_block_id": F.when(blank, F.col("local.label_block_id")).otherwise(F.col("label_block_id"))})
    x = x.join(blocks.select(*PAGE, F.col("block_id").alias("label_block_id"), F.col("score").alias("label_score")), [*PAGE, "label_block_id"], "left")
    sure = (F.col("v_page") == F.col("page")) & (F.col("v_state") == F.col("state")) & F.col("v_state").isin("CHECKED", "UNCHECKED") & (F.col("v_confidence") >= SURE)
    x = x.withColumn("sure", F.coalesce(sure, F.lit(False)))
    here, no = F.col("local").isNotNull(), F.lit(False)
    against = (
        ("overlaps_another", F.col("overlaps")), ("not_found_locally", ~here), ("states_disagree", here & ~F.coalesce(F.col("local.state") == F.col("state"), no)), ("labels_disagree", here & ~F.coalesce(F.col("local.label_block_id") == F.col("label_block_id"), no)),
        ("label_not_grounded", ~F.coalesce("label_grounded", no)), ("label_score_low", ~F.coalesce(F.col("label_score") >= LEGIBLE, no)), ("not_confirmed", ~F.col("discovered") & ~F.col("sure")), ("verification_disagrees", ~F.col("sure")),
    )
    risks = F.concat(F.coalesce("given_risks", F.array().cast("array<string>")), F.array_compact(F.array(*(F.when(c, name) for name, c in against))))
    x = x.withColumn("risks", F.array_distinct(risks))
    fine = F.size("risks") == 0
    differ = here & (~F.coalesce(F.col("local.state") == F.col("state"), no) | ~F.coalesce(F.col("v_state") == F.col("state"), no))
    return x.select(
        *PAGE, "id", "label", "state", F.when(fine, F.col("v_confidence")).otherwise(F.col("confidence")).alias("confidence"), F.when(fine, "automated").otherwise("review_required").alias("decision"),
        F.when(fine, "consensus").when(differ, "disagreement").otherwise("incomplete").alias("agreement"), "risks",
    )
