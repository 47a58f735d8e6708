"""What grounds a proposal: types that need evidence, an index of all places, audits that hold for one content only.

Defined cases: a proposal without known blocks has no box and no labels, so types that need
evidence become text; an audit whose digest is not that of the present proposal holds for
nothing; null labels are no labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .structure import SIGNED, first_chunks

PAGE = ("doc_id", "page")
#: Layout labels that speak for marginalia and for pictures, words that speak for a signature.
MARGINALIA, PICTURES = ("header", "footer", "footnote", "number", "vision_footnote"), ("header_image", "footer_image", "image")
SIGNATURE_WORDS = r"(?i)\b(?:attest(?:ation)?|electronically\s+(?:signed|authenticated)|signature|signed\s+by)\b|\[(?:E-)?SIGNED\]|\[ILLEGIBLE_SIGNATURE\]"
#: Share of one box that the other covers for them to show the same, height below which a lone word is no logo.
SHOWN, LOW = 0.40, 0.04
#: Fixed value: states of visual chunks that count as seen.
SEEN = ("model_verified", "human_approved")


def validated_types(proposals: DataFrame, members: DataFrame, evidence: DataFrame) -> DataFrame:
    """(doc_id, page, proposal_id, type, n_parts): the type that a proposal's blocks and visual evidence bear out, else text; and into how
    many objects it falls: attestations whose blocks all carry a signature's mark are one each. ``members``: proposal_id, ord, text,
    box, label (of the block's region); ``evidence``: proposal_id, source, box, on the page that it shows."""
    key = [*PAGE, "proposal_id"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    marked = F.greatest(*[F.contains(F.upper("text"), F.lit(m)) for m in SIGNED])
    m = members.groupBy(*key).agg(F.collect_set(F.lower("label")).alias("labels"), g.union_of("box").alias("around"), F.count("*").alias("n"), F.coalesce(F.bool_and(marked), F.lit(False)).alias("all_marked"), text.alias("text"))
    shown = evidence.where("source = 'visual' and box is not null").select(*key, F.col("box").alias("e_box")).join(m.where("around is not null").select(*key, "around"), key)
    covers = F.greatest(g.coverage(F.col("around"), F.col("e_box")), g.coverage(F.col("e_box"), F.col("around"))) >= SHOWN
    seen = shown.where(covers).groupBy(*key).agg(F.max(F.col("e_box.b") - F.col("e_box.t")).alias("height"))
    x = proposals.select(*key, "type").join(m, key, "left").join(seen, key, "left")
    has = lambda names: F.coalesce(F.arrays_overlap("labels", F.array(*map(F.lit, names))), F.lit(False))
    visual, picture = F.col("height").isNotNull(), has(PICTURES)
    word = visual & ~picture & (F.col("n") == 1) & (F.col("height") < LOW)
    bare = (
        F.when(F.col("type") == "marginalia", ~has(MARGINALIA)).when(F.col("type") == "logo", (~visual & ~picture) | word)
        .when(F.col("type") == "attestation", ~visual & ~F.coalesce(F.col("text").rlike(SIGNATURE_WORDS), F.lit(False))).when(F.col("type").isin("figure", "scan_code"), ~visual)
    )
    kind = F.when(F.coalesce(bare, F.lit(False)), "text").otherwise(F.col("type"))
    parts = F.when((kind == "attestation") & F.col("all_marked") & (F.col("n") > 1), F.col("n")).otherwise(1)
    return x.select(*key, kind.alias("type"), parts.cast("int").alias("n_parts"))


def grounding_index(blocks: DataFrame, members: DataFrame, visual_chunks: DataFrame) -> DataFrame:
    """(doc_id, page, block_id, chunk_id, type, score, box, text): every block with the first chunk that holds it, and every visual chunk
    that a model or a person has verified. ``members``: chunk_id, chunk_ord, block_id; ``visual_chunks``: chunk_id, type, box, text, provenance, verification."""
    own = blocks.join(first_chunks(members), [*PAGE, "block_id"], "left").select(*PAGE, "block_id", "chunk_id", "type", "score", "box", "text")
    seen = visual_chunks.where((F.col("provenance") == "visual") & F.col("verification").isin(*SEEN))
    return own.unionByName(seen.select(*PAGE, F.lit(None).cast(blocks.schema["block_id"].dataType).alias("block_id"), "chunk_id", "type", F.lit(None).cast(blocks.schema["score"].dataType).alias("score"), "box", "text"))


def proposal_digest(*fields: str) -> Column:
    """What an approval is bound to: the SHA-256 of all fields of a proposal, names and nulls included."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def audited(proposals: DataFrame, audits: DataFrame, fields: list[str]) -> DataFrame:
    """``proposals`` (doc_id, item_id, content and the ``fields`` that make its digest) with digest, status and shown: of the audits of the
    same id and digest (doc_id, item_id, digest, ord, status, content) the last one counts; a proposal that changed since is pending."""
    last = audits.groupBy("doc_id", "item_id", "digest").agg(F.max_by(F.struct("status", "content"), "ord").alias("_last"))
    x = proposals.withColumn("digest", proposal_digest(*fields)).join(last, ["doc_id", "item_id", "digest"], "left")
    return x.withColumns({"status": F.coalesce("_last.status", F.lit("pending")), "shown": F.coalesce("_last.content", "content")}).drop("_last")
