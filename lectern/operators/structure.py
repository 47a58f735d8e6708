"""Tables, semantic groups, signatures and redactions on pages, the order of what a page holds, and checks on proposals.

A page has at most some thousand blocks, so windows and joins within one page are bounded; nothing here groups by less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.text import strip
from .layout import LOW_CONFIDENCE

PAGE = ("doc_id", "page")
#: Texts that mark a signature, labels of page margins, parts of labels of signatures.
SIGNED = ("[E-SIGNED]", "[SIGNED]", "[ILLEGIBLE_SIGNATURE]")
MARGINAL = ("header", "footer", "page_number", "footnote", "marginalia")
SEALS = ("signature", "stamp", "seal")
SEMANTIC = ("marginalia", "logo", "attestation", "figure", "scan_code")
ATTESTED = r"(?i)^Electronically\s+signed\s+by:\s*\S"
#: What stands for a signature and before an attestation; types of nodes that are never merged.
SIGNATURE, ATTESTATION_MARK = "[SIGNED]\n[ILLEGIBLE_SIGNATURE]", "[E-SIGNED]"
UNMERGED = ("logo", "attestation", "figure", "scan_code")
#: Least score of a table candidate, characters of one batch of evidence, place of blocks without an order.
TABLE_SCORE, BATCH_CHARACTERS, NO_ORDER = 0.5, 80_000, 1_000_000


def table_blocks(tables: DataFrame, blocks: DataFrame, primary: DataFrame) -> DataFrame:
    """(doc_id, page, table_id, block_id, scope): the blocks whose primary region is the table's, or, if a table has none,
    those with their centre in its box; besides them, as "adjacent", those with it in the window but not in the box.
    ``tables``: region_id, box, window; ``primary``: (doc_id, page, block_id, region_id)."""
    t = tables.select(*PAGE, "table_id", F.col("region_id").alias("t_region"), F.col("box").alias("t_box"), "window")
    b = blocks.select(*PAGE, "block_id", "box").join(primary.select(*PAGE, "block_id", "region_id"), [*PAGE, "block_id"], "left")
    no = F.lit(False)
    x = t.join(b, list(PAGE)).withColumns({
        "linked": F.coalesce(F.col("region_id") == F.col("t_region"), no), "inside": F.coalesce(g.centre_inside(F.col("box"), F.col("t_box")), no), "near": F.coalesce(g.centre_inside(F.col("box"), F.col("window")), no),
    })
    any_linked = F.bool_or("linked").over(Window.partitionBy(*PAGE, "table_id"))
    x = x.withColumn("own", F.when(any_linked, F.col("linked")).otherwise(F.col("inside")))
    return x.where("own or (near and not inside)").select(*PAGE, "table_id", "block_id", F.when(F.col("own"), "own").otherwise("adjacent").alias("scope"))


def tables_with_cells_inside(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Per table whether all its cells lie in its box, give or take one pixel (of ``width`` and ``height``)."""
    c = cells.select(*PAGE, "table_id", F.col("box").alias("c_box"))
    i, o, dx, dy = F.col("c_box"), F.col("box"), 1 / F.col("width"), 1 / F.col("height")
    inside = (i["l"] >= o["l"] - dx) & (i["t"] >= o["t"] - dy) & (i["r"] <= o["r"] + dx) & (i["b"] <= o["b"] + dy)
    x = tables.join(c, [*PAGE, "table_id"], "left")
    return x.groupBy(*PAGE, "table_id").agg(F.count("c_box").alias("n_cells"), F.coalesce(F.bool_and(inside), F.lit(True)).alias("ok"))


def table_candidates(regions: DataFrame) -> DataFrame:
    """Regions labelled as tables, with selected: the score is at least 0.5."""
    return regions.where("lower(label) = 'table'").withColumn("selected", F.coalesce(F.col("score") >= TABLE_SCORE, F.lit(False)))


def candidate_counts(candidates: DataFrame) -> DataFrame:
    """Per document how many candidates there are, on which pages, and on which pages all were skipped."""
    page = candidates.groupBy(*PAGE).agg(F.count("*").alias("n"), F.bool_or("selected").alias("any"))
    pages = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("page")))), ",")
    return page.groupBy("doc_id").agg(F.sum("n").alias("n_candidates"), pages(F.lit(True)).alias("candidate_pages"), pages(~F.col("any")).alias("skipped_pages"))


def accepted_tables(tables: DataFrame, audits: DataFrame) -> DataFrame:
    """Tables that are valid and need no review and, in documents with audits, were accepted by one."""
    audited = audits.groupBy("doc_id").agg(F.lit(True).alias("audited"))
    accepted = audits.where("status = 'accepted' and table_id is not null").select("doc_id", "table_id").distinct().withColumn("accepted", F.lit(True))
    x = tables.where("status = 'valid' and not review_required").join(audited, "doc_id", "left").join(accepted, ["doc_id", "table_id"], "left")
    return x.where("audited is null or accepted").drop("audited", "accepted")


def refreshed_cells(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, table_id, cell_id, source_text): the present texts of a cell's source blocks in the order of its list, stripped,
    one space between two; blank and unknown ones are passed over."""
    key = ["doc_id", "table_id", "cell_id"]
    each = cells.select(*key, F.posexplode_outer("source_block_ids").alias("at", "block_id"))
    text = strip(F.col("text"))
    x = each.join(blocks.select("doc_id", "block_id", "text"), ["doc_id", "block_id"], "left")
    parts = F.array_sort(F.collect_list(F.when(text != "", F.struct("at", text.alias("text")))))
    return x.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("source_text"))


def table_counts(cells: DataFrame) -> DataFrame:
    """Per page the tables and their cells."""
    return cells.groupBy(*PAGE).agg(F.count_distinct("table_id").alias("n_tables"), F.count("*").alias("n_cells"))


def semantic_types(members: DataFrame) -> DataFrame:
    """Per group its type: the preferred one if it is not text; attestation for a signature's mark in a text; marginalia, logo or
    attestation by the labels of its blocks' regions; else text. ``members``: group_id, preferred, text, label."""
    label = F.lower("label")
    mark = F.greatest(*[F.contains(F.upper("text"), F.lit(m)) for m in SIGNED])
    seal = F.greatest(*[F.contains(label, F.lit(m)) for m in SEALS])
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    kind = (
        F.when(F.max("preferred").isin(*SEMANTIC), F.max("preferred")).when(some(mark), "attestation").when(some(label.isin(*MARGINAL)), "marginalia")
        .when(some(F.contains(label, F.lit("logo"))), "logo").when(some(seal), "attestation").otherwise("text")
    )
    return members.groupBy(*PAGE, "group_id").agg(kind.alias("type"))


def semantic_groups(blocks: DataFrame, primary: DataFrame, chunk: str) -> DataFrame:
    """Every block once in a group of its page: that of its primary region, else of its chunk, else its own; the latter two are
    numbered as fallbacks, chunks first. Groups stand in the order of their first blocks (reading_order)."""
    x = blocks.join(primary.select(*PAGE, "block_id", "region_id"), [*PAGE, "block_id"], "left")
    kind = F.when(F.col("region_id").isNotNull(), 0).when(F.col(chunk).isNotNull(), 1).otherwise(2)
    key = F.when(kind == 0, F.col("region_id")).when(kind == 1, F.col(chunk).cast("string")).otherwise(F.col("block_id"))
    groups = x.groupBy(*PAGE, kind.alias("kind"), key.alias("key")).agg(F.min("ord").alias("first"), F.min(F.when(kind == 1, F.col(chunk))).alias("chunk"), F.count("*").alias("n_blocks"))
    number = F.row_number().over(Window.partitionBy(*PAGE, F.col("kind") == 0).orderBy("kind", "chunk", "first"))
    name = F.when(F.col("kind") == 0, F.col("key")).otherwise(F.concat(F.lit("p"), "page", F.lit("-sr-fallback-"), number))
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("first"))
    return groups.select(*PAGE, name.alias("group_id"), order.alias("reading_order"), "n_blocks")


def signature_attestations(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page, block_id, attestation_id): per block of low score with its centre in an image region, the attestation line
    that ends nearest above it (by -0.005 to 0.05), with left edges at most 0.08 apart; of equals the earlier one."""
    image = regions.where("lower(label) = 'image'").select(*PAGE, F.col("box").alias("r_box"))
    low = blocks.where((F.col("score") < LOW_CONFIDENCE) & F.col("box").isNotNull())
    low = low.join(image, list(PAGE)).where(g.centre_inside(F.col("box"), F.col("r_box"))).select(*PAGE, "block_id", "box").distinct()
    lines = blocks.where(F.col("box").isNotNull() & strip(F.col("text")).rlike(ATTESTED)).select(*PAGE, F.col("block_id").alias("attestation_id"), F.col("ord").alias("a_ord"), F.col("box").alias("a_box"))
    gap = F.col("box.t") - F.col("a_box.b")
    x = low.join(lines, list(PAGE)).where((gap >= -0.005) & (gap <= 0.05) & (F.abs(F.col("box.l") - F.col("a_box.l")) <= 0.08))
    return x.groupBy(*PAGE, "block_id").agg(F.min_by("attestation_id", F.struct(F.abs(gap), "a_ord")).alias("attestation_id"))


def with_redactions(blocks: DataFrame, redactions: DataFrame) -> DataFrame:
    """(doc_id, page, pos, block_id, text): a block [REDACTED] after the label block it names, those without one (or with one
    that the page lacks) at the end. ``redactions``: redaction_id, red_ord, label_block_id. Later ones stand nearer to their label."""
    b = blocks.select(*PAGE, "block_id", "ord", "text")
    r = redactions.join(b.select(*PAGE, F.col("block_id").alias("label_block_id"), F.col("ord").alias("at")), [*PAGE, "label_block_id"], "left")
    added = r.select(*PAGE, F.col("redaction_id").alias("block_id"), F.col("at").alias("ord"), F.when(F.col("at").isNotNull(), -F.col("red_ord")).otherwise(F.col("red_ord")).alias("turn"), F.lit("[REDACTED]").alias("text"), F.lit(1).alias("added"))
    whole = b.withColumns({"turn": F.lit(None), "added": F.lit(0)}).unionByName(added)
    pos = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.col("ord").isNull(), "ord", "added", "turn", "block_id"))
    return whole.select(*PAGE, pos.alias("pos"), "block_id", "text")


def ordered_first(blocks: DataFrame, wanted: Column) -> DataFrame:
    """``blocks`` with pos: those with a wanted place by it, all others behind in their order, numbered 1..n per page."""
    return blocks.withColumn("pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.coalesce(wanted, F.lit(NO_ORDER)), "ord")))


def chunk_order(members: DataFrame) -> DataFrame:
    """Chunks of a page by the place of their first known block, unknown ones last in their order; numbered and named anew.
    ``members``: chunk_id, chunk_ord, ord (null for an unknown block)."""
    c = members.groupBy(*PAGE, "chunk_id").agg(F.min("ord").alias("first"), F.min("chunk_ord").alias("chunk_ord"))
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.col("first").asc_nulls_last(), "chunk_ord"))
    return c.select(*PAGE, "chunk_id", n.alias("reading_order"), F.concat(F.lit("p"), "page", F.lit("-c"), n).alias("new_id"))


def first_chunks(members: DataFrame) -> DataFrame:
    """Per block the first of the chunks that hold it."""
    return members.groupBy(*PAGE, "block_id").agg(F.min_by("chunk_id", "chunk_ord").alias("chunk_id"))


def page_batches(pages: DataFrame, limit: int = BATCH_CHARACTERS) -> DataFrame:
    """(doc_id, page, kind, batch): pages in order fill a batch until the next would pass ``limit`` characters; a larger page stands
    alone, none is cut. Pages with full context come after, each by itself. ``pages``: size, is_full."""
    rows = F.array_sort(F.collect_list(F.when(~F.col("is_full"), F.struct("page", "size"))))
    none = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<page:int,batch:int>>").alias("out"))

    def put(a: Column, p: Column) -> Column:
        new = (a["batch"] == 0) | (a["used"] + p["size"] > limit)
        batch = a["batch"] + new.cast("int")
        return F.struct(batch.alias("batch"), (F.when(new, F.lit(0)).otherwise(a["used"]) + p["size"]).cast("bigint").alias("used"), F.concat(a["out"], F.array(F.struct(p["page"].alias("page"), batch.alias("batch")))).alias("out"))

    folded = pages.groupBy("doc_id").agg(F.aggregate(rows, none, put).alias("x"))
    compact = folded.select("doc_id", "x.batch", F.explode("x.out").alias("o")).select("doc_id", "o.page", F.lit("compact").alias("kind"), "o.batch")
    full = pages.where("is_full").join(folded.select("doc_id", F.col("x.batch").alias("before")), "doc_id")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return compact.unionByName(full.select("doc_id", "page", F.lit("full").alias("kind"), (F.col("before") + n).alias("batch")))


def valid_ranges(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """``ranges`` with ok: start is not behind end and both are known pages (those between are not looked at)."""
    p = pages.select("doc_id", "page").distinct()
    known = lambda x, c: x.join(p.select("doc_id", F.col("page").alias(c), F.lit(True).alias(f"{c}_known")), ["doc_id", c], "left")
    x = known(known(ranges, "start_page"), "end_page")
    ok = (F.col("start_page") <= F.col("end_page")) & F.col("start_page_known").isNotNull() & F.col("end_page_known").isNotNull()
    return x.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("start_page_known", "end_page_known")


def spans_valid(nodes: DataFrame, length: str) -> DataFrame:
    """Per document whether 0 <= start <= end <= length for all its grounded nodes; one without a span is not valid."""
    ok = (F.col("start_at") >= 0) & (F.col("start_at") <= F.col("end_at")) & (F.col("end_at") <= F.col(length))
    return nodes.groupBy("doc_id").agg(F.coalesce(F.bool_and(F.when(F.col("grounded"), F.coalesce(ok, F.lit(False)))), F.lit(True)).alias("ok"))


def visual_problems(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """Visual objects that need a review: not rejected, and on an unknown page, with a repeated id or with blocks that the page lacks
    ("invalid"), or pending. ``items``: item_id, status, source_block_ids."""
    page = blocks.groupBy(*PAGE).agg(F.collect_set("block_id").alias("known"))
    x = items.withColumn("copies", F.count("*").over(Window.partitionBy("doc_id", "item_id"))).join(page, list(PAGE), "left")
    invalid = F.col("known").isNull() | (F.col("copies") > 1) | (F.size(F.array_except("source_block_ids", "known")) > 0)
    x = x.withColumn("problem", F.when(invalid, "invalid").when(F.col("status") == "pending", "pending"))
    return x.where("status <> 'rejected' and problem is not null").select(*PAGE, "item_id", "problem")


def visual_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per object its status: verified if there is exactly one decision on it, supported, with the same transcription (stripped)."""
    d = decisions.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.bool_and("supported").alias("supported"), F.max("transcription").alias("transcription"))
    x = items.join(d, ["doc_id", "item_id"], "left")
    ok = (F.col("n") == 1) & F.col("supported") & (strip(F.col("transcription")) == strip(F.col("content")))
    return x.select("doc_id", "item_id", F.when(F.coalesce(ok, F.lit(False)), "model_verified").otherwise("pending").alias("status"))


def inspected_pages(items: DataFrame, first: int = 16) -> DataFrame:
    """Pages that the first objects of each document lie on."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return items.withColumn("n", n).where(F.col("n") <= first).select(*PAGE).distinct()


def answers_shown(answers: DataFrame) -> DataFrame:
    """``answers`` with shown: grounded if all cited excerpts were supplied and, when "answered", there is a text and a citation;
    otherwise blank."""
    known = F.size(F.array_except("cited", "supplied")) == 0
    said = (F.col("disposition") != "answered") | ((strip(F.col("answer")) != "") & (F.size("cited") > 0))
    return answers.withColumn("shown", F.when(F.coalesce(known & said, F.lit(False)), F.col("answer")).otherwise(""))


def retried_pages(attempts: DataFrame) -> DataFrame:
    """Per page its status after at most one retry, and how many attempts are kept. ``attempts``: attempt (1, 2), ok."""
    a = attempts.where("attempt <= 2").groupBy(*PAGE).agg(F.bool_or(F.when(F.col("attempt") == 1, F.col("ok"))).alias("one"), F.bool_or(F.when(F.col("attempt") == 2, F.col("ok"))).alias("two"), F.count("*").alias("n_attempts"))
    return a.select(*PAGE, F.when(F.col("one"), "completed").when(F.col("two"), "completed_after_retry").otherwise("failed").alias("status"), "n_attempts")


def warning_counts(warnings: DataFrame, by: str) -> DataFrame:
    """Each group's distinct warnings in the order first seen, with how often they come."""
    x = warnings.groupBy(by, "warning").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    return x.select(by, F.row_number().over(Window.partitionBy(by).orderBy("seq")).alias("place"), "warning", "n")


def ocr_rollup(pages: DataFrame, by: str) -> DataFrame:
    """Per run the seconds of pages read anew and their share of the wall time, cache hits and misses, and seconds avoided.
    ``pages``: millis, hit, wall_millis."""
    missed = F.coalesce(F.sum(F.when(~F.col("hit"), F.col("millis"))), F.lit(0))
    avoided = F.coalesce(F.sum(F.when(F.col("hit"), F.col("millis"))), F.lit(0))
    wall = F.max("wall_millis")
    return pages.groupBy(by).agg(
        missed.alias("ocr_millis"), F.when(wall > 0, F.round(missed / wall, 3)).otherwise(0.0).alias("concurrency_ratio"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), avoided.alias("avoided_millis")
    )


def within_pixel_cap(pages: DataFrame, cap: int) -> DataFrame:
    """``pages`` with ok: the product of width and height is at most ``cap``."""
    return pages.withColumn("ok", F.coalesce(F.col("width").cast("bigint") * F.col("height") <= cap, F.lit(False)))


def words_of_blocks(raw: DataFrame) -> DataFrame:
    """Words of blocks with their boxes; entries without a readable box or score are passed over.
    ``raw``: words, an array of (text, score string, polygon), and the page's width and height."""
    x = raw.select(*PAGE, "block_id", "width", "height", F.posexplode("words").alias("at", "w"))
    box = g.raw_box(F.col("w.polygon"))
    x = x.select(*PAGE, "block_id", F.concat("block_id", F.lit("-w"), F.col("at") + 1).alias("word_id"), F.col("w.text").alias("text"), F.col("w.score").try_cast("double").alias("score"), box.alias("px"), "width", "height")
    x = x.where("score is not null and px is not null and width > 0 and height > 0")
    b = F.col("px")
    return x.withColumn("box", g.box(b["l"] / F.col("width"), b["t"] / F.col("height"), b["r"] / F.col("width"), b["b"] / F.col("height"))).drop("px", "width", "height")


def page_nodes(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, page, type, region_id, start_at, end_at): where the chunks of a page lie in its ``body``, in code points. A chunk is
    looked for behind the one before, else anywhere in the body; one that is not there is dropped. Neighbours of one region and
    type become one node. A page without nodes is one text node if it has a text. ``chunks``: chunk_ord, type, region_id, markdown.
    """
    parts = F.array_sort(F.collect_list(F.struct("chunk_ord", "type", "region_id", strip(F.col("markdown")).alias("value"))))
    x = pages.join(chunks.groupBy(*PAGE).agg(parts.alias("parts")), list(PAGE), "left")
    node = "struct<start_at:int,end_at:int,type:string,region_id:string>"
    none = F.struct(F.lit(0).alias("cursor"), F.array().cast(f"array<{node}>").alias("out"))

    def place(a: Column, c: Column) -> Column:
        behind = F.position(c["value"], F.col("body"), a["cursor"] + 1)
        at = F.when(c["value"] != "", F.when(behind > 0, behind).otherwise(F.position(c["value"], F.col("body")))).otherwise(0) - 1
        last = F.try_element_at(a["out"], F.lit(-1))
        end = at + F.length(c["value"])
        joins = F.coalesce((last["region_id"] == c["region_id"]) & (last["type"] == c["type"]) & ~c["type"].isin(*UNMERGED), F.lit(False))
        new = F.struct(F.when(joins, last["start_at"]).otherwise(at).alias("start_at"), end.alias("end_at"), c["type"].alias("type"), c["region_id"].alias("region_id"))
        before = F.when(joins, F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0)))).otherwise(a["out"])
        return F.when(at >= 0, F.struct(end.alias("cursor"), F.concat(before, F.array(new)).alias("out"))).otherwise(a)

    found = F.aggregate(F.coalesce("parts", F.array().cast("array<struct<chunk_ord:bigint,type:string,region_id:string,value:string>>")), none, place)["out"]
    whole = F.array(F.struct(F.lit(0).alias("start_at"), F.length("body").alias("end_at"), F.lit("text").alias("type"), F.lit(None).cast("string").alias("region_id")))
    nodes = x.withColumn("found", found).select(*PAGE, F.explode(F.when(F.size("found") > 0, F.col("found")).when(F.length("body") > 0, whole)).alias("n"))
    return nodes.select(*PAGE, "n.type", "n.region_id", "n.start_at", "n.end_at")


def table_reviews(tables: DataFrame, reviews: DataFrame) -> DataFrame:
    """(doc_id, table_id, status): what becomes of a table by its review. None, several, or one for another page leave it unresolved.
    ``tables``: page, status, n_cells; ``reviews``: page, outcome, visible_cells, n_cells, and for corrected grids applied (it is the
    present grid), grounded (all its cells are) and one_row (a row of few cells over many blocks)."""
    r = reviews.groupBy("doc_id", "table_id").agg(F.count("*").alias("n_reviews"), F.first(F.struct("page", "outcome", "visible_cells", "n_cells", "applied", "grounded", "one_row")).alias("r"))
    x = tables.join(r, ["doc_id", "table_id"], "left")
    one = (F.col("n_reviews") == 1) & (F.col("r.page") == F.col("page"))
    bare, corrected = F.col("r.n_cells") == 0, F.col("r.outcome") == "corrected"
    confirmed = (F.col("r.outcome") == "confirmed") & (F.col("status") == "valid") & bare & (F.col("r.visible_cells") == F.col("n_cells"))
    refused = (F.col("r.outcome") == "not_table") & (F.col("r.visible_cells") == 0) & bare
    status = (
        F.when(one & confirmed, "accepted").when(one & refused, "rejected").when(one & corrected & F.col("r.applied"), "accepted")
        .when(one & corrected & F.col("r.grounded"), F.when(F.col("r.one_row"), "rejected").otherwise("accepted")).otherwise("unresolved")
    )
    return x.select("doc_id", "table_id", status.alias("status"))


def signature_texts(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """``blocks`` with shown: marks for the text of a signature, a mark once before the attestation that belongs to one.
    ``found``: as signature_attestations gives them."""
    signed = found.select(*PAGE, "block_id").distinct().withColumn("signed", F.lit(True))
    attested = found.select(*PAGE, F.col("attestation_id").alias("block_id")).distinct().withColumn("attested", F.lit(True))
    x = blocks.join(signed, [*PAGE, "block_id"], "left").join(attested, [*PAGE, "block_id"], "left")
    text = F.when(F.col("signed"), SIGNATURE).otherwise(F.col("text"))
    marked = F.when(F.startswith(text, F.lit(ATTESTATION_MARK)), text).otherwise(F.concat(F.lit(ATTESTATION_MARK + "\n"), text))
    return x.withColumn("shown", F.when(F.col("attested"), marked).otherwise(text)).drop("signed", "attested")


def markdown_of_pages(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, selected): the parts of a document's ``markdown`` that the pages' spans name, in page order, an empty line between
    two; spans that are not in the text are passed over. The spans are gathered, the text is not shuffled by page."""
    s = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "start_at", "end_at"))).alias("spans"))
    x = documents.join(s, "doc_id", "left")
    n = F.length("markdown")
    held = F.filter("spans", lambda p: (p["start_at"] >= 0) & (p["start_at"] <= p["end_at"]) & (p["end_at"] <= n))
    parts = F.transform(held, lambda p: F.substr(F.col("markdown"), p["start_at"] + 1, p["end_at"] - p["start_at"]))
    return x.select("doc_id", F.coalesce(F.array_join(parts, "\n\n"), F.lit("")).alias("selected"))


def corrected_fields(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """``fields`` (doc_id, path, value) with shown and action: the last correction with a reason wins, "accept" if it names the
    recorded value; the recorded value stays. ``corrections``: path, seq, value, reason."""
    last = corrections.where(strip(F.col("reason")) != "").groupBy("doc_id", "path").agg(F.max_by(F.struct("value"), "seq").alias("c"), F.count("*").alias("n_corrections"))
    x = fields.join(last, ["doc_id", "path"], "left")
    action = F.when(F.col("c").isNotNull(), F.when(F.col("c.value").eqNullSafe(F.col("value")), "accept").otherwise("correct"))
    return x.select("doc_id", "path", "value", F.when(F.col("c").isNotNull(), F.col("c.value")).otherwise(F.col("value")).alias("shown"), action.alias("action"), F.coalesce("n_corrections", F.lit(0)).alias("n_corrections"))


def event_log(events: DataFrame, by: str) -> DataFrame:
    """``events`` (seq, state, millis) with elapsed (all up to it) and entered: the state is another than before."""
    w = Window.partitionBy(by).orderBy("seq")
    return events.withColumns({"elapsed": F.sum("millis").over(w), "entered": ~F.lag("state").over(w).eqNullSafe(F.col("state"))})


def evidence_metrics(blocks: DataFrame, full: DataFrame) -> DataFrame:
    """Per document the blocks and characters of its evidence and its pages, those in full context (``full``) and the others."""
    page = blocks.groupBy(*PAGE).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).join(full.select(*PAGE).distinct().withColumn("full", F.lit(True)), list(PAGE), "left")
    pages = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("page")))), ",")
    whole = F.coalesce("full", F.lit(False))
    return page.groupBy("doc_id").agg(F.sum("n").alias("n_blocks"), F.sum("chars").alias("n_chars"), pages(whole).alias("full_pages"), pages(~whole).alias("compact_pages"))


def for_targets(proposals: DataFrame, targets: DataFrame, *key: str) -> DataFrame:
    """The earlier proposals on targeted objects or pages."""
    return proposals.join(targets.select(*key).distinct(), list(key), "left_semi")


def checkbox_risks(candidates: DataFrame) -> DataFrame:
    """(doc_id, page, control_id, risks): reasons in fixed order against a checkbox. ``candidates``: box, label_box, state, reviewed
    (its page was looked at), the page's width and height and its flags blur, contrast, shadow, compression, edges."""
    b, known = F.col("box"), F.col("width").isNotNull()
    ok = F.col("reviewed") & g.valid(b)
    h = (b["b"] - b["t"]) * F.col("height")
    aspect = F.when(h != 0, (b["r"] - b["l"]) * F.col("width") / h).otherwise(0.0)
    rules = [
        ("invalid or unreviewed visual geometry", ~ok), ("control geometry is not checkbox-shaped", ok & known & ~aspect.between(0.5, 2)), ("label geometry is invalid", F.col("label_box").isNotNull() & ~g.valid(F.col("label_box"))),
    ]
    state = F.when(~F.coalesce(F.col("state").isin("CHECKED", "UNCHECKED"), F.lit(False)), F.concat(F.lit("state is "), F.coalesce("state", F.lit("None"))))
    flags = [("blur", "blur"), ("contrast", "low contrast"), ("shadow", "shadows"), ("compression", "compression artifacts"), ("edges", "cropped edges")]
    reason = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    return candidates.select(*PAGE, "control_id", F.concat_ws("; ", *[reason(c, name) for name, c in rules], state, *[reason(F.col(c), name) for c, name in flags]).alias("risks"))
