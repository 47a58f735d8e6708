"""Semantic regions that claim blocks: table candidates in order, and partitions of a page's blocks that hold as a whole or not at all.

Defined cases: proposals without blocks claim nothing; equal places in the order go by
proposal_ord; null ids are unknown blocks; a page without proposals keeps its fallback.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.text import strip
from ..sources.stage import in_turn, written

PAGE = ("doc_id", "page")
#: How a claimed table is named, and its style until its cells are built.
TABLE_SUFFIX, LAYOUT_SUFFIX, STYLE = "-table", "-semantic-table", "wireless"


def first_claims(taken: DataFrame, claims: DataFrame) -> DataFrame:
    """The ``claims`` (doc_id, page, claim_ord, name, block_ids) that hold: in order, each whose name is new and whose blocks are all
    free takes them. ``taken``: name and block_ids of what was there before. The claims of a page pass in order through one
    task, which holds the names and block ids taken on that page."""
    kind = claims.schema
    shape = lambda x, first: x.select(*PAGE, first.alias("claim_ord"), "name", "block_ids")
    rows = shape(taken, F.lit(None).cast(kind["claim_ord"].dataType)).unionByName(shape(claims, F.col("claim_ord")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, names, blocks = None, set(), set()
        for b in batches:
            stay = []
            for i, (doc, p, order, name, ids) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                if (doc, p) != page:
                    page, names, blocks = (doc, p), set(), set()
                if order is not None:
                    if name in names or not blocks.isdisjoint(ids):
                        continue
                    stay.append(i)
                names.add(name)
                blocks.update(ids)
            kept = b.take(pa.array(stay, pa.int64()))
            yield pa.RecordBatch.from_arrays(kept.columns[:4], names=["doc_id", "page", "claim_ord", "name"])

    schema = ", ".join(f"{c} {kind[c].dataType.simpleString()}" for c in (*PAGE, "claim_ord", "name"))
    return in_turn(rows, list(PAGE), F.asc_nulls_first("claim_ord"), "name").mapInArrow(work, schema)


def table_claims(tables: DataFrame, table_blocks: DataFrame, proposals: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, table_id, layout_region_id, box, origin): the tables of a page after its proposals. A table whose region two or more
    proposals cite is given up for them ("split"); the others are "retained", with the blocks of ``table_blocks``. A proposal is
    "added" as a table if its blocks are known, each once, and all free, and it cites no region that another table keeps.
    ``proposals``: proposal_ord, proposal_id, block_ids, region_ids; pages without proposals are left out."""
    p = proposals.withColumn("block_ids", F.coalesce("block_ids", F.array().cast("array<string>")))
    asked = p.select(*PAGE).distinct()
    t = tables.join(asked, list(PAGE), "left_semi")
    known = t.select(*PAGE, F.col("layout_region_id").alias("region_id")).distinct()
    cites = p.select(*PAGE, "proposal_ord", F.explode(F.array_distinct("region_ids")).alias("region_id")).join(known, [*PAGE, "region_id"])
    split = cites.groupBy(*PAGE, "region_id").agg((F.count("*") > 1).alias("split"))
    bound = cites.join(split, [*PAGE, "region_id"]).where("not split").select(*PAGE, "proposal_ord").distinct()
    given_up = split.where("split").select(*PAGE, F.col("region_id").alias("layout_region_id"))
    kept = t.join(given_up, [*PAGE, "layout_region_id"], "left_anti")
    each = p.select(*PAGE, "proposal_ord", F.explode("block_ids").alias("block_id")).join(blocks.select(*PAGE, "block_id", "box", F.lit(True).alias("there")), [*PAGE, "block_id"], "left")
    sound = each.groupBy(*PAGE, "proposal_ord").agg(F.coalesce(F.bool_and(F.coalesce("there", F.lit(False))), F.lit(False)).alias("sound"), g.union_of("box").alias("box"))
    able = p.where((F.size("block_ids") > 0) & (F.size("block_ids") == F.size(F.array_distinct("block_ids")))).join(bound, [*PAGE, "proposal_ord"], "left_anti")
    able = able.join(sound.where("sound and box is not null"), [*PAGE, "proposal_ord"]).withColumn("name", F.concat("proposal_id", F.lit(TABLE_SUFFIX)))
    own = kept.select(*PAGE, F.col("table_id").alias("name")).join(table_blocks.select(*PAGE, F.col("table_id").alias("name"), "block_id"), [*PAGE, "name"], "left")
    taken = own.groupBy(*PAGE, "name").agg(F.collect_set("block_id").alias("block_ids"))
    won = first_claims(taken, able.select(*PAGE, F.col("proposal_ord").alias("claim_ord"), "name", "block_ids"))
    added = won.select(*PAGE, F.col("claim_ord").alias("proposal_ord")).join(able, [*PAGE, "proposal_ord"])
    new = added.select(*PAGE, F.col("name").alias("table_id"), F.concat("proposal_id", F.lit(LAYOUT_SUFFIX)).alias("layout_region_id"), "box", F.lit("added").alias("origin"))
    return kept.select(*PAGE, "table_id", "layout_region_id", "box", F.lit("retained").alias("origin")).unionByName(new)


def partition_faults(proposals: DataFrame, blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page, fault, proposal_id): the first fault of each page whose proposals do not hold together: ids that stand twice; else, in
    reading order, a region that is not there, a block that stands twice in a proposal, one that is unknown or that an earlier one used."""
    ids = proposals.groupBy(*PAGE).agg((F.count("proposal_id") != F.count_distinct("proposal_id")).alias("twice")).where("twice")
    place = F.struct("reading_order", "proposal_ord")
    fault = lambda x, step, name: x.select(*PAGE, F.struct(place.alias("place"), F.lit(step).alias("step"), F.lit(name).alias("fault"), "proposal_id").alias("f"))
    key = ["reading_order", "proposal_ord", "proposal_id"]
    cited = proposals.select(*PAGE, *key, F.explode("region_ids").alias("region_id"))
    fallback = F.col("region_id").rlike(r"^p[0-9]+-sr-fallback-[1-9]\d*$") & F.startswith("region_id", F.concat(F.lit("p"), "page", F.lit("-")))
    strange = cited.where(~F.coalesce(fallback, F.lit(False))).join(regions.select(*PAGE, "region_id"), [*PAGE, "region_id"], "left_anti")
    each = proposals.select(*PAGE, *key, F.posexplode("block_ids").alias("at", "block_id"))
    before = Window.partitionBy(*PAGE, "block_id").orderBy("reading_order", "proposal_ord", "at")
    used = each.withColumns({"nth": F.row_number().over(before), "first": F.first("proposal_ord").over(before)})
    repeated = proposals.where(F.size("block_ids") != F.size(F.array_distinct("block_ids")))
    unknown = each.join(blocks.select(*PAGE, "block_id"), [*PAGE, "block_id"], "left_anti")
    reused = used.where(F.col("first") != F.col("proposal_ord"))
    every = fault(strange, 1, "unknown_region").unionByName(fault(repeated, 2, "repeated_block")).unionByName(fault(unknown, 3, "unknown_or_reused_block")).unionByName(fault(reused, 3, "unknown_or_reused_block"))
    worst = every.groupBy(*PAGE).agg(F.min("f").alias("f")).join(ids, list(PAGE), "left_anti")
    return worst.select(*PAGE, "f.fault", "f.proposal_id").unionByName(ids.select(*PAGE, F.lit("repeated_id").alias("fault"), F.lit(None).cast("string").alias("proposal_id")))


def semantic_chunks(proposals: DataFrame, blocks: DataFrame, regions: DataFrame, fallback: DataFrame) -> DataFrame:
    """(doc_id, page, reading_order, chunk_id, type, block_ids, text, origin): a page's proposals as its chunks ("proposed"), if they hold
    together, with a chunk for each block that none of them names ("missing") and the page's tables again ("table"), whose
    blocks no other chunk has; else, and on pages without proposals, the ``fallback`` chunks. Blocks with a source of their own
    stand behind ("derived"). The pages whose proposals hold are written once. ``blocks``: block_id, ord, text, source (null: read); ``fallback``: chunk_ord, chunk_id, type, block_ids, text."""
    read = blocks.where("source is null")
    faults = partition_faults(proposals, read, regions)
    asked = written(proposals.select(*PAGE).distinct().join(faults, list(PAGE), "left_anti"), "sound-pages")
    p = proposals.join(asked, list(PAGE), "left_semi")
    tables = fallback.where("type = 'table'").join(asked, list(PAGE), "left_semi")
    in_tables = tables.select(*PAGE, F.explode("block_ids").alias("block_id")).distinct()
    each = p.select(*PAGE, "reading_order", "proposal_ord", "proposal_id", "type", F.posexplode("block_ids").alias("at", "block_id"))
    own = each.join(in_tables, [*PAGE, "block_id"], "left_anti")
    kind = F.when(F.col("type") == "table", "text").otherwise(F.col("type"))
    long, key = (lambda c: F.col(c).cast("bigint")), [*PAGE, "place", "stage", "seq", "chunk_id", "type", "origin"]
    made = own.select(*PAGE, long("reading_order").alias("place"), F.lit(0).alias("stage"), long("proposal_ord").alias("seq"), F.col("proposal_id").alias("chunk_id"), kind.alias("type"), F.lit("proposed").alias("origin"), "at", "block_id")
    chunks = made.groupBy(*PAGE).agg(F.count_distinct("seq").alias("n_chunks"))
    n = p.groupBy(*PAGE).agg(F.count("*").alias("n_proposals")).join(chunks, list(PAGE), "left").select(*PAGE, (F.col("n_proposals") + F.coalesce("n_chunks", F.lit(0))).alias("n"))

    def alone(x: DataFrame, before: DataFrame, stage: int, name: str, origin: str) -> DataFrame:
        """A chunk for each block, behind as many as ``before`` counts."""
        x = x.withColumn("seq", F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord")).cast("bigint")).join(before, list(PAGE), "left")
        return x.select(*PAGE, (F.coalesce("n", F.lit(0)) + F.col("seq")).alias("place"), F.lit(stage).alias("stage"), "seq", F.concat(F.lit("p"), "page", F.lit(name), F.col("block_id") if stage == 1 else F.col("seq")).alias("chunk_id"), F.lit("text").alias("type"), F.lit(origin).alias("origin"), F.lit(0).alias("at"), "block_id")

    bare = blocks.select(*PAGE, "block_id", "ord", "source").join(asked, list(PAGE), "left_semi")
    missing = alone(bare.where("source is null").join(each.select(*PAGE, "block_id"), [*PAGE, "block_id"], "left_anti"), n, 1, "-semantic-fallback-", "missing")
    count = lambda x, c: x.groupBy(*PAGE).agg(c.alias("n"))
    so_far = chunks.select(*PAGE, F.col("n_chunks").alias("n")).unionByName(count(missing, F.count("*"))).unionByName(count(tables, F.count("*")))
    derived = alone(bare.where("source is not null"), count(so_far, F.sum("n")), 3, "-derived-", "derived")
    pieces = made.unionByName(missing).unionByName(derived).join(blocks.select(*PAGE, "block_id", "text"), [*PAGE, "block_id"])  # the texts pass here, once
    listed = pieces.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "block_id", "text"))).alias("s"))
    joined = F.array_join(F.transform("s", lambda b: strip(b["text"])), "\n")
    new = listed.select(*key, F.transform("s", lambda b: b["block_id"]).alias("block_ids"), F.when(F.col("stage") == 0, joined).otherwise(F.get("s", 0)["text"]).alias("text"))
    again = tables.select(*PAGE, long("chunk_ord").alias("place"), F.lit(2).alias("stage"), long("chunk_ord").alias("seq"), "chunk_id", "type", F.lit("table").alias("origin"), "block_ids", "text")
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("place", "stage", "seq"))
    new = new.unionByName(again).withColumn("reading_order", order.cast("bigint"))
    old = fallback.join(asked, list(PAGE), "left_anti").withColumns({"reading_order": F.row_number().over(Window.partitionBy(*PAGE).orderBy("chunk_ord")).cast("bigint"), "origin": F.lit("fallback")})
    out = [*PAGE, "reading_order", "chunk_id", "type", "block_ids", "text", "origin"]
    return new.select(*out).unionByName(old.select(*out))
