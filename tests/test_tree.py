"""The published tree, review regions and claims against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import claims as C
from lectern.operators import review as R
from lectern.operators import tree as T
from lectern.plans import tree_queries

BOX = "struct<l:double,t:double,r:double,b:double>"
CHUNKS = f"doc_id int, page int, chunk_ord int, chunk_id string, type string, region_id string, markdown string, box {BOX}, block_ids array<string>, table_id string"


def box(*v):
    return tuple(map(float, v))


@pytest.fixture(scope="module")
def tree(spark):
    pages = spark.createDataFrame([(1, 1, "Head\n\nbody one\n\nbody two\n\n<table><tr><th>A&amp;B</th><th>7</th></tr></table>", "completed"), (1, 2, "lost", "failed"), (1, 3, "", "completed"), (2, 1, "x", "completed")], "doc_id int, page int, body string, status string")
    b1, b2 = box(0, 0, 0.5, 0.1), box(0, 0.2, 0.5, 0.3)
    chunks = [
        (1, 1, 1, "c1", "marginalia", "r1", " Head ", b1, ["b0"], None), (1, 1, 2, "c2", "text", "r2", "body one", b1, ["b1"], None), (1, 1, 3, "c3", "odd", "r2", "body two", b2, ["b2", "gone"], None),
        (1, 1, 4, "c4", "text", None, "<table><tr><th>A&amp;B</th><th>7</th></tr></table>", None, ["b3"], "t1"), (1, 1, 5, "c5", "text", None, "nowhere", b1, ["b1"], None), (1, 2, 1, "d1", "text", "r", "other", b1, ["b1"], None), (9, 9, 1, "z", "text", None, "x", b1, [], None),
    ]
    tables = spark.createDataFrame([(1, 1, "t1", box(0, 0.5, 1, 0.9))], f"doc_id int, page int, table_id string, box {BOX}")
    cells = spark.createDataFrame([(1, 1, "t1", 1, 2, 1, 2, "7", None, ["b3", "gone"]), (1, 1, "t1", 1, 1, 1, 1, " A&B ", box(0, 0.5, 0.5, 0.6), [])], f"doc_id int, page int, table_id string, row int, col int, row_span int, column_span int, source_text string, box {BOX}, block_ids array<string>")
    blocks = spark.createDataFrame([(1, 1, "b0", "Head", None), (1, 1, "b1", "one", b1), (1, 1, "b2", "two!", b2), (1, 1, "b3", "7", box(0.5, 0.5, 1, 0.6))], f"doc_id int, page int, block_id string, text string, box {BOX}")
    return T.trees(pages, spark.createDataFrame(chunks, CHUNKS), tables, cells, blocks)


def test_a_tree_by_hand(tree):
    got = {r.doc_id: json.loads(r.j) for r in T.public(tree).select("doc_id", F.to_json("structure").alias("j")).collect()}
    page, lost, empty = got[1]["children"]
    assert [(n["type"], n["id"], n["grounding"]["range"]) for n in page["children"]] == [("marginalia", "marginalia-0", {"start": 0, "end": 4}), ("text", "text-0", {"start": 6, "end": 24}), ("table", "table-0", {"start": 26, "end": 76})]
    head, merged, table = page["children"]
    assert head["source_id"] == "c1" and head["atomic_grounding"] == [head["grounding"]]
    assert merged["grounding"]["box"] == {"xmin": 0.0, "ymin": 0.0, "xmax": 0.5, "ymax": 0.3} and "source_id" not in merged
    assert [a["range"] for a in merged["atomic_grounding"]] == [{"start": 11, "end": 14}, {"start": 6, "end": 24}]
    assert [(c["id"], c["row"], c["col"], c["colspan"], c["grounding"]["range"], c["grounding"]["box"]["xmax"]) for c in table["children"]] == [("table_cell-0", 0, 0, 1, {"start": 41, "end": 48}, 0.5), ("table_cell-1", 0, 1, 2, {"start": 57, "end": 58}, 1.0)]
    assert table["children"][1]["atomic_grounding"][0]["box"]["xmin"] == 0.5
    start = 76 + len("\n\n<!-- PAGE BREAK -->\n\n")
    assert (lost["status"], lost["children"][0]["id"], lost["grounding"]["range"]) == ("failed", "text-1", {"start": start, "end": start + 4})
    assert empty["children"] == [] and got[2]["children"][0]["children"][0]["type"] == "text"


def test_fields_go_at_any_depth(tree):
    text = T.public(tree, atomic=False).select(F.to_json("structure", {"ignoreNullFields": "false"}).alias("j")).collect()
    assert text and not any(w in r.j for r in text for w in ("atomic_grounding", "_region_id", "_block_ids"))
    assert "children" in text[0].j


def test_the_walk_gives_back_the_rows(spark, tree):
    walked = T.walk(tree)
    assert sorted((r.doc_id, r.depth, r.path, r.type) for r in walked.collect() if r.depth < 2) == [(1, 0, "", "document"), (1, 1, "/0", "page"), (1, 1, "/1", "page"), (1, 1, "/2", "page"), (2, 0, "", "document"), (2, 1, "/0", "page")]
    d = "/root/testdata/sf0.001"
    pages, chunks, tables, cells, blocks = tree_queries._evidence(spark, d)
    bodies = T.placed_bodies(pages)
    held = T.with_texts(T.nodes(bodies, chunks), bodies)
    every = T.semantic_nodes(held, blocks).unionByName(T.table_nodes(held, tables, cells, blocks))
    flat = every.select("doc_id", "node.id", "node.type", "page", "node.grounding.range.start", "node.grounding.range.end")
    inner = every.select("doc_id", "page", F.explode("node.children").alias("c")).select("doc_id", "c.id", "c.type", "page", "c.grounding.range.start", "c.grounding.range.end")
    rows = T.walk(T.trees(pages, chunks, tables, cells, blocks)).where("depth > 1").select(flat.columns)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, flat.unionByName(inner).collect()))


def test_places_with_odd_holders(spark):
    holders = spark.createDataFrame([(1, "aba ab"), (1, "aba ab"), (None, "q"), (3, None)], "k int, text string")
    parts = spark.createDataFrame([(1, 1, "ab"), (1, 2, "ab"), (1, 3, "a"), (1, 4, None), (1, 5, ""), (1, 6, "zz"), (None, 1, "q"), (3, 1, "x"), (4, 1, "x")], "k int, n int, value string")
    again = sorted(map(tuple, T.located(holders, parts, ["k"], ["n"], restart=True).collect()), key=str)
    assert again == sorted([(1, 1, "ab", 0, 2), (1, 2, "ab", 4, 6), (1, 3, "a", 0, 1), (None, 1, "q", 0, 1)], key=str)
    once = {(r.k, r.n): (r.start_at, r.end_at) for r in T.located(holders, parts, ["k"], ["n"], restart=False).collect()}
    assert once == {(1, 1): (0, 2), (1, 2): (4, 6), (1, 3): (None, None), (1, 4): (None, None), (1, 5): (None, None), (1, 6): (None, None), (None, 1): (0, 1)}


def brute_merge(boxes, target):
    """Pairs by plain loops over lists, in the order that the operator states."""
    area = lambda x: max(0, x[2] - x[0]) * max(0, x[3] - x[1])
    both = lambda x, y: (min(x[0], y[0]), min(x[1], y[1]), max(x[2], y[2]), max(x[3], y[3]))
    joins = lambda x, y: max(x[0], y[0]) <= min(x[2], y[2]) and max(x[1], y[1]) <= min(x[3], y[3]) and area(both(x, y)) <= 0.15 and area(both(x, y)) <= (area(x) + area(y)) * 1.5

    def settle(todo):
        done = []
        while todo:
            (now, own), todo = todo[0], todo[1:]
            k = 0
            while k < len(todo):
                if joins(now, todo[k][0]):
                    now, own = both(now, todo[k][0]), own + todo[k][1]
                    todo = todo[:k] + todo[k + 1 :]
                    k = 0
                else:
                    k += 1
            done.append((now, own))
        return done

    now = settle([(b, [i]) for i, b in enumerate(boxes)])
    while len(now) > target:
        near = [(((x[0] + x[2] - y[0] - y[2]) / 2) ** 2 + ((x[1] + x[3] - y[1] - y[3]) / 2) ** 2, i, j) for i, (x, _) in enumerate(now) for j, (y, _) in enumerate(now) if i < j and area(both(x, y)) <= 0.15]
        if not near:
            break
        _, i, j = min(near)
        now = settle([x for k, x in enumerate(now) if k not in (i, j)] + [(both(now[i][0], now[j][0]), now[i][1] + now[j][1])])
    return now


@pytest.mark.parametrize("seed", range(12))
def test_merged_boxes_equal_brute_force(seed):
    rng = random.Random(seed)
    boxes = []
    for _ in range(rng.choice([1, 5, 20, 60, 90])):
        x, y, s = rng.random(), rng.random(), rng.choice([0.01, 0.05, 0.3])
        boxes.append((round(x * (1 - s), 2), round(y * (1 - s), 2), round(x * (1 - s) + s * rng.random(), 2), round(y * (1 - s) + s * rng.random(), 2)))
    got, members = R.merged(np.array(boxes, float), 12)
    want = brute_merge(boxes, 12)
    assert [sorted(m) for m in members] == [sorted(m) for _, m in want]
    assert got.tolist() == [list(b) for b, _ in want]
    assert sorted(i for m in members for i in m) == list(range(len(boxes)))


def test_review_regions_tile_and_keep_sources(spark):
    rows = [(1, 1, 1, box(0, 0, 1, 0.5), ["wide"], ["b1"]), (1, 1, 2, box(0.9, 0.9, 0.95, 0.95), ["low"], ["b2"]), (2, 1, 1, None, ["low"], ["b3"]), (2, 1, 2, box(0, 0, 0.1, 0.1), ["risk"], ["b4"]), (3, 1, 1, box(0.5, 0, 0.4, 1), ["low"], ["b5"])]
    c = spark.createDataFrame(rows, f"doc_id int, page int, cand_ord int, box {BOX}, reasons array<string>, sources array<string>")
    p = spark.createDataFrame([(1, 1, ["skew"])], "doc_id int, page int, reasons array<string>")
    got = {}
    for r in R.review_regions(c, p).orderBy("doc_id", "region_no").collect():
        got.setdefault(r.doc_id, []).append((tuple(r.box), r.reasons, r.sources))
    wide = (["oversized_region_tiled", "skew", "wide"], ["b1"])
    assert got[1] == [((x, 0.0, x + 0.25, 0.5), *wide) for x in (0, 0.25, 0.5, 0.75)] + [((0.9, 0.9, 0.95, 0.95), ["low", "skew"], ["b2"])]
    assert got[2] == [((0.0, 0.0, 1.0, 1.0), ["low", "missing_uncertain_geometry", "risk"], [])] and got[3][0][1] == ["low", "missing_uncertain_geometry"]
    many = spark.range(30_000).select(F.lit(1).alias("doc_id"), (F.col("id") % 3000).cast("int").alias("page"), F.col("id").cast("int").alias("cand_ord"), F.expr("named_struct('l', (id % 10) / 20D, 't', (id % 7) / 10D, 'r', (id % 10) / 20D + 0.04D, 'b', (id % 7) / 10D + 0.04D)").alias("box"), F.array(F.lit("x")).alias("reasons"), F.array(F.col("id").cast("string")).alias("sources"))
    out = R.review_regions(many, p.limit(0))
    assert out.select(F.explode("sources").alias("s")).agg(F.count_distinct("s")).first()[0] == 30_000


PROPOSALS = "doc_id int, page int, proposal_ord int, reading_order int, proposal_id string, type string, block_ids array<string>, region_ids array<string>"


def test_table_claims(spark):
    t = spark.createDataFrame([(1, 1, "t1", "l1", None), (1, 1, "t2", "l2", None), (2, 1, "t3", "l1", None)], f"doc_id int, page int, table_id string, layout_region_id string, box {BOX}")
    held = spark.createDataFrame([(1, 1, "t1", "b1"), (1, 1, "t2", "b9")], "doc_id int, page int, table_id string, block_id string")
    blocks = spark.createDataFrame([(1, 1, f"b{i}", box(0, i / 10, 1, i / 10 + 0.05) if i != 8 else None) for i in range(10)], f"doc_id int, page int, block_id string, box {BOX}")
    p = [("a", ["b1", "b2"], ["l1"]), ("b", ["b3"], ["l1", "zz"]), ("c", ["b2"], []), ("d", ["b4", "b4"], []), ("e", ["b5"], ["l2"]), ("f", ["b9"], []), ("g", ["no"], []), ("h", [], []), ("i", ["b8"], []), ("a", ["b6"], []), ("j", ["b7", "b8"], ["l1"]), ("k", None, None)]
    proposals = spark.createDataFrame([(1, 1, k, k, *x) for k, x in enumerate(p)], "doc_id int, page int, proposal_ord int, reading_order int, proposal_id string, block_ids array<string>, region_ids array<string>")
    got = sorted((r.table_id, r.origin, r.box and r.box.t) for r in C.table_claims(t, held, proposals, blocks).collect())
    assert got == [("a-table", "added", 0.1), ("b-table", "added", 0.3), ("j-table", "added", 0.7), ("t2", "retained", None)]


def partition(spark, proposals):
    blocks = spark.createDataFrame([(1, 1, f"b{i}", i, f" t{i} ", "derived" if i == 6 else None) for i in range(7)], "doc_id int, page int, block_id string, ord int, text string, source string")
    regions = spark.createDataFrame([(1, 1, "l1")], "doc_id int, page int, region_id string")
    fallback = spark.createDataFrame([(1, 1, 1, "c1", "text", ["b0", "b1", "b2"], "T"), (1, 1, 2, "c2", "table", ["b3"], "X")], "doc_id int, page int, chunk_ord int, chunk_id string, type string, block_ids array<string>, text string")
    frame = spark.createDataFrame([(1, 1, k, *x) for k, x in enumerate(proposals)], PROPOSALS)
    faults = [(r.fault, r.proposal_id) for r in C.partition_faults(frame, blocks.where("source is null"), regions).collect()]
    chunks = [(r.chunk_id, r.type, r.block_ids, r.text, r.origin) for r in C.semantic_chunks(frame, blocks, regions, fallback).orderBy("reading_order").collect()]
    return faults, chunks


def test_partitions_hold_whole_or_not_at_all(spark):
    good = [(5, "p", "table", ["b1", "b0"], ["l1"]), (1, "q", "heading", ["b3", "b2"], ["p1-sr-fallback-2"]), (2, "r", "text", ["b3x"], [])]
    assert partition(spark, good[:2]) == ([], [
        ("q", "heading", ["b2"], "t2", "proposed"), ("c2", "table", ["b3"], "X", "table"), ("p", "text", ["b1", "b0"], "t1\nt0", "proposed"),
        ("p1-semantic-fallback-b4", "text", ["b4"], " t4 ", "missing"), ("p1-semantic-fallback-b5", "text", ["b5"], " t5 ", "missing"), ("p1-derived-1", "text", ["b6"], " t6 ", "derived"),
    ])
    fallen = [("c1", "text", ["b0", "b1", "b2"], "T", "fallback"), ("c2", "table", ["b3"], "X", "fallback")]
    cases = {
        ("unknown_or_reused_block", "r"): good, ("unknown_region", "p"): [(5, "p", "text", ["b0"], ["l9"]), (6, "r", "text", ["b0"], [])], ("repeated_block", "p"): [(1, "p", "text", ["b0", "b0"], [])],
        ("unknown_or_reused_block", "q"): [(2, "q", "text", ["b0"], []), (1, "p", "text", ["b0"], [])], ("repeated_id", None): [(1, "p", "text", ["b0"], []), (2, "p", "text", ["b1"], [])], ("unknown_region", "q"): [(1, "q", "text", ["b0"], ["p2-sr-fallback-1"])],
        ("unknown_or_reused_block", "s"): [(1, "s", "text", ["b6"], [])],
    }
    for fault, proposals in cases.items():
        assert partition(spark, proposals) == ([fault], fallen)
