"""Candidates of two lists, and records that three signals agree on."""

from pyspark.sql import functions as F

from lectern.operators import consensus as C

BOX = "struct<l:double,t:double,r:double,b:double>"
SHAPE = f"doc_id int, page int, ord int, id string, label string, state string, box {BOX}, label_block_id string, confidence double"


def at(x, y=0.1):
    return (x, y, x + 0.1, y + 0.1)


def test_a_box_that_overlaps_only_a_dropped_one_is_kept(spark):
    main = [(1, 1, 1, "a", "x", "CHECKED", at(0.1), "b1", 0.9), (1, 1, 2, "a", "y", "CHECKED", at(0.5), "b1", 0.9), (1, 2, 3, "z", "y", "CHECKED", None, "b1", 0.9)]
    local = [(1, 1, 1, "l1", "x", "CHECKED", at(0.13), "b1", 0.5), (1, 1, 2, "l2", "x", "CHECKED", at(0.16), "b1", 0.5), (1, 1, 3, "l3", "x", "CHECKED", at(0.18), "b1", 0.5), (1, 2, 1, "a", "x", "CHECKED", at(0.1), "b1", 0.5), (1, 2, 2, "l2", "x", "CHECKED", at(0.6), "b1", 0.5), (None, None, 1, "n", "x", "CHECKED", at(0.1), None, None)]
    got = C.joint_candidates(spark.createDataFrame(main, SHAPE), spark.createDataFrame(local, SHAPE)).collect()
    # l1 overlaps a and is dropped; l2 overlaps l1 above the limit, but not a: it stays, and l3 goes for it
    assert sorted((r.page or 0, r.id, r.discovered) for r in got) == [(0, "n", False), (1, "a", True), (1, "l2", False), (2, "a-local", False), (2, "l2-local", False), (2, "z", True)]


def test_records_and_what_speaks_against_them(spark):
    rows = [("good", 0.1, "CHECKED", True, "b1", "x"), ("twin", 0.12, "CHECKED", True, "b1", "x"), ("alone", 0.5, "UNCHECKED", True, "b1", "x"), ("blank", 0.7, "CHECKED", True, None, " "), ("bad id", 0.9, "CHECKED", True, "b1", "x"), ("other", 0.3, "CHECKED", True, "b1", "x"), ("unseen", 0.3, "CHECKED", True, "b1", "x"), ("low", 0.31, "CHECKED", False, "b2", "x")]
    c = spark.createDataFrame([(1, 1, k, i, lab, s, at(x, 0.1 if i != "low" else 0.6), blk, 0.4, d, None, True) for k, (i, x, s, d, blk, lab) in enumerate(rows)], f"doc_id int, page int, pos int, id string, label string, state string, box {BOX}, label_block_id string, confidence double, discovered boolean, given_risks array<string>, label_grounded boolean")
    v = spark.createDataFrame([(1, i, 1, "other" if i == "other" else "checkbox", "CHECKED" if i != "low" else "UNCHECKED", 0.95 if i != "low" else 0.9) for i in ("good", "twin", "alone", "blank", "bad id", "other", "low")], "doc_id int, id string, v_page int, control_status string, v_state string, v_confidence double")
    local = spark.createDataFrame([(1, 1, 1, "p", "loc", "CHECKED", at(0.1), "b1", 0.5), (1, 1, 2, "q", "loc", "CHECKED", at(0.7), "b1", 0.5), (1, 1, 3, "r", "loc", "CHECKED", at(0.31, 0.6), "b2", 0.5)], SHAPE)
    blocks = spark.createDataFrame([(1, 1, "b1", "text", 0.9), (1, 1, "b2", "text", 0.5)], "doc_id int, page int, block_id string, text string, score double")
    got = {r.id: r for r in C.consensus(c, v, local, blocks).collect()}
    assert set(got) == {"good", "twin", "alone", "blank", "low"}
    assert (got["good"].decision, got["good"].agreement, got["good"].confidence, got["good"].risks) == ("automated", "consensus", 0.95, [])
    assert got["twin"].risks == ["overlaps_another"] and got["twin"].agreement == "incomplete" and got["twin"].confidence == 0.4
    assert got["alone"].risks == ["not_found_locally", "verification_disagrees"]
    assert got["blank"].label == "loc" and got["blank"].decision == "automated"
    assert got["low"].risks == ["label_score_low", "not_confirmed", "verification_disagrees"] and got["low"].agreement == "disagreement"


def test_many_boxes_of_one_page(spark):
    x = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("pos"), F.expr("named_struct('l', id / 20000D, 't', 0D, 'r', id / 20000D + 0.0001D, 'b', 1D)").alias("box"), (F.col("id") % 2 == 1).alias("droppable"))
    assert C.overlaps_earlier(x, 0.1).where("overlaps").count() == 10_000
