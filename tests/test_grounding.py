"""Gold sets with one fault of each kind, types, audits and places by hand."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import gold as G
from lectern.operators import grounding as E

BOX = "struct<l:double,t:double,r:double,b:double>"
TABLE = {"id": "t1", "page": 1, "bbox": [0.1, 0.1, 0.9, 0.2], "review_status": "human_approved", "semantic_role": "r", "expected_rows": 2, "expected_columns": 2, "expected_cells": 3, "row_cell_counts": [1, 2]}
CHECKBOX = {"id": "c1", "page": 2, "bbox": [0, 0, 0.1, 0.1], "review_status": "human_approved", "group": "g", "label": "x", "state": "checked"}
GOOD = {
    "schema_version": "1.0", "dataset_id": "d", "coordinate_space": "normalized_top_left_xyxy", "source": {"filename": "f", "sha256": "a" * 64, "selected_pages": [1, 2]}, "approval": {"status": "human_approved", "reviewer_name": "Ann", "reviewed_at": "2026-01-02T03:04:05Z"},
    "candidate_provenance": ["p"], "page_summaries": [{"page": 1, "table_count": 9, "checkbox_count": 0}, {"page": 2, "table_count": 0, "checkbox_count": 1}, {"page": 1, "table_count": 1, "checkbox_count": 0}], "tables": [TABLE], "checkboxes": [CHECKBOX],
}


def changed(path, value):
    out = copy.deepcopy(GOOD)
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return out


CASES = [
    (GOOD, set()), (changed(["source", "selected_pages"], [1, 2, 2]), {("repeated_page", "2")}), (changed(["source", "selected_pages"], [1, 2, 3]), {("uncovered_page", "3")}), (changed(["checkboxes", 0, "page"], 3), {("page_not_selected", "c1"), ("checkbox_count", "2")}), (changed(["checkboxes", 0, "id"], "t1"), {("repeated_id", "t1")}),
    (changed(["page_summaries", 2, "table_count"], 0), {("table_count", "1")}), (changed(["page_summaries", 1, "checkbox_count"], 2), {("checkbox_count", "2")}), (changed(["tables", 0, "review_status"], "pending_human_review"), {("unapproved_annotation", "t1")}), (changed(["approval", "reviewer_name"], " "), {("no_reviewer", "approval")}), (changed(["approval", "reviewed_at"], None), {("no_reviewer", "approval")}),
    (changed(["tables", 0, "bbox"], [0.9, 0.1, 0.1, 0.2]), {("invalid_box", "t1")}), (changed(["checkboxes", 0, "bbox"], [0, 0, 2, 0.1]), {("invalid_box", "c1")}), (changed(["tables", 0, "bbox"], [0, 0, 1]), {("invalid_box", "t1")}), (changed(["tables", 0, "row_cell_counts"], [3]), {("row_count_length", "t1"), ("row_count_range", "t1")}), (changed(["tables", 0, "expected_cells"], 4), {("row_count_sum", "t1")}), (changed(["tables", 0, "expected_columns"], 1), {("row_count_range", "t1")}),
    (changed(["schema_version"], "2"), {("invalid_value", "schema_version")}), (changed(["source", "sha256"], "A"), {("invalid_value", "sha256")}), (changed(["checkboxes", 0, "state"], "on"), {("invalid_value", "c1")}), (changed(["candidate_provenance"], []), {("invalid_value", "candidate_provenance")}), (changed(["approval", "status"], "pending_human_review"), {("not_approved", "approval")}),
    (changed(["rejected_checkbox_candidates"], [{"id": "r", "page": 1, "source": "s", "reason": "", "review_status": "human_approved"}]), {("invalid_value", "r")}),
]


def test_each_rule_finds_its_fault(spark):
    x = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in enumerate(CASES)], "k int, j string").select("k", G.parsed_gold(F.col("j")).alias("g")).select("k", "g.*")
    got = {k: set() for k in range(len(CASES))}
    for r in G.gold_faults(x, "k", require_approval=True).collect():
        got[r.k].add((r.rule, r.subject))
    assert got == {k: want for k, (_, want) in enumerate(CASES)}


def test_files_are_read_strictly(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOOD, indent=1))
    assert G.gold_faults(G.read_gold(spark, str(tmp_path)), "dataset_id").count() == 0
    (tmp_path / "b.json").write_text('{"schema_version": ')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        G.read_gold(spark, str(tmp_path)).collect()


def test_types_need_evidence(spark):
    high, low = (0.1, 0.1, 0.5, 0.3), (0.1, 0.1, 0.5, 0.12)
    rows = [
        ("m1", "marginalia", [("x", high, "Header")], None, "marginalia", 1), ("m2", "marginalia", [("x", high, "text")], None, "text", 1), ("l1", "logo", [("x", high, None)], high, "logo", 1), ("l2", "logo", [("x", low, None)], low, "text", 1), ("l3", "logo", [("x", low, "image")], None, "logo", 1), ("l4", "logo", [("x", high, None)], None, "text", 1),
        ("a1", "attestation", [("Electronically", high, None), ("signed", high, None)], None, "attestation", 1), ("a2", "attestation", [("x [signed]", high, None), ("[E-SIGNED]", low, None)], None, "attestation", 2), ("a3", "attestation", [("x", high, None)], None, "text", 1), ("f1", "figure", [("x", high, None)], high, "figure", 1),
        ("f2", "figure", [("x", None, None)], high, "text", 1), ("f3", "scan_code", [("x", high, None)], (0.8, 0.8, 0.9, 0.9), "text", 1), ("t", "table", [], None, "table", 1), ("g", "logo", [], None, "text", 1),
    ]
    p = spark.createDataFrame([(1, 1, r[0], r[1]) for r in rows], "doc_id int, page int, proposal_id string, type string")
    m = spark.createDataFrame([(1, 1, r[0], k, *b) for r in rows for k, b in enumerate(r[2])], f"doc_id int, page int, proposal_id string, ord int, text string, box {BOX}, label string")
    e = spark.createDataFrame([(1, 1, r[0], "visual", r[3]) for r in rows if r[3]] + [(1, 2, "f3", "visual", high), (1, 1, "f3", "ocr", high), (1, 1, "m2", "visual", None)], f"doc_id int, page int, proposal_id string, source string, box {BOX}")
    assert {(r.proposal_id, r.type, r.n_parts) for r in E.validated_types(p, m, e).collect()} == {(r[0], r[4], r[5]) for r in rows}


def test_an_approval_holds_for_one_content(spark):
    fields = ["item_id", "content"]
    old = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", None)], "doc_id int, item_id string, content string")
    told = old.withColumn("digest", E.proposal_digest(*fields))
    audits = told.withColumns({"ord": F.lit(1), "status": F.lit("approved")}).unionByName(told.where("item_id = 'a'").withColumns({"ord": F.lit(2), "status": F.lit("rejected")}))
    now = old.withColumn("content", F.when(F.col("item_id") == "b", "y").otherwise(F.col("content")))
    assert {(r.item_id, r.status, r.shown) for r in E.audited(now, audits, fields).collect()} == {("a", "rejected", "x"), ("b", "pending", "y"), ("c", "approved", None)}
