"""Entries of a bundle and the check of its tables, by hand."""

import json

from lectern.operators import bundles as B


def test_entries_of_documents(spark):
    docs = spark.createDataFrame([(1, "# x"), (2, None)], "doc_id int, markdown string")
    manifests = spark.createDataFrame([(1, "ACCEPTED", None), (2, "FAILED", [3])], "doc_id int, state string, failed_pages array<int>")
    blocks = spark.createDataFrame([(1, 2, 2, 'b "q"', None), (1, 1, 1, "a", 0.5)], "doc_id int, page int, ord int, text string, score double")
    fields = spark.createDataFrame([(1, "z", "1"), (1, "a", "é"), (1, "a", "b")], "doc_id int, path string, value string")
    splits = spark.createDataFrame([(1, 7, "A/B c", 1, 2), (1, 3, "??", 2, 2), (1, 9, None, 8, 9)], "doc_id int, split_ord int, label string, start_page int, end_page int")
    bodies = spark.createDataFrame([(1, 1, "one"), (1, 2, "two")], "doc_id int, page int, body string")
    got = {(r.doc_id, r.name): r.content for r in B.bundle_contents(docs, manifests, blocks, fields, splits, bodies).collect()}
    assert set(got) == {(1, n) for n in ("document.md", "metadata.json", "blocks.jsonl", "extraction.json", "splits/01-document.md", "splits/02-A-B-c.md")} | {(2, "document.md"), (2, "metadata.json")}
    assert [json.loads(x) for x in got[1, "blocks.jsonl"].split("\n")] == [{"page": 1, "ord": 1, "text": "a", "score": 0.5}, {"page": 2, "ord": 2, "text": 'b "q"', "score": None}]
    assert json.loads(got[1, "metadata.json"]) == {"state": "ACCEPTED", "failed_pages": None} and json.loads(got[1, "extraction.json"]) == {"a": "é", "z": "1"}
    assert got[1, "splits/02-A-B-c.md"] == "one\n\n<!-- PAGE BREAK -->\n\ntwo" and got[1, "splits/01-document.md"] == "two"
    sizes = {(r.doc_id, r.name): (r.bytes, r.generated) for r in B.bundle_entries(B.bundle_contents(docs, manifests, blocks, fields, splits, bodies)).collect()}
    assert sizes[1, "document.md"] == (3, True) and sizes[2, "document.md"] == (None, False)


def test_tables_are_counted(spark):
    accepted = spark.createDataFrame([(1, 1, "<t>"), (1, 1, "<t>"), (1, 2, "<u>"), (2, 1, "<t>"), (3, 9, "<t>")], "doc_id int, page int, markup string")
    texts = spark.createDataFrame([(1, 1, "<t> <t> <t>"), (1, 2, "none"), (2, 1, "<t>"), (3, 1, "<t>")], "doc_id int, page int, text string")
    assert {(r.doc_id, r.expected, r.exported, r.complete) for r in B.bundle_check(accepted, texts).collect()} == {(1, 3, 2, False), (2, 1, 1, True), (3, 1, 0, False)}
