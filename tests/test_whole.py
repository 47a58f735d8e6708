"""Queries judge all rows: no rows or ends of texts are left out before an operator runs."""

import os

import pytest
from test_oracles import FOLDER, TABLES, rows

from lectern.plans import catalogue
from lectern.sources import adapt

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")

#: Query to a cut in its SQL and what stands there in a copy that makes none. The SQL itself stays as it is.
CUTS = {
    "a08_term_frequencies": (" HAVING count(*) >= 20", ""),
    "f09_quote_grounding": ("b.text[1:40] AS quote", "b.text AS quote"),
    "k08_markup_containment": ("d.text[1:4000]", "d.text"),
    "s14_base64_uploads": ("text[1:50]", "text"),
    "u05_content_ids": ("text[1:3]", "text"),
}


@pytest.mark.parametrize("name", sorted(CUTS))
def test_query_equals_sql_without_its_cut(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(catalogue.ORACLES[name].replace(*CUTS[name])).df()
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_quotes_are_compared_to_their_end(spark, tmp_path):
    start = "the same forty characters and a few more to begin with, "
    spark.createDataFrame([(0, start + "then this"), (1, start + "then that")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, start + "then this"), (1, start + "then this")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalogue.QUERIES["f09_quote_grounding"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.warning for r in got} == {0: None, 1: "quote_mismatch"}


def blocks(spark):
    return adapt.blocks(adapt.table(spark, FOLDER, "documents"))


def test_overlaps_are_judged_in_every_document(spark):
    got = catalogue.QUERIES["u06_first_of_overlapping"](spark, FOLDER)
    pages = blocks(spark).select("doc_id", "page").distinct().collect()
    assert {(r.doc_id, r.page) for r in got.collect()} == {(r.doc_id, r.page) for r in pages}
    assert any(r.doc_id % 3 == 0 for r in pages)


def test_agreement_of_long_lines_and_short(spark, tmp_path):
    long = " ".join(f"word{i} and" for i in range(400))
    spark.createDataFrame([(1, long + "\n\nshort line"), (2, long)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = adapt.blocks(adapt.table(spark, str(tmp_path), "documents"))
    got = catalogue.QUERIES["x11_text_agreement"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.ord) for r in got} == {(r.doc_id, r.ord) for r in want.collect()}
    assert want.where("length(text) >= 400").count() == 2
