"""Excerpts are cut and scored in one pass; what is ranked is read from what that pass has written."""

import os

from lectern.functions import text as X
from lectern.operators import retrieval as R
from lectern.sources.stage import shared_folder
from pyspark.sql import functions as F


def folders(spark):
    path = shared_folder(spark).removeprefix("file://")
    return {x for x in os.listdir(path) if x.startswith("excerpts-")} if os.path.isdir(path) else set()


def test_fair_topk_reads_keys_that_are_written(spark):
    docs = spark.createDataFrame([(1, "# Totals\nthe total is 4\n# B\ntotal"), (2, "# Other\nnothing"), (3, "# More\ntotal total total")], "doc_id int, markdown string")
    x = R.fair_topk(R.scored(R.excerpts(docs), "What is the total"), 4)
    assert "Generate " not in x._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc_id, r.excerpt_no, r.score) for r in x.orderBy("rank").collect()] == [(1, 2, 1), (2, 1, 0), (3, 1, 3), (1, 1, 1)]


def test_retrieve_scores_once_and_cuts_only_what_it_shows(spark):
    docs = spark.createDataFrame([(i, f"# Page {i}\n" + "total " * i) for i in range(1, 9)], "doc_id int, markdown string")
    for query, want in (("total", [1, 2, 3, 4]), ("an overview", [1, 2, 3, 4])):
        old = folders(spark)
        x = R.retrieve(docs, query, max_chars=120, limit=4)
        assert len(folders(spark) - old) == 1
        assert x._jdf.queryExecution().optimizedPlan().toString().count("Generate ") <= 2  # the texts shown, and the numbers within the budget
        assert [(r.doc_id, r.excerpt_no, r.excerpt.split()[1]) for r in x.orderBy("rank").collect()] == [(i, 1, "Page") for i in want]


def test_long_sections_are_cut_by_code_points(spark):
    text = "".join(chr(0x1F600 + i % 60) if i % 7 == 0 else "abé "[i % 4] for i in range(701))
    docs = spark.createDataFrame([(1, f"a\n\nb\n\n{text}\n\nend")], "doc_id int, markdown string")
    got = [r.excerpt for r in R.excerpts(docs, 100).orderBy("excerpt_no").collect()]
    want = ["a\n\nb", *(text[i : i + 100] for i in range(0, 700, 100)), text[700:] + "\n\nend"]
    assert got == [w.strip() for w in want]


def test_strip_takes_the_white_space_of_all_scripts(spark):
    odd = "\x1c\x1f  　  x  y\x85\n\x1d"
    assert spark.range(1).select(X.strip(F.lit(odd)), X.strip(F.lit("​ a")), X.strip(F.lit(" \n")), X.strip(F.lit(None).cast("string"))).first() == (odd.strip(), "​ a", "", None)


def test_scores_count_words_without_taking_the_others_out(spark):
    odd = "total total_ Total,total \U0001d49ctotal \U0001f600total totals subtotal STRASSE straße 7 77 7.7"
    x = R.scored(spark.createDataFrame([(odd, "Total 7"), ("", None), (None, None)], "excerpt string, heading string"), "7 total strasse")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert X.TERM not in plan and plan.count("lower(") == 2  # a text is folded once
    assert [r.score for r in x.collect()] == [4 + 2 + 3 + 2 * 2, 0, None]
