"""Labels of candidates pass as digests, and candidates are made once."""

from pyspark.sql import functions as F

from lectern.plans import consensus_queries as Q

FOLDER = "/root/testdata/sf0.001"


def test_a_digest_stands_for_a_label_unless_it_is_blank(spark):
    labels = [" ", "", None, "　\t", "x", " x ", "local y", "d41d8cd98f00b204e9800998ecf8427e"]
    x = spark.createDataFrame([(t,) for t in labels], "t string").withColumn("d", Q._digest(F.col("t")))
    rows = x.select("t", "d", Q._md5_of(F.col("d")).alias("got"), F.md5(F.coalesce("t", F.lit(""))).alias("want")).collect()
    assert len(rows) == 8 and all(r.got == r.want for r in rows)
    assert all(r.d == r.t for r in rows[:4]) and all(len(r.d) == 32 and r.d != r.t for r in rows[4:])


def test_no_text_among_the_candidates(spark):
    main, local, joint, _ = Q._evidence(spark, FOLDER)
    for x in (main, local, joint):
        assert x.where("length(trim(label)) > 0 and not label rlike '^[0-9a-f]{32}$'").isEmpty()


def test_candidates_are_made_once(spark):
    plan = Q.j18_consensus(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # as often as consensus names the boxes that it marks; none is left of the candidates
