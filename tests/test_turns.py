"""Passes over sorted rows: the rows of a key stay in one task, whatever join comes before."""

import contextlib

from pyspark.sql import functions as F

from lectern.operators import layout as L


@contextlib.contextmanager
def joins_that_change(spark, most):
    """Joins are planned with a shuffle of both sides and turn out as broadcasts of the side below ``most``."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": most, "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_group_is_shown_as_a_whole_behind_a_join_that_becomes_a_broadcast(spark):
    def first():
        seen = []
        return lambda row: seen.append(row) or len(seen) == 1

    n, each = 500, 20
    with joins_that_change(spark, "60k"):
        docs = spark.range(n, numPartitions=2).select(F.col("id").alias("doc"))
        rows = spark.range(n * each, numPartitions=8).select((F.col("id") % n).alias("doc"), F.expr(f"id div {n}").alias("ord")).join(docs, "doc")
        kept = L.kept_in_turn(rows, ["doc"], ["ord"], ["ord"], first)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = kept.groupBy("doc").agg(F.collect_list("ord").alias("ord")).collect()
    below = plan[plan.index("MapInArrow") : plan.index("SortMergeJoin")]
    assert "Exchange" in below and "REPARTITION_BY_COL" in below  # a deal of its own, whatever becomes of the join's
    assert sorted((r.doc, r.ord) for r in got) == [(i, [0]) for i in range(n)]
