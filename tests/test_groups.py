"""Requests and links of large groups: results in order, without a group in one row."""

import random

import pytest

from lectern.operators import graph as G
from lectern.operators import usage as U
from lectern.plans import catalogue


@pytest.mark.parametrize("name", ["w13_budget_admission", "g01_accepted_links"])
def test_no_group_is_held_in_one_row(spark, name, tmp_path):
    spark.createDataFrame([(1, 7), (2, 7), (3, None)], "event_id bigint, user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (3, None)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    x = catalogue.QUERIES[name](spark, str(tmp_path))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert x.count() == 3 and "collect_list" not in plan and "FlatMapGroups" not in plan


def test_admission_and_links_of_many_rows_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, 5, 900]) if i % 50 == 0 and i < 9_000 else rng.randint(1, 60), rng.choice([None, 1, 9, 30, 2, 2, 2, 2]) if i > 9_000 else rng.randint(0, 3)) for i in range(15_000)]
    want = []
    for run in ("a", "b", None):
        spent, blocked, own = 0, False, []
        for _, i, worst, actual in (r for r in rows if r[0] == run):
            ok = False if blocked else None if worst is None else spent + worst <= 15_000
            spent += (worst if actual is None else actual) if ok else 0
            blocked = blocked or (bool(ok) and actual is None)
            own.append((run, i, ok))
        want += [(*r, spent) for r in own]
    got = U.admissions(spark.createDataFrame(rows, "run string, seq int, worst int, actual int"), "run", "seq", 15_000).collect()
    assert {(r.run, r.seq, r.admitted, r.spent) for r in got} == set(want) and len(got) == len(want)
    rows = [(rng.choice([1, 1, 2, None]), rng.randint(0, 9), rng.randint(0, 9), i) for i in range(12_000)]
    want, before = [], {}
    for d, s, t, i in rows:
        edges = before.setdefault(d, set())
        seen, new = {t}, {t}
        while new:
            new = {b for a, b in edges if a in new} - seen
            seen |= new
        want.append((d, s, t, i, s not in seen))
        if s not in seen:
            edges.add((s, t))
    got = G.accepted_links(spark.createDataFrame(rows, "doc int, src int, dst int, ord int"), "doc").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
