"""Components where one node has most of the pairs."""

import random

import pytest
from loamgraph.operators import components
from loamgraph.operators.components import connected_components


def brute(links):
    least = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {x: m for x, m in least.items() if any(x in p and p[0] != p[1] for p in links)}


@pytest.mark.parametrize("seed", range(3))
def test_crowded_ends_change_nothing(spark, monkeypatch, seed):
    monkeypatch.setattr(components, "CROWD", 2)
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(99, x) for x in rng.sample(range(100, 140), 20)] + [(0, x) for x in rng.sample(range(200, 240), 20)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == brute(links)


def test_pairs_of_a_crowded_end_are_not_shuffled_to_one_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.range(1, 30_001).selectExpr("id as u", "0L as v").unionAll(spark.range(1, 30_000, 3).selectExpr("id + 1 as u", "id as v"))
        moved = components._large_star(pairs, 40_000)
        plan = moved._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 3  # who is crowded, twice, and where their pairs go
        assert moved.where("v = 0").count() == 30_000 and moved.count() == 30_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
