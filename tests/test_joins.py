"""Joins with a hot key."""

import pytest

from labelscope.operators.joins import hot_hashes, lookup_join

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def hot_third(spark):
    """A third of the rows share one key; every second key is in the lookup."""
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    fact = spark.range(0, 300000, numPartitions=16).selectExpr(
        "id AS row_id", "if(id % 3 = 0, 0, id % 997) AS k", "sha1(string(id)) AS filler"
    )
    yield fact, spark.range(0, 997, 2).selectExpr("id AS k", "id * 10 AS v")
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("how", ["left_semi", "left_anti", "left", "inner"])
def test_hot_key_is_split_and_nothing_changes(hot_third, how):
    fact, lookup = hot_third
    expected = fact.where("k % 2 = 0").count() if how in ("left_semi", "inner") else (
        fact.where("k % 2 = 1").count() if how == "left_anti" else 300000
    )
    plain = lookup_join(fact, lookup, ["k"], how)
    rows = plain.collect()
    assert len(rows) == len({r.row_id for r in rows}) == expected
    assert "(skew=true)" in plain._jdf.queryExecution().executedPlan().toString()

    hot = hot_hashes(fact, ["k"])
    assert hot.count() >= 1
    sliced = lookup_join(fact, lookup, ["k"], how, hot)
    again = sliced.collect()
    assert sorted(again) == sorted(rows)
    if how in ("left", "inner"):
        assert {(r.k, r.v) for r in again if r.v is not None} == {
            (k, 10 * k) for k in {r.k for r in rows} if k % 2 == 0
        }


def test_slices_spread_the_hot_key(hot_third):
    """No reducer gets much more than its share once hot keys are sliced."""
    fact, lookup = hot_third
    joined = lookup_join(fact, lookup, ["k"], "left_semi", hot_hashes(fact, ["k"]))
    fact.sparkSession.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        sizes = joined.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        fact.sparkSession.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    assert max(sizes) < 0.25 * sum(sizes)  # of eight reducers; a third and more without slices
