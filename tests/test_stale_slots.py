"""Slots that a queue and its protocol do not share."""

from siteglass.operators import planning


def test_stale_slots_take_one_shuffle_and_keep_nulls_apart(spark):
    queue = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "n")], "k int, name string")
    protocol = spark.createDataFrame([(1, "a"), (3, "a"), (3, "a"), (None, "n")], "k int, name string")
    got = planning.stale_slots(queue, protocol, ["k", "name"])
    assert sorted(map(tuple, got.collect()), key=str) == [(2, "a", "gone"), (3, "a", "missing"), (None, "n", "gone"), (None, "n", "missing")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert planning.stale_slots(queue.where("k = 1"), protocol.where("k = 1"), ["k", "name"]).isEmpty()
