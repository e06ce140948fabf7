import random

import pytest
from pyspark.sql import functions as F

from skimmer.functions.hashing import Hasher
from skimmer.operators import tables


def test_log_against_dict(spark):
    rng, state, log = random.Random(11), {}, []
    for seq in range(3000):
        key, op = f"k{rng.randrange(400)}", rng.choice(["put", "put", "delete"])
        log.append((seq, op, key, seq * 7))
        if op == "put":
            state[key] = seq * 7
        else:
            state.pop(key, None)
    df = spark.createDataFrame(log, "seq int, op string, key string, value int")
    now = tables.latest(df, "key", "value", "seq", "op")
    assert {r["key"]: r["value"] for r in now.collect()} == state
    asked = spark.createDataFrame([("k1",), ("nobody",)], "key string")
    got = {r["key"]: r["value"] for r in tables.lookup(asked, now, "key", "value", -1).collect()}
    assert got == {"k1": state.get("k1", -1), "nobody": -1}
    assert tables.contains(now, asked, "key").count() == ("k1" in state)
    assert tables.delete(now, asked, "key").count() == len(state) - ("k1" in state)


def simulate(homes, capacity):
    cells, probes = [None] * capacity, 0
    for h in homes:
        i = h
        while cells[i] is not None:
            i = (i + 1) % capacity
        cells[i] = h
        probes += (i - h) % capacity + 1
    return probes, [c is not None for c in cells]


@pytest.mark.parametrize("n, capacity", [(30, 100), (90, 100), (100, 100), (1, 1)])
def test_linear_probing_matches_a_simulation(spark, n, capacity):
    keys = spark.range(n).select(F.format_string("key-%d", "id").alias("k"))
    homes = [r["slot"] for r in tables.slots(keys, "k", capacity).collect()]
    probes, occupied = simulate(homes, capacity)
    got = tables.linear_probe_cost(keys, "k", capacity).first()
    assert got["probes"] == probes and got["n_keys"] == n
    assert [r["occupied"] for r in tables.linear_probing(keys, "k", capacity).orderBy("slot").collect()] == occupied


def test_full_table(spark):
    with pytest.raises(RuntimeError):
        tables.linear_probing(spark.range(5), "id", 4)


def test_chains(spark):
    keys = spark.range(60).select(F.format_string("key-%d", "id").alias("k"))
    lengths = [r["length"] for r in tables.bucket_lengths(keys.union(keys), "k", 16).collect()]
    assert len(lengths) == 16 and sum(lengths) == 60
    got = tables.chain_probes(keys, "k", 16).first()
    assert got["probes"] == sum(n * (n + 1) // 2 for n in lengths) and got["load_factor"] == 60 / 16
    assert sum(r["n_slots"] for r in tables.chain_histogram(keys, "k", 16).collect()) == 16


def test_growth(spark):
    df = spark.createDataFrame([(0,), (12,), (13,), (20_000,)], "n long")
    assert [(r["capacity"], r["n_resizes"]) for r in tables.growth(df, "n").orderBy("n").collect()] == [(16, 0), (16, 0), (32, 1), (32_768, 11)]
    for bad in ((0, 0.5), (16, 0), (16, 1.5)):
        with pytest.raises(ValueError):
            tables.growth(df, "n", *bad)


def test_replay_with_tombstones(spark):
    h = Hasher()
    log = spark.createDataFrame([("t", 0, "put", "a"), ("t", 1, "put", "b"), ("t", 2, "delete", "a"), ("t", 3, "put", "b"), ("t", 4, "put", "c")], "t string, seq int, op string, key string")
    rows = tables.replay(log, "t", "seq", "op", "key", 1 << 12, h).collect()
    assert {r["key"] for r in rows if r["state"] == "key"} == {"b", "c"} and len([r for r in rows if r["state"] == "tombstone"]) <= 1
    tight = tables.replay(log.where("seq < 3"), "t", "seq", "op", "key", 2, h).collect()
    assert sorted((r["key"], r["state"]) for r in tight if r["state"] == "key") == [("b", "key")]
    with pytest.raises(Exception, match="full"):
        tables.replay(log.where("op = 'put'"), "t", "seq", "op", "key", 2, h).collect()
