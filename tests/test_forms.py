from pyspark.sql import functions as F

from skimmer.functions import sizing
from skimmer.operators import bloom, similarity, tables


def test_signatures_inside_the_row(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f h"), (3, None), (4, ""), (5, "x")], "id long, text string")
    for backend in ("fast", "portable"):
        want = similarity.signatures(similarity.with_empty(docs, "id", "text"), 16, backend, 3)
        got = similarity.text_signatures(docs, "id", "text", 16, backend, 3)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_filter_inside_the_row_and_by_bucket(spark, monkeypatch):
    members, asked = spark.range(0, 3000, 2).withColumnRenamed("id", "x"), spark.range(4000).withColumnRenamed("id", "x")
    g = sizing.bloom(1500, 0.02, n_bits=200_000)
    filter_ = bloom.build(members, "x", g)
    here = sorted(map(tuple, bloom.contains(asked, "x", filter_, g).collect()))
    semi = sorted(bloom.semi_join(asked, members, "x").collect())
    monkeypatch.setattr(bloom, "SMALL_BITS", 0)
    assert here == sorted(map(tuple, bloom.contains(asked, "x", filter_, g).collect()))
    assert semi == sorted(bloom.semi_join(asked, members, "x").collect()) == sorted(members.collect())
    assert bloom.contains(asked, "x", filter_.limit(0), g).where("found").count() == 0


def test_misses(spark):
    keys, far = spark.range(100).withColumnRenamed("id", "k"), spark.range(90, 300).withColumnRenamed("id", "k")
    got = tables.chain_misses(keys, far.union(far), "k", 16).first()
    chain = {r["slot"]: r["n"] for r in tables.slots(keys, "k", 16).groupBy("slot").agg(F.count("*").alias("n")).collect()}
    want = sum(chain.get(r["slot"], 0) for r in tables.slots(far.where("k >= 100"), "k", 16).collect())
    assert (got["n_keys"], got["probes"]) == (200, want) and got["mean_probes"] == want / 200
    assert tables.chain_misses(keys, far.limit(0), "k", 16).first()["mean_probes"] == 0
