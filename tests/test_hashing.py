import hashlib

import pytest
from pyspark.sql import functions as F

from skimmer.functions.hashing import Hasher, canonical, clumping, exploded_indices, item, leading_zeros
from skimmer.operators import quality


def portable(text, seed=0):
    return int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def names(spark):
    return spark.range(5000).select(F.format_string("user-%07d", "id").alias("v")).persist()


def test_portable_is_an_md5_prefix(spark):
    df = spark.createDataFrame([("hello",), ("héllo",), ("",)], "v string")
    for seed in (0, 7):
        assert [r[0] for r in df.select(Hasher(seed=seed).h(F.col("v"))).collect()] == [portable(x, seed) for x in ("hello", "héllo", "")]


def test_canonical_forms(spark):
    df = spark.sql("SELECT 'abc' AS s, CAST('abc' AS BINARY) AS b, 1 AS i, 1L AS l, true AS t, CAST(NULL AS STRING) AS n")
    out = df.select(*[canonical(c, dict(df.dtypes)[c]).alias(c) for c in df.columns]).first()
    assert out["s"] == out["b"] and out["i"] == out["l"] == "1" and out["n"] == "None"
    pair = df.select(item(df, "s", "i")).first()[0]
    assert pair == "abc\x1f1"


def test_unknown_backend():
    with pytest.raises(ValueError):
        Hasher("sha0")
    with pytest.raises(ValueError):
        Hasher().indices(F.lit("x"), 0, 10)


@pytest.mark.parametrize("backend", ["portable", "fast"])
def test_indices_agree_and_fall_in_range(names, backend):
    h = Hasher(backend, 3)
    flat = {(r["v"], r["row"]): r["idx"] for r in exploded_indices(names.limit(200), F.col("v"), h, 5, 977, "v").collect()}
    for r in names.limit(200).select("v", h.indices(F.col("v"), 5, 977).alias("x")).collect():
        assert [flat[r["v"], i] for i in range(5)] == r["x"] and all(0 <= i < 977 for i in r["x"])


def test_clumping(spark):
    df = spark.createDataFrame([("user_100",), ("",), ("é",)], "v string")
    assert [r[0] for r in df.select(clumping(F.col("v"))).collect()] == [sum(x.encode()) for x in ("user_100", "", "é")]


def test_leading_zeros(spark):
    df = spark.createDataFrame([(0,), (1,), (255,), (-1,)], "v long")
    assert [r[0] for r in df.select(leading_zeros(F.col("v"))).collect()] == [64, 63, 56, 0]
    assert df.where("v >= 0").select(leading_zeros(F.col("v"), 8)).collect()[2][0] == 0
    for width in (0, 65):
        with pytest.raises(ValueError):
            leading_zeros(F.col("v"), width)


@pytest.mark.parametrize("backend, good", [("portable", True), ("fast", True), ("clumping", False)])
def test_uniformity(names, backend, good):
    x = quality.chi_square(names, "v", 64, lambda c, s: Hasher(backend, s).h(c)).first()
    assert quality.is_uniform(x["statistic"], x["dof"]) is good and x["n_values"] == 5000 and x["dof"] == 63


def test_bucket_counts_keep_empty_buckets(names):
    rows = quality.bucket_counts(names.limit(3), "v", 50, lambda c, s: Hasher(seed=s).h(c)).collect()
    assert len(rows) == 50 and sum(r["n"] for r in rows) == 3


def test_no_values_fail(names):
    with pytest.raises(Exception, match="no values"):
        quality.chi_square(names.where("v = ''"), "v", 8, lambda c, s: Hasher().h(c)).collect()


def test_p_value():
    assert quality.p_value(0, 10) == 1.0
    assert quality.p_value(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert quality.p_value(293.2478, 255) == pytest.approx(0.05, abs=1e-3)
    assert quality.p_value(1e5, 255) < 1e-12


def test_avalanche(spark):
    keys = spark.range(300)
    good = quality.avalanche_summary(keys, "id", lambda c, s: Hasher("fast", s).h(c), 64, 16).first()
    bad = quality.avalanche_summary(keys, "id", lambda c, s: Hasher("clumping", s).h(c), 64, 16).first()
    assert abs(good["mean_rate"] - 0.5) < 0.02 and quality.avalanches(good["worst_deviation"], 300)
    assert bad["mean_rate"] < 0.2 and not quality.avalanches(bad["worst_deviation"], 300)
