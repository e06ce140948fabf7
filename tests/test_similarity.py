import math
import re

import pytest
from pyspark.sql import functions as F

from skimmer.operators import features, similarity
from skimmer.sources import datagen

TEXTS = ["The quick brown fox jumps", "one two", "", None, "Été à la mer, été à la mer encore", "x " * 40, "a b c d e f g h i j", "A b c d e f g h i z"]


def words(text, k):
    w = re.findall(r"\w+", (text or "").lower())
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) > k else ({" ".join(w)} if w else set())


def chars(text, k):
    t = " ".join((text or "").lower().split())
    return {t[i : i + k] for i in range(len(t) - k + 1)} if len(t) > k else ({t} if t else set())


@pytest.mark.parametrize("kind, plain", [("word", words), ("char", chars)])
@pytest.mark.parametrize("size", [1, 3, 5])
def test_shingles(spark, kind, plain, size):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for r in df.select("i", similarity.shingles(F.col("t"), size, kind).alias("s")).collect():
        assert len(r["s"]) == len(set(r["s"])) and set(r["s"]) == plain(TEXTS[r["i"]], size)


def test_bad_arguments():
    for bad in ((0, "word"), (5, "line")):
        with pytest.raises(ValueError):
            similarity.shingles(F.lit("x"), *bad)
    with pytest.raises(ValueError):
        similarity.signatures(None, 0)


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(similarity.jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 1.0, 0.0]


@pytest.mark.parametrize("backend", ["fast", "portable"])
def test_minhash_error(spark, backend):
    sets = datagen.sets_with_jaccard(spark, [0.2, 0.5, 0.8], 200).withColumn("id", F.struct("target", "side"))
    sigs = {tuple(r["id"]): r["sig"] for r in similarity.signatures(sets.repartition(3), 64, backend).collect()}
    for t in (0.2, 0.5, 0.8):
        estimate = sum(a == b for a, b in zip(sigs[t, "left"], sigs[t, "right"])) / 64
        assert abs(estimate - t) <= 4 * math.sqrt(t * (1 - t) / 64) + 0.01
    again = {tuple(r["id"]): r["sig"] for r in similarity.signatures(sets.union(sets), 64, backend).collect()}
    assert again == sigs


def test_lsh_finds_planted_pairs(spark):
    docs, planted = datagen.text_corpus(spark, 80, 12, vocabulary=300)
    docs = docs.union(spark.createDataFrame([(900, ""), (901, None)], "doc_id long, text string"))
    exact = {(r["a"], r["b"]): r["jaccard"] for r in similarity.exact_pairs(docs, "doc_id", "text").collect()}
    assert {tuple(r) for r in planted.collect()} | {(900, 901)} == set(exact)
    sigs = similarity.signatures(similarity.with_empty(docs, "doc_id", "text"), 64).persist()
    keys = similarity.band_keys(sigs, 16, 4)
    found = similarity.verified_pairs(similarity.candidate_pairs(keys), docs.select(F.col("doc_id").alias("id"), similarity.shingles(F.col("text")).alias("s")))
    assert len({(r["a"], r["b"]) for r in found.collect()} & set(exact)) >= 0.9 * len(exact)
    stats = similarity.lsh_stats(sigs, 16, 4).first()
    assert stats["n_keys"] == 82 and stats["all_pairs"] == 82 * 81 // 2 and stats["work_ratio"] < 0.05
    hits = similarity.query(keys, similarity.band_keys(sigs.where("id = 70"), 16, 4)).where("id <> probe")
    assert {r["id"] for r in hits.collect()} <= {a for a, b in exact if b == 70} | {b for a, b in exact if a == 70}
    with pytest.raises(Exception, match="length"):
        similarity.band_keys(sigs, 5, 5).collect()


def test_representatives(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, "")], "id int, t string")
    assert {r["id"]: r["representative"] for r in similarity.unique_texts(df, "id", "t").collect()} == {3: 1, 1: 1, 2: 2, 4: 2}


def test_features(spark):
    df = spark.createDataFrame([(1, "red", 2.5, True, ["p", "q"]), (2, None, 0.0, False, None)], "id int, color string, size double, flag boolean, tags array<string>")
    rows = sorted(tuple(r) for r in features.tokens(df, "id", ["color", "size", "flag", "tags"]).collect())
    assert rows == [(1, "color=red", 1.0), (1, "flag=True", 1.0), (1, "p", 1.0), (1, "q", 1.0), (1, "size", 2.5), (2, "color=None", 1.0), (2, "flag=False", 1.0), (2, "size", 0.0)]
    hashed = features.transform(features.tokens(df, "id", ["color", "size", "tags"]), "id", 8)
    wide = {r["id"]: r["features"] for r in features.dense(hashed, "id", 8).collect()}
    assert all(len(v) == 8 for v in wide.values())
    plain = features.transform(features.tokens(df, "id", ["color", "size", "tags"]), "id", 8, alternate=False)
    assert plain.where("id = 1").agg(F.sum("weight")).first()[0] == 5.5
    maps = spark.createDataFrame([(1, {"a": 2.0})], "id int, m map<string,double>")
    assert features.map_tokens(maps, "id", "m").first()["token"] == "a"
    with pytest.raises(ValueError):
        features.bucket_of(F.lit("x"), 0)


def test_collisions(spark):
    tokens = spark.range(2000).select(F.format_string("user_id=user-%06d", "id").alias("t"))
    got = features.collision_rate(tokens.union(tokens), "t", 1024).first()
    assert got["n_tokens"] == 2000 and abs(got["collision_rate"] - similarity.sizing.collision_rate(2000, 1024)) < 0.03
    assert features.collision_rate(tokens.limit(0), "t", 8).first()["collision_rate"] == 0
    groups = features.colliding_groups(tokens, "t", 1024).collect()
    assert all(len(r["tokens"]) > 1 and r["tokens"] == sorted(r["tokens"]) for r in groups)


def test_ridge(spark):
    import numpy as np

    rows = datagen.categorical_table(spark, 600, 60, 20).persist()
    x = features.transform(features.tokens(rows, "row_id", ["user_id", "city", "device"]), "row_id", 32).join(rows.select("row_id", "y"), "row_id").persist()
    got = features.ridge_r2(x.where("row_id < 450"), x.where("row_id >= 450"), "y", "row_id", 32)
    a, y = np.zeros((600, 32)), np.zeros(600)
    for r in x.collect():
        a[r["row_id"], r["bucket"]] += r["weight"]
        y[r["row_id"]] = r["y"]
    w = np.linalg.solve(a[:450].T @ a[:450] + np.eye(32), a[:450].T @ y[:450])
    e = y[450:] - a[450:] @ w
    assert got == pytest.approx(1 - (e @ e) / ((y[450:] - y[450:].mean()) ** 2).sum())
