import numpy as np
import pytest
from pyspark.sql import functions as F

from skimmer.llm import neighbours

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, every=20, k=20):
    out = {}
    for i, q in zip(ids, vectors):
        if i % every == 0:
            s = {j: float(np.dot(v.astype(float), q.astype(float))) for j, v in zip(ids, vectors) if j != i}
            out[i] = sorted(s.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v], 0) for i, v in zip(ids, vectors)], EMBEDDINGS)


def test_recall_and_scores(spark):
    rng = np.random.RandomState(0)
    centers = rng.randn(10, 64)
    x = centers[rng.randint(10, size=3000)] + 1.2 * rng.randn(3000, 64)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    want = brute(range(3000), x)
    for block in (20_000, 40):
        rows = neighbours.nearest(frame(spark, range(3000), x), p=neighbours.CrossPolytopeParams(block_rows=block)).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
        assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
        for q, found in got.items():
            assert found == sorted(found, key=lambda f: (-f[1], f[0]))
            for v, s in found:
                assert s == pytest.approx(float(x[q].astype(float) @ x[v].astype(float)), abs=1e-12)


def test_norms_differ(spark):
    rng = np.random.RandomState(1)
    x = (rng.randn(1500, 16) * rng.lognormal(0, 0.3, (1500, 1))).astype(np.float32)
    want = brute(range(1500), x)
    got = {}
    for r in neighbours.nearest(frame(spark, range(1500), x)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_few_odd_and_equal_vectors(spark):
    rng = np.random.RandomState(2)
    x = rng.randn(12, 8).astype(np.float32)
    x[5:9] = x[0]
    rows = [(i * 10, [float(a) for a in v], 1) for i, v in enumerate(x)]
    bad = [(200, None, 0), (220, [0.0] * 8, 0), (240, [1.0] * 7 + [float("nan")], 0), (260, [None] + [1.0] * 7, 0), (280, [float("inf")] * 8, 0), (300, [1.0] * 5, 0), (None, [1.0] * 8, 0), (320, [], 0)]
    df = spark.createDataFrame(rows + bad, EMBEDDINGS).withColumn("v", F.lit("clash")).withColumn("bucket", F.lit(0))
    df = df.unionByName(df.where("vec_id = 0"))
    want = brute([i * 10 for i in range(12)], x)
    got = {}
    assert df.where("vec_id = 0").count() == 2
    for r in neighbours.digest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [a for a, _ in v] for q, v in want.items()}


def test_nothing(spark):
    assert neighbours.digest(spark.createDataFrame([], EMBEDDINGS)).count() == 0
    assert neighbours.digest(spark.createDataFrame([(0, [1.0, 2.0], 0)], EMBEDDINGS)).count() == 0


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_recall_on_the_tables(spark, scale):
    df = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    want = brute([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float32))
    got = {}
    for r in neighbours.digest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(want) and np.mean([len(got[q] & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_buckets_follow_from_the_rows():
    p = neighbours.CrossPolytopeParams()
    sizes = [neighbours.geometry(n, p).buckets for n in (10, 8_000, 50_000, 10**6, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == 128 and 10**9 / sizes[-1] <= p.bucket_rows


def test_probes_ascend_and_are_the_nearest():
    x = np.random.RandomState(4).randn(9, 20)
    p = neighbours.CrossPolytopeParams(axes=8, depth=2)
    some, every = neighbours.buckets(x, 1, p, 40), neighbours.buckets(x, 1, p, 256)
    assert (some == every[:, :40]).all() and all(len(set(r)) == 256 for r in every.tolist())
    assert (some[:, :1] == neighbours.buckets(x, 1, p, 1)).all()


def test_hadamard():
    x = np.random.RandomState(5).randn(3, 128)
    h = np.ones((1, 1))
    while len(h) < 128:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(neighbours.hadamard(x), x @ h / np.sqrt(128))


def test_copies_and_one_id_of_two_vectors(spark):
    """A third of all rows are one vector; vec_id 20 has two vectors, so that its scores are the larger ones."""
    x = np.random.RandomState(6).randn(120, 8).astype(np.float32)
    x[40:80] = x[40]
    ids = list(range(120))
    ids[119] = 20
    score, pairs = {}, {}
    for i, v in zip(ids, x):
        for j, w in zip(ids, x):
            if i % 20 == 0 and i != j:
                s = sum(float(a) * float(b) for a, b in zip(v, w))
                pairs.setdefault((i, j), []).append(s)
                score.setdefault(i, {})[j] = max(score.get(i, {}).get(j, -np.inf), s)
    want = {i: sorted(s.items(), key=lambda y: (-y[1], y[0]))[:20] for i, s in score.items()}
    got = {}
    for r in neighbours.digest(frame(spark, ids, x)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert all(any(abs(s - x) < 1e-12 for x in pairs[q, v]) for q in got for v, s in got[q])
