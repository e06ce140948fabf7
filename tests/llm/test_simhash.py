import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skimmer.llm import simhash

from .conftest import DOCS, make_docs


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return [low.get(root(i)) for i in range(len(fps))]


def test_fingerprints(odd_texts):
    for t in odd_texts:
        if t is None or len(t) < 5000:
            assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).astype(np.int64)


def noisy(rng, n, balls):
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(balls):
        center = rng.getrandbits(64)
        for _ in range(60):
            x = center
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out


@pytest.mark.parametrize("block", [4, 64, 512])
def test_stars_are_exact(block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = sorted(set(noisy(random.Random(block), 300, 12)))
    a, b = simhash.stars(np.array(fps, np.uint64), 2)
    want = brute_components(list(range(len(fps))), fps)
    got = dict(zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist()))
    groups = {}
    for f, w in zip(fps, want):
        groups.setdefault(w, set()).add(got.get(f, f))
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len({got.get(f, f) for f in fps})


@pytest.mark.parametrize("rows", [40, 200, 100_000])
def test_sharded_components(spark, rows):
    fps = noisy(random.Random(5), 200, 10)
    marks = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in set(fps)], "fp long")
    p = simhash.SimHashParams(shard_rows=rows, sample_per_shard=8)
    groups = {r[0]: r[1] for r in simhash.connected_components(simhash.linked(marks, p)).collect()}
    keys = sorted(set(fps))
    want = brute_components(list(range(len(keys))), keys)
    got = {}
    for f, w in zip(keys, want):
        s = int(np.uint64(f).astype(np.int64))
        got.setdefault(w, set()).add(groups.get(s, s))
    assert all(len(x) == 1 for x in got.values()) and len(got) == len(set().union(*got.values()))


def test_components_and_dedup(spark, odd_texts):
    ids = [None if i == 5 else 100 - i for i in range(len(odd_texts))]
    docs = make_docs(spark, odd_texts, ids).withColumn("fp", F.lit("clash")).withColumn("group", F.lit(1))
    docs = docs.unionByName(docs.where("doc_id = 92"))
    fps = [simhash.fingerprint(t) for t in odd_texts]
    want = dict(zip(ids, brute_components(ids, fps)))
    rows = simhash.digest(docs).collect()
    assert len(rows) == len(odd_texts) + 1
    for r in rows:
        assert r["component_id"] == want[r["doc_id"]]
        assert r["fingerprint"] == f"{fps[ids.index(r['doc_id'])]:016x}"
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({x for x in want.values() if x is not None})


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.digest(docs).count() == 0 and simhash.deduplicated(docs).count() == 0
