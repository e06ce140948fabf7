import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from skimmer.llm import mixing

from .conftest import DOCS, make_docs


def brute_seats(votes, limits, seats):
    out = [0] * len(votes)
    for _ in range(min(seats, sum(n for n, v in zip(limits, votes) if v > 0))):
        best = max((v / (2 * s + 1), -i) for i, (v, s, n) in enumerate(zip(votes, out, limits)) if s < n and v > 0)
        out[-best[1]] += 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 120))
def test_sainte_lague(pairs, seats):
    votes, limits = [float(a) for a, _ in pairs], [b for _, b in pairs]
    assert mixing.sainte_lague(np.array(votes), np.array(limits), seats).tolist() == brute_seats(votes, limits, seats)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 30)), min_size=1, max_size=5), st.integers(0, 60)), min_size=1, max_size=5))
def test_sainte_lague_by_group(groups):
    votes, limits, group = (np.array(x) for x in zip(*((float(v), n, 3 * g) for g, (pairs, _) in enumerate(groups) for v, n in pairs)))
    want = [x for pairs, seats in groups for x in brute_seats([float(v) for v, _ in pairs], [n for _, n in pairs], seats)]
    assert mixing.sainte_lague(votes, limits, np.array([s for _, s in groups]), group).tolist() == want


def test_a_source_without_words_has_no_window(spark):
    docs = make_docs(spark, [None, "", " "] * 30 + ["a b c"] * 500, None, ["empty"] * 90 + ["full"] * 500)
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 590 and all(r["taken"] == 0 and r["target"] == 0 for r in rows if r["source"] == "empty")
    assert abs(sum(r["taken"] for r in rows) - 2250) <= 32


def test_targets():
    assert mixing.targets([10, 10, 10], [3, 1, 2], 45, 2) == pytest.approx([20, 25 / 3, 50 / 3])
    assert mixing.targets([10, 0, 100], [3, 1, 2], 165, 2) == pytest.approx([20, 0, 145])
    assert mixing.targets([], [], 0, 2) == []


def test_mix(spark, odd_texts):
    texts = odd_texts * 3
    sources = [("b", "a", None, "c")[i % 4] for i in range(len(texts))]
    ids = [None if i == 4 else i for i in range(len(texts))]
    docs = make_docs(spark, texts, ids, sources)
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(texts)
    size = {i: len((t or "").encode().split()) for i, t in zip(ids, texts)}
    names = ["a", "b", "c", None]
    total = {s: sum(size[i] for i, x in zip(ids, sources) if x == s) for s in names}
    goal = dict(zip(names, mixing.targets([total[s] for s in names], [3, 1, 2, 3], 1.5 * sum(total.values()), 2)))
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s in names:
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - goal[s]) <= 64
    again = mixing.digest(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, mixing.digest(docs).collect()), key=str)


def test_many_shards(spark, odd_texts):
    docs = make_docs(spark, odd_texts[8:] * 20)
    rows = mixing.mixed(docs, mixing.MixParams(shard_words=3000, weights=(1.0,))).collect()
    size = sum(r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 1.5 * size) < 0.03 * size
    assert all(r["taken"] <= 2 * r["size"] for r in rows)


def test_nothing(spark):
    assert mixing.digest(spark.createDataFrame([], DOCS)).count() == 0
    rows = mixing.digest(make_docs(spark, [None, ""])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2
