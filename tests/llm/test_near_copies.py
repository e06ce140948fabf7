import random

import pytest

import corpus_pipeline as pipeline
from skimmer.llm import near_copies, simhash

from .conftest import DOCS, make_docs


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in (a, b)))
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(texts):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    """Groups of copies of 200 words with none to seven words changed, about the threshold, and others."""
    rng = random.Random(8)
    out = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 200))) for _ in range(20)]
    for _ in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        out += [edited(rng, base, rng.randrange(8)) for _ in range(12)]
    rng.shuffle(out)
    return [*out, None, "", " \n", "a b", "A  b"]


@pytest.mark.parametrize("piece", [300, 1_000_000])
def test_components(spark, texts, piece):
    p = near_copies.NearCopyParams(piece_shingles=piece)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.components(make_docs(spark, texts), p).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_stage_drops_what_radius_two_leaves(spark, texts):
    docs = make_docs(spark, texts)
    want = sorted(set(brute(texts)))
    assert simhash.deduplicated(docs).count() > len(want)
    assert sorted(r["doc_id"] for r in pipeline.simhash_stage(spark, docs, "").select("doc_id").collect()) == want


def test_empty(spark):
    assert near_copies.deduplicated(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_finds_what_no_band_has(spark):
    """Of texts of 3,000 words with a word changed, a band of 3,000 values has none and SimHash has those within two bits."""
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(3000)] for _ in range(6)]
    docs = make_docs(spark, [t for b in bases for t in (" ".join(b), edited(rng, b, 1))] + ["x y", None])
    p = near_copies.NearCopyParams(bands=1, rows=3000, first=1)
    assert near_copies.deduplicated(docs, p).count() == 14
    assert 8 <= near_copies.deduplicated(docs, near_copies.NearCopyParams(bands=1, rows=3000, first=1, radius=2)).count() <= 12


def test_stage_links_fingerprints(spark, texts, monkeypatch):
    """The stage's method is SimHash; the bands only add to it."""
    asked, linked = [], simhash.linked
    monkeypatch.setattr(simhash, "linked", lambda rows, p: asked.append(p.radius) or linked(rows, p))
    pipeline.simhash_stage(spark, make_docs(spark, texts), "").collect()
    assert asked == [2]
