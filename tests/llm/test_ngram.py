import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skimmer.llm import ngram

from .conftest import DOCS, make_docs


def brute(ids, texts, order=2):
    """The model by plain dictionaries."""
    held = [zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2 for i in ids]
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    grams = [list(zip(*([*["<s>"] * k, *x][: len(x)] for k in range(order - 1, -1, -1)))) for x in tokens]
    one = Counter(w for h, x in zip(held, tokens) if not h for w in x)
    counts = {order: Counter(g for h, x in zip(held, grams) if not h for g in x)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter()
        for g, n in counts[k + 1].items():
            counts[k][g[1:]] += n if g[1] == "<s>" else 1

    def discounts(values):
        n = [sum(c == k for c in values) for k in (1, 2, 3, 4)]
        out = [0, 0.5, 1.0, 1.5]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            for k in (1, 2, 3):
                if n[k - 1] and n[k]:
                    out[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k)
        return out

    d = {k: discounts(c.values()) for k, c in counts.items()}
    total, follow = defaultdict(int), defaultdict(Counter)
    for k in range(2, order + 1):
        for g, n in counts[k].items():
            total[g[:-1]] += n
            follow[g[:-1]][min(n, 3)] += 1
    V, N, T = len(one), sum(one.values()), sum(counts[1].values())
    spare = sum(d[1][min(c, 3)] for c in counts[1].values()) / T if T else 1.0

    def p(*g):
        k, c = len(g), counts[len(g)][g]
        if k == 1:
            return (max(c - d[1][min(c, 3)], 0) / T if T else 0) + spare / (V + 1)
        if not total[g[:-1]]:
            return p(*g[1:])
        return (max(c - d[k][min(c, 3)], 0) + sum(d[k][j] * n for j, n in follow[g[:-1]].items()) * p(*g[1:])) / total[g[:-1]]

    rows = [(h, len(x), sum(one[w] > 0 for w in x), N, sum(math.log10((one[w] + 1) / (N + V + 1)) for w in x), sum(math.log10(p(*g)) for g in b)) for h, x, b in zip(held, tokens, grams)]
    return rows, p, one


def corpus(odd_texts):
    rng = random.Random(8)
    words = [f"v{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    return [*odd_texts[:7], *odd_texts[8:], *(" ".join(words[i : i + 90]) for i in range(0, 4000, 80)), " ".join(["often"] * 900)]


SMALL = {"shard_bytes": 2000, "flush_tokens": 300, "slice_tokens": 100}


@pytest.mark.parametrize("p", [ngram.NgramParams(), ngram.NgramParams(**SMALL), ngram.NgramParams(order=3), ngram.NgramParams(order=3, sample_bytes=4000, **SMALL), ngram.NgramParams(order=4, **SMALL)])
def test_scores(spark, odd_texts, p):
    texts = corpus(odd_texts)
    ids = [None if i == 9 else i for i in range(len(texts))]
    docs = make_docs(spark, texts, ids)
    model = ngram.train(docs.where(~ngram.held_out(p)), p)
    got = {r["doc_id"]: tuple(r)[1:] for r in ngram.scored(docs, model, p).collect()}
    want, _, _ = brute(ids, texts, p.order)
    for i, w in zip(ids, want):
        assert got[i][:4] == w[:4]
        assert got[i][4] == pytest.approx(w[4], rel=1e-12) and got[i][5] == pytest.approx(w[5], rel=1e-9)


@pytest.mark.parametrize("before", [("<s>",), (b"v1",), (b"never",), ("<s>", "<s>"), ("<s>", b"v1"), (b"v1", b"v2")])
def test_probabilities_sum_to_one(odd_texts, before):
    texts = corpus(odd_texts)
    _, p, one = brute(range(len(texts)), texts, len(before) + 1)
    assert sum(p(*before, w) for w in one if one[w]) + p(*before, b"unknown") == pytest.approx(1)


def test_a_hot_word_is_split(spark):
    """A word before half of all others is in many shards, and none holds much more than its share."""
    rng = random.Random(5)
    docs = make_docs(spark, [" ".join(w for _ in range(200) for w in ("the", f"x{rng.randrange(20_000)}")) for _ in range(100)])
    p = ngram.NgramParams(shard_bytes=16_000)
    model = ngram.train(docs, p)
    sizes = [len(np.load(f"{model.folder}/gram2-{s}-key.npy")) for s in np.flatnonzero(model.present["gram2"])]
    assert model.shards >= 16 and max(sizes) < 3 * sum(sizes) / model.shards
    assert len(model.hot[0]) <= 4 * model.shards


def test_a_lost_shard_is_an_error(spark, odd_texts):
    docs = make_docs(spark, corpus(odd_texts))
    p = ngram.NgramParams(**SMALL)
    for table in ("word", "context2", "gram2"):
        model = ngram.train(docs, p)
        s = np.flatnonzero(model.present[table])[0]
        os.remove(f"{model.folder}/{table}-{s}-key.npy")
        with pytest.raises(Exception, match="No such file"):
            ngram.scored(docs, model, p).collect()


def test_order():
    with pytest.raises(ValueError):
        ngram.NgramParams(order=1)


def test_beats_base_on_held_out(spark):
    rng = random.Random(1)
    step = {w: [f"w{rng.randrange(200)}" for _ in range(3)] for w in (f"w{i}" for i in range(200))}
    texts = []
    for _ in range(300):
        w, out = "w0", []
        for _ in range(60):
            w = rng.choice(step[w])
            out.append(w)
        texts.append(" ".join(out))
    rows = [r for r in ngram.digest(make_docs(spark, texts)).collect() if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > 0.5 * sum(r["base_score"] for r in rows)


def test_nothing(spark):
    assert ngram.digest(spark.createDataFrame([], DOCS)).count() == 0
    rows = ngram.digest(make_docs(spark, [None, ""])).collect()
    assert [(r["n_tokens"], r["n_known"]) for r in rows] == [(1, 1)] * 2
