import random

import numpy as np
import pyarrow as pa
import pytest

from skimmer.llm import quality

from .conftest import DOCS, make_docs

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the of and river stone cloud green walk".split()) if i % 4 else rng.choice("$$$ !!! buy now click".split()) for _ in range(rng.randrange(30, 90))) for i in range(200)]
    return texts, [(i, int(i % 4 > 0), 0) for i in range(0, 200, 2)] + [(1, None, None), (None, 1, 0)]


def test_keeps_good_documents(spark):
    texts, labels = corpus()
    docs = make_docs(spark, texts)
    kept = {r["doc_id"] for r in quality.kept(docs, spark.createDataFrame(labels, LABELS)).collect()}
    good = {i for i in range(200) if i % 4}
    # the labels hold even ids only, half of them good
    share = 0.5 + 0.02
    assert abs(len(kept) - share * 200) <= 1 and len(kept & good) >= len(kept) - 2


def test_weights_match_plain_counts(spark):
    texts, labels = corpus()
    p = quality.ResampleParams(buckets=64, prior=2.0)
    rows, _ = quality.weights(make_docs(spark, texts), spark.createDataFrame(labels, LABELS), p)
    f, row, n = quality._features(pa.array(texts), 64)
    raw = np.bincount(f, minlength=64)
    good = np.array([dict((a, b) for a, b, _ in labels).get(i) == 1 for i in range(200)])
    target = np.bincount(f[good[row]], minlength=64)
    q = raw / raw.sum()
    for r in rows.collect():
        mine = f[row == r["doc_id"]]
        want = sum(np.log((target[b] / target.sum() + 2 * q[b]) / 3 / q[b]) for b in mine)
        assert r["__weight"] == pytest.approx(want) and r["__words"] == n[r["doc_id"]]


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 5) for _ in range(3000)] + [1.25] * 500
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 700, 1200, 3500):
        assert quality.kth_largest(df, "x", k, 16, 50) == sorted(values, reverse=True)[k - 1]


def test_the_largest_keys_are_selected(spark):
    texts, labels = corpus()
    docs, marks = make_docs(spark, texts), spark.createDataFrame(labels, LABELS)
    scored, share = quality.weights(docs, marks)
    keys = sorted(((r["__key"], r["doc_id"]) for r in scored.collect()), reverse=True)
    want = {d for _, d in keys[: round(share * len(texts))]}
    assert {r["doc_id"] for r in quality.resampled(docs, marks).collect()} == want == {r["doc_id"] for r in quality.kept(docs, marks).collect()}


def test_unseen_labels(spark):
    """Fitted on half of the table's labels, the weights tell the other half's good documents from the bad ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored, _ = quality.weights(docs, labels.where("doc_id % 2 = 0"))
    rows = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "__weight").collect()
    good, bad = ([r["__weight"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert bad and sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.8 * len(good) * len(bad)


def test_odd_input(spark, odd_texts):
    docs = make_docs(spark, odd_texts, [None if i == 2 else i % 15 for i in range(len(odd_texts))])
    none = spark.createDataFrame([], LABELS)
    assert quality.kept(docs, none).count() == len(odd_texts)
    some = spark.createDataFrame([(3, 1, None), (3, 0, 0), (8, 1, 0), (9, 0, 1)], LABELS)
    assert quality.kept(docs, some).columns == docs.columns and quality.digest(docs, some).count() >= 1
    assert quality.digest(spark.createDataFrame([], DOCS), some).count() == 0
