import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skimmer.llm import substrings, textvec

from .conftest import DOCS, make_docs

P = substrings.ChunkParams()


def brute_chunks(text):
    """Chunks by the definition, word by word."""
    words = textvec.word_bytes(text)
    h = textvec.words(pa.array([text]))[0].tolist()
    out, last, rolling = [], 0, []
    for i in range(len(words)):
        rolling = [*rolling, h[i]][-P.bits :]
        value = sum(x << j for j, x in enumerate(reversed(rolling))) % (1 << P.bits)
        if i + 1 - last >= P.most or (value < P.cut and i + 1 - last >= P.least) or i + 1 == len(words):
            out.append((last, tuple(words[last : i + 1])))
            last = i + 1
    return out


def brute(rows):
    """(doc_id, start, words, first doc_id) by the definition; documents are pairs of id and text."""
    first, out = {}, set()
    for d, _, text in sorted({(d, mark(t), t) for d, t in rows if t}, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        run = None
        for start, c in [*brute_chunks(text), (10**9, ())]:
            if c in first or not c:
                if run and c and run[0] + run[1] == start:
                    run = (run[0], run[1] + len(c), run[2])
                else:
                    if run and run[1] >= P.min_words:
                        out.add((d, *run))
                    run = (start, len(c), first.get(c))
            else:
                first[c] = d
    return out


def mark(text):
    """The signed XXH64 that orders texts under one id."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def corpus():
    rng = random.Random(9)
    word = lambda: f"x{rng.randrange(5000)}"
    passages = [" ".join(word() for _ in range(51)) for _ in range(40)]
    texts, holds = [], []
    for i in range(120):
        body = [word() for _ in range(rng.randrange(0, 200))]
        at = rng.randrange(len(body) + 1)
        held = i % 40 if i < 80 else None
        holds.append(held)
        texts.append(" ".join(body[:at]) + (" " + passages[held].upper() if i % 3 and held is not None else "\n" + passages[held] if held is not None else "") + " " + "\t".join(body[at:]))
    return texts, holds


def test_chunks(odd_texts):
    column = pa.array(odd_texts)
    h, at = textvec.words(column)
    starts, ends = substrings.boundaries(h, at, P)
    row = np.searchsorted(at, starts, "right") - 1
    for i, t in enumerate(odd_texts):
        assert [(int(s - at[i]), int(e - s)) for s, e in zip(starts[row == i], ends[row == i])] == [(s, len(c)) for s, c in brute_chunks(t)]


def test_repeats(spark, odd_texts):
    texts, holds = corpus()
    texts += [t for t in odd_texts if t]
    docs = make_docs(spark, texts).withColumn("start", F.lit("clash")).withColumn("digest", F.lit(0))
    got = {tuple(r) for r in substrings.digest(docs).collect()}
    assert got == brute(list(enumerate(texts)))
    caught = {d for d, *_ in got}
    assert {i for i, h in enumerate(holds) if h is not None and i >= 40} <= caught
    assert not caught & {i for i in range(120) if holds[i] is None or i < 40}


def test_cut_out(spark):
    texts, holds = corpus()
    docs = make_docs(spark, [*texts, None, ""])
    out = {r["doc_id"]: r["text"] for r in substrings.deduplicated(docs).collect()}
    assert out[0] == texts[0] and out[120] is None and out[121] == ""
    assert len(out) == 122 and all(len(out[i]) < len(texts[i]) - 100 for i in range(40, 80))


@pytest.mark.parametrize("texts", [[], [None, ""], ["a b"] * 3])
def test_nothing(spark, texts):
    docs = make_docs(spark, texts) if texts else spark.createDataFrame([], DOCS)
    assert substrings.digest(docs).count() == 0


def test_same_id_and_null_id(spark):
    text = " ".join(f"k{i}" for i in range(300))
    docs = make_docs(spark, [text] * 4, [7, 7, None, 9])
    assert sorted(((r["doc_id"], r["first_doc_id"]) for r in substrings.digest(docs).collect()), key=str) == [(9, 7), (None, 7)]


def odd_rows():
    """Repeated ids with other texts, shorter ones among them, null ids, repeated rows."""
    rng = random.Random(21)
    unique = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    shared = unique(60)
    texts = [(1, f"{unique(30)} {shared} {unique(30)}"), (2, f"{unique(60)} {shared} {unique(60)}"), (2, unique(120)), (2, unique(9)), (2, "a b")]
    texts += [(None, f"{shared} {unique(40)}"), (None, unique(150)), (None, f"{unique(11)}"), (None, None), (3, None), (3, "")]
    texts += [(5, f"{unique(80)}\n{shared}"), (5, f"{shared} {unique(20)}")] + [(6, f"{unique(20)} {shared}")]
    return texts + [texts[0], texts[1], texts[5]]


def test_odd_rows_against_brute_force(spark):
    rows = odd_rows()
    docs = make_docs(spark, [t for _, t in rows], [d for d, _ in rows])
    assert {tuple(r) for r in substrings.digest(docs).collect()} == brute(rows)


def test_no_unique_word_is_lost(spark):
    rows = odd_rows()
    docs = make_docs(spark, [t for _, t in rows], [d for d, _ in rows]).withColumn("doc", F.lit("clash"))
    out = substrings.deduplicated(docs).collect()
    assert len(out) == len(rows) and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((d is None, d or 0) for d, _ in rows)
    assert {w for _, t in rows for w in (t or "").split()} == {w for r in out for w in (r["text"] or "").split()}
    whole = {(d, t) for d, t in rows}
    assert sum((r["doc_id"], r["text"]) not in whole for r in out) >= 5
