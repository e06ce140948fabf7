import random

import pytest
from pyspark.sql import functions as F

from skimmer.llm import decontaminate

from .conftest import DOCS, make_docs


def shingles(text, like=None):
    """Windows of 5 words, or of all words of a shorter item ``like``."""
    w, size = (text or "").encode().lower().split(), min(5, len(((text if like is None else like) or "").split()))
    return {b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} if w and size else set()


def test_pairs(spark, odd_texts):
    rng = random.Random(1)
    items = [" ".join(f"q{rng.randrange(500)}" for _ in range(n)) for n in (1, 3, 5, 6, 14, 20, 33, 59, 200)] + ["", None]
    texts = list(odd_texts)
    for t in items[:9]:  # the first three have fewer words than a shingle, or as many
        w = t.split()
        for drop in range(0, len(w), max(1, len(w) // 6)):
            filler = [f"z{rng.randrange(9999)}" for _ in range(800)]
            at = rng.randrange(800)
            texts.append(" ".join(filler[:at] + w[: len(w) - drop] + filler[at:]).upper())
    texts.append(" ".join(items[5].split()[:15]) + " gap " + "\n".join(items[5].split()[8:]))
    docs = make_docs(spark, texts).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(d, i, len(b), len(a & b)) for d, t in enumerate(texts) for i, q in enumerate(items) for a, b in [(shingles(t, q or ""), shingles(q))] if b and len(a & b) >= 0.8 * len(b) - 1e-9}
    for block in (7, 500_000):
        p = decontaminate.ContainmentParams(block_shingles=block)
        assert {tuple(r) for r in decontaminate.contained(docs, bench, p).collect()} == want
        clean = decontaminate.decontaminated(docs, bench, p)
        assert clean.columns == docs.columns
        assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, *_ in want}
    assert len(want) > 10 and {0, 1} <= {i for _, i, _, _ in want}


@pytest.mark.parametrize("side", ["docs", "items"])
def test_empty(spark, side, odd_texts):
    docs = make_docs(spark, odd_texts) if side == "items" else spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([(0, "a b c d e f")] if side == "docs" else [], "item_id long, text string")
    assert decontaminate.digest(docs, bench).count() == 0
    assert decontaminate.decontaminated(docs, bench).count() == (0 if side == "docs" else len(odd_texts))


def test_many_blocks_make_a_small_plan(spark, odd_texts):
    """Each block's pairs are written: no task holds the indexes of several blocks."""
    texts = [f"{t or ''} a{i} b{i} c{i} d{i} e{i} f{i}" for i, t in enumerate(odd_texts)]
    bench = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(12)], "item_id long, text string")
    p = decontaminate.ContainmentParams(block_shingles=2)
    assert sum(1 for _ in decontaminate._blocks(bench, p)) == 12
    for broadcast in (0, 100):
        out = decontaminate.decontaminated(make_docs(spark, texts), bench, decontaminate.ContainmentParams(block_shingles=2, broadcast_rows=broadcast))
        plan = out._jdf.queryExecution().toString()
        assert "MapInArrow" not in plan and out.count() == len(texts) - 12


def test_sql_finds_short_items(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    filler = lambda n: " ".join(f"z{rng.randrange(9999)}" for _ in range(n))
    items = ["alpha", "beta gamma", "one two three", "p q r s", "a b c d e f g", ""]
    texts = [f"{filler(300)} {t.upper()} {filler(200)}" for t in items] + ["two three", "alpha", None, ""]
    docs, bench = make_docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    c = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    want = sorted(c.execute(decontaminate.ORACLE).fetchall())
    assert [r[:2] for r in want] == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (7, 0)]
    assert sorted(tuple(r) for r in decontaminate.digest(docs, bench).collect()) == want
