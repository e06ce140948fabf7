import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from skimmer.llm import lines

from .conftest import DOCS, make_docs

P = lines.LineParams(ratio=0.5, min_pages=3)


def brute(rows):
    once = {(t or "", s) for t, s in rows}
    pages = Counter(s for _, s in once)
    seen = Counter((s, x) for t, s in once for x in {y.strip(" \t\n\v\f\r") for y in (t or "").split("\n")} if x)
    gone = {k for k, n in seen.items() if n >= 3 and n > pages[k[0]] * 0.5}
    return ["\n".join(x for x in (t or "").split("\n") if (s, x.strip(" \t\n\v\f\r")) not in gone) for t, s in rows]


def test_lines(spark):
    texts = [f"menu\n  body {i}\nfoot\t\n\nfoot" if i % 3 else f"menu\nother {i}\n" for i in range(12)] + ["menu", None, "", "menu\nmenu\nx\nx"]
    sources = [("a", "b", None)[i % 2 if i < 12 else 2] for i in range(len(texts))]
    docs = make_docs(spark, texts, None, sources).withColumn("site", F.lit("clash")).withColumn("h", F.lit(1))
    for few in (0, 50):
        got = lines.line_dedup(docs, lines.LineParams(0.5, 3, few))
        assert got.columns == [*docs.columns, "__dropped"]
        assert [r["text"] or "" for r in got.orderBy("doc_id").collect()] == brute(list(zip(texts, sources)))
    assert got.where("text IS NULL").count() == 1


def test_empty_and_small_sites(spark):
    assert lines.digest(spark.createDataFrame([], DOCS)).count() == 0
    docs = make_docs(spark, ["x"] * 40)
    assert {r["n_dropped"] for r in lines.digest(docs).collect()} == {0}


def test_pipeline_drops_planted_footers(spark):
    # footers on 3 % of a hot source and on 5 of a small one's 60 pages; near copies, 4 % of the hot one, keep their body
    rng = random.Random(2)
    body = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(60))
    texts = [body() + ("\nhot footer of the site" if i % 33 == 0 else "") for i in range(600)]
    texts += [body() + ("\nsmall footer of the site" if i % 12 == 0 else "\nrare line" if i % 15 == 1 else "") for i in range(60)]
    copied = body()
    texts += [f"{copied}\ncopy {i}" for i in range(24)]
    docs = make_docs(spark, texts, None, ["hot"] * 600 + ["small"] * 60 + ["hot"] * 24)
    out = [r["text"] for r in pipeline.line_stage(spark, docs, "").orderBy("doc_id").collect()]
    assert not any("footer" in t for t in out)
    assert sum("rare line" in t for t in out) == sum("rare line" in t for t in texts) > 0
    assert out[-24:] == texts[-24:]
