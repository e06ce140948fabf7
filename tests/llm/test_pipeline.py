import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from skimmer.llm import common, decontaminate

from .conftest import DOCS, make_docs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output over the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, docs := spark.read.parquet(path))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_duplicates", "benchmark", "mixing"]
    for name, (before, after) in stages.items():
        assert after.count() <= before.count()
        if name != "mixing":
            assert after.columns == before.columns and after.exceptAll(before).count() == 0 or name == "lines"


def test_quality_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    before, after = stages["quality"]
    good = before.join(labels, "doc_id", "left_semi").count()
    assert after.join(labels, "doc_id", "left_semi").count() >= 0.95 * good


def test_one_document_a_group_stays(stages):
    """Against all pairs: groups of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    before, after = stages["near_duplicates"]
    sets = {}
    for r in before.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            shared = len(sets[i] & sets[j])
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {root(i) for i in ids}
    assert len(groups) < len(ids) and sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(groups)


def test_no_benchmark_item_is_left(spark, stages):
    before, after = stages["benchmark"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contained(after, items).count() == 0
    hit = decontaminate.contained(before, items).select("doc_id").distinct().count()
    assert before.count() - after.count() == hit


def test_mix(stages):
    before, after = stages["mixing"]
    rows = after.collect()
    assert {(r["doc_id"], r["text"]) for r in rows} <= {tuple(r) for r in before.select("doc_id", "text").collect()}
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before.select("doc_id").collect()}
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 64


def test_odd_documents(spark, odd_texts):
    docs = make_docs(spark, odd_texts, [None if i == 4 else i for i in range(len(odd_texts))], [None, "a", "b"] * 5 + ["c"] * (len(odd_texts) - 15))
    docs = docs.withColumn("page", F.lit("clash")).withColumn("bucket", F.lit(3))
    docs = docs.unionByName(docs.where("doc_id = 9"))
    for name, stage in pipeline.STAGES:
        for input_ in (docs, docs.limit(0)):
            out = stage(spark, input_, SF)
            out.collect()
            if name != "mixing":
                assert out.columns == docs.columns


def test_run_twice(spark):
    one, two = (sorted(map(tuple, pipeline.run(spark, SF).collect())) for _ in range(2))
    assert one == two and one


def test_run_leaves_only_its_result(spark):
    out = pipeline.run(spark, SF)
    folder = common.shared_dir(spark).removeprefix("file://") + f"/skimmer/{spark.sparkContext.applicationId}"
    mine = {p for p in os.listdir(folder) if p.startswith("pipeline-")}
    assert out.count() and os.path.basename(out._skimmer_path) in mine
    before = set(os.listdir(folder))
    again = pipeline.run(spark, SF)
    assert set(os.listdir(folder)) - before == {os.path.basename(again._skimmer_path)}
