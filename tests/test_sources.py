import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from skimmer import settings
from skimmer.sources import datagen, results
from skimmer.streaming import sketches


@pytest.mark.parametrize("distribution", ["zipf", "uniform"])
def test_stream(spark, distribution):
    df = datagen.stream(spark, 20_000, 500, 7, distribution)
    counts = [r["n"] for r in df.groupBy("item").agg(F.count("*").alias("n")).collect()]
    assert sum(counts) == 20_000 and len(counts) == 500
    assert (max(counts) > 1000) == (distribution == "zipf")
    assert datagen.absent_items(spark, 100).join(df, "item", "left_semi").count() == 0
    again = datagen.stream(spark, 20_000, 500, 7, distribution).repartition(9)
    assert again.exceptAll(df).count() == 0


def test_bad_generators(spark):
    with pytest.raises(ValueError):
        datagen.stream(spark, 5, 10)
    with pytest.raises(ValueError):
        datagen.stream(spark, 10, 5, distribution="cauchy")
    with pytest.raises(ValueError):
        datagen.text_corpus(spark, 5, 6)


def test_unique_and_sets(spark):
    assert datagen.unique_items(spark, 300).distinct().count() == 300
    sets = {}
    for r in datagen.sets_with_jaccard(spark, [0.5], 300).collect():
        sets.setdefault(r["side"], set()).add(r["shingle"])
    a, b = sets["left"], sets["right"]
    assert len(a) == len(b) == 300 and len(a & b) / len(a | b) == 0.5


def test_result_documents(spark, tmp_path):
    @dataclasses.dataclass
    class Point:
        x: float

    payload = {"df": spark.createDataFrame([(1, float("nan"))], "a int, b double"), "nan": float("inf"), "set": {3, 1}, "point": Point(2.0), "tuple": (1, None), "odd": object}
    path = results.save(payload, "one", tmp_path, seed=4)
    first = path.read_bytes()
    got = results.load("one", tmp_path)
    assert got["df"] == [{"a": 1, "b": None}] and got["nan"] is None and got["set"] == [1, 3] and got["point"] == {"x": 2.0} and got["_meta"] == {"name": "one", "seed": 4}
    assert results.save(payload, "one", tmp_path, seed=4).read_bytes() == first
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "a int, b double")
    results.write_json(df, f"{tmp_path}/rows")
    assert results.read_json(spark, f"{tmp_path}/rows").where("b IS NULL").count() == 1
    assert json.loads(results.to_documents(df).orderBy("document").first()[0]) == {"a": 1, "b": None}


def test_settings(tmp_path, monkeypatch):
    assert settings.of("hll", {}) == settings.SECTIONS["hll"]
    env = {"SKIMMER_HLL__PRECISION": "12", "SKIMMER_COUNT_MIN__EPSILON": "0.01", "OTHER": "1"}
    settings.check(env)
    assert settings.of("hll", env).precision == 12 and settings.of("count_min", env).epsilon == 0.01
    for bad in ({"SKIMMER_NOPE__X": "1"}, {"SKIMMER_HLL__NOPE": "1"}, {"SKIMMER_HLL__PRECISION": "99"}, {"SKIMMER_COUNT_MIN__DELTA": "x"}):
        with pytest.raises(ValueError):
            settings.check(bad)
    monkeypatch.setenv("SKIMMER_OUTPUT__FOLDER", str(tmp_path / "out"))
    monkeypatch.setenv("SKIMMER_OUTPUT__SEED", "4")
    assert results.save({"a": 1}, "x").parent == tmp_path / "out"
    assert results.load("x")["_meta"]["seed"] == 4


def test_streams(spark, tmp_path):
    rows = spark.range(400).select(F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, int(id % 48))").alias("ts"), (F.col("id") % 37).alias("u"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = sketches.windowed_distinct(source(), "ts", "u").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n_rows"] for r in spark.table("w").collect()) == [192, 208]
    g = sketches.HllGeometry(10)
    q = source().writeStream.foreachBatch(sketches.registers_sink(f"{tmp_path}/regs", "u", g)).trigger(availableNow=True).start()
    q.awaitTermination()
    merged = sketches.merged_registers(spark, f"{tmp_path}/regs")
    assert sorted(merged.collect()) == sorted(sketches.hll.registers(rows, "u", g).collect())
    q = source().writeStream.foreachBatch(sketches.cells_sink(f"{tmp_path}/cells", "u")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sketches.merged_cells(spark, f"{tmp_path}/cells").where("row = 0").agg(F.sum("cnt")).first()[0] == 400
    q = sketches.unique_events(source(), "ts", ["u"]).writeStream.outputMode("append").format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 37
