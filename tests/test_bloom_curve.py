import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skimmer.functions import sizing
from skimmer.functions.hashing import Hasher
from skimmer.operators import bloom, bloom_curve

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("hasher", [Hasher(), Hasher("fast")], ids=lambda h: h.backend)
@pytest.mark.parametrize("part, chunk", [(1 << 23, 1 << 16), (1000, 70)])
def test_as_filters_one_by_one(spark, monkeypatch, hasher, part, chunk):
    monkeypatch.setattr(bloom_curve, "PART", part)
    monkeypatch.setattr(bloom_curve, "CHUNK", chunk)
    members, asked = spark.range(0, 3000, 2).withColumnRenamed("id", "x"), spark.range(1000, 4000).withColumnRenamed("id", "x")
    shapes = [sizing.bloom(1500, 0.05), sizing.bloom(300, 0.01)]
    got = bloom_curve.measured(bloom_curve.keys(members.union(members), asked.union(spark.createDataFrame([(None,)], "x long")), "x", hasher), shapes)
    for g, (bits, lost, rate) in zip(shapes, got):
        filter_ = bloom.build(members, "x", g, hasher)
        assert bits == bloom.stats(filter_, g).first()["bits_set"] and lost == 0
        assert rate == pytest.approx(bloom.false_positive_rate(asked.join(members, "x", "left_anti"), "x", filter_, g, hasher).first()["fp_rate"])
    assert bloom_curve.measured(bloom_curve.keys(members.limit(0), asked.limit(0), "x"), shapes) == [(0, 0, None)] * 2


def test_one_key_of_each_kind(spark):
    keys = spark.createDataFrame([(0, 5, 7), (1, 5, 7), (2, 90, 1)], "kind int, h1 long, h2 long")
    g = sizing.bloom(10, 0.01, n_bits=101)
    assert bloom_curve.measured(keys, [g])[0][1:] == (0, 0.0)


@pytest.mark.parametrize("name", ["bloom_error_curve", "bloom_overfill"])
def test_keys_are_scanned_once(spark, monkeypatch, name):
    """Each step of a curve read and shuffled all keys several times."""
    duckdb = pytest.importorskip("duckdb")
    read, read_one = [], entry.catalogue.table
    monkeypatch.setattr(entry.catalogue, "table", lambda s, d, t: read.append(t) or read_one(s, d, t))
    df = entry.queries()[name](spark, SF)
    assert sorted(read) == ["lineitem", "orders"]
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = c.execute(entry.oracle_sql()[name])
    assert df.columns == [x[0] for x in out.description]
    assert sorted(map(tuple, df.collect())) == [pytest.approx(r) for r in sorted(out.fetchall())]
