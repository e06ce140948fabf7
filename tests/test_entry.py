import pytest

import __spark_entry__ as entry


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row["exact"] > 0 and abs(row["relative_error"]) < 0.12


@pytest.mark.parametrize("name", ["bloom_membership", "cms_error_report", "linear_probe_cost", "fh_colliding_groups"])
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    got = sorted(tuple(r[k] for k in sorted(df.columns)) for r in df.collect())
    out = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in out.description]
    want = sorted(tuple(r[names.index(k)] for k in sorted(names)) for r in out.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == pytest.approx(float(y), abs=1e-6) if isinstance(x, float) else x == y for x, y in zip(a, b))
