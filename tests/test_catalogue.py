import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NEW = ["hash_avalanche", "chain_miss_cost", "minhash_signatures", "lsh_candidates", "lsh_verified_pairs", "lsh_work_projection", "lsh_default_geometry", "fh_vocabulary_projection", "generator_facts",
       "decision_guide", "project_summary", "bloom_fp_rate", "bloom_semi_join", "bloom_error_curve"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events", "documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NEW)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = sorted((tuple(r[k] for k in sorted(df.columns)) for r in df.collect()), key=str)
    out = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(k)] for k in sorted(names)) for r in out.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == pytest.approx(float(y), abs=1e-6) if isinstance(x, float) else x == y for x, y in zip(a, b))


def test_comparison_seconds(spark):
    rows = entry.queries()["comparison_seconds"](spark, SF).collect()
    assert {r["comparison"] for r in rows} == {"membership", "cardinality", "near duplicates"} and all(r["seconds"] > 0 for r in rows)
