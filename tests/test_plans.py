"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from axonframe.plans import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def key(rows):
    return sorted(tuple((v is None, 0 if v is None else v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql is not None))
def test_query_is_its_sql(spark, small, sql, name):
    q = REGISTRY[name]
    columns = [c for c, _ in q.columns]
    got = key(tuple(r) for r in q(spark, small).collect())
    want = key(sql.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({q.oracle()})").fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x[0] == y[0] and (x[1] == pytest.approx(y[1], abs=2e-6) if isinstance(x[1], float) else x[1] == y[1]) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql is None and n not in ("forest_decoding", "cluster_silhouette", "permutation_mi", "svm_decoding")))
def test_kernel_runs(spark, small, name):
    q = REGISTRY[name]
    df = q(spark, small)
    rows = df.collect()
    assert df.columns == [c for c, _ in q.columns] and rows
    for k, (_, kind) in enumerate(q.columns):
        values = [r[k] for r in rows if r[k] is not None]
        assert values and (kind != "double" or all(map(math.isfinite, values)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_slices_reach_the_scan(spark, tmp_path):
    from axonframe.sources.files import read_signal, write_signal

    df = spark.range(100).selectExpr("id % 2 AS session", "id % 5 AS freq", "id AS t_idx", "1.0D AS value")
    write_signal(df, str(tmp_path / "s"), ["session"])
    got = read_signal(spark, str(tmp_path / "s"), freqs=[1, 2], times=(10, 20)).filter("session = 1")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session" in plan and "GreaterThanOrEqual(t_idx,10)" in plan
    assert sorted(r.t_idx for r in got.collect()) == [11, 17]
