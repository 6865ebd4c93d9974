"""Every registered query against its DuckDB SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from markloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_query_has_rows_and_a_schema(spark, sf_dir):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        df = catalog.queries()[name](spark, sf_dir)
        assert df.columns and df.limit(1).collect() is not None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_human_sizes_beyond_a_terabyte(spark, tmp_path):
    """The SQL of human_sizes ends at GB, whatever the size."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    keys = [*range(1, 1200), *range(3000, 60_000, 7), 60_000]
    pq.write_table(pa.table({"s_suppkey": pa.array(keys, pa.int64()), "s_nationkey": pa.array([k % 25 for k in keys], pa.int32())}), tmp_path / "supplier.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    found = sorted(map(tuple, catalog.queries()["human_sizes"](spark, str(tmp_path)).collect()))
    assert found == sorted(c.sql(catalog.oracle_sql()["human_sizes"]).fetchall())
