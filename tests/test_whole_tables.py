"""Queries that once read parts of tables, against their SQL on tables large enough for a cut to drop rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from markloom.plans import catalog
from tests.conftest import DATA, rows_of

WHOLE = [
    ("greedy_fuse", DATA),
    ("mask_raster", DATA),
    ("combined_confidence", DATA),
    ("quality_score", DATA),
    ("greedy_decode", "/root/testdata/sf0.01"),
    ("unfinished_jobs_page", DATA),
]


@pytest.mark.parametrize("name, folder", WHOLE, ids=[w[0] for w in WHOLE])
def test_query_reads_whole_tables(name, folder, spark):
    sql = catalog.oracle_sql()[name]
    assert not any(cut in sql for cut in (" % 29", " % 50", " % 4 ", "user_id < ", "l_quantity < ", "LIMIT"))
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in sorted(Path(folder).glob("*.parquet")):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, whole = catalog.queries()[name](spark, folder), c.sql(sql)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(whole.columns, whole.fetchall())
