"""The SQL of the operators, on the smallest tables."""

import duckdb
import pytest

from lorekeep.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert set(columns) <= set(df.columns)
    rows = found.fetchall()
    assert rows and sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, rows))
