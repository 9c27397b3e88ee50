import duckdb
import pytest

from siteglass import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_agrees_with_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLES:
        assert df.columns
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    assert got == rows_of(want.columns, want.fetchall())
