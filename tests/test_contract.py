import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    import os

    import duckdb
    from verify import rows

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    rel = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.collect(), df.columns, sorted(cols)) == rows(rel.fetchall(), cols, sorted(cols))
