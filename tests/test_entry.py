import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() == 3


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


from pairlens.plans import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, sql, name):
    got = registry.QUERIES[name](spark, DIR)
    want = sql.sql(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]

    def plain(x):
        return round(float(x), 6) if x.__class__.__name__ in ("Decimal", "float") else x

    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-6 * max(1, abs(u))) for u, v in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0
