import duckdb
import pytest

from modlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shape(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = [tuple(shape(r[c]) for c in cols) for r in df.collect()]
    if name not in registry.ORACLES:
        assert got is not None
        return
    r = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = [tuple(shape(x[names.index(c)]) for c in cols) for x in r.fetchall()]
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_the_flagship_runs(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
