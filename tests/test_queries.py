"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pytest

from quillspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(plain, v))
    return round(float(v), 7) if isinstance(v, (float, int, np.number)) and not isinstance(v, bool) else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(str([plain(v) for v in r]) for r in df[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, small, duck, name):
    got = registry.QUERIES[name](spark, small).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.sql(registry.ORACLES[name]).df()
    assert rows(got) == rows(want)


def test_entry_names(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
