"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from citylattice.plans import catalogue, further  # noqa: F401  (the second adds to the first)

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, (int, float, np.number)) and not isinstance(x, bool):
        return format(float(x) + 0.0, ".6g")
    return str(x)


def shaped(df):
    cols = sorted(df.columns)
    return df[cols].map(plain).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(name, spark, duck):
    got = catalogue.QUERIES[name](spark, D).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want = duck.execute(catalogue.ORACLES[name]).df()
    pd.testing.assert_frame_equal(shaped(got), shaped(want))
