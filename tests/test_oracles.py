"""Every core query with SQL against DuckDB on the smallest tables."""

import numpy as np
import pandas as pd
import pytest

from barsmith.catalogue import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: SQL that takes some seconds even here; `-m "not heavy"` leaves these out.
HEAVY = {"period_5m", "period_1y", "period_mtd", "period_catalogue"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def table(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        x = df[c]
        if x.dtype == object or str(x.dtype).startswith(("datetime", "str")):
            df[c] = x.map(lambda v: "" if v is None or v != v else str(v)[:10] if hasattr(v, "year") else v)
        else:
            df[c] = pd.to_numeric(x).astype(float)
    keys = [c for c in df if df[c].dtype == object or (df[c] % 1 == 0).all()] or list(df)
    return df.sort_values(keys, key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", [pytest.param(n, marks=pytest.mark.heavy) if n in HEAVY else n for n in sorted(ORACLES)])
def test_query(spark, sf, duck, name):
    """Values as the queries round them: equal but for a last digit that falls on either side."""
    got, want = table(QUERIES[name](spark, sf).toPandas()), table(duck.sql(ORACLES[name]).df())
    assert list(got) == list(want) and len(got) == len(want)
    for c in got:
        if got[c].dtype == object:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c
        else:
            np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1.5e-6, atol=1.5e-6, err_msg=c)
