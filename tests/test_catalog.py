"""Every catalog query against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from lexigauge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df: pd.DataFrame):
    def cell(v):
        if hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return v.tolist()
        if v is None or pd.isna(v):
            return None
        return round(float(v), 8) if isinstance(v, (int, float, np.number, np.bool_)) else str(v)

    return sorted(repr([cell(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.SQL[name]).df())
