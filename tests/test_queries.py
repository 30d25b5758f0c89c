"""Every query with an oracle against DuckDB on the smallest tables."""

import math
from collections import Counter
from numbers import Number
from pathlib import Path

import duckdb
import numpy as np
import pytest

from vellum import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
        return None
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    return round(float(x), 6) if isinstance(x, Number) else str(x)


def rows(frame):
    return Counter(tuple(map(value, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_oracle(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
