"""A session and DuckDB views over the smallest driver tables."""

import os
import sys
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text with rounded floats, rows in order."""

    def text(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        # a nullable integer column is of floats on one side and of integers on the other
        return repr(round(float(v), 6)) if isinstance(v, (int, float, np.number, Decimal)) else str(v)

    out = df[sorted(df.columns)].astype(object).map(text)
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out) else out


@pytest.fixture(scope="session")
def same():
    def check(a: pd.DataFrame, b: pd.DataFrame):
        assert sorted(a.columns) == sorted(b.columns)
        x, y = plain(a), plain(b)
        assert len(x) == len(y), (len(x), len(y))
        bad = (x != y).any(axis=1) if len(x) else x
        assert not len(x) or not bad.any(), (x[bad].head(3).to_string(), y[bad].head(3).to_string())

    return check
