import math
import os

import duckdb
import pandas as pd
import pytest

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import session

    s = session("local[8]", spark_driver_memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.6g}"
    return str(pd.Timestamp(v)) if type(v).__name__ in ("Timestamp", "datetime", "date") else str(v)


@pytest.fixture(scope="session")
def rows():
    """A frame as sorted rows of text, columns by name."""
    return lambda df: (sorted(df.columns), sorted(tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)))
