from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from trialspark.session import build_session

    session = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def canonical(frame) -> list[tuple[str, ...]]:
    """Rows as sorted tuples of text, columns by name; numbers to nine digits."""
    import numpy as np
    import pandas as pd

    def text(v) -> str:
        if isinstance(v, list | tuple | np.ndarray):
            return str([text(x) for x in v])
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool | np.bool_):
            return str(bool(v))
        try:
            return f"{float(v):.9g}"
        except (TypeError, ValueError):
            return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(text, row)) for row in frame.itertuples(index=False))
